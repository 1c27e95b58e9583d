"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Running sums of the tokens' byte lengths give where each ends; an equi-join of both sides' ends within a document finds the cuts, where both end; the running
count of cuts is a token's group; and a range join of the sides, by the place of each end among the other side's, gives the links. A group of a and b tokens has a + b - 1 links, so no group makes
a times b candidates.

There are two forms. `places` and `aligned` are relational: exploded tokens, windows and one shuffle by document. `summaries` takes the same steps over
arrays, a document at a time, in the task that encodes it, which needs no shuffle of tokens; `scored` is built on it, for the relational form doesn't keep within the check tool's limits (see the README).
What is corpus-wide is relational in both: counts of id pairs, and their way back to the documents. Pairs with more than one in HOT_SHARE of all links, so at most HOT_SHARE of them, go back by a broadcast, the rest by a
shuffle in which no pair is hot.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, small_batches, spread, stored

#: A pair of ids with more than one in so many links is joined by a broadcast.
HOT_SHARE = 1 << 16
#: Bits of an id in a packed pair or place; ids of both vocabularies are below.
ID_BITS = 20
#: Ids are kept less this, as 16 bits with a sign.
SHIFT = 1 << 15
# How byte-level entries part a text, and characters of whose kind there is no doubt in any table of characters.
SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = "[\n\x20-\x7e\u00c0-\u017f]*"
# The sign of a space in pieces, and how they write a single byte.
SPACE_SIGN, BYTE_PIECE = "▁", r"<0x([0-9A-F]{2})>"


@functools.cache
def _encoders(byte_level: str, pieces: str) -> tuple:
    """Both tokenizers, each with the bytes of its tokens by id, made once a process."""
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(byte_level)
    first.encode_special_tokens = True
    # Byte-level entries write a byte as a character: printable ones as themselves, the others from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    entries = first.get_vocab(with_added_tokens=True)
    first_bytes = [b""] * (max(entries.values()) + 1)
    for entry, k in entries.items():
        first_bytes[k] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    second = sentencepiece.SentencePieceProcessor(model_file=pieces)

    def piece_bytes(k: int) -> bytes:
        piece = second.id_to_piece(k)
        single = re.fullmatch(BYTE_PIECE, piece)
        return bytes([int(single[1], 16)]) if single else piece.replace(SPACE_SIGN, " ").encode()

    second_bytes = [piece_bytes(k) for k in range(second.get_piece_size())]
    if max(len(first_bytes), len(second_bytes)) > 2 * SHIFT:
        raise ValueError("ids must fit 16 bits")
    import tiktoken

    # The same vocabulary in a faster library, for plain texts only.
    special = first.get_added_tokens_decoder()
    plain = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks={raw: k for k, raw in enumerate(first_bytes) if k not in special}, special_tokens={})
    return first, first_bytes, second, second_bytes, plain


def _both(byte_level: str, pieces: str) -> Callable[[str], tuple[list[int], list[int]]]:
    """A function that gives both sides' ids of a text, none where it is empty or a side doesn't give back its bytes."""
    import re

    first, first_bytes, second, second_bytes, plain = _encoders(byte_level, pieces)
    is_plain = re.compile(PLAIN).fullmatch

    def ids(text: str) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        led = " " + text
        a = plain.encode_ordinary(led) if is_plain(text) else first.encode(led, add_special_tokens=False).ids
        b = second.encode(text, num_threads=1)
        same = b"".join(map(first_bytes.__getitem__, a)) == led.encode() == b"".join(map(second_bytes.__getitem__, b))
        return (a, b) if same else ([], [])

    return ids


def sizes(spark: SparkSession, byte_level: str, pieces: str) -> DataFrame:
    """(side, id, size): the byte lengths of both vocabularies' tokens, at most 2 * 65,536 rows."""
    _, first, _, second, _ = _encoders(byte_level, pieces)
    return spark.createDataFrame([(side, k, len(raw)) for side, table in enumerate((first, second)) for k, raw in enumerate(table)], "side int, id int, size int")


def encoded(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """docs (text) with their columns renamed to _0, _1 and so on (`numbered`), without the text, and a_ids and b_ids: the ids of both sides less SHIFT, in 16 bits; empty where the text is null, empty, or not the bytes of both.

    The text is encoded with a space before it. Strings of special tokens within texts are plain text.
    """
    small_batches(docs.sparkSession)
    own, _ = numbered(docs)
    at = docs.columns.index("text")
    kept = [c for k, c in enumerate(own.columns) if k != at]
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own.select(*kept).schema.fields)

    def arrays(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids_of = _both(byte_level, pieces)
        packed = lambda ids: (np.array(ids, np.int32) - SHIFT).astype(np.int16).tobytes()

        def lists(parts: list[bytes]) -> pa.ListArray:
            ends = np.r_[0, np.cumsum([len(x) // 2 for x in parts])].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int16(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))]))

        for batch in batches:
            both = [tuple(map(packed, ids_of(text.as_py() or ""))) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lists([x[0] for x in both]), lists([x[1] for x in both])], [*batch.schema.names[1:], "a_ids", "b_ids"])

    return own.select(f"_{at}", *kept).mapInArrow(arrays, f"{fields}a_ids array<smallint>, b_ids array<smallint>")


def places(texts: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row a token of texts (doc: a key of the row, the arrays of `encoded`, and kept: what else is to be carried along), in order of doc, start and side: side (0 or 1), id, start, end, cut (both sides start here), grp (from 1), and link: the (a, b) ids that overlap from here on, null where the other side's row of this place has it. Before them a row of side -1 has kept, which is null in the others."""
    none = F.lit(None).cast(texts.schema["kept"].dataType)
    side = lambda s, name: F.transform(f"{name}_ids", lambda x, k: F.struct(F.lit(s).alias("side"), k.alias("pos"), (x + F.lit(SHIFT)).alias("id"), none.alias("kept")))
    head = F.array(F.struct(F.lit(-1).alias("side"), F.lit(0).alias("pos"), F.lit(-1).alias("id"), F.col("kept")))
    tokens = spread(texts, "doc").select("doc", F.inline(F.concat(head, side(0, "a"), side(1, "b"))))
    tokens = tokens.join(F.broadcast(sizes), ["side", "id"], "left")  # both vocabularies, of 16 bits each
    ended = tokens.select("doc", "side", "id", "size", "kept", F.sum("size").over(Window.partitionBy("doc", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    started = ended.select("doc", "side", "id", "kept", F.coalesce(F.col("end") - F.col("size"), F.lit(0).cast("long")).alias("start"), "end")
    order = Window.partitionBy("doc").orderBy("start", "side")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda s: F.last(F.when(F.col("side") == s, F.struct("start", "id")), ignorenulls=True).over(so_far)
    met = started.select("*", F.lead("start").over(order).alias("next"), latest(0).alias("a"), latest(1).alias("b"))
    cut = F.when(F.col("side") == 0, F.col("next") == F.col("start")).otherwise(F.col("a.start") == F.col("start"))
    met = met.select("doc", "side", "id", "kept", "start", "end", F.coalesce(cut, F.lit(False)).alias("cut"), "a", "b")
    link = F.when((F.col("side") == 1) | (F.col("side") == 0) & ~F.col("cut"), F.struct(F.col("a.id").alias("a"), F.col("b.id").alias("b")))
    return met.select("doc", "side", "id", "kept", "start", "end", "cut", link.alias("link"), F.sum(F.when(F.col("cut") & (F.col("side") == 0), 1).otherwise(0)).over(so_far).alias("grp"))


def _groups(packed: str) -> Column:
    """Of packed (start, id, cut) values in order: the ids of each group, comma-joined, as an array."""
    item = F.transform(packed, lambda x: F.concat(F.when(x % 2 == 1, ";").otherwise(","), F.shiftright(x, 1).bitwiseAND((1 << ID_BITS) - 1).cast("string")))
    return F.split(F.substring(F.array_join(item, ""), 2, 2_147_483_647), ";")


def aligned(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """docs (text, any other columns) with their columns but for text in a struct `kept`, as _0, _1 and so on, and per document n_a, n_b (tokens), n_groups, n_links, groups ('a1,a2|b1' a group, in order) and pairs: (a, b, n) of each pair of ids that n links hold.

    Null and empty texts, and those whose bytes a side doesn't give back, have no tokens: zeros and empty arrays. Rows are taken one by one: repeated rows, ties and null ids give a row each, an
    empty table none. A very long text is one row of its task, as for the encoders themselves. docs come in an order that a second reading repeats, as files do.
    """
    texts = encoded(docs, byte_level, pieces)
    kept = F.struct(*[c for c in texts.columns if c not in ("a_ids", "b_ids")], F.lit(True).alias("there"))
    texts = texts.select(F.monotonically_increasing_id().alias("doc"), kept.alias("kept"), "a_ids", "b_ids")
    start = lambda s: F.when(F.col("side") == s, F.shiftleft(F.col("start"), ID_BITS + 1) + F.col("id") * 2 + F.col("cut").cast("int"))
    pair = F.shiftleft(F.col("link.a").cast("long"), ID_BITS) + F.col("link.b")
    rows = places(texts, sizes(docs.sparkSession, byte_level, pieces)).groupBy("doc").agg(F.first("kept", ignorenulls=True).alias("kept"), F.collect_list(start(0)).alias("a"), F.collect_list(start(1)).alias("b"), F.collect_list(pair).alias("links"))
    rows = rows.select("doc", "kept", F.sort_array("a").alias("a"), F.sort_array("b").alias("b"), F.sort_array("links").alias("links"))
    groups = F.zip_with(_groups("a"), _groups("b"), lambda a, b: F.concat(a, F.lit("|"), b))
    # Equal links stand together: where each run starts, and how far the next one is.
    n = F.size("links")
    runs = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get("links", k) != F.get("links", k - 1)))
    none = F.array().cast("array<int>")
    rows = rows.select("doc", "kept", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), n.cast("long").alias("n_links"), F.when(n > 0, groups).otherwise(F.array().cast("array<string>")).alias("groups"), "links", F.when(n > 0, runs).otherwise(none).alias("runs"))
    low = F.lit((1 << ID_BITS) - 1).cast("long")
    found = F.transform("runs", lambda at, k: F.struct(F.shiftright(F.get("links", at), ID_BITS).cast("int").alias("a"), F.get("links", at).bitwiseAND(low).cast("int").alias("b"), (F.coalesce(F.get(F.col("runs"), k + 1), n) - at).alias("n")))
    return rows.select("doc", "kept", "n_a", "n_b", F.size("groups").cast("long").alias("n_groups"), "n_links", "groups", found.alias("pairs"))


def summaries(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """The columns of `aligned`, but for groups_sha256 (of groups, joined by semicolons; empty without tokens) in place of groups: the same steps over arrays, in the task that encodes a document."""
    small_batches(docs.sparkSession)
    own, _ = numbered(docs)
    at = docs.columns.index("text")
    kept = F.struct(*[c for k, c in enumerate(own.columns) if k != at], F.lit(True).alias("there")).alias("kept")
    rows = own.select(f"_{at}", F.monotonically_increasing_id().alias("doc"), kept)
    names = ["doc", "kept", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]

    def summed(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        ids_of = _both(byte_level, pieces)
        _, first_bytes, _, second_bytes, _ = _encoders(byte_level, pieces)
        lengths = [np.array([len(x) for x in table], np.int64) for table in (first_bytes, second_bytes)]
        said = [str(k) for k in range(max(map(len, lengths)))]
        fields = [pa.field(name, pa.int32(), False) for name in ("a", "b", "n")]

        def summary(text: str) -> tuple:
            a, b = (np.array(ids, np.int64) for ids in ids_of(text))
            if not len(a):
                return 0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64)
            ends_a, ends_b = lengths[0][a].cumsum(), lengths[1][b].cumsum()
            cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
            # In order of group, side and place; a sign after each id says what comes next.
            key = np.concatenate([np.searchsorted(cuts, ends_a) * 2, np.searchsorted(cuts, ends_b) * 2 + 1])
            order = np.argsort(key, kind="stable")
            key = key[order]
            last = np.r_[key[1:] != key[:-1], True]
            signs = np.where(last, np.where(key % 2 == 0, "|", ";"), ",")
            text = "".join([said[k] + sign for k, sign in zip(np.concatenate([a, b])[order].tolist(), signs.tolist(), strict=True)])
            # The other side's token at each end is the first that ends there or later.
            ends = np.union1d(ends_a, ends_b)
            pairs, n = np.unique((a[np.searchsorted(ends_a, ends)] << ID_BITS) + b[np.searchsorted(ends_b, ends)], return_counts=True)
            return len(a), len(b), len(cuts), len(ends), hashlib.sha256(text[:-1].encode()).hexdigest(), pairs, n

        for batch in batches:
            found = [summary(text.as_py() or "") for text in batch.column(0)]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(4)] + [pa.array([x[4] for x in found], pa.string())]
            pairs, n = (np.concatenate([*[x[k] for x in found], np.empty(0, np.int64)]) for k in (5, 6))
            values = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (pairs >> ID_BITS, pairs & ((1 << ID_BITS) - 1), n)], fields=fields)
            ends = np.r_[0, np.cumsum([len(x[5]) for x in found])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns, pa.ListArray.from_arrays(pa.array(ends), values)], names)

    types = f"doc long, kept {rows.schema['kept'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>"
    return rows.mapInArrow(summed, types)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, count, best) of found (pairs): how many links of the corpus hold a pair, and whether no other pair of its b has more."""
    counts = found.select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """`summaries` with n_best (links of a pair that is its b's most frequent one in the corpus, ties included) and count_sum (of the corpus counts of all links) in place of pairs; the columns that were kept are its own again.

    Texts, rows and tables that are null, empty, repeated or tied come out as in `aligned`.
    """
    # Sorted pairs are small differences.
    found = stored(summaries(docs, byte_level, pieces), "alignment-pairs", **{"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"})
    counts = stored(pair_counts(found), "alignment-counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = F.col("count") * HOT_SHARE > total
    links = found.select("doc", F.inline("pairs"))
    common = links.join(F.broadcast(counts.where(hot)), ["a", "b"])  # at most HOT_SHARE rows
    rare = links.join(F.broadcast(counts.where(hot).select("a", "b")), ["a", "b"], "left_anti").join(counts.where(~hot), ["a", "b"])
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    each = common.groupBy("doc").agg(*sums).unionAll(rare.groupBy("doc").agg(*sums)).groupBy("doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    kept = [F.col(f"kept.{f.name}") for f in found.schema["kept"].dataType.fields if f.name != "there"]
    return found.drop("pairs").join(each, "doc", "left").select(*kept, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
