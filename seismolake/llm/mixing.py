"""Mixing sources to target weights by a low-discrepancy schedule.

A source's target is cut into blocks of equal size, the last of which carries what is left. The blocks of all
sources lie end to end on a line, so that their numbers are the sources' cumulative weights. Slots visit the
line in van der Corput order: slot i takes the block whose number is i with its bits reversed. So each run of slots,
however short, holds the sources nearly in proportion, and the whole schedule holds each block exactly once. A source's
r-th slot takes its r-th block of its documents, shuffled by a seeded hash and read as one stream of words
that goes round at most `epochs` times. Streams and ranks are numbered in strips whose totals are added up, and a
strip has about as many rows as there are strips, so that a source with a third of all documents is no single task's work.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored, word_count


#: Sources up to this number are sent to all tasks; blocks that one row makes at a time.
FEW, CHUNK = 10_000, 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """sizes (source, source_size) with target: `share` of all sizes, by the weights in turn over the sources by code point, null last.

    A target stops at `epochs` times its source's size; the excess goes to the others by weight, until
    none is above. One row a source comes together here.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # The level at which water stands: of the sources that it doesn't fill, the first one's, which is the highest.
    level = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everywhere)
    return rows.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "target")


def _in_strips(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """rows (keys, strip) with `before`: the sum of value over the rows of the same keys that come before, strips in turn, rows within them in order. Null keys are keys."""
    rows = rows.withColumn("_value", value)
    within = Window.partitionBy(*keys, "strip").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(*keys).orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "strip").agg(F.sum("_value").alias("_all"))
    firsts = sums.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "strip")], F.coalesce(F.sum("_all").over(along), F.lit(0)).alias("_first"))
    inside = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    same = [inside[k].eqNullSafe(firsts[f"_{k}"]) for k in keys] + [inside["strip"] == firsts["_strip"]]
    return inside.join(firsts, same).withColumn("before", (F.col("_first") + F.col("_inside")).cast("long")).drop("_value", "_inside", "_first", *[f"_{k}" for k in (*keys, "strip")])


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, block_words: int = 1024, least_blocks: int = 4096, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, schedule, pieces) of docs (doc_id, text, source).

    documents: one row a row of docs, told apart by (source, strip, number), with body (a hash of id and text), size (words; null
    text: 0), source_size, target and first (words of its source before it in the shuffled stream). schedule: slot, source, rank (the block to
    take) and first, last (words of the source's stream that it holds, the end exclusive). pieces: source, rank, strip, number, round, words: what
    a block takes from a document. A block has block_words words, fewer if the whole mix has not least_blocks of them; the last of a
    source has what is left of its target, so that a tiny source changes no other's. A null source is a source, the last. A
    document without words takes no part, but has its row. Rows that repeat, or have no id, are documents each
    of its own. An empty table gives no rows. Other columns are not read.
    """
    own = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("body"))
    rows = stored(own.withColumn("draw", F.xxhash64("body", F.lit(seed))), "mix-rows")
    strips = isqrt(rows.count()) + 1
    # Strips follow the order of draw, so their sums are where the strips start in the stream.
    rows = rows.withColumn("strip", F.floor((F.col("draw") / 2.0**64 + 0.5) * strips).cast("long"))
    order = ["draw", "doc_id", "body"]
    placed = _in_strips(rows, ["source"], order, F.col("size"))
    placed = placed.withColumn("number", F.row_number().over(Window.partitionBy("source", "strip").orderBy(*order)))
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    aims = stored(aims.withColumn("aim", F.least(F.round("target").cast("long"), epochs * F.col("source_size"))), "mix-targets")
    few = aims.count() <= FEW
    documents = placed.join(F.broadcast(aims) if few else aims, placed.source.eqNullSafe(aims.source)).drop(aims.source)
    documents = stored(documents.select("doc_id", "body", "source", "strip", "number", "size", "source_size", "target", "aim", F.col("before").alias("first")), "mix-documents")

    total = aims.agg(F.sum("aim").alias("all")).first()["all"] or 0
    size = max(1, min(block_words, total // least_blocks))
    schedule = slots(aims, size)
    # Block r of a source is words r * size and on of its stream gone round, up to its target.
    copies = documents.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.withColumn("at", F.col("first") + F.col("round") * F.col("source_size")).withColumn("end", F.least(F.col("at") + F.col("size"), "aim")).where("at < end")
    cut = copies.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("end") - 1) / size))))
    words = F.least("end", (F.col("rank") + 1) * size) - F.greatest(F.col("at"), F.col("rank") * size)
    return documents, schedule, cut.select("source", "rank", "strip", "number", "round", words.alias("words"))


def slots(aims: DataFrame, size: int) -> DataFrame:
    """slot, source, rank, first and last of the schedule of sources (aim: words to take) in blocks of `size` words.

    Slots are in order, with gaps: there are as many slot numbers as the next power of two. Blocks are made in two steps, so that no
    row makes them all; one row a source comes together to lay the sources end to end.
    """
    spark = aims.sparkSession
    before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = F.ceil(F.col("aim") / size).cast("long")
    laid = stored(aims.where("aim > 0").select("source", "aim", blocks.alias("blocks")).withColumn("start", F.coalesce(F.sum("blocks").over(before), F.lit(0))), "mix-laid")
    n = laid.agg(F.sum("blocks").alias("n")).first()["n"] or 0
    bits, strips = max(1, (n - 1).bit_length()), isqrt(n) + 1
    chunks = laid.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / CHUNK))))
    each = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source", "chunk")
    each = each.withColumn("number", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, "blocks") - 1)))
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin(F.col("start") + F.col("number")), bits, "0")), 2, 10).cast("long")
    drawn = stored(each.select("source", "aim", reversed_bits.alias("slot")), "mix-slots").withColumn("strip", F.floor(F.col("slot") * (strips / 2.0**bits)).cast("long"))
    ranked = _in_strips(drawn, ["source"], ["slot"], F.lit(1).cast("long"))
    return ranked.select("slot", "source", F.col("before").alias("rank"), (F.col("before") * size).alias("first"), F.least((F.col("before") + 1) * size, "aim").alias("last"))


def _taken(docs: DataFrame, **settings) -> tuple[DataFrame, DataFrame]:
    """The documents of mix(), and source, strip, number, round, words taken and first slot of each time round in which a document is taken."""
    documents, schedule, pieces = mix(docs, **settings)
    key = F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none")
    got = schedule.select(*key, "rank", "slot").join(pieces.select(*key, "rank", "strip", "number", "round", "words"), ["s", "none", "rank"])
    return documents, got.groupBy("s", "none", "strip", "number", "round").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))


def taken(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, body (a hash of id and text), source, size, source_size, target and taken: the words that the mix takes from each row of docs, repeats counted."""
    documents, got = _taken(docs, **settings)
    got = got.groupBy("s", "none", "strip", "number").agg(F.sum("words").alias("taken"))
    same = (F.coalesce(documents.source, F.lit("")) == got.s) & (documents.source.isNull() == got.none) & (documents.strip == got.strip) & (documents.number == got.number)
    return documents.join(got, same, "left").select("doc_id", "body", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """docs as the mix takes them, in the schedule's order: a row for each time round in which half of a document or more is taken, where its first block stands.

    The rows come dealt out by runs of the schedule and in order within each, so that files written of them follow it. Of each source at most one document
    is taken in part. A row without words goes, for nothing of it can be taken. Rows that share id, text and
    source are taken together, if one of them is. All columns of docs are kept, whatever their names.
    """
    documents, got = _taken(docs, **settings)
    same = (F.coalesce(documents.source, F.lit("")) == got.s) & (documents.source.isNull() == got.none) & (documents.strip == got.strip) & (documents.number == got.number)
    times = documents.join(got.where("words > 0"), same).where(2 * F.col("words") >= F.col("size")).groupBy("doc_id", "body", "s", "none", "round").agg(F.min("slot").alias("slot"))
    times = stored(times, "mix-times")
    own, row = numbered(docs)
    of = {name: F.col(f"_{docs.columns.index(name)}") for name in ("doc_id", "text", "source")}
    keyed = own.select(of["doc_id"].alias("doc_id"), F.xxhash64(of["doc_id"], of["text"]).alias("body"), F.coalesce(of["source"], F.lit("")).alias("s"), of["source"].isNull().alias("none"), row)
    right = times.select(F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("body", "s", "none")], "slot")
    joined = keyed.join(right, keyed.doc_id.eqNullSafe(right._id) & (keyed.body == right._body) & (keyed.s == right._s) & (keyed.none == right._none)).select("slot", "row")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = times.agg(F.max("slot").alias("most")).first()["most"] or 0
    run = F.least(F.floor(F.col("slot") * (parts / (most + 1))), F.lit(parts - 1)).cast("int")
    return joined.repartitionById(parts, run).sortWithinPartitions("slot").select("row.*")
