"""Spelling variants: pairs of words that one edit parts, found by merging the subtrees of a trie.

In a trie of the words each inner node calls the child with most words below it heavy and the others, the end of a word
among them, light. A light subtree is merged into the heavy path beside it with one character replaced by the heavy one, skipped, or the heavy one put in
before it; terminals that coincide are words one edit apart. A word lies in light subtrees at most log2(words) times, since each of them holds at most half of its node's words (small to
large), so a word makes at most three times so many altered copies, whatever its length.

The tries' nodes are hashes of prefixes, made in one pass over each word: a clash of hashes could only call another child heavy, which changes the work and not the pairs.
Coinciding terminals are joins on the altered words themselves. A pair is found once: a replacement at its one place, a
missing character at the last of equal ones in a row, where the two words part.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# What a run of letters is, and the rule by which a query's runs lose a character.
LETTERS, EVERY = "[A-Za-zÀ-ÿ]+", 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A node that more than one in so many words pass is joined by a broadcast.
HOT_SHARE = 1024
#: Words longer than this meet by their digest, which no shorter word equals.
LONGEST = 63


def damaged_runs(docs: DataFrame) -> DataFrame:
    """`word` of each run of letters of docs (doc_id, text), with A-Z lower-cased; runs whose checksum with the document's id (null: nothing) 31 divides lose one character."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({LETTERS})"), F.lit(1))).alias("run")).where(F.length("run") >= LEAST_LENGTH)
    runs = runs.select(F.translate("run", UPPER, LOWER).alias("run"), F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.translate("run", UPPER, LOWER)).cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the different words that are long and frequent enough; null ones are none."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _key(word: Column) -> Column:
    return F.when(F.length(word) > LONGEST, F.sha2(word.cast("binary"), 256)).otherwise(word)


def _prefixes(batches: Iterator) -> Iterator:
    """(wid, at, node, c) of each place of each word: node is a hash of what stands before, c the character there, '' at the end."""
    import numpy as np
    import pyarrow as pa

    mod, base, most = (1 << 61) - 1, 0x1F3D5B79A2C4E68B % ((1 << 61) - 1), 1 << 16
    for batch in batches:
        wid, at, node, char = [], [], [], []
        for w, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = 1
            for k, c in enumerate([*word, ""]):
                wid.append(w)
                at.append(k)
                node.append(h)
                char.append(c)
                h = (h * base + ord(c) + 1) % mod if c else h
                if len(wid) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(wid, pa.int64()), pa.array(np.array(at, np.int32)), pa.array(node, pa.int64()), pa.array(char, pa.string())], ["wid", "at", "node", "c"])
                    wid, at, node, char = [], [], [], []
        if wid:
            yield pa.RecordBatch.from_arrays([pa.array(wid, pa.int64()), pa.array(np.array(at, np.int32)), pa.array(node, pa.int64()), pa.array(char, pa.string())], ["wid", "at", "node", "c"])


def light_edges(words: DataFrame) -> DataFrame:
    """(wid, at, heavy, c) of the light edges on the way of each word (wid, word): its own character, '' at its end, and the heavy one of the node."""
    rows = stored(words.select("wid", "word").mapInArrow(_prefixes, "wid long, at int, node long, c string"), "spelling-prefixes")
    children = rows.groupBy("node", "c").agg(F.count("*").alias("n"))
    size = F.when(F.col("c") != "", F.struct(F.col("n"), F.col("c")))
    nodes = children.groupBy("node").agg(F.max(size)["c"].alias("heavy"), F.sum("n").alias("below"), F.count("*").alias("children")).where("children > 1").drop("children")
    nodes = stored(nodes, "spelling-nodes")
    total = words.count()
    # Nodes of one depth share the words out, so at most HOT_SHARE of each depth are hot.
    hot = F.col("below") * HOT_SHARE > total
    common = rows.join(F.broadcast(nodes.where(hot).drop("below")), "node")
    rare = rows.join(F.broadcast(nodes.where(hot).select("node")), "node", "left_anti").join(nodes.where(~hot).drop("below"), "node")
    return common.unionByName(rare).where("c <> heavy").select("wid", "at", "heavy", "c")


def merged(words: DataFrame) -> DataFrame:
    """(word, n, op, at, key, other, other_n) of the altered copies of words (wid, word, n): op is r (replaced), d (skipped) or i (the heavy character put in); other: the word that a copy equals, or null."""
    edges = light_edges(words).groupBy("wid").agg(F.collect_list(F.struct("at", "heavy", "c")).alias("edges"))
    each = words.join(edges, "wid").select("word", "n", F.inline("edges"))
    before, after = F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.length("word"))
    copies = F.array(
        F.when(F.col("c") != "", F.struct(F.lit("r").alias("op"), F.concat(before, "heavy", after).alias("copy"))),
        F.when((F.col("c") != "") & ~F.startswith(after, F.col("c")), F.struct(F.lit("d").alias("op"), F.concat(before, after).alias("copy"))),
        F.struct(F.lit("i").alias("op"), F.concat(before, "heavy", "c", after).alias("copy")),
    )
    each = each.select("word", "n", "at", F.inline(F.filter(copies, lambda x: x.isNotNull()))).select("word", "n", "op", "at", _key(F.col("copy")).alias("key"))
    known = words.select(_key(F.col("word")).alias("key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return each.join(known, "key", "left").where("op = 'r' or other is not null")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) of the words (wid, word, n) that have any other within one edit: how many, and the one of largest n, of these the smallest.

    Replacements that coincide are one group of a place and a copy, at most one word a letter of the alphabet; its words are counted, and each told of the group's most frequent other one, without pairs.
    """
    found = stored(merged(words), "spelling-copies")
    as_rank = lambda n, word: F.struct((-F.col(n)).alias("order"), F.col(word).alias("word"))
    lookups = found.where("op <> 'r'")
    apart = lookups.select("word", F.lit(1).alias("near"), as_rank("other_n", "other").alias("best")).unionByName(lookups.select(F.col("other").alias("word"), F.lit(1).alias("near"), as_rank("n", "word").alias("best")))
    groups = found.where("op = 'r'").groupBy("at", "key").agg(F.collect_list(as_rank("n", "word")).alias("light"), F.first(F.when(F.col("other").isNotNull(), as_rank("other_n", "other")), ignorenulls=True).alias("own"))
    groups = groups.select(F.array_sort(F.filter(F.concat("light", F.array("own")), lambda x: x.isNotNull())).alias("all")).where(F.size("all") > 1)
    beside = F.transform("all", lambda x, k: F.struct(x["word"].alias("word"), (F.size("all") - 1).alias("near"), F.get(F.col("all"), F.when(k == 0, 1).otherwise(0)).alias("best")))
    every = apart.unionByName(groups.select(F.inline(beside)))
    return every.groupBy("word").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.order")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): forms are followed to the last, twice as far each round. Each is ten times as frequent as the word before, so there are few."""
    done = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = done.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        far = stored(done.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if far.where("moved").isEmpty():
            return far.select("word", "root")
        done = far.select("word", "root")


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """words (word, n: different words and how often each occurs) with form, root, n_near and form_n.

    n_near: how many others differ by exactly one inserted, deleted or replaced character. form: the one of these of largest n, of equal ones the smallest in code-point order, if its n is at least
    factor times the word's, else null; form_n: its n. root: the last when forms are followed, the word itself if it has none. Null words are left out; an empty table gives an
    empty one; a very long word costs what it has of characters, and its altered copies.
    """
    known = stored(words.where("word is not null").select("word", "n").withColumn("wid", F.monotonically_increasing_id()), "spelling-words")
    near = known.select("word", "n").join(neighbours(known), "word", "left")
    strong = F.col("near_n") >= factor * F.col("n")
    near = stored(near.select("word", "n", F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")), "spelling-near")
    roots = _roots(near.where("form is not null").select("word", "form"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
