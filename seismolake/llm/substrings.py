"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of all `seed`-word grams of a window of `length` words the smallest hash.
The same window has the same anchor in every document, so documents that share a window meet on it.
A run is a longest stretch of windows of one document with the same anchor. Extension goes both ways
from the anchor over the run: documents whose whole runs are equal share all its windows at once;
where runs of one anchor differ, one document of each different run is read again and the run's
windows are compared one by one, so that a match ends exactly where the texts part. Windows found
in a document with a smaller id are removed; overlapping ones merge into maximal repeats. No pair of
documents is formed, so a passage in a third of all documents costs no more than its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

LENGTH, SEED = 50, 12


class Windows:
    """Hashes of words, anchors and windows of one text; one a worker, for its cache of words."""

    def __init__(self, length: int, seed: int):
        self.length, self.seed, self.words, self.powers = length, seed, {}, None

    def _word(self, word: bytes) -> int:
        import xxhash

        if len(self.words) > 500_000:
            self.words.clear()
        got = self.words[word] = xxhash.xxh64_intdigest(word, 7)
        return got

    def hashes(self, text: str | None):
        import numpy as np

        words = (text or "").encode("utf-8", "surrogatepass").split()
        known = self.words
        return words, np.fromiter((known[w] if w in known else self._word(w) for w in words), np.uint64, len(words))

    def sums(self, hashes):
        """s such that the polynomial hash of words i to j - 1 follows from s[i] and s[j]."""
        import numpy as np

        n = len(hashes) + 1
        if self.powers is None or len(self.powers[0]) < n:
            with np.errstate(over="ignore"):
                base = np.uint64(0x9E3779B97F4A7C15)
                self.powers = tuple(np.r_[np.uint64(1), np.cumprod(np.full(max(n, 4096), b))] for b in (base, np.uint64(pow(int(base), -1, 1 << 64))))
        return np.r_[np.uint64(0), np.cumsum(hashes * self.powers[0][: len(hashes)])]

    def span(self, sums, start, n):
        """A hash of the n words from start, the same wherever they stand."""
        import numpy as np

        got = (sums[start + n] - sums[start]) * self.powers[1][start] + np.uint64(0x9E3779B97F4A7C15) * np.asarray(n, np.uint64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            got = (got ^ (got >> np.uint64(shift))) * np.uint64(by)
        return got ^ (got >> np.uint64(31))

    def runs(self, hashes):
        """(anchor, hash of all words of the run, first window, last window) of each run."""
        import numpy as np

        if len(hashes) < self.length:
            return None
        sums = self.sums(hashes)
        low = self.span(sums, np.arange(len(hashes) - self.seed + 1), self.seed)
        wanted, reach = self.length - self.seed + 1, 1
        while 2 * reach <= wanted:
            low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
        if reach < wanted:
            low = np.minimum(low[: len(low) - (wanted - reach)], low[wanted - reach :])
        cuts = np.flatnonzero(low[1:] != low[:-1])
        first, last = np.r_[0, cuts + 1], np.r_[cuts, len(low) - 1]
        return low[first], self.span(sums, first, last - first + self.length), first, last


def _runs(docs: DataFrame, length: int, seed: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .substrings import Windows

        state = Windows(length, seed)
        for batch in batches:
            got = [(doc_id, body, *runs) for doc_id, body, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True) if (runs := state.runs(state.hashes(text.as_py())[1])) is not None]
            if not got:
                continue
            counts = [len(x[2]) for x in got]
            columns = [pa.array(np.repeat([x[k] for x in got], counts)) for k in (0, 1)]
            columns += [pa.array(np.concatenate([x[k] for x in got]).view(np.int64)) for k in (2, 3)] + [pa.array(np.concatenate([x[k] for x in got]).astype(np.int32)) for k in (4, 5)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "anchor", "run", "first", "last"])

    return docs.mapInArrow(mapped, f"doc_id {kind}, body long, anchor long, run long, first int, last int")


def _windows(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """A row a window of the runs (at: array of anchor, first, last) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mapped(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .substrings import Windows

        state = Windows(length, seed)
        for batch in batches:
            for doc_id, body, text, runs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                sums = state.sums(state.hashes(text)[1])
                starts = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in runs])
                anchors = np.repeat(np.array([r["anchor"] for r in runs], np.int64), [r["last"] - r["first"] + 1 for r in runs])
                hashes = state.span(sums, starts, length).view(np.int64)
                for a in range(0, len(starts), 50_000):
                    some = slice(a, a + 50_000)
                    n = len(starts[some])
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, batch.schema.field(0).type), pa.array(np.full(n, body)), pa.array(anchors[some]), pa.array(hashes[some]), pa.array(starts[some].astype(np.int32))], ["doc_id", "body", "anchor", "window", "first"])

    return docs.mapInArrow(mapped, f"doc_id {kind}, body long, anchor long, window long, first int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, body (a hash of the text) and spans (array of first and last window) to remove: windows whose words also start in a document with a smaller doc_id."""
    read = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("body"), "text")
    runs = stored(_runs(read, length, seed), "substring-runs")
    anchors = runs.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), (F.min("run") != F.max("run")).alias("mixed"))
    shared = stored(anchors.where("low < high").select("anchor", "low", "mixed"), "substring-anchors")
    met = stored(runs.join(shared, "anchor"), "substring-met")
    # Equal runs of a smaller document: the whole run goes.
    variants = stored(met.where("mixed").groupBy("anchor", "run").agg(F.min("doc_id").alias("first_doc")), "substring-variants")
    whole = met.where("not mixed and doc_id > low").select("doc_id", "body", "first", "last")
    mixed = stored(met.where("mixed").join(variants, ["anchor", "run"]), "substring-mixed")
    whole = whole.union(mixed.where("doc_id > first_doc").select("doc_id", "body", "first", "last"))
    # The first document of each different run of an anchor: window by window.
    leads = mixed.where("doc_id = first_doc").groupBy("doc_id", "body").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("at"))
    windows = stored(_windows(read.join(leads, ["doc_id", "body"]).select("doc_id", "body", "text", "at"), length, seed), "substring-windows")
    lowest = stored(windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first_doc")).join(shared.where("mixed").select("anchor"), "anchor", "left_semi"), "substring-lowest")
    parts = windows.join(lowest, ["anchor", "window"]).where("doc_id > first_doc").select("doc_id", "body", "first", F.col("first").alias("last"))
    return whole.union(parts).groupBy("doc_id", "body").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Each row's doc_id, n_words, n_removed, kept (the words left, joined by one space) of docs (doc_id, text).

    A word goes if a window of `length` words that covers it also starts in a document with a smaller
    doc_id. Null and empty texts have no words. Rows of one doc_id are never repeats of each other.
    A null doc_id takes no part: its text stays whole. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(docs, length, seed)
    marked = docs.withColumn("body", F.xxhash64("text")).join(spans, ["doc_id", "body"], "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n, removed, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                if not found:
                    removed.append(0)
                    kept.append(b" ".join(words).decode())
                    continue
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [s["first"] for s in found], 1)
                np.add.at(edge, [s["last"] + length for s in found], -1)
                gone = (edge.cumsum() > 0)[:-1]
                removed.append(int(gone.sum()))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return marked.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")
