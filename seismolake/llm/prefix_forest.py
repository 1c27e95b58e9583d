"""Approximate nearest neighbours by inner product: a hash-prefix forest in blocks.

Vectors are dealt by hash into blocks of bounded size; a block holds, for each tree, its vectors'
long hash strings (signs of random projections) as one sorted array. A query descends in each tree
to the longest prefix that it shares with any entry: a binary search. Then all trees ascend in step,
one letter at a time, until the ranges that match the shortened prefixes hold enough candidates. The entries
with whom the query shares most letters over all trees are scored exactly, a small share of the block. So that near directions mean large inner products, vectors are hashed with
one more component that fills their length up to the longest one (queries: zero there).

Equal vectors are one class, which keeps its 21 smallest ids: no list of 20 neighbours can need
more. So copies of a vector, however many, are one entry of the forest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a block of the index, and queries of a block.
BLOCK, QUERIES = 8192, 4096
#: Letters at a string's start whose votes are added by whole rows of a block.
HEAD = 6


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Forest:
    """The sorted strings of a block's entries, an array a tree. hashed: a row an entry, a column a tree, strings of `letters` bits."""

    def __init__(self, hashed, letters: int):
        import numpy as np

        (self.n, self.trees), self.letters, self.head = hashed.shape, letters, min(HEAD, letters - 1)
        order = np.argsort(hashed, axis=0, kind="stable")
        # A row a tree, so that a range of its array is one piece of memory.
        self.arrays, self.order = (np.ascontiguousarray(x.T) for x in (np.take_along_axis(hashed, order, axis=0), order))
        self.heads = np.ascontiguousarray(hashed.T >> (letters - self.head))
        cuts = np.arange((2 << self.head) + 1) << (letters - self.head - 1)
        self.starts = np.stack([np.searchsorted(array, cuts) for array in self.arrays])

    def ranges(self, own, length):
        """Where the entries lie that share the first letters, `length` of them for a column, with the strings of a row a tree."""
        import numpy as np

        rest, more = self.letters - length, self.head + 1 - length
        if (more >= 0).all():
            tree, cell = np.arange(self.trees)[:, None], own >> rest
            return self.starts[tree, cell << more], self.starts[tree, (cell + 1) << more]
        prefix = own >> rest << rest
        return tuple(np.stack([np.searchsorted(array, x) for array, x in zip(self.arrays, prefix + up, strict=True)]) for up in (0, 1 << rest))

    def votes(self, own, enough: int):
        """A row a query, a column an entry: a vote of a tree for each letter that its string shares with the query's, if the entry is in the query's range.

        All trees ascend in step: a query stops at the longest prefixes whose ranges hold enough entries over all trees.
        """
        import numpy as np

        own, n, head = np.ascontiguousarray(own.T), self.n, self.head
        queries = own.shape[1]
        # Shorter prefixes hold more, so that the length is found by halving.
        length, beyond = np.zeros(queries, np.int64), np.full(queries, self.letters + 1)
        while (beyond - length > 1).any():
            middle = (length + beyond) // 2
            low, high = self.ranges(own, middle)
            done = (high - low).sum(axis=0) >= enough
            length, beyond = np.where(done, middle, length), np.where(done, beyond, middle)
        votes = np.zeros((queries, n), np.int32)
        # Votes for the first letters are the same for all queries with the same ones, so they are added by whole rows.
        cells = np.arange(1 << head)
        shared = (head - np.frexp(cells[:, None] ^ cells)[1]).astype(np.uint8)
        for short in np.unique(length[length <= head]).tolist():
            which = np.flatnonzero(length == short)
            worth, asked = np.where(shared >= short, shared, 0).astype(np.uint8), own[:, which] >> (self.letters - head)
            rows, full = np.zeros((len(which), n), np.uint8), 255 // max(head, 1)
            for t in range(self.trees):
                if t and t % full == 0:
                    votes[which] += rows
                    rows[:] = 0
                by_cell = np.ascontiguousarray(worth[self.heads[t]].T)
                for a in range(0, len(which), 128):
                    rows[a : a + 128] += by_cell[asked[t, a : a + 128]]
            votes[which] += rows
        # The others are added by the entries of the ranges beyond, some queries at a time.
        low, high = self.ranges(own, np.maximum(length, head + 1))
        flat, entry, base = self.arrays.ravel(), self.order.ravel(), np.arange(self.trees) * n
        left = self.letters - np.where(length <= head, head, 0)
        held = np.cumsum((high - low).sum(axis=0))
        for some in np.split(np.arange(queries), np.flatnonzero(np.diff(held >> 16)) + 1):
            width = (high - low)[:, some].T.ravel()
            each = lambda x: np.repeat(x.ravel(), width)  # noqa: B023, E731
            held_at = np.arange(width.sum()) + each((low[:, some].T + base).ravel() - (np.cumsum(width) - width))
            # The exponent of a double is the place of a string's first letter that differs.
            differ = np.maximum(((flat[held_at] ^ each(own[:, some].T)).astype(np.float64).view(np.int64) >> 52) - 1022, 0)
            at = entry[held_at] + each(np.repeat(np.arange(len(some)) * n, self.trees))
            deep = np.bincount(at, weights=each(np.repeat(left[some], self.trees)) - differ, minlength=len(some) * n)
            votes[some] += deep.reshape(-1, n).astype(np.int32)
        return votes


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 160, letters: int = 24, reach: int = 16, wanted: float = 0.12, least: int = 200, block: int = BLOCK, queries: int = QUERIES, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of each row of vectors (vec_id, embedding) that is a query.

    Candidates are all rows but those with the query's own id; ties go to the smaller id. The trees stop ascending once their ranges
    hold `reach` entries for each entry of the block, over all trees; `wanted` is the share of a block's entries, `least` their least number, that are scored. Vectors
    that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows without an id, and vectors
    of different lengths never meet. Rows that share id and vector count once; a query id with several vectors is searched
    by each, and its best scores count. An empty table gives no rows. Other columns are not read.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = stored(rows.distinct(), "forest-rows")
    by_class = Window.partitionBy("vector").orderBy("vec_id")
    ranked = rows.select("vec_id", "vector", F.row_number().over(by_class).alias("n")).where(F.col("n") <= k + 1)
    classes = stored(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "forest-classes")
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    sizes = {row["dim"]: row for row in classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(squared).alias("longest")).collect()}
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    counts = {row["dim"]: row["n"] for row in asked.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}

    def blocks(number: dict[int, int], size: int) -> Column:
        """How many blocks the vectors of this row's length need."""
        return reduce(lambda other, d: F.when(F.size("vector") == d, F.lit(max(1, -(-number[d] // size)))).otherwise(other), number, F.lit(1))

    index_blocks = {d: max(1, -(-row["n"] // block)) for d, row in sizes.items()}
    n_index, n_query = blocks({d: row["n"] for d, row in sizes.items()}, block), blocks(counts, queries)
    longest = {d: row["longest"] for d, row in sizes.items()}
    dim = F.size("vector").alias("dim")
    entries = classes.select(dim, F.pmod(F.xxhash64("vector"), n_index).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), n_query - 1)).alias("j"), "vector", "members")
    searched = asked.select(dim, F.explode(F.sequence(F.lit(0), n_index - 1)).alias("i"), F.pmod(F.xxhash64("query_id", F.lit(1)), n_query).cast("int").alias("j"), "query_id", "vector")

    def search(held, queried):
        import numpy as np
        import pyarrow as pa

        ids, ranks, found, scores = [], [], [], []
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not held.num_rows or not queried.num_rows:
            return schema.empty_table()

        def matrix(table):
            column = table.column("vector").combine_chunks()
            return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

        points, asks = matrix(held), matrix(queried)
        members, n = held.column("members").to_pylist(), held.num_rows
        planes = np.random.default_rng(seed).standard_normal((points.shape[1] + 1, trees * letters))
        fill = np.sqrt(np.maximum(0.0, longest[points.shape[1]] - (points**2).sum(1)))
        place = (1 << np.arange(letters, dtype=np.int64))[::-1]
        strings = lambda x: ((x @ planes).reshape(len(x), trees, letters) > 0) @ place
        forest = Forest(np.concatenate([strings(np.c_[points[a : a + 1024], fill[a : a + 1024]]) for a in range(0, n, 1024)]), letters)
        enough, scored = reach * n, min(n, max(least, int(wanted * n)))
        for at in range(0, len(asks), 1024):
            some = asks[at : at + 1024]
            votes = forest.votes(strings(np.c_[some, np.zeros(len(some))]), enough)
            for q in range(len(some)):
                near = np.argpartition(-votes[q], scored - 1)[:scored] if scored < n else np.arange(n)
                got = np.einsum("ij,j->i", points[near], some[q])
                if len(near) > k + 1:
                    keep = got >= np.partition(got, -(k + 1))[-(k + 1)]
                    near, got = near[keep], got[keep]
                query = queried.column("query_id")[at + q].as_py()
                best = sorted((-s, m) for p, s in zip(near.tolist(), got.tolist(), strict=True) for m in members[p] if m != query)[:k]
                ids += [query] * len(best)
                found += [m for _, m in best]
                scores += [-s for s, _ in best]
        return pa.table([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], schema=schema)

    keys = ("dim", "i", "j")
    local = entries.groupBy(*keys).cogroup(searched.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    once = local.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
