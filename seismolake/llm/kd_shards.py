"""Shards of near-equal bytes by a k-d tree over documents' metadata.

The tree's points are groups of equal texts, so that copies share a shard. Its dimensions are the source and
the language (values in order, spread within a value by a hash), the size and the number of copies. Each level splits
every node that still stands for several shards, all nodes at once, at a weighted median along the
dimension in which the node is widest, until each leaf is one shard of the target bytes. Medians are found by
histograms of bounded size that close in on the boundary. Points of over a small share of a shard would
make the cuts coarse: they are few, and split at a median of their own along the same dimension; the light points' cut then evens
the bytes. A group too large for one shard is a point for each of many parts of its rows.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BINS = 512
#: Times that a histogram is drawn anew within the bin that holds a median.
ROUNDS = 3
# Bytes that a row weighs besides its text.
ROW_BYTES = 16
#: Share of a shard over which a point is heavy: at most shards / share of them, which come to the driver.
HEAVY_SHARE = 0.005
#: Values of a dimension up to this number are sent to all tasks.
FEW = 10_000


def measured(docs: DataFrame, *names: str) -> DataFrame:
    """doc_id, size, text_crc32 and body (a hash of the text) of each row of docs (doc_id, text), and its columns of the given names as text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("body"), *[F.col(f"`{name}`").cast("string").alias(f"meta_{name}") for name in names])


def _unit(*columns: Column | str) -> Column:
    """A hash of the columns as a number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _ranked(points: DataFrame, name: str) -> DataFrame:
    """points with the column name, a text, as a number from 0 to below 1 in the order of its values, null first; points of one value are spread over its part. One row a value comes together."""
    values = points.select(name).distinct()
    ranks = stored(values.select(F.col(name).alias("value"), F.row_number().over(Window.orderBy(F.col(name).asc_nulls_first())).alias("rank")), "kd-values")
    n = ranks.count()
    joined = points.join(F.broadcast(ranks) if n <= FEW else ranks, points[name].eqNullSafe(ranks["value"]))
    return joined.withColumn(name, (F.col("rank") - 1 + _unit("body", F.lit(name))) / F.lit(float(max(1, n)))).drop("value", "rank")


def kd_cells(points: DataFrame, dims: list[str], shards: int, heavy_share: float = HEAVY_SHARE, bins: int = BINS, rounds: int = ROUNDS) -> DataFrame:
    """points (dims as doubles, weight, any other columns) with the column cell, 0 to shards - 1, of near-equal weight. The driver holds one row a node, and the heavy points."""
    spark = points.sparkSession
    total = points.agg(F.sum("weight").alias("total")).first()["total"] or 0.0
    is_heavy = F.col("weight") > heavy_share * total / shards
    heavy = [row.asDict() | {"cell": 0} for row in points.where(is_heavy).orderBy(*points.columns).collect()]
    here = stored(points.where(~is_heavy), "kd-light").withColumn("cell", F.lit(0))
    spans = [(0, shards)]  # (first cell, cells) of each node
    while any(n > 1 for _, n in spans):
        left_cells = {first: n // 2 for first, n in spans if n > 1}
        cells = {first: n for first, n in spans if n > 1}
        stats = here.where(F.col("cell").isin(list(cells))).groupBy("cell").agg(F.sum("weight").alias("weight"), *[f(d).alias(f"{d}_{name}") for d in dims for name, f in (("min", F.min), ("max", F.max))])
        light = {row["cell"]: row for row in stats.collect()}  # one row a node
        weighty: dict[int, list[dict]] = {c: [h for h in heavy if h["cell"] == c] for c in cells}

        def reach(c: int, d: str) -> tuple[float, float]:
            own = [h[d] for h in weighty[c]] + [light[c][f"{d}_{end}"] for end in ("min", "max") if c in light]  # noqa: B023
            return (min(own), max(own)) if own else (0.0, 0.0)

        width = lambda x: x[1] - x[0]
        whole = {d: max((reach(c, d)[1] for c in cells), default=0.0) - min((reach(c, d)[0] for c in cells), default=0.0) or 1.0 for d in dims}
        plan = []
        for c, n in cells.items():
            dim = max(dims, key=lambda d: width(reach(c, d)) / whole[d])  # noqa: B023
            weight = light[c]["weight"] if c in light else 0.0
            most = (weight + sum(h["weight"] for h in weighty[c])) * left_cells[c] / n
            goes = _heavy_side(sorted(weighty[c], key=lambda h: h[dim]), left_cells[c] / n, most, weight)  # noqa: B023
            for h in weighty[c]:
                if id(h) not in goes:
                    h["cell"] = c + left_cells[c]
            goal = min(weight, max(0.0, most - sum(h["weight"] for h in weighty[c] if id(h) in goes)))
            if c in light:
                low, high = light[c][f"{dim}_min"], light[c][f"{dim}_max"]
                plan.append((c, c + left_cells[c], dims.index(dim), float(low), float((high - low) / bins or 1.0 / bins), 0.0, float(goal)))
        for turn in range(rounds):
            nodes = spark.createDataFrame(plan, "cell int, other int, dim int, low double, step double, before double, goal double")
            place = F.element_at(F.array(*dims), F.col("dim") + 1)
            drawn = here.join(F.broadcast(nodes), "cell").withColumn("bin", F.floor((place - F.col("low")) / F.col("step")))
            drawn = drawn.where((F.col("bin") >= 0) & (F.col("bin") <= bins)).withColumn("bin", F.least("bin", F.lit(bins - 1)))
            counts = drawn.groupBy("cell", "goal", "before", "bin").agg(F.sum("weight").alias("w"))
            upto = counts.withColumn("upto", F.col("before") + F.sum("w").over(Window.partitionBy("cell").orderBy("bin")))
            found = upto.where("upto >= goal - 1e-6").groupBy("cell").agg(F.min_by(F.struct("bin", "w", "upto"), "bin").alias("x"))
            at = {row["cell"]: row["x"] for row in found.collect()}  # one row a node
            for k, (c, other, dim, low, step, before, goal) in enumerate(plan):
                b, w, run = (at[c]["bin"], at[c]["w"], at[c]["upto"]) if c in at else (bins - 1, 0.0, goal)
                edge = low + step * b
                if turn == rounds - 1:
                    # At the end the bin that straddles the goal goes where it does less harm.
                    edge += step if run - goal <= goal - (run - w) else 0.0
                    plan[k] = (c, other, dim, edge, step, before, goal)
                else:
                    plan[k] = (c, other, dim, edge, step / bins, run - w, goal)
        cuts = spark.createDataFrame([p[:4] for p in plan], "cell int, other int, dim int, cut double")
        moved = F.when(F.element_at(F.array(*dims), F.col("dim") + 1) >= F.col("cut"), F.col("other")).otherwise(F.col("cell"))
        here = here.join(F.broadcast(cuts), "cell", "left").withColumn("cell", moved).select(*points.columns, "cell")
        spans = [s for first, n in spans for s in ([(first, n // 2), (first + n // 2, n - n // 2)] if n > 1 else [(first, n)])]
    return here.unionByName(spark.createDataFrame([tuple(h[c] for c in here.columns) for h in heavy], here.schema))


def _heavy_side(ordered: list[dict], share: float, most: float, light: float) -> set[int]:
    """Which heavy points of a node (in order along its dimension) go left: so many of the first ones that their weight comes nearest to their share, among those that the light points can still even out."""
    every = sum(h["weight"] for h in ordered)
    best, run = None, 0.0
    for k in range(len(ordered) + 1):
        short = max(0.0, run - most) + max(0.0, most - run - light)  # bytes that no cut of the light points can even out
        if best is None or (short, abs(run - share * every)) < best[0]:
            best = ((short, abs(run - share * every)), k)
        run += ordered[k]["weight"] if k < len(ordered) else 0.0
    return {id(h) for h in ordered[: best[1]]}


def shard_by_bytes(docs: DataFrame, shards: int = 40, cut_share: float = 0.02, names: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs (doc_id, text and, where they are there, the columns `names`), shards near equal in bytes.

    Rows of equal texts share a shard, unless they weigh over cut_share of a shard's bytes: those are
    dealt to points of even weight. Null and empty texts are one group, of ROW_BYTES a row; a null source or
    language is a value, the first. slot numbers the rows of a shard from 0 without gaps. Rows that repeat, or have no
    id, are rows like any other. Other columns are not read, and columns of any type may have clashing names. An empty table gives no rows.
    """
    names = tuple(name for name in names if name in docs.columns)
    metas = [f"meta_{name}" for name in names]
    rows = stored(measured(docs, *names), "kd-rows")
    keys = ["body", "text_crc32", "size"]
    groups = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.min(m).alias(m) for m in metas]), "kd-groups")
    totals = groups.agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("n")).first()
    bound = cut_share * (totals["total"] or 0) / shards
    whole = groups.where(F.col("size") * F.col("n") <= bound)
    large = stored(groups.where(F.col("size") * F.col("n") > bound).select(*keys, F.col("n").alias("copies"), *metas), "kd-large")
    # A large group's rows are dealt to parts of even weight, each a point of the tree.
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(64 * shards)).cast("int")
    dealt = rows.select("doc_id", *keys).join(large.select(*keys, "copies"), keys, "left")
    placed = stored(dealt.withColumn("part", F.when(F.col("copies").isNotNull(), part).otherwise(-1)), "kd-placed")
    parts = placed.where("part >= 0").groupBy(*keys, "part", "copies").agg(F.count("*").alias("n")).join(large.select(*keys, *metas), keys)
    points = whole.select(*keys, F.lit(-1).alias("part"), "n", F.col("n").alias("copies"), *metas).unionByName(parts.select(*keys, "part", "n", "copies", *metas))
    for m in metas:
        points = _ranked(points, m)
    # Groups of one size or number are told apart by a hash; parts of a group lie side by side, so that only a boundary through them cuts it.
    beside = _unit("body", "part") * 1e-5
    points = points.select(
        *keys, "part", (F.col("size") * F.col("n")).cast("double").alias("weight"), *[(F.col(m) + beside).alias(m) for m in metas],
        (F.log2(F.col("size") + _unit("body")) + beside).alias("d_size"), (F.log2(F.col("copies") + _unit("body", F.lit("copies"))) + beside).alias("d_copies"),
    )
    cells = kd_cells(points, [*metas, "d_size", "d_copies"], shards)
    out = placed.join(cells.select(*keys, "part", F.col("cell").cast("int").alias("shard")), [*keys, "part"]).select("doc_id", "size", "text_crc32", "body", "shard")
    return _slots(stored(out, "kd-out"), isqrt((totals["n"] or 0) // shards) + 1)


def _slots(rows: DataFrame, strips: int) -> DataFrame:
    """Numbers the rows of each shard from 0: within hashed strips of the shard, whose counts are then added up."""
    rows = rows.withColumn("strip", F.pmod(F.xxhash64("doc_id", "body"), F.lit(strips)).cast("int"))
    within = F.row_number().over(Window.partitionBy("shard", "strip").orderBy("doc_id", "body"))
    counts = rows.groupBy("shard", "strip").agg(F.count("*").alias("n"))  # one row a strip
    before = Window.partitionBy("shard").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "strip", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.withColumn("at", within).join(firsts, ["shard", "strip"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"))
