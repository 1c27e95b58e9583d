"""Samples for display: by strata of magnitude, by view and by stride, seeded; limits are top-k, and places come from counts of strips, so no group comes together in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismolake.functions.geo import in_box

# Lower bounds of the strata of magnitude; shares of the largest events, in all, in a view and in a plot; the share of a view.
STRATA = (float("-inf"), 2.0, 3.0, 4.0, 5.0)
TOP_SHARE, MOST_TOP, VIEW_TOP, PLOT_TOP, IN_VIEW = 0.1, 100, 0.2, 0.2, 0.8


def draw(seed: int) -> Column:
    """A seeded order of events: the digest of the id."""
    return F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary"))


def stratum(magnitude: Column) -> Column:
    return reduce(lambda n, bound: n + (magnitude >= bound).cast("int"), STRATA[1:], F.lit(0))


def placed(events: DataFrame, by: list[Column], strip: Column, order: list[Column]) -> DataFrame:
    """events with _at, the place from 0 of each in its group in order of strip and then order, and _n, the events of the group. Strips are counted first, so that a group of any size is numbered by many tasks."""
    marked = events.withColumns({f"_by{k}": c for k, c in enumerate(by)} | {"_strip": strip})
    keys = [f"_by{k}" for k in range(len(by))]
    counts = marked.groupBy(*keys, "_strip").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    firsts = counts.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_strip").alias("_strip_"), F.coalesce(F.sum("_c").over(group.orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.sum("_c").over(group).alias("_n"))
    within = F.row_number().over(Window.partitionBy(*keys, "_strip").orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in (*keys, "_strip")])
    return marked.withColumn("_within", within).join(firsts, same).withColumn("_at", F.col("_first") + F.col("_within") - 1).select(*events.columns, "_at", "_n")


def stride(events: DataFrame, by: list[Column], every: int) -> DataFrame:
    """Each `every`th event of a group, in time, from the first on."""
    return placed(events, by, F.to_date("time"), [F.col("time"), F.col("id")]).where(F.col("_at") % every == 0).drop("_at", "_n")


def largest(events: DataFrame, k: int) -> DataFrame:
    return events.orderBy(F.desc_nulls_last("magnitude"), "id").limit(k)


def stratified(events: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """At most `size` events, and so many if there are: the largest tenth (100 at most), then equal shares of the strata of magnitude, then others, by a seeded order of their ids."""
    top = min(int(size * TOP_SHARE), MOST_TOP)
    top_events = largest(events, top)
    rest = events.join(top_events.select("id"), "id", "left_anti").select("id", "magnitude", draw(seed).alias("_draw"))
    share = (size - top) // len(STRATA)
    parts = [rest.where(F.coalesce(stratum(F.col("magnitude")), F.lit(0)) == k).orderBy("_draw").limit(share).withColumn("_turn", F.lit(0)) for k in range(len(STRATA))]
    # What short strata leave is filled from all: more are drawn than can be wanted.
    parts.append(rest.orderBy("_draw").limit(size).withColumn("_turn", F.lit(1)))
    chosen = reduce(DataFrame.unionByName, parts).groupBy("id", "_draw").agg(F.min("_turn").alias("_turn")).orderBy("_turn", "_draw").limit(size - top)
    return top_events.unionByName(events.join(F.broadcast(chosen.select("id")), "id", "left_semi"))  # at most `size` rows


def for_view(events: DataFrame, south: float, north: float, west: float, east: float, size: int, seed: int = 42) -> DataFrame:
    """At most `size` events: four fifths from the view, a fifth of these the largest and the others by a seeded order, and as many of the largest from outside as there is room for."""
    inside = in_box(F.col("latitude"), F.col("longitude"), south, north, west, east)
    n, view = int(size * IN_VIEW), events.where(inside)
    top_events = largest(view, int(n * VIEW_TOP))
    others = view.join(top_events.select("id"), "id", "left_anti").withColumn("_draw", draw(seed)).orderBy("_draw").limit(n - int(n * VIEW_TOP)).drop("_draw")
    ranked = top_events.unionByName(others).withColumn("_turn", F.lit(0)).unionByName(largest(events.where(~inside), size).withColumn("_turn", F.lit(1)))
    return ranked.orderBy("_turn", F.desc_nulls_last("magnitude"), "id").limit(size).drop("_turn")


def scatter(events: DataFrame, size: int = 500, seed: int = 42) -> DataFrame:
    """At most `size` events for a plot: all if they are no more; else the largest fifth of the size, and then each k-th in order of magnitude (ties by a seeded order), for the k that fills it."""
    top = int(size * PLOT_TOP)
    # A strip is a magnitude and a part of its ties, so that one common magnitude is no single task's work.
    digest = draw(seed)
    strip = F.struct((-F.col("magnitude")).alias("m"), F.substring(digest, 1, 2).alias("part"))
    ranked = placed(events.where("magnitude is not null"), [], strip, [F.desc("magnitude"), digest])
    step = F.greatest(F.lit(1), F.floor((F.col("_n") - top) / (size - top)))
    wanted = (F.col("_n") <= size) | (F.col("_at") < top) | ((F.col("_at") - top) % step == 0)
    return ranked.where(wanted).orderBy("_at").limit(size).drop("_at", "_n")
