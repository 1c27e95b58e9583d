"""One event from a group of matched events, by strategy: every strategy is an aggregation over the group's leader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismolake.functions.authority import mechanism_rank, network_rank
from seismolake.functions.scores import at_most, below, js_round

# Magnitude types by preference; unknown types, and none.
TYPE_RANKS = ((1, ("mw", "mww", "mwc", "mwb", "mwr", "mwp")), (2, ("ms", "ms_20", "ms_bb")), (3, ("mb", "mbb", "mb_lg")), (4, ("ml", "mlv", "mlr")), (5, ("md", "mc")))
UNKNOWN, NONE = 100, 999
# Points of a merge's quality score, and the most that each metric can have.
GAP_POINTS, LEAST_GAP, WIDE_GAP = ((120, 20.0), (180, 15.0)), 180.0, 270.0
RMS_POINTS = ((0.3, 15.0), (0.5, 12.0), (1.0, 8.0), (2.0, 4.0))
UNCERTAINTY_POINTS = ((0.1, 15.0), (0.2, 12.0), (0.3, 8.0), (0.5, 4.0))
TYPE_POINTS = ((15.0, ("mw", "mww", "mwc", "mwb")), (12.0, ("ms", "ms_20")), (9.0, ("mb", "mbb")), (6.0, ("ml", "mlv")), (3.0, ("md", "mc")))
STATUS_SCORES = ((10.0, ("final", "reviewed")), (6.0, ("confirmed",)), (2.0, ("preliminary",)))
MOST_STATIONS, FALLBACK = 32, {"depth": 10.0, "magnitude": 10.0, "time": 5.0}
# What detailed records add to completeness.
DETAIL_POINTS = {"n_origins": 5, "n_magnitudes": 5, "n_picks": 3, "n_arrivals": 3, "n_mechanisms": 2, "n_amplitudes": 2}
RECORD_POINTS, METRIC_POINTS, UNCERTAIN_POINTS = 10, 3, 2
# Largest groups and ranges that a sound group may have, by mean magnitude.
MAGNITUDE_RANGE = ((4.0, 0.5), (5.5, 0.8), (7.0, 1.2))
MOST_MAGNITUDE_RANGE, MOST_MEMBERS = 1.5, 15


def type_rank(kind: Column) -> Column:
    rank = F.lit(UNKNOWN)
    for place, names in TYPE_RANKS:
        rank = F.when(F.lower(kind).isin(*names), place).otherwise(rank)
    return F.when(F.coalesce(kind, F.lit("")) == "", NONE).otherwise(rank)


def location_weight() -> Column:
    """The inverse of the horizontal uncertainty, or of the geometric mean of those of latitude and longitude, held between 0.1 and 100; 1 where neither is there."""
    both = F.sqrt(F.col("latitude_uncertainty") * F.col("longitude_uncertainty"))
    u = F.coalesce(F.when(F.col("horizontal_uncertainty") > 0, F.col("horizontal_uncertainty")), F.when(both > 0, both))
    return F.when(u.isNotNull(), 1 / F.greatest(F.lit(0.1), F.least(F.lit(100.0), u))).otherwise(1.0)


def event_quality() -> Column:
    """0 to 100: the points that stations, gap, residual, magnitude uncertainty, type and status have, of those that the known ones could have. Without any, points for depth, magnitude and time."""
    stations, gap, status = F.col("stations"), F.col("gap"), F.lower("evaluation_status")

    def named(value: Column, points: tuple) -> Column:
        out = F.lit(0.0)
        for score, names in points:
            out = F.when(value.isin(*names), score).otherwise(out)
        return out

    fading = F.when(gap <= WIDE_GAP, 10 * (1 - (gap - LEAST_GAP) / (WIDE_GAP - LEAST_GAP))).otherwise(0.0)
    kind = F.lower("magnitude_type")
    parts = [
        (stations > 0, 25.0, F.least(F.lit(25.0), 25 * F.log2(stations + F.lit(1.0)) / F.log2(F.lit(float(MOST_STATIONS))))),
        (gap.isNotNull(), 20.0, F.when(gap <= LEAST_GAP, at_most(gap, GAP_POINTS, 0.0)).otherwise(fading)),
        (F.col("rms").isNotNull(), 15.0, at_most(F.col("rms"), RMS_POINTS, 0.0)),
        (F.col("magnitude_uncertainty").isNotNull(), 15.0, at_most(F.col("magnitude_uncertainty"), UNCERTAINTY_POINTS, 0.0)),
        (F.coalesce(kind, F.lit("")) != "", 15.0, named(kind, TYPE_POINTS)),
        (F.coalesce(status, F.lit("")) != "", 10.0, named(status, STATUS_SCORES)),
    ]
    had = sum(F.when(known, points).otherwise(0.0) for known, points, _ in parts)
    got = sum(F.when(known, score).otherwise(0.0) for known, _, score in parts)
    basic = sum(F.when(F.col(name).isNotNull(), points).otherwise(0.0) for name, points in FALLBACK.items())
    return F.when(had > 0, got / F.nullif(had, F.lit(0.0)) * 100).otherwise(basic)


def _span() -> Column:
    """Aggregate: the range of longitudes, the shorter way round where a group lies across the date line."""
    lon = F.col("longitude")
    plain, turned = F.max(lon) - F.min(lon), F.max(F.pmod(lon, F.lit(360.0))) - F.min(F.pmod(lon, F.lit(360.0)))
    return F.least(plain, turned)


def group_faults(groups: DataFrame) -> DataFrame:
    """leader, n and fault (magnitude_range, depth_range, group_size, spatial_spread or null: the first that applies) of each group of two or more."""
    g = groups.groupBy("leader").agg(
        F.count("*").alias("n"), F.avg("magnitude").alias("m"), (F.max("magnitude") - F.min("magnitude")).alias("m_range"), F.count("depth").alias("depths"), F.avg("depth").alias("d"), (F.max("depth") - F.min("depth")).alias("d_range"),
        (F.max("latitude") - F.min("latitude")).alias("up"), _span().alias("along"), ((F.max("latitude") + F.min("latitude")) / 2).alias("mid"),
    ).where("n > 1")
    small = F.col("m") < 5
    d_most = F.when(F.col("d") < 70, F.when(small, 30).otherwise(50)).when(F.col("d") < 300, F.when(small, 50).otherwise(100)).otherwise(F.when(small, 100).otherwise(150))
    spread = F.sqrt(F.pow(F.col("up") * 111, 2) + F.pow(F.col("along") * 111 * F.cos(F.radians("mid")), 2))
    fault = (
        F.when(F.col("m_range") > below(F.col("m"), MAGNITUDE_RANGE, MOST_MAGNITUDE_RANGE), "magnitude_range")
        .when((F.col("depths") >= 2) & (F.col("d_range") > d_most), "depth_range")
        .when(F.col("n") > MOST_MEMBERS, "group_size")
        .when((F.col("n") > 3) & (spread > F.when(small, 100).when(F.col("m") < 6, 150).otherwise(200)), "spatial_spread")
    )
    return g.select("leader", "n", fault.alias("fault"))


def split_unsound(groups: DataFrame) -> DataFrame:
    """Groups that fail validation fall apart into single events."""
    bad = group_faults(groups).where("fault is not null").select(F.col("leader").alias("bad"))
    return groups.join(bad, groups.leader == bad.bad, "left").withColumn("leader", F.when(F.col("bad").isNull(), F.col("leader")).otherwise(F.col("id"))).drop("bad")


def average(groups: DataFrame) -> DataFrame:
    """Weighted location (circular across the date line), the best magnitude, the best depth and the earliest time of each group."""
    w, lon = location_weight(), F.col("longitude")
    mean = F.sum(lon * w) / F.sum(w)
    circular = F.degrees(F.atan2(F.sum(F.sin(F.radians(lon)) * w), F.sum(F.cos(F.radians(lon)) * w)))
    # Best magnitude: known type, small uncertainty, then the earliest; best depth: the smallest uncertainty in steps of 5 km, then most stations.
    order = (F.col("time"), F.col("catalogue_id"), F.col("id"))
    by_type = F.struct(type_rank(F.col("magnitude_type")), F.coalesce("magnitude_uncertainty", F.lit(999.0)), *order)
    by_depth = F.struct(F.floor(F.coalesce("depth_uncertainty", F.lit(999.0)) / 5), -F.coalesce("stations", F.lit(0)), *order)
    return groups.groupBy("leader").agg(
        F.count("*").alias("n"), F.min("time").alias("time"), (F.sum(F.col("latitude") * w) / F.sum(w)).alias("latitude"), F.when(F.max(lon) - F.min(lon) < 180, mean).otherwise(circular).alias("longitude"),
        F.min_by("magnitude", F.when(F.col("magnitude").isNotNull(), by_type)).alias("magnitude"), F.min_by("depth", F.when(F.col("depth").isNotNull(), by_depth)).alias("depth"),
    )


KEPT = ("id", "catalogue_id", "time", "latitude", "longitude", "depth", "magnitude")


def pick(groups: DataFrame, *key: Column) -> DataFrame:
    """The member of each group with the largest key; of equal ones the first in order of time, catalogue and id. sources: all members' ids, in that order."""
    us, row = F.unix_micros(F.col("time").cast("timestamp")), F.struct(*KEPT)
    rank = F.struct(*[k.alias(f"k{n}") for n, k in enumerate(key)], (-us).alias("t"), (-F.col("catalogue_id")).alias("c"), (-F.col("id")).alias("i"))
    members = F.transform(F.sort_array(F.collect_list(F.struct(us.alias("us"), "catalogue_id", "id"))), lambda x: x["id"])
    found = groups.groupBy("leader").agg(F.max_by(row, rank).alias("best"), F.count("*").alias("n"), members.alias("sources"))
    return found.select("leader", "n", "best.*", "sources")


def newest(groups: DataFrame) -> DataFrame:
    return pick(groups, F.col("time"))


def completeness_points(fields: tuple[str, ...]) -> Column:
    """How many of the fields are there, and more for detailed records (counts of origins, magnitudes, picks and others), metrics and uncertainties of the origin."""
    given = sum(F.col(f).isNotNull().cast("int") for f in fields)
    some = lambda name: F.coalesce(F.col(name) > 0, F.lit(False)).cast("int")
    record = F.coalesce(*[F.col(name) for name in DETAIL_POINTS]).isNotNull().cast("int")
    origin = some("n_origins")
    metrics = F.coalesce(F.col("gap"), F.col("stations").cast("double"), F.col("rms")).isNotNull().cast("int")
    return given + record * RECORD_POINTS + sum(some(name) * points for name, points in DETAIL_POINTS.items()) + origin * metrics * METRIC_POINTS + origin * F.col("horizontal_uncertainty").isNotNull().cast("int") * UNCERTAIN_POINTS


def most_complete(groups: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    return pick(groups, completeness_points(fields))


def best_quality(groups: DataFrame) -> DataFrame:
    return pick(groups, js_round(event_quality(), 6))


def by_authority(groups: DataFrame, source: str = "source") -> DataFrame:
    """The member of each group from the most authoritative network, where the group's first event lies; then the best quality."""
    return pick(_with_place(groups), *_authority(source))


def _with_place(groups: DataFrame) -> DataFrame:
    first = F.struct("time", "catalogue_id", "id")
    where = groups.groupBy("leader").agg(F.min_by("latitude", first).alias("_lat"), F.min_by("longitude", first).alias("_lon"))
    return groups.join(where, "leader")


def _authority(source: str) -> tuple[Column, Column]:
    return -network_rank(F.col(source), F.col("_lat"), F.col("_lon")), js_round(event_quality(), 6)


def by_priority(groups: DataFrame, priority: str, source: str = "source") -> DataFrame:
    """newest, quality and authority as such; else the first member whose source holds the text, by authority in groups without one."""
    if priority == "newest":
        return newest(groups)
    if priority == "quality":
        return best_quality(groups)
    if priority == "authority":
        return by_authority(groups, source)
    named = F.coalesce(F.lower(source).contains(priority.lower()), F.lit(False))
    rank, quality = _authority(source)
    return pick(_with_place(groups), named, F.when(~named, rank), F.when(~named, quality))


STRATEGIES = ("average", "newest", "completeness", "quality", "priority")


def resolved(groups: DataFrame, strategy: str = "priority", fields: tuple[str, ...] = (), priority: str = "authority") -> DataFrame:
    """One event a group by a strategy's name; groups of one come out as they are."""
    if strategy == "average":
        return average(groups)
    if strategy == "newest":
        return newest(groups)
    if strategy == "completeness":
        return most_complete(groups, fields)
    if strategy == "quality":
        return best_quality(groups)
    if strategy == "priority":
        return by_priority(groups, priority)
    raise ValueError(f"no strategy: {strategy}")


def united(catalogues: list[tuple[object, str, DataFrame]]) -> DataFrame:
    """The events of several catalogues (id, source, events) in one table with the columns of all, each row with its catalogue_id and source; an unnamed source is unknown."""
    tagged = [events.drop("catalogue_id", "source").withColumns({"catalogue_id": F.lit(number), "source": F.lit(source or "unknown")}) for number, source, events in catalogues]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


# How severe a group's fault is.
SEVERE = "group_size"


def conflicts(groups: DataFrame) -> DataFrame:
    """Number of groups by fault and severity; none: sound."""
    severity = F.when(F.col("fault").isNull(), "none").when(F.col("fault") == SEVERE, "error").otherwise("warning")
    return group_faults(groups).groupBy(F.coalesce("fault", F.lit("none")).alias("fault"), severity.alias("severity")).agg(F.count("*").alias("groups"), F.sum("n").alias("events"))


def preview(groups: DataFrame) -> DataFrame:
    """Events before, groups after, groups of two or more, events removed."""
    sizes = groups.groupBy("leader").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("events_before"), F.count("*").alias("events_after"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("removed"))


# Points of a representative by status, and a point's worth of a field that is there.
STATUS_POINTS = {"reviewed": 100, "manual": 50}
FIELD_POINTS = 5


def representatives(groups: DataFrame, fields: tuple[str, ...] = ("depth", "magnitude_type", "event_type", "gap", "phases", "stations"), by: str = "group") -> DataFrame:
    """The member of each duplicate group (by) with most points for status, stations, gap and fields; of equal ones the first in order of time, catalogue and id."""
    us = F.unix_micros(F.col("time").cast("timestamp"))
    status = F.lit(0)
    for name, points in STATUS_POINTS.items():
        status = F.when(F.col("evaluation_status") == name, points).otherwise(status)
    gap = F.when(F.col("gap") != 0, (360 - F.col("gap")) / 10)
    score = status + F.coalesce("stations", F.lit(0)) + F.coalesce(gap, F.lit(0.0)) + FIELD_POINTS * sum(F.col(f).isNotNull().cast("int") for f in fields)
    return groups.groupBy(by).agg(F.max_by("id", F.struct(score.alias("score"), (-us).alias("t"), (-F.col("catalogue_id")).alias("c"), (-F.col("id")).alias("i"))).alias("id"), F.count("*").alias("n"), js_round(F.max(score), 4).alias("score"))


def group_confidence(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """group and confidence: the mean over the pairs (a_id, confidence) of each group's members (id, group), high 3, medium 2, low 1."""
    points = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    mean = pairs.join(members, pairs.a_id == members.id).groupBy("group").agg(F.avg(points).alias("mean"), F.count("*").alias("pairs"))
    return mean.select("group", "pairs", F.when(F.col("mean") >= 2.5, "high").when(F.col("mean") >= 1.5, "medium").otherwise("low").alias("confidence"))


def best_mechanisms(mechanisms: DataFrame) -> DataFrame:
    """The mechanism of each event (event_id, source, quality, id) by source, then quality, then id."""
    return mechanisms.groupBy("event_id").agg(F.min_by(F.struct("id", "source", "quality"), F.struct(mechanism_rank(F.col("source")), -F.col("quality"), F.col("id"))).alias("x")).select("event_id", "x.*")


def merged_mechanisms(mechanisms: DataFrame, by: str = "leader") -> DataFrame:
    """The best mechanism (id, source, quality) of each group by source, then quality, then id, and all of the group's in that order."""
    rank = F.struct(mechanism_rank(F.col("source")).alias("rank"), (-F.col("quality")).alias("worse"), F.col("id"), F.col("source"))
    ordered = F.sort_array(F.collect_list(rank))
    found = mechanisms.groupBy(by).agg(ordered.alias("all"))
    return found.select(by, F.get("all", F.lit(0))["id"].alias("id"), (-F.get("all", F.lit(0))["worse"]).alias("quality"), F.transform("all", lambda x: F.struct(x["id"].alias("id"), x["source"].alias("source"), (-x["worse"]).alias("quality"))).alias("all"))


def preview_groups(groups: DataFrame) -> DataFrame:
    """Groups of two or more, kept whole, with warnings: a range of magnitudes over 1, or of depths over 100 (200 where the deepest is below 300)."""
    g = groups.groupBy("leader").agg(F.count("*").alias("n"), (F.max("magnitude") - F.min("magnitude")).alias("m_range"), (F.max("depth") - F.min("depth")).alias("d_range"), F.max("depth").alias("deepest")).where("n > 1")
    magnitude = F.coalesce(js_round(F.col("m_range"), 6) > 1, F.lit(False))
    depth = F.coalesce(js_round(F.col("d_range"), 6) > F.when(F.col("deepest") > 300, 200).otherwise(100), F.lit(False))
    return g.select("leader", "n", magnitude.alias("magnitude_warning"), depth.alias("depth_warning"), (magnitude | depth).alias("suspicious"))
