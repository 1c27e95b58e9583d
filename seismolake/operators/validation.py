"""Checks of events, each an array of what fails, and reports over them: one pass, no collected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismolake.functions import text as read
from seismolake.functions.scores import at_least, js_round
from seismolake.plans.fields import RANGES, REQUIRED

Rule = tuple[str, str, str, Column]  # name, field, severity, condition
EARLIEST, INSTRUMENTS = "1000-01-01", "1900-01-01"
# Depths that stand for an unknown depth.
DEFAULT_DEPTHS = (0, 10, 33)


def failing(rules: list[Rule]) -> Column:
    """Array of (name, field, severity) of the rules whose condition holds; null conditions don't."""
    return F.array_compact(F.array(*[F.when(condition, F.struct(F.lit(name).alias("name"), F.lit(field).alias("field"), F.lit(severity).alias("severity"))) for name, field, severity, condition in rules]))


def row_failures(raw: dict[str, Column]) -> Column:
    """Failures of a row that is read from text (raw: the source text of fields), beside its typed columns: missing_required, invalid_type, out_of_range, invalid_format."""
    rules: list[Rule] = []
    for field in (*REQUIRED, "depth"):
        source = raw.get(field, F.lit(None).cast("string"))
        given = F.coalesce(F.trim(source) != "", F.lit(False))
        value = F.col(field)
        if field == "time":
            rules += [("missing_required", field, "error", value.isNull() & ~given), ("invalid_format", field, "error", value.isNull() & given)]
            continue
        low, high = RANGES[field]
        rules.append(("out_of_range", field, "error", ~value.between(low, high)))
        if field in REQUIRED:
            rules.append(("missing_required", field, "error", value.isNull() & ~(given & ~read.is_number(source))))
            rules.append(("invalid_type", field, "error", value.isNull() & given & ~read.is_number(source)))
        else:
            rules.append(("invalid_type", field, "warning", value.isNull() & given))
    return failing(rules)


def has_error(failures: Column) -> Column:
    return F.exists(failures, lambda x: x["severity"] == "error")


def anomalies(now: Column | None = None) -> Column:
    """Anomalies of one event. `now`: the time that later events are in the future of."""
    c = F.col
    lat, lon, depth, mag, gap, n, phases, rms, time = (c(x) for x in ("latitude", "longitude", "depth", "magnitude", "gap", "stations", "phases", "rms", "time"))
    time = time.cast("timestamp")
    now = F.current_timestamp() if now is None else now
    # Trailing zeros don't count, so a value is finer than six decimals if rounding to six changes it.
    fine = lambda x: F.round(x, 6) != x
    day = lambda d: F.lit(d).cast("timestamp")
    return failing([
        ("latitude_range", "latitude", "error", ~lat.between(-90, 90)),
        ("longitude_range", "longitude", "error", ~lon.between(-180, 180)),
        ("null_island", "location", "warning", (lat == 0) & (lon == 0)),
        ("fine_coordinates", "location", "info", fine(lat) | fine(lon)),
        ("negative_depth", "depth", "error", depth < 0),
        ("deep", "depth", "warning", depth > 700),
        ("shallow_great", "consistency", "warning", (depth < 5) & (mag > 7.5)),
        ("default_depth", "depth", "info", depth.isin(*DEFAULT_DEPTHS)),
        ("depth_uncertain", "depth", "warning", c("depth_uncertainty") > depth),
        ("magnitude_low", "magnitude", "error", mag < -2),
        ("magnitude_high", "magnitude", "error", mag > 10),
        ("surface_large", "consistency", "warning", (depth < 1) & (mag > 6)),
        ("magnitude_uncertain", "magnitude", "warning", c("magnitude_uncertainty") > 1),
        ("gap_very_large", "gap", "warning", gap > 270),
        ("gap_large", "gap", "info", (gap > 180) & (gap <= 270)),
        ("few_stations", "stations", "warning", n < 4),
        ("some_stations", "stations", "info", n.between(4, 5)),
        ("few_phases", "phases", "info", phases < 8),
        ("rms_large", "rms", "warning", rms > 2),
        ("rms_moderate", "rms", "info", (rms > 1) & (rms <= 2)),
        ("future", "time", "error", time > now),
        ("too_early", "time", "error", time < day(EARLIEST)),
        ("before_instruments", "time", "info", (time >= day(EARLIEST)) & (time < day(INSTRUMENTS))),
    ])


def severity_of(flags: Column) -> Column:
    """critical, high, medium, low or none, by the errors and warnings among flags."""
    count = lambda s: F.size(F.filter(flags, lambda x: x["severity"] == s))
    return F.when(count("error") > 0, "critical").when(count("warning") >= 3, "high").when(count("warning") == 2, "medium").when(F.size(flags) > 0, "low").otherwise("none")


def cross_field(now: Column | None = None) -> Column:
    """Fields that contradict each other within an event; an event passes if none is an error."""
    c = F.col
    depth, mag, n, phases, gap, rms = c("depth"), c("magnitude"), c("stations"), c("phases"), c("gap"), c("rms")
    d_unc, m_unc, time = c("depth_uncertainty"), c("magnitude_uncertainty"), c("time").cast("timestamp")
    now = F.current_timestamp() if now is None else now
    lat, lon = c("latitude"), c("longitude")
    day = lambda d: F.lit(d).cast("timestamp")
    return failing([
        ("shallow_great", "depth", "warning", (depth < 5) & (mag > 8)),
        ("deep_small", "magnitude", "warning", (depth > 300) & (mag < 3)),
        ("very_deep_small", "depth", "warning", (depth > 700) & (mag < 4)),
        ("depth_twice_uncertain", "depth_uncertainty", "warning", d_unc > 2 * depth),
        ("depth_uncertain", "depth_uncertainty", "info", (depth > 0) & (d_unc > depth)),
        ("magnitude_uncertain", "magnitude_uncertainty", "warning", m_unc > 1),
        ("magnitude_unknown", "magnitude_uncertainty", "error", m_unc > F.abs(mag)),
        ("more_stations_than_phases", "stations", "error", n > phases),
        ("few_phases", "phases", "info", phases < n * 1.2),
        ("lopsided_location", "location", "warning", asymmetry(c("latitude_uncertainty"), c("longitude_uncertainty")) > 10),
        ("more_magnitude_stations", "magnitude_stations", "warning", c("magnitude_stations") > n),
        ("gap_despite_stations", "gap", "warning", (n >= 10) & (gap > 180)),
        ("gap_small", "gap", "info", (n < 6) & (gap < 90)),
        ("rms_large", "rms", "warning", rms > 5),
        ("rms_small", "rms", "info", rms < 0.01),
        ("future", "time", "error", time > now),
        ("too_early", "time", "error", time < day(EARLIEST)),
        ("before_instruments", "time", "info", (time >= day(EARLIEST)) & (time < day(INSTRUMENTS))),
        ("null_island", "latitude", "warning", (lat == 0) & (lon == 0)),
        ("near_null_island", "latitude", "warning", (F.abs(lat) < 0.001) & (F.abs(lon) < 0.001)),
    ])


def asymmetry(a: Column, b: Column) -> Column:
    """The larger of two uncertainties over the smaller; infinite if only that is zero, null if one is missing or both are zero."""
    low, high = F.least(a, b), F.greatest(a, b)
    ratio = F.when((low == 0) & (high > 0), F.lit(float("inf"))).otherwise(high / F.nullif(low, F.lit(0.0)))
    return F.when(a.isNotNull() & b.isNotNull(), ratio)


def thresholds() -> Column:
    """Whether an event's uncertainties and coverage pass the plain thresholds; zero and missing values count as unknown."""
    known = lambda name: F.nullif(F.col(name).cast("double"), F.lit(0.0))
    return failing([
        ("horizontal", "horizontal_uncertainty", "warning", known("horizontal_uncertainty") > 0.1),
        ("depth", "depth_uncertainty", "warning", known("depth_uncertainty") > 10),
        ("stations", "stations", "warning", known("stations") < 6),
        ("gap", "gap", "warning", known("gap") > 180),
    ])


def by_severity(frame: DataFrame, flags: str, by: str = "catalogue_id") -> DataFrame:
    """by, severity and number of events, for each overall severity."""
    return frame.groupBy(by, severity_of(F.col(flags)).alias("severity")).agg(F.count("*").alias("n"))


def failure_counts(frame: DataFrame, flags: str, *keys: str) -> DataFrame:
    """Number of failures by keys (of name, field, severity): partial counts first, so rows don't shuffle."""
    return frame.select(F.explode(flags).alias("x")).groupBy(*[F.col(f"x.{k}").alias(k) for k in keys]).agg(F.count("*").alias("n"))


def cross_field_summary(frame: DataFrame, flags: str) -> DataFrame:
    """Events, passed and failed ones, and checks by severity, as one row."""
    of = lambda s: F.sum(F.size(F.filter(flags, lambda x: x["severity"] == s))).cast("long").alias(f"{s}s")
    bad = has_error(F.col(flags))
    return frame.agg(F.count("*").alias("events"), F.count_if(~bad).alias("passed"), F.count_if(bad).alias("failed"), F.sum(F.size(flags)).cast("long").alias("checks"), of("error"), of("warning"), of("info"))


def quality_report(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """Completeness, consistency and accuracy of each catalogue (0 to 100), their mean and its name."""
    valid = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.col("magnitude").between(-3, 10) & F.col("time").isNotNull() & (F.col("depth").isNull() | F.col("depth").between(0, 1000))
    same = events.groupBy(by, "time").agg(
        F.count("*").alias("n"), F.count_if(valid).alias("valid"), F.count_if((F.col("depth") < 5) & (F.col("magnitude") > 7)).alias("odd"), F.count_if(F.col("horizontal_uncertainty") > 0.1).alias("wide"),
    )
    out = same.groupBy(by).agg(F.sum("n").alias("n"), F.sum("valid").alias("valid"), F.max(F.col("n") > 1).alias("repeats"), F.max(F.col("odd") > 0).alias("odd"), F.sum("wide").alias("wide"))
    parts = out.select(by, "n", (100.0 * F.col("valid") / F.col("n")).alias("completeness"), (100.0 - F.when(F.col("repeats"), 10).otherwise(0) - F.when(F.col("odd"), 5).otherwise(0)).alias("consistency"), F.when(F.col("wide") > 0.5 * F.col("n"), 70.0).otherwise(100.0).alias("accuracy"))
    overall = (F.col("completeness") + F.col("consistency") + F.col("accuracy")) / 3
    names = at_least(overall, ((90, "excellent"), (75, "good"), (60, "fair")), "poor")
    return parts.select(by, "n", *[js_round(F.col(x), 4).alias(x) for x in ("completeness", "consistency", "accuracy")], js_round(overall, 4).alias("overall"), names.alias("quality"))


def bounds_problems(boxes: DataFrame) -> DataFrame:
    """Boxes (south, north, west, east) with problems: inverted, huge or tiny."""
    up, along = F.col("north") - F.col("south"), F.col("east") - F.col("west")
    return boxes.withColumn("problems", failing([
        ("inverted", "latitude", "error", up <= 0), ("inverted", "longitude", "error", along <= 0),
        ("huge", "area", "warning", (up > 170) | (along > 350)), ("tiny", "area", "warning", (up < 0.01) & (along < 0.01)),
    ]))


def validity() -> Column:
    """Struct of whether an event's place, magnitude and depth (or none) are in range."""
    c = F.col
    return F.struct(
        (c("latitude").between(-90, 90) & c("longitude").between(-180, 180)).alias("place"), c("magnitude").between(-3, 10).alias("magnitude"), (c("depth").isNull() | c("depth").between(0, 1000)).alias("depth"),
    )


# Closed ranges of the whole schema's numbers, those that must be whole, and the most letters of its texts.
SCHEMA_RANGES = {
    "latitude": (-90, 90), "longitude": (-180, 180), "depth": (0, 1000), "magnitude": (-3, 10), "latitude_uncertainty": (0, 10), "longitude_uncertainty": (0, 10), "depth_uncertainty": (0, 100), "horizontal_uncertainty": (0, 100), "time_uncertainty": (0, 60),
    "magnitude_uncertainty": (0, 5), "azimuthal_gap": (0, 360), "used_phase_count": (0, 1000), "used_station_count": (0, 500), "standard_error": (0, 100), "magnitude_station_count": (0, 500), "minimum_distance": (0, 180), "maximum_distance": (0, 180),
    "associated_phase_count": (0, 10_000), "associated_station_count": (0, 5000), "depth_phase_count": (0, 1000),
}
SCHEMA_LENGTHS = {"magnitude_type": 10, "region": 255, "location_name": 255, "source": 100, "depth_type": 50, "earth_model_id": 100, "method_id": 100, "agency_id": 50, "author": 100, "magnitude_method_id": 100, "magnitude_evaluation_mode": 50, "magnitude_evaluation_status": 50}


def schema_problems(columns: dict[str, str], now: Column | None = None) -> Column:
    """What keeps an event out by the whole schema; columns: the column of each of its fields that is there. Missing values pass but for time, place and magnitude."""
    now = F.current_timestamp() if now is None else now
    c = lambda field: F.col(columns[field])
    rules: list[Rule] = []
    for field, (low, high) in SCHEMA_RANGES.items():
        if field in columns:
            rules.append(("range", field, "error", ~c(field).between(low, high)))
        if field in columns and field.endswith("_count"):
            rules.append(("whole", field, "error", c(field).cast("double") != F.floor(c(field).cast("double"))))
    rules += [("length", field, "error", F.length(c(field)) > most) for field, most in SCHEMA_LENGTHS.items() if field in columns]
    rules += [("missing", field, "error", c(field).isNull()) for field in REQUIRED if field in columns]
    time = c("time").cast("timestamp")
    rules.append(("period", "time", "error", (time < F.lit(EARLIEST).cast("timestamp")) | (time > now)))
    if "depth" in columns:
        rules.append(("shallow_great", "depth", "error", (c("depth") < 5) & (c("magnitude") > 8)))
        if "depth_uncertainty" in columns:
            rules.append(("depth_uncertain", "depth_uncertainty", "error", c("depth_uncertainty") > 2 * c("depth")))
    return failing(rules)


def event_problems() -> Column:
    """Array of texts of what keeps an event out by the plain rules."""
    c, ok = F.col, validity()
    say = lambda condition, text: F.when(F.coalesce(condition, F.lit(False)), text)
    no_place = c("latitude").isNull() | c("longitude").isNull()
    return F.array_compact(F.array(
        say(no_place, "Latitude and longitude are required"), say(~no_place & ~ok["place"], "Invalid coordinates: latitude must be -90 to 90, longitude must be -180 to 180"), say(c("magnitude").isNull(), "Magnitude is required"),
        say(~ok["magnitude"], "Invalid magnitude: must be between -3 and 10"), say(~ok["depth"], "Invalid depth: must be between 0 and 1000 km"), say(c("time").isNull(), "Timestamp is required"),
    ))


# Least score of a passed check, and the bounds below which each part of a report asks for work.
LEAST_SCORE, LEAST_COMPLETE, LEAST_OTHER = 60, 90, 80


def quality_check(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """score (the rounded mean of the report's parts), passed (a mean of 60 or more, and no event out of range) and recommendations of each catalogue."""
    from .statistics import bounds, dataset_anomalies

    ok = F.col("ok")
    marked = events.withColumn("ok", validity())
    wrong = marked.groupBy(by).agg(
        F.count_if(~F.coalesce(ok["place"] & ok["magnitude"] & ok["depth"], F.lit(False))).alias("wrong"), F.count("*").alias("all"),
        F.count_if(F.coalesce("horizontal_uncertainty", "depth_uncertainty", "magnitude_uncertainty").isNotNull()).alias("uncertain"), F.count_if(F.coalesce(F.col("gap"), F.col("stations").cast("double"), F.col("phases").cast("double")).isNotNull()).alias("measured"),
    )
    boxes = bounds_problems(bounds(events, by)).select(by, has_error(F.col("problems")).alias("bad_box"))
    odd = dataset_anomalies(events, by).select(by, ((F.col("extreme") > 0).cast("int") + F.col("too_many_at_zero").cast("int") + (F.col("close") > 0).cast("int")).alias("warnings"))
    x = quality_report(events, by).join(wrong, by).join(boxes, by).join(odd, by)
    mean = (F.col("completeness") + F.col("consistency") + F.col("accuracy")) / 3
    advice = F.array_compact(F.array(
        F.when(F.col("completeness") < LEAST_COMPLETE, "fill required fields"), F.when(F.col("uncertain") < 0.5 * F.col("all"), "add uncertainties"), F.when(F.col("measured") < 0.5 * F.col("all"), "add quality metrics"),
        F.when(F.col("consistency") < LEAST_OTHER, "review repeated or doubtful events"), F.when(F.col("accuracy") < LEAST_OTHER, "improve locations"), F.when(F.col("warnings") > 0, F.format_string("review %d warnings", "warnings")), F.when(F.col("bad_box"), "correct the bounds"),
    ))
    advice = F.when(F.size(advice) == 0, F.array(F.lit("ready to import"))).otherwise(advice)
    return x.select(by, js_round(mean).alias("score"), ((mean >= LEAST_SCORE) & (F.col("wrong") == 0)).alias("passed"), advice.alias("recommendations"))


def strengths(located: Column) -> Column:
    """(name, field, severity) of what speaks for a solution (info) and against it (warning); located: the location component, 0 to 100. Zeros count as unknown."""
    known = lambda name: F.nullif(F.col(name).cast("double"), F.lit(0.0))
    gap, n, rms, unc, status = known("gap"), known("stations"), known("rms"), known("magnitude_uncertainty"), F.col("evaluation_status")
    return failing([
        ("precise_location", "location", "info", located >= 80), ("poor_location", "location", "warning", located < 60), ("good_coverage", "gap", "info", gap < 90), ("poor_coverage", "gap", "warning", gap > 270),
        ("many_stations", "stations", "info", n >= 20), ("few_stations", "stations", "warning", n < 5), ("good_fit", "rms", "info", rms < 0.3), ("poor_fit", "rms", "warning", rms > 1),
        ("precise_magnitude", "magnitude_uncertainty", "info", unc < 0.1), ("uncertain_magnitude", "magnitude_uncertainty", "warning", unc > 0.3), ("reviewed", "evaluation_status", "info", status.isin("reviewed", "final")), ("preliminary", "evaluation_status", "warning", status == "preliminary"),
    ])


def meets_minimum(errors: Column, completeness: Column, score: Column) -> Column:
    return (errors == 0) & (completeness >= 50) & (score >= 60)
