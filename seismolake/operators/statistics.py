"""Statistics of catalogues: every one an aggregation by its keys, never a pass over collected rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismolake.functions.scores import js_round

# Days of a mean month and year.
MONTH_DAYS, YEAR_DAYS = 30.44, 365.25


def bin_of(magnitude: Column, width: float = 0.1) -> Column:
    """The whole number of a magnitude's bin. Doubles, so 2.3 is in the bin of 2.2, as in the source's results."""
    return F.floor(magnitude / F.lit(width)).cast("long")


def magnitude_frequency(events: DataFrame, by: str = "catalogue_id", width: float = 0.1) -> DataFrame:
    """by, bin, n, cumulative: each bin between the smallest and the largest of a group, empty ones too, and the events at or above it."""
    counts = events.where("magnitude is not null").groupBy(by, bin_of(F.col("magnitude"), width).alias("bin")).agg(F.count("*").alias("n"))
    spine = counts.groupBy(by).agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select(by, F.explode(F.sequence("a", "b")).alias("bin"))
    full = spine.join(counts, [by, "bin"], "left").select(by, "bin", F.coalesce("n", F.lit(0)).alias("n"))
    above = Window.partitionBy(by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return full.withColumn("cumulative", F.sum("n").over(above))


def gutenberg_richter(events: DataFrame, by: str = "catalogue_id", least: float = 2.0, width: float = 0.1) -> DataFrame:
    """b and a of the least-squares line of log10 N(>= M) on M, with r2; groups of 10 events and 3 bins at least."""
    line = magnitude_frequency(events.where(F.col("magnitude") >= least), by, width).where("cumulative > 0")
    x, y = F.col("bin") / F.lit(1 / width), F.log10(F.col("cumulative").cast("double"))
    fit = line.groupBy(by).agg(F.sum("n").alias("n_events"), F.count("*").alias("n_bins"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("at_zero"), F.regr_r2(y, x).alias("fit"))
    fit = fit.where("n_events >= 10 and n_bins >= 3")
    return fit.select(by, "n_events", "n_bins", js_round(F.abs("slope"), 6).alias("b_value"), js_round(F.col("at_zero"), 6).alias("a_value"), js_round(F.col("fit"), 6).alias("r2"))


def fit_completeness(events: DataFrame, by: str = "catalogue_id", least: float = 2.0, width: float = 0.1, near: float = 0.2) -> DataFrame:
    """by and completeness: the smallest magnitude, but for the largest bin, whose count of events at or above it lies within `near` (in log10) of the line of `gutenberg_richter`; the smallest of all where none does."""
    line = magnitude_frequency(events.where(F.col("magnitude") >= least), by, width).where("cumulative > 0")
    x, y = F.col("bin") / F.lit(1 / width), F.log10(F.col("cumulative").cast("double"))
    fit = line.groupBy(by).agg(F.sum("n").alias("n_events"), F.count("*").alias("n_bins"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("at_zero"), F.max("bin").alias("top"), F.min("bin").alias("bottom"))
    fit = fit.where("n_events >= 10 and n_bins >= 3")
    apart = F.abs(y - (F.col("at_zero") + F.col("slope") * x))
    fits = line.join(fit, by).groupBy(by).agg(F.min(F.when((apart < near) & (F.col("bin") < F.col("top")), F.col("bin"))).alias("found"), F.first("bottom").alias("bottom"))
    return fits.select(by, js_round(F.coalesce("found", "bottom") / F.lit(1 / width), 1).alias("completeness"))


def type_counts(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """by, magnitude_type (Unknown where it is null or empty), n, and the least, mean and largest magnitude of each."""
    kind = F.coalesce(F.nullif("magnitude_type", F.lit("")), F.lit("Unknown"))
    return events.groupBy(by, kind.alias("magnitude_type")).agg(F.count("*").alias("n"), F.min("magnitude").alias("least"), js_round(F.avg("magnitude"), 6).alias("mean"), F.max("magnitude").alias("largest"))


def quality_summary(scored: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """Of events with a score (0 to 100): n, the mean score, how many have each grade, and the percentages with an uncertainty of place, a mechanism (`mechanism`, boolean) and stations. All events are scored, none sampled."""
    from seismolake.functions.scores import GRADES, grade

    letters = [*dict.fromkeys(g for _, g in GRADES), "F"]
    share = lambda condition, name: js_round(100 * F.count_if(condition) / F.count("*"), 1).alias(name)
    located = reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(0.0)) != 0 for c in ("latitude_uncertainty", "longitude_uncertainty", "depth_uncertainty")])
    graded = scored.withColumn("_grade", grade(F.col("score")))
    counts = [F.count_if(F.col("_grade") == g).alias(f"grade_{g.lower().replace('+', '_plus')}") for g in letters]
    return graded.groupBy(by).agg(F.count("*").alias("n"), js_round(F.avg("score"), 1).alias("mean_score"), *counts, share(located, "with_uncertainty"), share(F.coalesce("mechanism", F.lit(False)), "with_mechanism"), share(F.coalesce("stations", F.lit(0)) > 0, "with_stations"))


def completeness_magnitude(events: DataFrame, by: str = "catalogue_id", width: float = 0.1) -> DataFrame:
    """The fullest bin, the lowest on ties, of groups of 50 events at least; confidence: the share of events at or above it."""
    counts = magnitude_frequency(events, by, width)
    best = counts.groupBy(by).agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("bin"), F.sum("n").alias("n_events")).where("n_events >= 50")
    return best.join(counts.select(by, "bin", "cumulative"), [by, "bin"]).select(by, "n_events", js_round(F.col("bin") / F.lit(1 / width), 1).alias("mc"), js_round(F.col("cumulative") / F.col("n_events"), 6).alias("confidence"))


def upper_median(events: DataFrame, value: str, by: str) -> DataFrame:
    """The element number floor(n / 2), from 0, of each group's sorted values, found by counts of values."""
    counts = events.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    up = Window.partitionBy(by).orderBy(value)
    placed = counts.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    return placed.where("upto > floor(total / 2)").groupBy(by).agg(F.min(value).alias("median"))


def summary(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """Counts and ranges of each group; days: the span in whole days, begun ones too."""
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    out = events.groupBy(by).agg(
        F.count("*").alias("n"), F.min(micros).alias("first_us"), F.max(micros).alias("last_us"),
        F.min("magnitude").alias("min_magnitude"), F.max("magnitude").alias("max_magnitude"), js_round(F.avg("magnitude"), 6).alias("avg_magnitude"),
        F.coalesce(F.min("depth"), F.lit(0.0)).alias("min_depth"), F.coalesce(F.max("depth"), F.lit(0.0)).alias("max_depth"), js_round(F.coalesce(F.avg("depth"), F.lit(0.0)), 6).alias("avg_depth"),
        js_round(F.avg("gap"), 6).alias("avg_gap"), js_round(F.avg("stations"), 6).alias("avg_stations"), F.count("horizontal_uncertainty").alias("with_uncertainty"),
    )
    out = out.withColumn("span_days", F.ceil((F.col("last_us") - F.col("first_us")) / 86_400e6))
    return out.join(upper_median(events, "magnitude", by), by, "left")


def seismic_moment(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """log10 of the summed moment (N m), its magnitude, and the largest event with its share in percent."""
    moment = F.pow(F.lit(10.0), 1.5 * F.col("magnitude") + 9.1)
    out = events.where("magnitude is not null").groupBy(by).agg(F.sum(moment).alias("total"), F.max("magnitude").alias("largest"), F.max(moment).alias("most"))
    return out.select(by, js_round(F.log10("total"), 6).alias("log10_moment"), js_round((F.log10("total") - 9.1) / 1.5, 6).alias("moment_magnitude"), "largest", js_round(100 * F.col("most") / F.col("total"), 4).alias("largest_percent"))


def daily_series(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """by, day (number since 1970), n and the running total."""
    days = events.groupBy(by, F.unix_date(F.to_date("time")).alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("running", F.sum("n").over(Window.partitionBy(by).orderBy("day")))


def rates(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """Events a day, month and year, over a span of a day at least."""
    micros = F.unix_micros(F.col("time").cast("timestamp"))
    out = events.groupBy(by).agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), (F.max(micros) - F.min(micros)) / 86_400e6).alias("days"))
    per = F.col("n") / F.col("days")
    return out.select(by, "n", js_round(per, 6).alias("a_day"), js_round(per * MONTH_DAYS, 4).alias("a_month"), js_round(per * YEAR_DAYS, 4).alias("a_year"))


def weekly_series(events: DataFrame) -> DataFrame:
    """week (day number of its Sunday) and n."""
    day = F.to_date("time")
    return events.groupBy(F.unix_date(F.date_sub(day, F.dayofweek(day) - 1)).alias("week")).agg(F.count("*").alias("n"))


def histogram(events: DataFrame, value: str, edges: tuple[float, ...]) -> DataFrame:
    """edge and n of each half-open bin, empty ones too; values outside all bins are left out."""
    number = F.lit(None).cast("double")
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        number = F.when((F.col(value) >= low) & (F.col(value) < high), F.lit(float(low))).otherwise(number)
    spine = events.sparkSession.createDataFrame([(float(e),) for e in edges[:-1]], "edge double")
    counts = events.groupBy(number.alias("edge")).agg(F.count("*").alias("n"))
    return F.broadcast(spine).join(counts, "edge", "left").select("edge", F.coalesce("n", F.lit(0)).alias("n"))


def top_regions(events: DataFrame, k: int = 10) -> DataFrame:
    """The k regions with most events, by name on ties; null and empty ones are Unknown."""
    name = F.when(F.coalesce("region", F.lit("")) == "", "Unknown").otherwise(F.col("region"))
    return events.groupBy(name.alias("region")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "region").limit(k)


def bounds(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    return events.groupBy(by).agg(F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))


def completeness(events: DataFrame, fields: tuple[str, ...], by: str = "catalogue_id") -> DataFrame:
    """by, field and the percentage of rows that have it, for each field: one pass, then unpivoted."""
    wide = events.groupBy(by).agg(*[js_round(100.0 * F.count(f) / F.count(F.lit(1)), 4).alias(f) for f in fields])
    return wide.unpivot(by, list(fields), "field", "percent")


def with_gaps(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """events with `since`: microseconds since the one before (by time and id) in its group, null for the first. Days are numbered apart; a day's first event follows the last of the latest day before."""
    us, day = F.unix_micros(F.col("time").cast("timestamp")), F.to_date("time")
    days = events.groupBy(F.col(by).alias("_by"), day.alias("_day")).agg(F.max(us).alias("_last"))
    before = days.withColumn("_before", F.lag("_last").over(Window.partitionBy("_by").orderBy("_day"))).drop("_last")
    inside = events.withColumn("_in", us - F.lag(us).over(Window.partitionBy(by, day).orderBy("time", "id")))
    joined = inside.join(before, F.col(by).eqNullSafe(F.col("_by")) & (day == F.col("_day")), "left")
    return joined.withColumn("since", F.coalesce("_in", us - F.col("_before"))).drop("_in", "_before", "_by", "_day")


# The share of events at depth zero, and the seconds between events, that make an anomaly.
MOST_AT_ZERO, CLOSE_SECONDS = 0.1, 1


def dataset_anomalies(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """Counts of extreme magnitudes, great depths, zero depths (and whether these are too many), and events less than a second after the one before."""
    counts = with_gaps(events, by).groupBy(by).agg(
        F.count("*").alias("n"), F.count_if((F.col("magnitude") > 9) | (F.col("magnitude") < -1)).alias("extreme"), F.count_if(F.col("depth") > 700).alias("deep"), F.count_if(F.col("depth") == 0).alias("at_zero"),
        F.count_if(F.col("since") < CLOSE_SECONDS * 1_000_000).alias("close"),
    )
    return counts.withColumn("too_many_at_zero", F.col("at_zero") > F.col("n") * MOST_AT_ZERO)


def frequency_comparison(events: DataFrame, by: str = "catalogue_id", width: float = 0.1) -> DataFrame:
    """magnitude_frequency of all groups, with log10 of the cumulative count, and the range of bins over all groups, for one axis."""
    counts = magnitude_frequency(events, by, width)
    reach = counts.agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))  # one row
    return counts.crossJoin(F.broadcast(reach)).withColumn("log_cumulative", js_round(F.log10(F.col("cumulative").cast("double")), 6))


def display_fit(events: DataFrame, by: str = "catalogue_id", least: float | None = None, width: float = 0.1) -> DataFrame:
    """The variant of displays: b with its sign, a and r2 (0 for a flat line) of the least-squares line, and the middle of the fullest bin; groups of too few events or bins have an error instead."""
    counts = magnitude_frequency(events if least is None else events.where(F.col("magnitude") >= least), by, width)
    x, y = F.when(F.col("cumulative") > 0, F.col("bin") / F.lit(1 / width)), F.log10(F.col("cumulative").cast("double"))
    fit = counts.groupBy(by).agg(
        F.sum("n").alias("n_events"), F.count(x).alias("n_bins"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("at_zero"), F.coalesce(F.regr_r2(y, x), F.lit(0.0)).alias("fit"),
        F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("peak"), F.var_pop(y).alias("spread"),
    )
    error = F.when(F.col("n_events") < 10, "too few events").when(F.col("n_bins") < 3, "too few bins")
    sound = lambda c: F.when(F.col("error").isNull(), c)
    flat = F.when(F.col("spread") > 0, F.col("fit")).otherwise(0.0)
    return fit.withColumn("error", error).select(
        by, "n_events", "error", sound(js_round(-F.col("slope"), 6)).alias("b_value"), sound(js_round(F.col("at_zero"), 6)).alias("a_value"), sound(js_round(flat, 6)).alias("r2"),
        sound(js_round(F.col("peak") / F.lit(1 / width) + width / 2, 2)).alias("completeness"),
    )


def field_completeness(events: DataFrame, required: tuple[str, ...], optional: tuple[str, ...], by: str = "catalogue_id") -> DataFrame:
    """Percentages of required and optional values that are there (not null, not empty), their sum by 0.7 and 0.3, rounded, and how many of each required field are missing."""
    there = lambda f: F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "")
    share = lambda fields: 100.0 * sum(there(f) for f in fields) / (F.count(F.lit(1)) * len(fields)) if fields else F.lit(100.0)
    out = events.groupBy(by).agg(share(required).alias("r"), share(optional).alias("o"), *[(F.count(F.lit(1)) - there(f)).alias(f"missing_{f}") for f in required])
    return out.select(by, js_round(F.col("r")).alias("required"), js_round(F.col("o")).alias("optional"), js_round(F.col("r") * 0.7 + F.col("o") * 0.3).alias("overall"), *[f"missing_{f}" for f in required])


def activity(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """by, start (day number), n and the running total: by days, or by weeks from Sunday where the group spans over 365 days."""
    day = F.unix_date(F.to_date("time"))
    days = events.groupBy(by, day.alias("day")).agg(F.count("*").alias("n"))
    spans = days.groupBy(F.col(by).alias("_by")).agg((F.max("day") - F.min("day")).alias("_span"))
    week = F.col("day") - (F.dayofweek(F.date_from_unix_date("day")) - 1)
    steps = days.join(spans, F.col(by).eqNullSafe(F.col("_by"))).groupBy(by, F.when(F.col("_span") > 365, week).otherwise(F.col("day")).alias("start")).agg(F.sum("n").alias("n"))
    return steps.withColumn("running", F.sum("n").over(Window.partitionBy(by).orderBy("start")))


# Fields of each category of completeness, and the categories' weights.
CATEGORIES = {
    "required": ("id", "time", "latitude", "longitude", "magnitude"), "location": ("depth", "region"), "uncertainty": ("horizontal_uncertainty", "depth_uncertainty", "magnitude_uncertainty"),
    "quality": ("gap", "stations", "phases", "rms", "minimum_distance"), "evaluation": ("magnitude_type", "evaluation_mode", "evaluation_status"),
}
CATEGORY_WEIGHTS = {"required": 0.4, "location": 0.15, "uncertainty": 0.15, "quality": 0.15, "evaluation": 0.15}


def category_completeness(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """Percentages of each category (the mean of its fields), their weighted sum, and events that have all, or only the required fields."""
    share = lambda f: 100.0 * F.count(f) / F.count(F.lit(1))
    means = {name: sum(share(f) for f in fields) / len(fields) for name, fields in CATEGORIES.items()}
    present = lambda fields: F.size(F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), 1) for f in fields]))) == len(fields)
    every = tuple(f for fields in CATEGORIES.values() for f in fields)
    out = events.groupBy(by).agg(*[m.alias(name) for name, m in means.items()], F.count_if(present(every)).alias("full"), F.count_if(present(CATEGORIES["required"])).alias("with_required"))
    overall = sum(F.col(name) * w for name, w in CATEGORY_WEIGHTS.items())
    return out.select(by, *[js_round(F.col(name), 4).alias(name) for name in CATEGORIES], js_round(overall, 4).alias("overall"), "full", "with_required")


def moment_bins(events: DataFrame, by: str = "catalogue_id", width: float = 0.5) -> DataFrame:
    """by, bin, n and log10 of the moment of each bin of magnitude."""
    moment = F.pow(F.lit(10.0), 1.5 * F.col("magnitude") + 9.1)
    return events.where("magnitude is not null").groupBy(by, bin_of(F.col("magnitude"), width).alias("bin")).agg(F.count("*").alias("n"), js_round(F.log10(F.sum(moment)), 6).alias("log10_moment"))


def top_clusters(declustered: DataFrame, k: int = 20) -> DataFrame:
    """The k largest clusters, for displays; the earlier mainshock's id breaks ties."""
    return clusters(declustered).orderBy(F.desc("n"), "mainshock").limit(k)


def cluster_b_values(declustered: DataFrame, least: int = 10) -> DataFrame:
    """mainshock and b_value of the clusters of so many events or more whose magnitudes fill three bins."""
    return gutenberg_richter(declustered, "mainshock", float("-inf")).where(F.col("n_events") >= least).select("mainshock", "n_events", "b_value")


def clusters(declustered: DataFrame, least: int = 3) -> DataFrame:
    """Clusters of `least` events or more of declustered events (mainshock): size, days, largest and second magnitude, and type.

    burst: within a day; swarm: five events or more, the two largest within half a unit; else mainshock-aftershock.
    """
    us = F.unix_micros(F.col("time").cast("timestamp"))
    # The two largest of a group by two aggregates, not a list: the second is the largest of all but the mainshock.
    g = declustered.groupBy("mainshock").agg(F.count("*").alias("n"), ((F.max(us) - F.min(us)) / 86_400e6).alias("days"), F.max("magnitude").alias("largest"), F.max(F.when(F.col("id") != F.col("mainshock"), F.col("magnitude"))).alias("second"))
    kind = F.when(F.col("days") < 1, "burst").when((F.col("n") >= 5) & (F.col("largest") - F.col("second") < 0.5), "swarm").otherwise("mainshock-aftershock")
    return g.where(F.col("n") >= least).select("mainshock", "n", js_round(F.col("days"), 4).alias("days"), "largest", "second", kind.alias("kind"))


def quality_coverage(events: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """How many events have each kind of uncertainty and quality metric, zeros not counted."""
    some = lambda f: F.count_if(F.col(f) != 0).alias(f"with_{f}")
    return events.groupBy(by).agg(F.count("*").alias("n"), *[some(f) for f in ("horizontal_uncertainty", "depth_uncertainty", "magnitude_uncertainty", "gap", "stations", "rms")])


def grade_counts(scored: DataFrame, by: str = "catalogue_id") -> DataFrame:
    """by, grade, n and mean score of events with a score (0 to 100)."""
    from seismolake.functions.scores import grade

    return scored.groupBy(by, grade(F.col("score")).alias("grade")).agg(F.count("*").alias("n"), js_round(F.avg("score"), 4).alias("mean_score"))


def total_events(catalogues: DataFrame) -> DataFrame:
    """One row: the stored numbers of events of all catalogues (events) together."""
    return catalogues.agg(F.coalesce(F.sum("events"), F.lit(0)).alias("total"))


def distinct_values(events: DataFrame, *names: str) -> DataFrame:
    """The different values of columns, without rows in which the last is null or empty."""
    return events.where(F.coalesce(F.col(names[-1]), F.lit("")) != "").select(*names).distinct()


def counts_by(events: DataFrame, *names: str) -> DataFrame:
    """Events of each value of columns, the most first, then by value."""
    return events.groupBy(*names).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *names)


# Grades of completeness by least percentage.
COMPLETENESS_GRADES = ((90, "A", "Excellent"), (75, "B", "Good"), (60, "C", "Fair"), (40, "D", "Poor"))


def completeness_grade(percent: Column) -> Column:
    """Struct of grade and label."""
    out = F.struct(F.lit("F").alias("grade"), F.lit("Very Poor").alias("label"))
    for least, grade, label in reversed(COMPLETENESS_GRADES):
        out = F.when(percent >= least, F.struct(F.lit(grade).alias("grade"), F.lit(label).alias("label"))).otherwise(out)
    return out


def completeness_text(categories: DataFrame) -> DataFrame:
    """category_completeness with grade, label and a text that says so."""
    graded = categories.withColumn("_g", completeness_grade(F.col("overall")))
    parts = [F.format_string(f"{name} %.1f%%", js_round(F.col(name), 1)) for name in CATEGORIES]
    text = F.concat(F.format_string("Overall %.1f%% (", js_round(F.col("overall"), 1)), F.col("_g.grade"), F.lit(", "), F.col("_g.label"), F.lit("): "), F.concat_ws(", ", *parts))
    return graded.withColumns({"grade": F.col("_g.grade"), "label": F.col("_g.label"), "text": text}).drop("_g")


def box_text(boxes: DataFrame) -> DataFrame:
    """Boxes with area in square degrees, centre and a text."""
    say = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    return boxes.withColumns({
        "area": (F.col("north") - F.col("south")) * (F.col("east") - F.col("west")), "mid_latitude": (F.col("north") + F.col("south")) / 2, "mid_longitude": (F.col("east") + F.col("west")) / 2,
        "text": F.concat_ws(" ", say("south"), F.lit("to"), say("north"), F.lit("by"), say("west"), F.lit("to"), say("east")),
    })


def peak_completeness(events: DataFrame, by: str = "catalogue_id", width: float = 0.1) -> DataFrame:
    """The variant of displays: the middle of the fullest bin, the lowest on ties, of any group that has events."""
    counts = events.where("magnitude is not null").groupBy(by, bin_of(F.col("magnitude"), width).alias("bin")).agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("bin"), F.sum("n").alias("n_events"))
    return best.select(by, "n_events", js_round(F.col("bin") / F.lit(1 / width) + width / 2, 2).alias("mc"))


def thinned_series(events: DataFrame, by: str = "catalogue_id", most: int = 500) -> DataFrame:
    """The daily series with every k-th day, so that at most `most` are left in a group."""
    series = daily_series(events, by)
    own = Window.partitionBy(by)
    ranked = series.withColumn("_r", F.row_number().over(own.orderBy("day"))).withColumn("_every", F.ceil(F.count("*").over(own) / most))
    return ranked.where((F.col("_r") - 1) % F.col("_every") == 0).drop("_r", "_every")
