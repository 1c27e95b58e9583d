"""Registered queries of the catalogue operators, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seismolake.functions import geo, scores, stations
from seismolake.functions.scores import js_round
from seismolake.operators import match, search, statistics, validation
from seismolake.plans.catalogue import FAULTS, catalogue, faults, oracle_view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

MAGNITUDE_EDGES = (2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 10.0)
DEPTH_EDGES = (0.0, 10.0, 20.0, 30.0, 40.0, 1000.0)
COMPLETENESS_FIELDS = ("depth", "stations", "phases", "gap", "rms", "magnitude_type", "evaluation_mode", "region")
COMPLETE_FIELDS = ("depth", "stations", "phases", "gap", "rms", "magnitude_type", "evaluation_mode", "evaluation_status", "region")
NAMES = ((0, "North network"), (1, "South network"), (2, "Ocean network"), (3, "Second agency"))


def query(oracle: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of the catalogue's events; oracle: SQL over q, the same events."""
    def register(f: Callable) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(catalogue(spark, sf_dir))
        if oracle:
            _ORACLES[f.__name__] = f"WITH RECURSIVE {oracle_view()}{',' if oracle.lstrip().startswith('+') else ''} {oracle.lstrip().removeprefix('+')}"
        return f

    return register


def rounded(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def km_sql(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2))"
    return f"(2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def steps_sql(x: str, steps: scores.Steps, other: object, sign: str) -> str:
    say = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"CASE {' '.join(f'WHEN {x} {sign} {bound} THEN {say(v)}' for bound, v in steps)} ELSE {say(other)} END"


US = "epoch_us(time)"

# Filters, search and paging


@query("SELECT id, catalogue_id, magnitude, depth FROM q WHERE magnitude BETWEEN 3 AND 6 AND depth <= 200 AND gap <= 180 AND stations >= 10 AND latitude >= -45 AND evaluation_mode = 'manual' AND event_type = 'earthquake'")
def f1_event_filter(q: DataFrame) -> DataFrame:
    wanted = search.EventFilter(least_magnitude=3, most_magnitude=6, most_depth=200, most_gap=180, least_stations=10, south=-45, mode="manual", event_type="earthquake")
    return q.where(wanted.column()).select("id", "catalogue_id", "magnitude", "depth")


@query("SELECT id, magnitude FROM q WHERE magnitude >= 2.5 AND magnitude < 5 AND lower(coalesce(region, '')) LIKE '%click%' AND (CAST(id AS VARCHAR) LIKE '%ms%' OR lower(coalesce(region, '')) LIKE '%ms%' OR lower(coalesce(event_type, '')) LIKE '%ms%' OR lower(coalesce(magnitude_type, '')) LIKE '%ms%')")
def f3_search(q: DataFrame) -> DataFrame:
    return search.search(q, "mag:>=2.5 mag:<5 region:click Ms").select("id", "magnitude")


# Queries of the search language and the SQL conditions that say the same, over events with all columns of text.
_SAYS = lambda *columns: lambda value: "(" + " OR ".join(f"contains(lower(coalesce(CAST({c} AS VARCHAR), '')), '{value}')" for c in columns) + ")"
_ANY = _SAYS("event_public_id", "event_type", "id", "region", "location_name", "magnitude_type", "agency_id", "author")
_PLACE = _SAYS("region", "location_name")
SEARCHES = {
    "id:17": _SAYS("id", "event_public_id")("17"), "public:NET/12": _SAYS("event_public_id")("net/12"), "type:explo": _SAYS("event_type")("explo"), "EVENT:Quake": _SAYS("event_type")("quake"), "region:click": _PLACE("click"), "loc:bay": _PLACE("bay"),
    'location:"north bay" mag:2..6': f"{_PLACE('north bay')} AND magnitude BETWEEN 2 AND 6", "mode:manual depth:<=30": "evaluation_mode LIKE '%manual%' AND depth <= 30", "status:final": "evaluation_status LIKE '%final%'", "geonet": _ANY("geonet"), "Mw auth7": f"{_ANY('mw')} AND {_ANY('auth7')}",
    "bay mag:high depth:5": f"{_ANY('bay')} AND depth = 5", "mag:-1": "false", "date:soon time:2024-01-02..2024-01-03": "time >= TIMESTAMP '2024-01-02' AND time < TIMESTAMP '2024-01-04'", "a": "false", "% _": f"{_ANY('%')} AND {_ANY('_')}", "colour:red type:": "false", "smi:": _ANY("smi:"),
}
_TEXTS = "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('smi:net/', CAST(id AS VARCHAR)) END AS event_public_id, CASE id % 7 WHEN 0 THEN 'North Bay' WHEN 1 THEN 'Bay, 100% _here' ELSE NULL END AS location_name, source AS agency_id, CASE WHEN id % 3 = 0 THEN NULL ELSE concat('auth', CAST(id % 11 AS VARCHAR)) END AS author"


@query(f"+e AS (SELECT *, {_TEXTS} FROM q) " + " UNION ALL ".join(f"SELECT '{k}' AS search, id FROM e WHERE {sql}" for k, sql in SEARCHES.items()))
def f4_search_tokens(q: DataFrame) -> DataFrame:
    events = q.withColumns({
        "event_public_id": F.when(F.col("id") % 5 != 0, F.concat(F.lit("smi:net/"), F.col("id").cast("string"))), "location_name": F.when(F.col("id") % 7 == 0, "North Bay").when(F.col("id") % 7 == 1, "Bay, 100% _here"),
        "agency_id": F.col("source"), "author": F.when(F.col("id") % 3 != 0, F.concat(F.lit("auth"), (F.col("id") % 11).cast("string"))),
    })
    found = [search.search(events, text).select(F.lit(text).alias("search"), "id") for text in SEARCHES]
    return reduce(DataFrame.unionAll, found)


@query("SELECT id, depth FROM q WHERE depth BETWEEN 10 AND 50 AND magnitude > 2")
def f5_search_numbers(q: DataFrame) -> DataFrame:
    return search.search(q, "depth:10..50 mag:>2").select("id", "depth")


@query("SELECT id FROM q WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-02-01'")
def f6_search_dates(q: DataFrame) -> DataFrame:
    return search.search(q, "date:2024-01").select("id")


@query("SELECT id, catalogue_id FROM q WHERE catalogue_id IN (0, 1, 2) AND magnitude >= 3")
def f7_search_catalogue(q: DataFrame) -> DataFrame:
    names = q.sparkSession.createDataFrame(NAMES, "catalogue_id long, name string")
    return search.search(q, "catalogue:network mag:>=3", names).select("id", "catalogue_id")


@query("+b AS (SELECT catalogue_id, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east FROM q GROUP BY 1) SELECT catalogue_id, south, north FROM b WHERE south <= -40 AND north >= -50 AND (west <= -170 OR east >= 175)")
def f8_region_overlap(q: DataFrame) -> DataFrame:
    return search.overlapping(statistics.bounds(q), -50, -40, 175, -170).select("catalogue_id", "south", "north")


@query("SELECT id FROM q WHERE latitude BETWEEN -42 AND -38 AND longitude BETWEEN 172 AND 176")
def f10_box(q: DataFrame) -> DataFrame:
    return q.where(geo.in_box(F.col("latitude"), F.col("longitude"), -42, -38, 172, 176)).select("id")


@query("SELECT id FROM q WHERE magnitude BETWEEN 2 AND 8 AND depth BETWEEN 0 AND 100 AND CASE WHEN coalesce(region, '') = '' THEN 'Unknown' ELSE region END IN ('view', 'click', 'Unknown') AND catalogue_id IN (0, 3, 4) AND time >= TIMESTAMP '2024-01-24 06:00:00' - INTERVAL 7 DAY")
def f12_dashboard_filter(q: DataFrame) -> DataFrame:
    return search.dashboard(q, (2, 8), (0, 100), ("view", "click", "Unknown"), (0, 3, 4), "week", "2024-01-24 06:00:00").select("id")


@query("SELECT count(*) FILTER (WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180) AS in_range, count(*) FILTER (WHERE magnitude BETWEEN -3 AND 10) AS sized, count(*) FILTER (WHERE depth IS NULL OR depth BETWEEN 0 AND 1000) AS placed FROM q")
def f16_validity(q: DataFrame) -> DataFrame:
    ok = q.select(validation.validity().alias("ok"))
    return ok.agg(F.count_if("ok.place").alias("in_range"), F.count_if("ok.magnitude").alias("sized"), F.count_if("ok.depth").alias("placed"))


@query("SELECT id, magnitude FROM q ORDER BY time DESC, id DESC LIMIT 50 OFFSET 100")
def l1_page(q: DataFrame) -> DataFrame:
    return search.page(q, 3, 50).select("id", "magnitude")


@query("SELECT id, magnitude, CAST((SELECT count(*) FROM q WHERE magnitude >= 2) AS BIGINT) AS total FROM q WHERE magnitude >= 2 ORDER BY time DESC, id DESC LIMIT 50 OFFSET 50")
def l1_page_and_total(q: DataFrame) -> DataFrame:
    rows, total = search.page_and_total(q.where("magnitude >= 2"), 2, 50)
    return q.sparkSession.createDataFrame([(r.id, r.magnitude, total) for r in rows], "id long, magnitude double, total long")


@query("SELECT id, magnitude FROM q WHERE time < TIMESTAMP '2024-01-20' OR time = TIMESTAMP '2024-01-20' AND id < 5 ORDER BY time DESC, id DESC LIMIT 40")
def l2_page_after(q: DataFrame) -> DataFrame:
    return search.page_after(q, "2024-01-20", 5, 40).select("id", "magnitude")


@query("SELECT id, catalogue_id, CASE WHEN id % 2 = 0 THEN 'updated' WHEN magnitude NOT BETWEEN -3 AND 10 OR depth > 1000 THEN 'error' ELSE 'new' END AS action FROM q")
def j9_import_actions(q: DataFrame) -> DataFrame:
    return search.classify_import(q.where("id % 2 = 0"), q).select("id", "catalogue_id", "action")


@query(f"SELECT q.id, n.name FROM q LEFT JOIN (VALUES {', '.join(f'({k}, {chr(39)}{n}{chr(39)})' for k, n in NAMES)}) n(catalogue_id, name) ON n.catalogue_id = q.catalogue_id")
def j10_names(q: DataFrame) -> DataFrame:
    names = q.sparkSession.createDataFrame(NAMES, "catalogue_id long, name string")
    return search.labelled(q, names).select("id", "name")


# Statistics

_MFD = "+h AS (SELECT catalogue_id, CAST(floor(magnitude / CAST(0.1 AS DOUBLE)) AS BIGINT) AS bin, count(*) AS n FROM q WHERE {where} GROUP BY 1, 2), r AS (SELECT catalogue_id, min(bin) AS a, max(bin) AS b FROM h GROUP BY 1), s AS (SELECT r.catalogue_id, k.bin FROM r JOIN (SELECT unnest(range(-30, 101)) AS bin) k ON k.bin BETWEEN r.a AND r.b), m AS (SELECT s.catalogue_id, s.bin, coalesce(h.n, 0) AS n, CAST(sum(coalesce(h.n, 0)) OVER (PARTITION BY s.catalogue_id ORDER BY s.bin DESC) AS BIGINT) AS cumulative FROM s LEFT JOIN h ON h.catalogue_id = s.catalogue_id AND h.bin = s.bin)"


@query(f"+u AS (SELECT catalogue_id, magnitude AS median FROM (SELECT catalogue_id, magnitude, row_number() OVER (PARTITION BY catalogue_id ORDER BY magnitude) AS r, count(*) OVER (PARTITION BY catalogue_id) AS n FROM q) WHERE r = floor(n / 2) + 1), g AS (SELECT catalogue_id, count(*) AS n, min({US}) AS first_us, max({US}) AS last_us, min(magnitude) AS min_magnitude, max(magnitude) AS max_magnitude, {rounded('avg(magnitude)')} AS avg_magnitude, coalesce(min(depth), 0) AS min_depth, coalesce(max(depth), 0) AS max_depth, {rounded('coalesce(avg(depth), 0)')} AS avg_depth, {rounded('avg(gap)')} AS avg_gap, {rounded('avg(stations)')} AS avg_stations, count(horizontal_uncertainty) AS with_uncertainty FROM q GROUP BY 1) SELECT g.*, CAST(ceil((last_us - first_us) / 86400e6) AS BIGINT) AS span_days, median FROM g JOIN u USING (catalogue_id)")
def a1_summary(q: DataFrame) -> DataFrame:
    return statistics.summary(q)


@query(_MFD.format(where="magnitude IS NOT NULL") + " SELECT * FROM m")
def a2_magnitude_frequency(q: DataFrame) -> DataFrame:
    return statistics.magnitude_frequency(q)


@query(_MFD.format(where="magnitude IS NOT NULL") + f" SELECT m.*, (SELECT min(bin) FROM m) AS first_bin, (SELECT max(bin) FROM m) AS last_bin, {rounded('log10(CAST(cumulative AS DOUBLE))')} AS log_cumulative FROM m")
def a3_frequency_comparison(q: DataFrame) -> DataFrame:
    return statistics.frequency_comparison(q)


_LINE = "log10(CAST(cumulative AS DOUBLE)), CAST(bin AS DOUBLE) / 10"


@query(_MFD.format(where="magnitude >= 2") + f" SELECT catalogue_id, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_bins, {rounded(f'abs(regr_slope({_LINE}))')} AS b_value, {rounded(f'regr_intercept({_LINE})')} AS a_value, {rounded(f'regr_r2({_LINE})')} AS r2 FROM m WHERE cumulative > 0 GROUP BY 1 HAVING sum(n) >= 10 AND count(*) >= 3")
def a4_gutenberg_richter(q: DataFrame) -> DataFrame:
    return statistics.gutenberg_richter(q)


@query(_MFD.format(where="magnitude >= 2") + f", f AS (SELECT catalogue_id, regr_slope({_LINE}) AS slope, regr_intercept({_LINE}) AS zero, max(bin) AS top, min(bin) AS bottom FROM m WHERE cumulative > 0 GROUP BY 1 HAVING sum(n) >= 10 AND count(*) >= 3) SELECT catalogue_id, {rounded('coalesce(min(bin) FILTER (WHERE bin < top AND abs(log10(CAST(cumulative AS DOUBLE)) - (zero + slope * CAST(bin AS DOUBLE) / 10)) < 0.2), any_value(bottom)) / CAST(10 AS DOUBLE)', 1)} AS completeness FROM m JOIN f USING (catalogue_id) WHERE cumulative > 0 GROUP BY 1")
def a4_fit_completeness(q: DataFrame) -> DataFrame:
    return statistics.fit_completeness(q)


@query(f"SELECT catalogue_id, coalesce(nullif(magnitude_type, ''), 'Unknown') AS magnitude_type, count(*) AS n, min(magnitude) AS least, {rounded('avg(magnitude)')} AS mean, max(magnitude) AS largest FROM q GROUP BY 1, 2")
def a1_type_counts(q: DataFrame) -> DataFrame:
    return statistics.type_counts(q)


@query(_MFD.format(where="magnitude IS NOT NULL") + f" SELECT catalogue_id, n_events, {rounded('bin / CAST(10 AS DOUBLE)', 1)} AS mc, {rounded('cumulative / CAST(n_events AS DOUBLE)')} AS confidence FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY catalogue_id) AS BIGINT) AS n_events, row_number() OVER (PARTITION BY catalogue_id ORDER BY n DESC, bin) AS r FROM m) WHERE r = 1 AND n_events >= 50")
def a5_completeness_magnitude(q: DataFrame) -> DataFrame:
    return statistics.completeness_magnitude(q)


@query("+d AS (SELECT catalogue_id, CAST(date_diff('day', DATE '1970-01-01', CAST(time AS DATE)) AS INTEGER) AS day, count(*) AS n FROM q GROUP BY 1, 2) SELECT *, CAST(sum(n) OVER (PARTITION BY catalogue_id ORDER BY day) AS BIGINT) AS running FROM d")
def a6_daily_series(q: DataFrame) -> DataFrame:
    return statistics.daily_series(q)


@query(f"+r AS (SELECT catalogue_id, count(*) AS n, greatest(1.0, (max({US}) - min({US})) / 86400e6) AS days FROM q GROUP BY 1) SELECT catalogue_id, n, {rounded('n / days')} AS a_day, {rounded('n / days * 30.44', 4)} AS a_month, {rounded('n / days * 365.25', 4)} AS a_year FROM r")
def a6_rates(q: DataFrame) -> DataFrame:
    return statistics.rates(q)


@query(f"+s AS (SELECT catalogue_id, sum(pow(10, 1.5 * magnitude + 9.1)) AS total, max(magnitude) AS largest, max(pow(10, 1.5 * magnitude + 9.1)) AS most FROM q GROUP BY 1) SELECT catalogue_id, {rounded('log10(total)')} AS log10_moment, {rounded('(log10(total) - 9.1) / 1.5')} AS moment_magnitude, largest, {rounded('100 * most / total', 4)} AS largest_percent FROM s")
def a8_moment(q: DataFrame) -> DataFrame:
    return statistics.seismic_moment(q)


def _edges_sql(value: str, edges: tuple[float, ...]) -> str:
    return f"SELECT e.edge, count(q.id) AS n FROM (VALUES {', '.join(f'(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))' for a, b in zip(edges, edges[1:], strict=False))}) e(edge, upto) LEFT JOIN q ON q.{value} >= e.edge AND q.{value} < e.upto GROUP BY 1"


@query(_edges_sql("magnitude", MAGNITUDE_EDGES))
def a14_magnitude_histogram(q: DataFrame) -> DataFrame:
    return statistics.histogram(q, "magnitude", MAGNITUDE_EDGES)


@query(_edges_sql("depth", DEPTH_EDGES))
def a15_depth_histogram(q: DataFrame) -> DataFrame:
    return statistics.histogram(q, "depth", DEPTH_EDGES)


@query("SELECT CASE WHEN coalesce(region, '') = '' THEN 'Unknown' ELSE region END AS region, count(*) AS n FROM q GROUP BY 1 ORDER BY n DESC, region LIMIT 10")
def a16_top_regions(q: DataFrame) -> DataFrame:
    return statistics.top_regions(q)


@query("SELECT catalogue_id, count(*) AS n FROM q GROUP BY 1")
def a17_catalogue_counts(q: DataFrame) -> DataFrame:
    return statistics.counts_by(q, "catalogue_id")


@query("SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(time AS DATE) - CAST(dayofweek(time) AS INTEGER)) AS INTEGER) AS week, count(*) AS n FROM q GROUP BY 1")
def a18_weekly_series(q: DataFrame) -> DataFrame:
    return statistics.weekly_series(q)


@query("SELECT DISTINCT catalogue_id, region FROM q WHERE region <> ''")
def a20_distinct_regions(q: DataFrame) -> DataFrame:
    return statistics.distinct_values(q, "catalogue_id", "region")


@query("SELECT catalogue_id, field, percent FROM (" + " UNION ALL ".join(f"SELECT catalogue_id, '{f}' AS field, {rounded(f'100.0 * count({f}) / count(*)', 4)} AS percent FROM q GROUP BY 1" for f in COMPLETENESS_FIELDS) + ")")
def a21_completeness(q: DataFrame) -> DataFrame:
    return statistics.completeness(q, COMPLETENESS_FIELDS)


@query(f"+l AS (SELECT *, {US} - lag({US}) OVER (PARTITION BY catalogue_id ORDER BY time, id) AS since FROM q) SELECT catalogue_id, count(*) AS n, count(*) FILTER (WHERE depth = 0) > 0.1 * count(*) AS too_many_at_zero, count(*) FILTER (WHERE magnitude > 9 OR magnitude < -1) AS extreme, count(*) FILTER (WHERE depth > 700) AS deep, count(*) FILTER (WHERE depth = 0) AS at_zero, count(*) FILTER (WHERE since < 1000000) AS close FROM l GROUP BY 1")
def a25_dataset_anomalies(q: DataFrame) -> DataFrame:
    return statistics.dataset_anomalies(q)


@query("SELECT catalogue_id, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east FROM q GROUP BY 1")
def a28_bounds(q: DataFrame) -> DataFrame:
    return statistics.bounds(q)


# Scores

_SIX = {
    "gap": f"CASE WHEN gap IS NULL THEN 0 ELSE {steps_sql('gap', scores.GAP_STEPS, 0, '<=')} END",
    "stations": f"CASE WHEN stations IS NULL THEN 0 ELSE {steps_sql('stations', scores.STATION_STEPS, 0, '>=')} END",
    "rms": f"CASE WHEN rms IS NULL THEN 0 ELSE {steps_sql('rms', scores.RMS_STEPS, 0, '<=')} END",
    "horizontal": f"CASE WHEN horizontal_uncertainty IS NULL THEN 0 ELSE {steps_sql('horizontal_uncertainty * 111', scores.HORIZONTAL_STEPS, 0, '<=')} END",
    "depth": f"CASE WHEN depth_uncertainty IS NULL THEN 0 ELSE {steps_sql('depth_uncertainty', scores.DEPTH_STEPS, 0, '<=')} END",
    "distance": f"CASE WHEN minimum_distance IS NULL THEN 3 ELSE {steps_sql('minimum_distance', scores.DISTANCE_STEPS, 0, '<=')} END",
}


def _six(q: DataFrame) -> dict[str, Column]:
    return scores.six_scores(F.col("gap"), F.col("stations"), F.col("rms"), F.col("horizontal_uncertainty") * 111, F.col("depth_uncertainty"), F.col("minimum_distance"))


@query(f"SELECT id, {', '.join(f'{sql} AS s_{name}' for name, sql in _SIX.items())}, least({', '.join(_SIX.values())}) AS score FROM q")
def e8_six_criteria(q: DataFrame) -> DataFrame:
    six = _six(q)
    return q.select("id", *[c.alias(f"s_{name}") for name, c in six.items()], F.least(*six.values()).alias("score"))


_COSTS = {
    "location": "CASE WHEN coalesce(horizontal_uncertainty, 0) > 0 THEN least(40, horizontal_uncertainty * 444) ELSE 20 END + CASE WHEN depth_uncertainty IS NULL THEN 15 ELSE least(30, depth_uncertainty * 3) END + CASE WHEN time_uncertainty IS NULL THEN 10 ELSE least(30, time_uncertainty * 30) END",
    "network": "CASE WHEN gap IS NULL THEN 25 WHEN gap < 90 THEN 0 WHEN gap < 180 THEN (gap - 90) / 2 ELSE 45 + least(5, (gap - 180) / 18) END + CASE WHEN stations IS NULL THEN 15 WHEN stations >= 20 THEN 0 WHEN stations >= 10 THEN (20 - stations) * 1.5 WHEN stations >= 5 THEN 15 + (10 - stations) * 2 ELSE 25 + 5 - stations END + CASE WHEN phases IS NULL THEN 10 WHEN phases >= 30 THEN 0 WHEN phases >= 15 THEN (30 - phases) / 2 WHEN phases >= 8 THEN 7.5 + (15 - phases) * 0.8 ELSE 13 + least(7, 8 - phases) END",
    "solution": "CASE WHEN rms IS NULL THEN 30 WHEN rms < 0.3 THEN 0 WHEN rms < 0.5 THEN (rms - 0.3) * 100 WHEN rms < 1 THEN 20 + (rms - 0.5) * 60 ELSE 50 + least(50, (rms - 1) * 50) END",
    "magnitude": "CASE WHEN magnitude_uncertainty IS NULL THEN 20 ELSE least(60, magnitude_uncertainty * 120) END + CASE WHEN magnitude_stations IS NULL THEN 20 WHEN magnitude_stations >= 10 THEN 0 WHEN magnitude_stations >= 5 THEN (10 - magnitude_stations) * 4 WHEN magnitude_stations >= 3 THEN 20 + (5 - magnitude_stations) * 5 ELSE 30 + (3 - magnitude_stations) * 5 END",
    "evaluation": "CASE WHEN evaluation_mode = 'automatic' THEN 20 ELSE 0 END + CASE evaluation_status WHEN 'confirmed' THEN 10 WHEN 'preliminary' THEN 30 ELSE 0 END",
}


def _components(q: DataFrame) -> dict[str, Column]:
    c = F.col
    return scores.components(c("horizontal_uncertainty"), c("depth_uncertainty"), c("time_uncertainty"), c("gap"), c("stations"), c("phases"), c("rms"), c("magnitude_uncertainty"), c("magnitude_stations"), c("evaluation_mode"), c("evaluation_status"))


@query(f"+s AS (SELECT id, {', '.join(f'greatest(0, 100 - CAST(({x}) AS DOUBLE)) AS {n}' for n, x in _COSTS.items())} FROM q) SELECT id, {', '.join(f'{rounded(n, 4)} AS {n}' for n in _COSTS)}, {rounded('0.35 * location + 0.25 * network + 0.15 * solution + 0.15 * magnitude + 0.1 * evaluation', 4)} AS overall FROM s")
def e1_quality_score(q: DataFrame) -> DataFrame:
    parts = _components(q)
    return q.select("id", *[js_round(c, 4).alias(n) for n, c in parts.items()], js_round(scores.overall(parts), 4).alias("overall"))


@query("SELECT catalogue_id, CASE WHEN gap < 90 AND stations >= 10 THEN 'excellent' WHEN gap < 180 AND stations >= 6 THEN 'good' WHEN gap < 270 AND stations >= 4 THEN 'fair' ELSE 'poor' END AS class, count(*) AS n FROM q GROUP BY ALL")
def e32_coverage_classes(q: DataFrame) -> DataFrame:
    return q.groupBy("catalogue_id", stations.coverage_class(F.col("gap"), F.col("stations")).alias("class")).agg(F.count("*").alias("n"))


_MW = f"CASE WHEN lower(magnitude_type) LIKE 'mw%' THEN magnitude WHEN lower(magnitude_type) LIKE 'ms%' THEN {rounded('CASE WHEN magnitude < 6.2 THEN 0.67 * magnitude + 2.07 ELSE 0.99 * magnitude + 0.08 END', 2)} WHEN lower(magnitude_type) = 'mb' THEN {rounded('0.85 * magnitude + 1.03', 2)} WHEN lower(magnitude_type) LIKE 'ml%' OR lower(magnitude_type) IN ('md', 'mc') THEN {rounded('0.67 * magnitude + 1.17', 2)} END"


@query(f"SELECT id, {_MW} AS mw FROM q")
def e25_moment_magnitude(q: DataFrame) -> DataFrame:
    return q.select("id", scores.moment_magnitude(F.col("magnitude"), F.col("magnitude_type")).alias("mw"))


@query(f"SELECT id, {steps_sql('magnitude', scores.TIME_BY_MAGNITUDE, 3.0, '<')} AS t, {steps_sql('magnitude', scores.DISTANCE_BY_MAGNITUDE, 4.0, '<')} AS d, CAST(CASE WHEN depth > 300 THEN 1.5 WHEN depth > 100 THEN 1.2 ELSE 1.0 END AS DOUBLE) AS z FROM q")
def e27_multipliers(q: DataFrame) -> DataFrame:
    m = F.col("magnitude")
    return q.select("id", scores.time_multiplier(m).alias("t"), scores.distance_multiplier(m).alias("d"), scores.depth_multiplier(F.col("depth")).alias("z"))


@query(f"+s AS (SELECT catalogue_id, " + " + ".join(f"{w} * greatest(0, 100 - CAST(({_COSTS[n]}) AS DOUBLE))" for n, w in scores.WEIGHTS.items()) + f" AS exact FROM q), o AS (SELECT catalogue_id, {rounded('exact')} AS x FROM s) SELECT catalogue_id, {steps_sql('x', scores.GRADES, 'F', '>=')} AS grade, count(*) AS n, {rounded('avg(x)', 4)} AS mean_score FROM o GROUP BY 1, 2")
def e34_grades(q: DataFrame) -> DataFrame:
    return statistics.grade_counts(q.select("catalogue_id", js_round(scores.overall(_components(q)), 6).alias("score")))


_LETTERS = (("A+", "a_plus"), ("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("F", "f"))


@query(f"+s AS (SELECT *, " + " + ".join(f"{w} * greatest(0, 100 - CAST(({_COSTS[n]}) AS DOUBLE))" for n, w in scores.WEIGHTS.items()) + f" AS exact FROM q), o AS (SELECT *, {rounded('exact')} AS x FROM s), g AS (SELECT *, {steps_sql('x', scores.GRADES, 'F', '>=')} AS grade FROM o) SELECT catalogue_id, count(*) AS n, {rounded('avg(x)', 1)} AS mean_score, " + ", ".join(f"count(*) FILTER (WHERE grade = '{letter}') AS grade_{name}" for letter, name in _LETTERS) + ", " + ", ".join(f"{rounded(f'100 * count(*) FILTER (WHERE {sql}) / CAST(count(*) AS DOUBLE)', 1)} AS with_{name}" for name, sql in {"uncertainty": "latitude_uncertainty <> 0 OR longitude_uncertainty <> 0 OR depth_uncertainty <> 0", "mechanism": "n_mechanisms > 0", "stations": "stations > 0"}.items()) + " FROM g GROUP BY 1")
def a19_quality_summary(q: DataFrame) -> DataFrame:
    return statistics.quality_summary(q.withColumns({"score": js_round(scores.overall(_components(q)), 6), "mechanism": F.col("n_mechanisms") > 0}))


_CENTRE = "(SELECT -41.0 AS latitude, 174.0 AS longitude)"


@query(f"SELECT q.id, {rounded(km_sql('q', 'c'), 4)} AS km, {rounded('pow(10, 0.1238 * magnitude + 0.983)', 4)} AS window_km FROM q, {_CENTRE} c")
def x1_distances(q: DataFrame) -> DataFrame:
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(-41.0), F.lit(174.0))
    return q.select("id", js_round(km, 4).alias("km"), js_round(match.window_km(F.col("magnitude")), 4).alias("window_km"))


# Matching

_ORDER = "(a.time, a.catalogue_id, a.id) < (b.time, b.catalogue_id, b.id)"
_DT = "((epoch_us(b.time) - epoch_us(a.time)) / 1e6)"
_MEAN = "((a.magnitude + b.magnitude) / 2)"
_CELL = 25 / 111.32
_ADAPTIVE = f"""p AS (SELECT a.id AS a_id, b.id AS b_id, {_DT} AS dt, {km_sql('a', 'b')} AS km, {_MEAN} AS mean, a.magnitude AS m, greatest(a.depth, b.depth) AS z,
 abs(floor(a.latitude / {_CELL}) - floor(b.latitude / {_CELL})) AS up, abs(floor(a.longitude / {_CELL}) - floor(b.longitude / {_CELL})) % 1602 AS along FROM q a JOIN q b ON {_ORDER} AND b.time <= a.time + INTERVAL 90 SECOND),
 e AS (SELECT * FROM p WHERE dt <= 30 * ({steps_sql('mean', scores.TIME_BY_MAGNITUDE, 3.0, '<')}) AND dt <= 30 * ({steps_sql('m', scores.TIME_BY_MAGNITUDE, 3.0, '<')}) AND km <= 25 * ({steps_sql('mean', scores.DISTANCE_BY_MAGNITUDE, 4.0, '<')}) * (CASE WHEN z > 300 THEN 1.5 WHEN z > 100 THEN 1.2 ELSE 1.0 END) AND up <= 1 AND least(along, 1602 - along) <= 1)"""


@query(f"+{_ADAPTIVE} SELECT a_id, b_id, {rounded('km')} AS km FROM e")
def j1_adaptive_matches(q: DataFrame) -> DataFrame:
    return match.adaptive_matches(q).select("a_id", "b_id", js_round(F.col("km"), 6).alias("km"))


_SCORE = "exp(-ln(2) * pow(({}) / ({}), 2))"
_PARTS = f"0.3 * {_SCORE.format('dt', '30')} + 0.4 * {_SCORE.format('km', '25')} + 0.2 * {_SCORE.format('dm', '0.5')}"
_SIMILAR = f"""p AS (SELECT a.id AS a_id, b.id AS b_id, {_DT} AS dt, {km_sql('a', 'b')} AS km, abs(a.magnitude - b.magnitude) AS dm, abs(a.depth - b.depth) AS dz FROM q a JOIN q b ON {_ORDER} AND b.time <= a.time + INTERVAL 30 SECOND),
 s AS (SELECT *, CASE WHEN dz IS NULL THEN ({_PARTS}) / 0.9 ELSE ({_PARTS} + 0.1 * {_SCORE.format('dz', '20')}) / 1.0 END AS score, concat_ws(', ', CASE WHEN dt < 5 THEN 'very close in time' WHEN dt < 30 THEN 'close in time' END, CASE WHEN km < 5 THEN 'very close in location' WHEN km < 20 THEN 'close in location' END, CASE WHEN dm < 0.2 THEN 'similar magnitude' WHEN dm < 0.5 THEN 'close magnitude' END, CASE WHEN dz < 5 THEN 'similar depth' WHEN dz < 15 THEN 'close depth' END) AS reason FROM p)"""


@query(f"+{_SIMILAR} SELECT a_id, b_id, {rounded('score', 4)} AS score, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.75 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN reason = '' THEN 'matches within thresholds' ELSE reason END AS reason FROM s WHERE score >= 0.7")
def j4_similar_pairs(q: DataFrame) -> DataFrame:
    return match.similar_pairs(q).select("a_id", "b_id", js_round(F.col("score"), 4).alias("score"), "confidence", "reason")


@query(f"+f AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, CAST({y} AS DOUBLE), CAST({x} AS DOUBLE))' for n, line in FAULTS for x, y in line)}) v(name, latitude, longitude)), d AS (SELECT q.id, f.name, {rounded('min(' + km_sql('q', 'f') + ')', 1)} AS km FROM q, f GROUP BY 1, 2) SELECT id, name, km, CAST(row_number() OVER (PARTITION BY id ORDER BY km, name) AS INTEGER) AS rank FROM d WHERE km <= 100 QUALIFY rank <= 5")
def j6_near_faults(q: DataFrame) -> DataFrame:
    return match.near_faults(q, faults(q.sparkSession), 100.0)


@query(f"SELECT a.id AS a_id, b.id AS b_id FROM q a JOIN q b ON {_ORDER} AND b.time <= a.time + INTERVAL 30 SECOND WHERE {km_sql('a', 'b')} <= 25")
def j7_simple_matches(q: DataFrame) -> DataFrame:
    return match.simple_matches(q).select("a_id", "b_id")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
