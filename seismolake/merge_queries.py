"""Registered queries of matched groups: components, greedy claiming, merge strategies, representatives, samples. The SQL finds the same groups by recursion, one component's events in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismolake.catalogue_queries import _ADAPTIVE, _SIMILAR, COMPLETE_FIELDS, query, rounded
from seismolake.functions import mechanism
from seismolake.functions.scores import js_round
from seismolake.operators import match, resolve, sampling

# The components of edges e(a_id, b_id), and in each the earliest seed that an event has an edge from, taken in order of time, catalogue and id.
_PARTS = """u AS (SELECT a_id AS x, b_id AS y FROM e UNION SELECT b_id, a_id FROM e),
 reach AS (SELECT x AS node, x AS seen FROM u UNION SELECT r.node, u.y FROM reach r JOIN u ON u.x = r.seen),
 part AS (SELECT node, min(seen) AS c FROM reach GROUP BY 1)"""
_GROUPS = f"""{_ADAPTIVE}, {_PARTS},
 place AS (SELECT p.node, p.c, row_number() OVER (PARTITION BY p.c ORDER BY q.time, q.catalogue_id, q.id) AS j FROM part p JOIN q ON q.id = p.node),
 earlier AS (SELECT b.c, b.j, list(a.j) AS js FROM e JOIN place a ON a.node = e.a_id JOIN place b ON b.node = e.b_id GROUP BY 1, 2),
 walk AS (SELECT DISTINCT c, CAST(1 AS BIGINT) AS j, [CAST(1 AS BIGINT)] AS seeds, [CAST(1 AS BIGINT)] AS owners FROM place
  UNION ALL SELECT w.c, w.j + 1, CASE WHEN list_min(list_intersect(x.js, w.seeds)) IS NULL THEN list_append(w.seeds, w.j + 1) ELSE w.seeds END,
   list_append(w.owners, coalesce(list_min(list_intersect(x.js, w.seeds)), w.j + 1)) FROM walk w JOIN place p ON p.c = w.c AND p.j = w.j + 1 LEFT JOIN earlier x ON x.c = w.c AND x.j = w.j + 1),
 done AS (SELECT c, owners FROM walk QUALIFY row_number() OVER (PARTITION BY c ORDER BY j DESC) = 1),
 own AS (SELECT p.node, s.node AS leader FROM done d JOIN place p ON p.c = d.c JOIN place s ON s.c = d.c AND s.j = d.owners[p.j]),
 g AS (SELECT q.*, coalesce(own.leader, q.id) AS leader FROM q LEFT JOIN own ON own.node = q.id)"""
_TURNED = "(CASE WHEN longitude < 0 THEN longitude + 360 ELSE longitude END)"
_FAULTS = f"""{_GROUPS}, f0 AS (SELECT leader, count(*) AS n, floor(avg(magnitude) * 1e6 + 0.5) / 1e6 AS m, max(magnitude) - min(magnitude) AS mr, count(depth) AS nd, floor(avg(depth) * 1e6 + 0.5) / 1e6 AS d, max(depth) - min(depth) AS dr,
  max(latitude) - min(latitude) AS up, least(max(longitude) - min(longitude), max{_TURNED} - min{_TURNED}) AS along, (max(latitude) + min(latitude)) / 2 AS mid FROM g GROUP BY 1 HAVING count(*) > 1),
 f AS (SELECT leader, n, CASE WHEN mr > CASE WHEN m < 4 THEN 0.5 WHEN m < 5.5 THEN 0.8 WHEN m < 7 THEN 1.2 ELSE 1.5 END THEN 'magnitude_range'
  WHEN nd >= 2 AND dr > CASE WHEN d < 70 THEN CASE WHEN m < 5 THEN 30 ELSE 50 END WHEN d < 300 THEN CASE WHEN m < 5 THEN 50 ELSE 100 END ELSE CASE WHEN m < 5 THEN 100 ELSE 150 END END THEN 'depth_range'
  WHEN n > 15 THEN 'group_size' WHEN n > 3 AND sqrt(pow(up * 111, 2) + pow(along * 111 * cos(radians(mid)), 2)) > CASE WHEN m < 5 THEN 100 WHEN m < 6 THEN 150 ELSE 200 END THEN 'spatial_spread' END AS fault FROM f0)"""
# Sound groups: those with a fault fall apart.
_SOUND = f"{_FAULTS}, s AS (SELECT g.* REPLACE (CASE WHEN f.fault IS NULL THEN g.leader ELSE g.id END AS leader) FROM g LEFT JOIN f ON f.leader = g.leader)"


def _named(value: str, points: tuple) -> str:
    return f"CASE {' '.join(f'WHEN {value} IN ({chr(44).join(repr(n) for n in names)}) THEN {score}' for score, names in points)} ELSE 0 END"


def _upto(value: str, steps: tuple) -> str:
    return f"CASE {' '.join(f'WHEN {value} <= {bound} THEN {points}' for bound, points in steps)} ELSE 0 END"


_METRICS = [
    ("stations > 0", 25, "least(25, 25 * log2(stations + 1) / log2(32))"), ("gap IS NOT NULL", 20, "CASE WHEN gap <= 120 THEN 20 WHEN gap <= 180 THEN 15 WHEN gap <= 270 THEN 10 * (1 - (gap - 180) / 90) ELSE 0 END"),
    ("rms IS NOT NULL", 15, _upto("rms", ((0.3, 15), (0.5, 12), (1.0, 8), (2.0, 4)))), ("magnitude_uncertainty IS NOT NULL", 15, _upto("magnitude_uncertainty", ((0.1, 15), (0.2, 12), (0.3, 8), (0.5, 4)))),
    ("magnitude_type IS NOT NULL", 15, _named("lower(magnitude_type)", ((15, ("mw", "mww", "mwc", "mwb")), (12, ("ms", "ms_20")), (9, ("mb", "mbb")), (6, ("ml", "mlv")), (3, ("md", "mc"))))),
    ("evaluation_status IS NOT NULL", 10, _named("evaluation_status", ((10, ("final", "reviewed")), (6, ("confirmed",)), (2, ("preliminary",))))),
]
_HAD = " + ".join(f"CASE WHEN {known} THEN {most} ELSE 0 END" for known, most, _ in _METRICS)
_GOT = " + ".join(f"CASE WHEN {known} THEN {score} ELSE 0 END" for known, _, score in _METRICS)
_QUALITY = f"(floor((CASE WHEN ({_HAD}) > 0 THEN ({_GOT}) / CAST(({_HAD}) AS DOUBLE) * 100 ELSE CASE WHEN depth IS NULL THEN 0 ELSE 10 END + CASE WHEN magnitude IS NULL THEN 0 ELSE 10 END + 5 END) * 1e6 + 0.5) / 1e6)"
_RANK = "CASE source WHEN 'GeoNet' THEN 1 WHEN 'ISC' THEN 3 WHEN 'USGS/NEIC' THEN 4 WHEN 'JMA Japan' THEN 6 WHEN 'elsewhere' THEN 100 ELSE 999 END"
_POINTS = " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in COMPLETE_FIELDS) + " + CASE WHEN n_origins IS NULL THEN 0 ELSE 10 END + " + " + ".join(f"CASE WHEN {name} > 0 THEN {points} ELSE 0 END" for name, points in resolve.DETAIL_POINTS.items()) + " + CASE WHEN n_origins > 0 AND coalesce(gap, stations, rms) IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN n_origins > 0 AND horizontal_uncertainty IS NOT NULL THEN 2 ELSE 0 END"


def _best(order: str, table: str = "s") -> str:
    """The first member of each group of a table in an order, then by time, catalogue and id."""
    return f" SELECT leader, n, id, magnitude, sources FROM (SELECT *, count(*) OVER (PARTITION BY leader) AS n, string_agg(CAST(id AS VARCHAR), ',') OVER (PARTITION BY leader ORDER BY time, catalogue_id, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sources, row_number() OVER (PARTITION BY leader ORDER BY {order}, time, catalogue_id, id) AS r FROM {table}) WHERE r = 1"


def _sound(q: DataFrame) -> DataFrame:
    return resolve.split_unsound(match.merge_groups(q))


def _shown(best: DataFrame) -> DataFrame:
    return best.select("leader", "n", "id", "magnitude", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query(f"+{_GROUPS} SELECT id, leader FROM g")
def j2_merge_groups(q: DataFrame) -> DataFrame:
    return match.merge_groups(q).select("id", "leader")


@query(f"+{_SIMILAR}, e AS (SELECT a_id, b_id FROM s WHERE score >= 0.7), {_PARTS} SELECT node AS id, c AS \"group\" FROM part")
def j5_duplicate_groups(q: DataFrame) -> DataFrame:
    return match.duplicate_groups(q)


@query(f"+{_GROUPS}, x AS (SELECT leader, count(*) AS n, floor((max(magnitude) - min(magnitude)) * 1e6 + 0.5) / 1e6 > 1 AS m, coalesce(floor((max(depth) - min(depth)) * 1e6 + 0.5) / 1e6 > CASE WHEN max(depth) > 300 THEN 200 ELSE 100 END, false) AS d FROM g GROUP BY 1 HAVING count(*) > 1) SELECT leader, n, m AS magnitude_warning, d AS depth_warning, m OR d AS suspicious FROM x")
def j3_preview_groups(q: DataFrame) -> DataFrame:
    return resolve.preview_groups(match.merge_groups(q))


_SOURCES = ((0, "GeoNet"), (1, "USGS"), (2, ""), (3, "second"), (4, "third"), (5, ""))


@query(f"SELECT id, CASE catalogue_id {' '.join(f'WHEN {k} THEN {chr(39)}{name or 'unknown'}{chr(39)}' for k, name in _SOURCES)} END AS source, catalogue_id, CASE WHEN catalogue_id = 5 THEN NULL ELSE region END AS region, CASE WHEN catalogue_id = 3 THEN NULL ELSE depth END AS depth FROM q")
def j11_united_sources(q: DataFrame) -> DataFrame:
    # Two catalogues lack a column each.
    lacks = {5: "region", 3: "depth"}
    made = resolve.united([(k, name, q.where(F.col("catalogue_id") == k).drop(lacks.get(k, ""))) for k, name in _SOURCES])
    return made.select("id", "source", F.col("catalogue_id").cast("long").alias("catalogue_id"), "region", "depth")


@query(f"+{_GROUPS}, x AS (SELECT leader, count(*) AS n FROM g GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS events_before, count(*) AS events_after, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS removed FROM x")
def a31_merge_preview(q: DataFrame) -> DataFrame:
    return resolve.preview(match.merge_groups(q))


@query(f"+{_FAULTS} SELECT coalesce(fault, 'none') AS fault, CASE WHEN fault IS NULL THEN 'none' WHEN fault = 'group_size' THEN 'error' ELSE 'warning' END AS severity, count(*) AS groups, CAST(sum(n) AS BIGINT) AS events FROM f GROUP BY 1, 2")
def a32_conflicts(q: DataFrame) -> DataFrame:
    return resolve.conflicts(match.merge_groups(q))


_W = "CASE WHEN horizontal_uncertainty > 0 THEN 1 / greatest(0.1, least(100, horizontal_uncertainty)) WHEN latitude_uncertainty * longitude_uncertainty > 0 THEN 1 / greatest(0.1, least(100, sqrt(latitude_uncertainty * longitude_uncertainty))) ELSE 1 END"
_TYPE = "CASE WHEN magnitude_type IS NULL THEN 999 WHEN lower(magnitude_type) IN ('mw', 'mww') THEN 1 WHEN lower(magnitude_type) IN ('ms', 'ms_20') THEN 2 WHEN lower(magnitude_type) = 'mb' THEN 3 WHEN lower(magnitude_type) IN ('ml', 'mlv') THEN 4 WHEN lower(magnitude_type) = 'md' THEN 5 ELSE 100 END"


@query(
    f"+{_SOUND}, w AS (SELECT *, {_W} AS w FROM s), a AS (SELECT leader, count(*) AS n, min(epoch_us(time)) AS us, sum(latitude * w) / sum(w) AS lat, CASE WHEN max(longitude) - min(longitude) < 180 THEN sum(longitude * w) / sum(w) ELSE degrees(atan2(sum(sin(radians(longitude)) * w), sum(cos(radians(longitude)) * w))) END AS lon FROM w GROUP BY 1),"
    f" m AS (SELECT leader, magnitude FROM s WHERE magnitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY leader ORDER BY {_TYPE}, coalesce(magnitude_uncertainty, 999), time, catalogue_id, id) = 1),"
    " d AS (SELECT leader, depth FROM s WHERE depth IS NOT NULL QUALIFY row_number() OVER (PARTITION BY leader ORDER BY floor(coalesce(depth_uncertainty, 999) / 5), -coalesce(stations, 0), time, catalogue_id, id) = 1)"
    f" SELECT a.leader, n, us, {rounded('lat')} AS latitude, {rounded('lon')} AS longitude, magnitude, depth FROM a LEFT JOIN m ON m.leader = a.leader LEFT JOIN d ON d.leader = a.leader"
)
def m2_average(q: DataFrame) -> DataFrame:
    out = resolve.resolved(_sound(q), "average")
    return out.select("leader", "n", F.unix_micros(F.col("time").cast("timestamp")).alias("us"), js_round(F.col("latitude"), 6).alias("latitude"), js_round(F.col("longitude"), 6).alias("longitude"), "magnitude", "depth")


@query(f"+{_SOUND}{_best('time DESC')}")
def m3_newest(q: DataFrame) -> DataFrame:
    return _shown(resolve.resolved(_sound(q), "newest"))


@query(f"+{_SOUND}{_best(f'({_POINTS}) DESC')}")
def m4_most_complete(q: DataFrame) -> DataFrame:
    return _shown(resolve.resolved(_sound(q), "completeness", COMPLETE_FIELDS))


@query(f"+{_SOUND}{_best(f'{_QUALITY} DESC')}")
def m5_best_quality(q: DataFrame) -> DataFrame:
    return _shown(resolve.resolved(_sound(q), "quality"))


@query(f"+{_SOUND}{_best(f'CASE WHEN lower(source) LIKE {chr(39)}%isc%{chr(39)} THEN 0 ELSE 1 END, CASE WHEN lower(source) LIKE {chr(39)}%isc%{chr(39)} THEN 0 ELSE {_RANK} END, CASE WHEN lower(source) LIKE {chr(39)}%isc%{chr(39)} THEN 0 ELSE -{_QUALITY} END')}")
def m6_priority(q: DataFrame) -> DataFrame:
    return _shown(resolve.resolved(_sound(q), "priority", priority="ISC"))


@query(f"SELECT id, {_QUALITY} AS quality FROM q")
def m7_merge_quality(q: DataFrame) -> DataFrame:
    return q.select("id", js_round(resolve.event_quality(), 6).alias("quality"))


@query(f"SELECT DISTINCT magnitude_type, {_TYPE} AS rank FROM q")
def m16_type_ranks(q: DataFrame) -> DataFrame:
    return q.select("magnitude_type", resolve.type_rank(F.col("magnitude_type")).alias("rank")).distinct()


@query(f"+{_GROUPS}{_best(f'{_RANK}, {_QUALITY} DESC', 'g')}")
def m15_by_authority(q: DataFrame) -> DataFrame:
    return _shown(resolve.by_authority(match.merge_groups(q)))


_MECHANISM = [
    ("stations IS NOT NULL", 25, "CASE WHEN stations >= 50 THEN 25 WHEN stations >= 30 THEN 20 WHEN stations >= 15 THEN 15 WHEN stations >= 8 THEN 10 ELSE 5 END"), ("rms IS NOT NULL", 20, _upto("rms", ((0.1, 20), (0.2, 15), (0.3, 10), (0.5, 5)))),
    ("id % 2 = 0", 30, "15 + CASE WHEN horizontal_uncertainty * 10 >= 0.8 THEN 15 WHEN horizontal_uncertainty * 10 >= 0.6 THEN 10 WHEN horizontal_uncertainty * 10 >= 0.4 THEN 5 ELSE 0 END"), ("gap IS NOT NULL", 15, _upto("gap", ((90, 15), (120, 12), (180, 8), (270, 4)))),
    ("evaluation_status IS NOT NULL", 10, _named("evaluation_status", ((10, ("final", "reviewed")), (7, ("confirmed",)), (3, ("preliminary",))))),
]
_M_HAD = " + ".join(f"CASE WHEN {known} THEN {most} ELSE 0 END" for known, most, _ in _MECHANISM)
_M_GOT = " + ".join(f"CASE WHEN {known} THEN {score} ELSE 0 END" for known, _, score in _MECHANISM)


@query(f"+{_GROUPS}, m AS (SELECT leader, id, source, CASE source WHEN 'GeoNet' THEN 2 WHEN 'USGS/NEIC' THEN 3 WHEN 'ISC' THEN 4 ELSE CASE WHEN source IS NULL THEN 999 ELSE 100 END END AS rank, floor(CASE WHEN ({_M_HAD}) > 0 THEN ({_M_GOT}) / CAST(({_M_HAD}) AS DOUBLE) * 100 ELSE 50 END * 1e6 + 0.5) / 1e6 AS quality FROM g WHERE n_mechanisms > 0) SELECT leader, n, id, quality, ids FROM (SELECT *, count(*) OVER (PARTITION BY leader) AS n, string_agg(CAST(id AS VARCHAR), ',') OVER (PARTITION BY leader ORDER BY rank, quality DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ids, row_number() OVER (PARTITION BY leader ORDER BY rank, quality DESC, id) AS r FROM m) WHERE r = 1")
def m19_merged_mechanisms(q: DataFrame) -> DataFrame:
    c = F.col
    quality = mechanism.quality(c("stations"), c("rms"), c("id") % 2 == 0, c("horizontal_uncertainty") * 10, c("gap"), c("evaluation_status"))
    made = match.merge_groups(q).where("n_mechanisms > 0").select("leader", "id", "source", js_round(quality, 6).alias("quality"))
    return resolve.merged_mechanisms(made).select("leader", F.size("all").cast("long").alias("n"), "id", "quality", F.array_join(F.transform("all", lambda x: x["id"].cast("string")), ",").alias("ids"))


_FIELDS = ("depth", "magnitude_type", "event_type", "gap", "phases", "stations")
_SCORE = "CASE evaluation_status WHEN 'reviewed' THEN 100 WHEN 'manual' THEN 50 ELSE 0 END + coalesce(stations, 0) + CASE WHEN coalesce(gap, 0) <> 0 THEN (360 - gap) / 10 ELSE 0 END + 5 * (" + " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE 1 END" for f in _FIELDS) + ")"


@query(f"+{_SIMILAR}, e AS (SELECT a_id, b_id FROM s WHERE score >= 0.7), {_PARTS}, x AS (SELECT p.c, q.*, {_SCORE} AS points FROM q JOIN part p ON p.node = q.id) SELECT c AS \"group\", id, n, {rounded('points', 4)} AS score FROM (SELECT *, count(*) OVER (PARTITION BY c) AS n, row_number() OVER (PARTITION BY c ORDER BY points DESC, time, catalogue_id, id) AS r FROM x) WHERE r = 1")
def m17_representatives(q: DataFrame) -> DataFrame:
    return resolve.representatives(q.join(match.duplicate_groups(q), "id")).select("group", "id", "n", "score")


@query(f"+{_SIMILAR}, e AS (SELECT a_id, b_id, CASE WHEN score >= 0.9 THEN 3 WHEN score >= 0.75 THEN 2 ELSE 1 END AS points FROM s WHERE score >= 0.7), {_PARTS}, x AS (SELECT p.c, count(*) AS pairs, avg(points) AS mean FROM e JOIN part p ON p.node = e.a_id GROUP BY 1) SELECT c AS \"group\", pairs, CASE WHEN mean >= 2.5 THEN 'high' WHEN mean >= 1.5 THEN 'medium' ELSE 'low' END AS confidence FROM x")
def m18_group_confidence(q: DataFrame) -> DataFrame:
    return resolve.group_confidence(match.similar_pairs(q), match.duplicate_groups(q))


# Declustering: at this size the SQL's pairs are too many; the operator is tested against a loop on a small catalogue.


@query()
def a7_decluster(q: DataFrame) -> DataFrame:
    return match.decluster(q).select("id", "catalogue_id", "mainshock")


@query()
def a7_clusters(q: DataFrame) -> DataFrame:
    from seismolake.operators import statistics

    return statistics.clusters(match.decluster(q))


@query()
def a11_top_clusters(q: DataFrame) -> DataFrame:
    from seismolake.operators import statistics

    return statistics.top_clusters(match.decluster(q))


# Samples, in order of the digest of the id.

_DRAW = "md5(CAST(id AS VARCHAR) || ':42')"
_STRATUM = "CASE WHEN magnitude >= 5 THEN 4 WHEN magnitude >= 4 THEN 3 WHEN magnitude >= 3 THEN 2 WHEN magnitude >= 2 THEN 1 ELSE 0 END"


@query(f"+t AS (SELECT id FROM q ORDER BY magnitude DESC, id LIMIT 50), r AS (SELECT id, magnitude, {_DRAW} AS draw, row_number() OVER (PARTITION BY {_STRATUM} ORDER BY {_DRAW}) AS k FROM q WHERE id NOT IN (SELECT id FROM t)), c AS (SELECT id FROM r ORDER BY CASE WHEN k <= 90 THEN 0 ELSE 1 END, draw LIMIT 450) SELECT id, magnitude FROM q WHERE id IN (SELECT id FROM t UNION ALL SELECT id FROM c)")
def l7_stratified_sample(q: DataFrame) -> DataFrame:
    return sampling.stratified(q, 500).select("id", "magnitude")


_VIEW = "latitude BETWEEN -45 AND -38 AND longitude BETWEEN 170 AND 178"


@query(f"+v AS (SELECT * FROM q WHERE {_VIEW}), t AS (SELECT id FROM v ORDER BY magnitude DESC, id LIMIT 64), o AS (SELECT id FROM v WHERE id NOT IN (SELECT id FROM t) ORDER BY {_DRAW} LIMIT 256), i AS (SELECT id FROM t UNION ALL SELECT id FROM o), x AS (SELECT id FROM q WHERE NOT ({_VIEW}) ORDER BY magnitude DESC, id LIMIT (SELECT 400 - count(*) FROM i)) SELECT id, magnitude FROM q WHERE id IN (SELECT id FROM i UNION ALL SELECT id FROM x)")
def l8_view_sample(q: DataFrame) -> DataFrame:
    return sampling.for_view(q, -45, -38, 170, 178, 400).select("id", "magnitude")


@query("SELECT id, magnitude FROM (SELECT id, magnitude, row_number() OVER (PARTITION BY catalogue_id, floor(magnitude) ORDER BY time, id) AS r FROM q) WHERE (r - 1) % 10 = 0")
def l9_stride_sample(q: DataFrame) -> DataFrame:
    return sampling.stride(q, [F.col("catalogue_id"), F.floor("magnitude")], 10).select("id", "magnitude")


@query(f"+r AS (SELECT id, magnitude, row_number() OVER (ORDER BY magnitude DESC, {_DRAW}) - 1 AS k, count(*) OVER () AS n FROM q) SELECT id, magnitude FROM r WHERE n <= 500 OR k < 100 OR (k - 100) % greatest(1, floor((n - 100) / 400)) = 0 ORDER BY k LIMIT 500")
def l10_scatter_sample(q: DataFrame) -> DataFrame:
    return sampling.scatter(q).select("id", "magnitude")


@query("SELECT id, magnitude FROM q ORDER BY magnitude DESC, id LIMIT 100")
def l10_largest(q: DataFrame) -> DataFrame:
    return sampling.largest(q, 100).select("id", "magnitude")
