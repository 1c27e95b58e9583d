"""The driver's events table as a set of earthquake catalogues; the same text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ROW = """
SELECT event_id + {shift} AS id, ts + {seconds} * INTERVAL '1' SECOND AS time, {catalogue} AS catalogue_id,
  CAST(-48 AS DOUBLE) + CAST((event_id * 7919) % 1400 + {lat} AS DOUBLE) / CAST(100 AS DOUBLE) AS latitude,
  coalesce({own_lon}, CAST(165 AS DOUBLE) + CAST((event_id * 104729) % 1499 + {lon} AS DOUBLE) / CAST(100 AS DOUBLE)) AS longitude,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST((event_id * 31) % 4000 + {depth} AS DOUBLE) / CAST(10 AS DOUBLE) END AS depth,
  CAST(10 + {mag} + LEAST(CAST(floor(value / CAST(5 AS DOUBLE)) AS BIGINT), 80) AS DOUBLE) / CAST(10 AS DOUBLE) AS magnitude,
  CASE event_id % 6 WHEN 5 THEN NULL ELSE event_type END AS region, event_id + 3 * {seconds} AS s
FROM {{events}} {rest}
"""

# Copies of some events: shift of the id, seconds, catalogue, and what is added to latitude, longitude (hundredths), depth and magnitude (tenths);
# which events (number modulo, rest); and a longitude of their own. A second and a third network, pairs across the date line, magnitudes and
# depths too far apart for one event, and groups of 19.
_COPIES = [
    (100_000_000, 4, 3, 2, 1, 12, 1, 5, 0, None), (200_000_000, 9, 4, 5, -3, 40, 2, 25, 0, None), (400_000_000, 1, 4, 0, 0, 0, 0, 200, 11, 179.97), (500_000_000, 3, 5, 1, 0, 5, 1, 200, 11, -179.96),
    (600_000_000, 2, 4, 1, 1, 2, 20, 250, 13, None), (700_000_000, 2, 4, 1, 1, 2500, 1, 250, 17, None),
    *[(800_000_000 + k * 10_000_000, k % 6, 4 + k % 2, k % 3, k % 2, k % 4, k % 3, 400, 7, None) for k in range(18)],
]
_VALUES = ", ".join(f"({', '.join(map(str, c[:9]))}, {'CAST(NULL AS DOUBLE)' if c[9] is None else f'CAST({c[9]} AS DOUBLE)'})" for c in _COPIES)
_FIRST = _ROW.format(shift=0, seconds=0, catalogue="event_id % 3", lat=0, lon=0, depth=0, mag=0, own_lon="CAST(NULL AS DOUBLE)", rest="")
_AGAIN = _ROW.format(
    shift="c.shift", seconds="c.seconds", catalogue="c.catalogue", lat="c.lat", lon="c.lon", depth="c.depth", mag="c.mag", own_lon="c.own_lon",
    rest=f"JOIN (VALUES {_VALUES}) c(shift, seconds, catalogue, lat, lon, depth, mag, every, remainder, own_lon) ON event_id % c.every = c.remainder",
)
#: Three catalogues, and three of other networks that hold near copies of some of their events; metrics differ between copies, and each is missing in some rows.
ADAPTER = f"""
SELECT id, time, catalogue_id, latitude, longitude, depth, magnitude,
  CASE WHEN s % 7 = 0 THEN NULL ELSE (s * 13) % 40 END AS stations,
  CASE WHEN s % 13 = 0 THEN NULL ELSE (s * 29) % 60 END AS phases,
  CASE WHEN s % 9 = 0 THEN NULL ELSE (s * 11) % 50 END AS magnitude_stations,
  CASE WHEN s % 5 = 0 THEN NULL ELSE CAST((s * 17) % 360 AS DOUBLE) END AS gap,
  CASE WHEN s % 17 = 0 THEN NULL ELSE CAST((s * 19) % 250 AS DOUBLE) / CAST(100 AS DOUBLE) END AS rms,
  CASE WHEN s % 19 = 0 THEN NULL ELSE CAST((s * 23) % 120 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS horizontal_uncertainty,
  CASE WHEN s % 16 = 0 THEN NULL ELSE CAST((s * 3) % 40 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS latitude_uncertainty,
  CASE WHEN s % 18 = 0 THEN NULL ELSE CAST((s * 7) % 90 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS longitude_uncertainty,
  CASE WHEN s % 14 = 0 THEN NULL ELSE CAST((s * 5) % 150 AS DOUBLE) / CAST(100 AS DOUBLE) END AS time_uncertainty,
  CASE WHEN s % 23 = 0 THEN NULL ELSE CAST((s * 37) % 900 AS DOUBLE) / CAST(10 AS DOUBLE) END AS depth_uncertainty,
  CASE WHEN s % 29 = 0 THEN NULL ELSE CAST((s * 41) % 60 AS DOUBLE) / CAST(100 AS DOUBLE) END AS magnitude_uncertainty,
  CASE WHEN s % 31 = 0 THEN NULL ELSE CAST((s * 43) % 900 AS DOUBLE) END AS minimum_distance,
  CASE s % 10 WHEN 0 THEN 'Mw' WHEN 1 THEN 'ML' WHEN 2 THEN 'mb' WHEN 3 THEN 'Ms' WHEN 4 THEN 'Md' WHEN 5 THEN 'Mww' WHEN 6 THEN 'MLv' WHEN 7 THEN 'ms_20' WHEN 8 THEN 'Mx' ELSE NULL END AS magnitude_type,
  CASE s % 8 WHEN 0 THEN NULL WHEN 1 THEN 'explosion' ELSE 'earthquake' END AS event_type,
  CASE s % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'automatic' ELSE NULL END AS evaluation_mode,
  CASE s % 7 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'preliminary' WHEN 3 THEN 'final' WHEN 4 THEN 'rejected' WHEN 5 THEN 'manual' ELSE NULL END AS evaluation_status,
  CASE WHEN id % 10 = 1 THEN '' ELSE region END AS region,
  CASE catalogue_id WHEN 0 THEN 'GeoNet' WHEN 1 THEN 'USGS/NEIC' WHEN 2 THEN 'elsewhere' WHEN 3 THEN 'JMA Japan' WHEN 4 THEN 'ISC' ELSE NULL END AS source,
  CASE WHEN s % 4 = 0 THEN NULL ELSE s % 3 END AS n_origins, CASE WHEN s % 4 = 0 THEN NULL ELSE s % 2 END AS n_magnitudes, CASE WHEN s % 4 = 0 THEN NULL ELSE s % 5 END AS n_picks,
  CASE WHEN s % 4 = 0 THEN NULL ELSE s % 6 END AS n_arrivals, CASE WHEN s % 4 = 0 THEN NULL ELSE s % 7 END AS n_mechanisms, CASE WHEN s % 4 = 0 THEN NULL ELSE s % 9 END AS n_amplitudes
FROM ({_FIRST} UNION ALL {_AGAIN}) made
"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(ADAPTER, events=events)


def oracle_view(name: str = "q") -> str:
    """The adapter as a DuckDB common table expression."""
    return f"{name} AS ({ADAPTER.format(events='events')})"


def faults(spark: SparkSession) -> DataFrame:
    """Four made fault lines: name and points (longitude, latitude)."""
    rows = [(name, [list(map(float, p)) for p in line]) for name, line in FAULTS]
    return spark.createDataFrame(rows, "name string, points array<array<double>>")


FAULTS = (("north", ((174, -37), (175, -38), (176.5, -38.5))), ("middle", ((172, -41), (173.5, -41.5), (175, -41.2))), ("south", ((168, -44.5), (170, -43.5), (171.5, -42.8))), ("far", ((166.2, -46.5), (167, -46))))
