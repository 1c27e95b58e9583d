"""Distances, directions and boxes on the sphere, as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The mean radius of the earth in km, and km of a degree.
RADIUS, DEGREE_KM = 6371.0, 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    up, along = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(up / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(along / 2), 2)
    return 2 * RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction from the first point to the second, 0 to below 360 degrees from north."""
    along = F.radians(lon2 - lon1)
    y = F.sin(along) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(along)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def normal_longitude(lon: Column) -> Column:
    """Longitude brought to -180..180; both ends stay as they are."""
    return F.when(F.abs(lon) <= 180, lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Within a closed box; west > east means that it crosses the date line."""
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return (lat >= south) & (lat <= north) & across


def search_box(lat: Column, lon: Column, km: float) -> Column:
    """(south, north, west, east) of the box around a circle."""
    up = km / DEGREE_KM
    along = km / F.greatest(F.lit(0.01), DEGREE_KM * F.cos(F.radians(lat)))
    return F.struct((lat - up).alias("south"), (lat + up).alias("north"), (lon - along).alias("west"), (lon + along).alias("east"))


def line_km(points: Column) -> Column:
    """Length of a line of (longitude, latitude) points."""
    leg = lambda k: haversine_km(points[k][1], points[k][0], points[k + 1][1], points[k + 1][0])
    return F.aggregate(F.sequence(F.lit(0), F.size(points) - 2), F.lit(0.0), lambda s, k: s + leg(k))


def mean_longitude(lon: Column) -> Column:
    """Aggregate: the plain mean, or the circular one where the group spans half the circle or more."""
    circular = F.degrees(F.atan2(F.avg(F.sin(F.radians(lon))), F.avg(F.cos(F.radians(lon)))))
    return F.when(F.max(lon) - F.min(lon) < 180, F.avg(lon)).otherwise(circular)


def held(frame: DataFrame, **columns: Column) -> DataFrame:
    """frame with columns that are evaluated once a row: a generator's columns, unlike a projection's, are not written anew into every expression that uses them."""
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _with_band(frame: DataFrame, km: Column | float, beside: Column) -> DataFrame:
    """frame (latitude, longitude) with _y, _n and _x: the band of latitude `beside` bands from a point's own, the number of its cells, and the one under the point. Bands are km high, their cells at least km wide over the band and its neighbours; the cells of a band go round it evenly."""
    lat, lon = F.col("latitude"), F.col("longitude")
    high = (km if isinstance(km, Column) else F.lit(float(km))) / (math.pi * RADIUS / 180) * 1.001
    frame = held(frame, _y=(F.floor(lat / high) + beside).cast("long"), _high=high)
    frame = held(frame, _widest=F.greatest(F.abs((F.col("_y") - 1) * F.col("_high")), F.abs((F.col("_y") + 2) * F.col("_high"))))
    # Two points of neighbouring bands at that distance are at most so many degrees of longitude apart; towards the poles one cell is the whole band.
    reach = F.col("_high") / 1.001 * (math.pi * RADIUS / 180)
    frame = held(frame, _sine=F.sin(reach / (2 * RADIUS)) / F.cos(F.radians(F.least("_widest", F.lit(90.0)))))
    n = F.when((F.col("_widest") >= 90) | (F.col("_sine") >= 1), 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(360 / 1.001) / F.degrees(2 * F.asin(F.least(F.lit(1.0), "_sine"))))))
    frame = held(frame, _n=n.cast("long")).drop("_high", "_widest", "_sine")
    return held(frame, _x=F.pmod(F.floor((lon + 180) / 360 * F.col("_n")).cast("long"), F.col("_n")))


def with_cell(frame: DataFrame, km: Column | float) -> DataFrame:
    """frame (latitude, longitude) with `cell` (y, x): the cell of a point on a grid for distances up to km."""
    return _with_band(frame, km, F.lit(0)).withColumn("cell", F.struct(F.col("_y").alias("y"), F.col("_x").alias("x"))).drop("_y", "_n", "_x")


def with_cells_around(frame: DataFrame, km: Column | float) -> DataFrame:
    """frame (latitude, longitude), a row for each `cell` in which points within km of its own may lie, across the date line and the poles too."""
    bands = _with_band(frame.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_beside")), km, F.col("_beside"))
    across = F.array_distinct(F.array(*[F.pmod(F.col("_x") + k, F.col("_n")) for k in (-1, 0, 1)]))
    cells = bands.select("*", F.explode(across).alias("_at")).withColumn("cell", F.struct(F.col("_y").alias("y"), F.col("_at").alias("x")))
    return cells.drop("_beside", "_y", "_n", "_x", "_at")
