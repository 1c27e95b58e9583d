"""Station coverage of an event, from arrays of azimuths and distances, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import DEGREE_KM
from .scores import at_least, below

PICKS = "array<struct<waveformID:struct<networkCode:string,stationCode:string>>>"
ARRIVALS = "array<struct<azimuth:double,distance:double>>"
SECTOR, FULL_SECTOR = 30, 3


def gaps(azimuths: Column) -> Column:
    """Angles between neighbouring azimuths, the one across north last; none below two azimuths."""
    ordered = F.array_sort(F.filter(azimuths, lambda x: x.isNotNull()))
    n = F.size(ordered)
    between = F.zip_with(F.slice(ordered, F.lit(1), n - 1), F.slice(ordered, F.lit(2), n - 1), lambda a, b: b - a)
    return F.when(n >= 2, F.concat(between, F.array(360 - F.element_at(ordered, -1) + F.element_at(ordered, 1)))).otherwise(F.array().cast("array<double>"))


def azimuthal_gap(azimuths: Column) -> Column:
    return F.coalesce(F.array_max(gaps(azimuths)), F.lit(360.0))


def coverage_class(gap: Column, stations: Column) -> Column:
    return F.when((gap < 90) & (stations >= 10), "excellent").when((gap < 180) & (stations >= 6), "good").when((gap < 270) & (stations >= 4), "fair").otherwise("poor")


def sectors(azimuths: Column, size: int = SECTOR) -> Column:
    """Array of (start, end, n, coverage) of equal sectors; 360 is in none."""
    def one(k: Column) -> Column:
        n = F.size(F.filter(azimuths, lambda a: (a >= k * size) & (a < (k + 1) * size)))
        return F.struct((k * size).alias("start"), ((k + 1) * size).alias("end"), n.alias("n"), F.least(F.lit(1.0), n / F.lit(float(FULL_SECTOR))).alias("coverage"))

    return F.transform(F.sequence(F.lit(0), F.lit(360 // size - 1)), one)


def unevenness(azimuths: Column) -> Column:
    """0 for evenly spread azimuths up to 1: the gaps' standard deviation over their mean."""
    all_gaps = gaps(azimuths)
    n = F.size(all_gaps)
    mean = F.lit(360.0) / F.nullif(n, F.lit(0))
    variance = F.aggregate(all_gaps, F.lit(0.0), lambda s, g: s + F.pow(g - mean, 2)) / F.nullif(n, F.lit(0))
    return F.coalesce(F.least(F.lit(1.0), F.sqrt(variance) / mean), F.lit(0.0))


def spread_class(ratio: Column) -> Column:
    return below(ratio, ((0.3, "excellent"), (0.5, "good"), (0.7, "fair")), "poor")


def coverage(picks: Column, arrivals: Column) -> Column:
    """Struct of stations, azimuthal_gap, mean, least and greatest distance in km and class, from JSON of picks and arrivals; null if both are."""
    known_picks = F.from_json(picks, PICKS)
    stations = F.array_distinct(F.transform(F.filter(known_picks, lambda p: p["waveformID"].isNotNull()), lambda p: F.concat_ws(".", F.coalesce(p["waveformID"]["networkCode"], F.lit("XX")), F.coalesce(p["waveformID"]["stationCode"], F.lit("UNKNOWN")))))
    stations = F.coalesce(stations, F.array().cast("array<string>"))
    known = F.coalesce(F.from_json(arrivals, ARRIVALS), F.array().cast(ARRIVALS))
    km = F.transform(F.filter(known, lambda a: a["distance"].isNotNull()), lambda a: a["distance"] * DEGREE_KM)
    gap = azimuthal_gap(F.transform(known, lambda a: a["azimuth"]))
    mean = F.when(F.size(km) > 0, F.aggregate(km, F.lit(0.0), lambda s, x: s + x) / F.size(km)).otherwise(0.0)
    out = F.struct(F.size(stations).alias("stations"), gap.alias("azimuthal_gap"), mean.alias("mean_km"), F.coalesce(F.array_min(km), F.lit(0.0)).alias("least_km"), F.coalesce(F.array_max(km), F.lit(0.0)).alias("most_km"), coverage_class(gap, F.size(stations)).alias("class"))
    return F.when(picks.isNotNull() | arrivals.isNotNull(), out)


def confidence_class(confidence: Column) -> Column:
    return at_least(confidence, ((0.9, "high"), (0.7, "medium"), (0.5, "low")), "very low")
