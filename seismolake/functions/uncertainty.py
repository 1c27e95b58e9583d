"""Uncertainty ellipses, location quality and levels, completeness and magnitude comparison, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import at_least, at_most, below, js_round, moment_magnitude

METRES_A_DEGREE = 111_000
# Bounds of levels by kind.
LEVELS = {
    "horizontal": ((0.01, "excellent"), (0.05, "good"), (0.1, "fair")),
    "depth": ((1, "excellent"), (5, "good"), (10, "fair")),
    "time": ((0.1, "excellent"), (0.5, "good"), (1, "fair")),
}
# magnitudes' names and markers, depths' classes.
MAGNITUDE_NAMES = ((2, "micro"), (3, "minor"), (4, "light"), (5, "moderate"), (6, "strong"), (7, "major"))
# Tolerance of equivalent magnitudes beside their uncertainties.
EQUIVALENT = 0.3


def ellipse(latitude: Column, lat_unc: Column, lon_unc: Column, gap: Column) -> Column:
    """Struct of major and minor half-axes in metres, rotation and confidence; null if both uncertainties are zero or missing."""
    up = F.coalesce(lat_unc, F.lit(0.0)) * METRES_A_DEGREE
    along = F.coalesce(lon_unc, F.lit(0.0)) * METRES_A_DEGREE * F.cos(F.radians(latitude))
    sure = F.when(gap.isNull(), 0.68).otherwise(F.greatest(F.lit(0.3), F.least(F.lit(0.95), 1 - gap / 360)))
    out = F.struct(F.greatest(up, along).alias("major"), F.least(up, along).alias("minor"), F.when(up > along, 0).otherwise(90).alias("rotation"), sure.alias("confidence"))
    return F.when((F.coalesce(lat_unc, F.lit(0.0)) != 0) | (F.coalesce(lon_unc, F.lit(0.0)) != 0), out)


def location_quality(lat_unc: Column, lon_unc: Column, depth_unc: Column, time_unc: Column, gap: Column) -> Column:
    """Struct of score (0 to 100, whole) and grade A to F: 100 less what uncertainties and the gap cost."""
    least = lambda most, x: F.when(x.isNull(), 0.0).otherwise(F.least(F.lit(float(most)), x))
    wide = F.greatest(F.coalesce(lat_unc, F.lit(0.0)), F.coalesce(lon_unc, F.lit(0.0)))
    score = 100 - least(30, wide * 300) - least(20, depth_unc * 2) - least(30, gap / 270 * 30) - least(20, time_unc * 20)
    return F.struct(F.greatest(F.lit(0.0), js_round(score)).alias("score"), at_least(score, ((90, "A"), (80, "B"), (70, "C"), (60, "D")), "F").alias("grade"))


def level(value: Column, kind: str) -> Column:
    return F.when(value.isNull(), "unknown").otherwise(below(value, LEVELS[kind], "poor"))


def magnitude_name(magnitude: Column) -> Column:
    return below(magnitude, MAGNITUDE_NAMES, "great")


def depth_class(depth: Column) -> Column:
    return at_most(depth, ((70, "shallow"), (300, "intermediate")), "deep")


def equivalent_magnitudes(a: Column, kind_a: Column, unc_a: Column, b: Column, kind_b: Column, unc_b: Column) -> Column:
    """Whether two magnitudes, converted to one scale where it is known, differ by no more than their uncertainties together and a tolerance."""
    first, second = F.coalesce(moment_magnitude(a, kind_a), a), F.coalesce(moment_magnitude(b, kind_b), b)
    both_known = moment_magnitude(a, kind_a).isNotNull() & moment_magnitude(b, kind_b).isNotNull()
    apart = F.abs(F.when(both_known, first - second).otherwise(a - b))
    return apart <= F.sqrt(F.pow(F.coalesce(unc_a, F.lit(0.0)), 2) + F.pow(F.coalesce(unc_b, F.lit(0.0)), 2)) + EQUIVALENT


# Combined quality by least six-criterion and detailed scores; the first four need both, the others one.
COMBINED = ((6, 90, "Excellent"), (5, 80, "Very Good"), (4, 70, "Good"), (3, 60, "Fair"), (2, 50, "Poor"), (1, 40, "Very Poor"))
BOTH = 4


def combined_quality(six: Column, overall: Column) -> Column:
    out = F.lit("Unconstrained")
    for k, (least_six, least_overall, name) in reversed(list(enumerate(COMBINED))):
        a, b = six >= least_six, overall >= least_overall
        out = F.when(a & b if k < BOTH else a | b, name).otherwise(out)
    return out


def use_cases(six: Column, overall: Column) -> Column:
    """What an event's quality allows, from its six-criterion and its detailed score."""
    names = ("research", "hazard", "public_information", "monitoring")
    return F.struct(*[((six >= least_six) & (overall >= least_overall)).alias(name) for name, (least_six, least_overall, _) in zip(names, COMBINED[2:], strict=True)])


def horizontal_km(latitude: Column, lat_unc: Column, lon_unc: Column) -> Column:
    """The larger of both uncertainties in km; null if one is missing."""
    along = lon_unc * 111 * F.cos(F.radians(F.coalesce(latitude, F.lit(0.0))))
    return F.when(lat_unc.isNotNull() & lon_unc.isNotNull(), F.greatest(lat_unc * 111, along))
