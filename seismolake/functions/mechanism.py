"""Focal mechanisms: reading, style of faulting and quality, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import Steps, at_least, at_most

PLANE = "struct<strike:double,dip:double,rake:double>"
NESTED = "struct<nodalPlanes:struct<nodalPlane1:struct<strike:struct<value:double>,dip:struct<value:double>,rake:struct<value:double>>>>"
# Points of a mechanism by polarities, misfit, variance reduction, gap and status.
POLARITIES: Steps = ((50, 25), (30, 20), (15, 15), (8, 10))
MISFITS: Steps = ((0.1, 20), (0.2, 15), (0.3, 10), (0.5, 5))
REDUCTIONS: Steps = ((0.8, 15), (0.6, 10), (0.4, 5))
GAPS: Steps = ((90, 15), (120, 12), (180, 8), (270, 4))
STATUSES = {"final": 10, "reviewed": 10, "confirmed": 7, "preliminary": 3}
UNKNOWN_QUALITY = 50.0


def first_plane(text: Column) -> Column:
    """(strike, dip, rake) of JSON: an object or an array's first element, with plain or nested values; null where none is."""
    one = F.when(F.ltrim(text).startswith("["), F.get_json_object(text, "$[0]")).otherwise(text)
    plain, nested = F.from_json(one, PLANE), F.from_json(one, NESTED)["nodalPlanes"]["nodalPlane1"]
    value = lambda k: F.coalesce(plain[k], nested[k]["value"])
    return F.when(value("strike").isNotNull() & value("dip").isNotNull() & value("rake").isNotNull(), F.struct(*[value(k).alias(k) for k in ("strike", "dip", "rake")]))


def quality(polarities: Column, misfit: Column, has_tensor: Column, reduction: Column, gap: Column, status: Column) -> Column:
    """0 to 100: points had of the points that could be had with what is known; 50 if nothing is."""
    judged = F.lit(0)
    for name, points in STATUSES.items():
        judged = F.when(status == name, points).otherwise(judged)
    tensor = F.coalesce(has_tensor, F.lit(False))
    parts = [
        (polarities.isNotNull(), 25, at_least(polarities, POLARITIES, 5)), (misfit.isNotNull(), 20, at_most(misfit, MISFITS, 0)),
        (tensor, 30, 15 + F.when(reduction.isNull(), 0).otherwise(at_least(reduction, REDUCTIONS, 0))), (gap.isNotNull(), 15, at_most(gap, GAPS, 0)), (status.isNotNull(), 10, judged),
    ]
    had = sum(F.when(known, F.lit(most)).otherwise(0) for known, most, _ in parts)
    got = sum(F.when(known, points).otherwise(0) for known, _, points in parts)
    return F.when(had > 0, got / had * 100).otherwise(UNKNOWN_QUALITY)
