"""How authoritative a source is, by words in its name, with regions where others come first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import in_box

Ranks = tuple[tuple[int, tuple[str, ...]], ...]
# Ranks of networks by words in their names, over the world and in two boxes (south, north, west, east); of mechanisms' sources; of unknown and missing ones.
WORLD: Ranks = ((1, ("geonet", "gns", "nz")), (2, ("gcmt", "cmt", "globalcmt")), (3, ("isc", "isc-gem")), (4, ("usgs", "neic", "anss")), (5, ("emsc", "csem")), (6, ("jma", "japan")), (7, ("geofon", "gfz")), (8, ("iris",)), (9, ("ingv",)), (10, ("ign",)))
REGIONS: tuple[tuple[tuple[float, float, float, float], Ranks], ...] = (
    ((-48, -34, 165, 180), ((1, ("geonet", "gns", "nz")), (2, ("gcmt", "cmt")), (3, ("isc",)), (4, ("usgs", "neic")))),
    ((24, 46, 122, 154), ((1, ("jma", "japan")), (2, ("gcmt", "cmt")), (3, ("isc",)), (4, ("usgs", "neic")))),
)
MECHANISMS: Ranks = ((1, ("gcmt", "globalcmt", "cmt")), (2, ("geonet", "gns")), (3, ("usgs", "neic")), (4, ("isc",)))
UNKNOWN, NONE = 100, 999


def rank_of(name: Column, ranks: Ranks) -> Column:
    """The first rank one of whose words the name holds; null if none."""
    out = F.lit(None).cast("int")
    for rank, words in reversed(ranks):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(w)) for w in words]), rank).otherwise(out)
    return out


def network_rank(name: Column, latitude: Column, longitude: Column, ranks: Ranks = WORLD) -> Column:
    here = [F.when(in_box(latitude, longitude, *box), rank_of(name, own)) for box, own in REGIONS]
    return F.when(F.coalesce(name, F.lit("")) == "", NONE).otherwise(F.coalesce(*here, rank_of(name, ranks), F.lit(UNKNOWN)))


def mechanism_rank(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", NONE).otherwise(F.coalesce(rank_of(name, MECHANISMS), F.lit(UNKNOWN)))
