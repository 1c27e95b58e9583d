"""The pipe-separated text that FDSN event services answer with, and the requests for it."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import datetime, timedelta
from urllib.parse import urlencode

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .delimited import read_lines
from .rows import typed

# Columns of the text format by field; a box around New Zealand.
COLUMNS = {"EventID": "id", "Time": "time", "Latitude": "latitude", "Longitude": "longitude", "Depth/km": "depth", "Author": "author", "MagType": "magnitude_type", "Magnitude": "magnitude", "EventLocationName": "location_name"}
NEW_ZEALAND = {"minlatitude": -47.5, "maxlatitude": -34.0, "minlongitude": 165.0, "maxlongitude": 179.0}


@dataclass(frozen=True)
class Request:
    """What a service is asked for; only what is set is sent."""

    starttime: datetime | None = None
    endtime: datetime | None = None
    updatedafter: datetime | None = None
    minlatitude: float | None = None
    maxlatitude: float | None = None
    minlongitude: float | None = None
    maxlongitude: float | None = None
    latitude: float | None = None
    longitude: float | None = None
    maxradius: float | None = None
    mindepth: float | None = None
    maxdepth: float | None = None
    minmagnitude: float | None = None
    maxmagnitude: float | None = None
    eventid: str | None = None
    orderby: str | None = None
    limit: int | None = None
    format: str = "text"

    def url(self, base: str) -> str:
        say = lambda v: v.strftime("%Y-%m-%dT%H:%M:%S") if isinstance(v, datetime) else v
        return f"{base}?{urlencode({f.name: say(v) for f in fields(self) if (v := getattr(self, f.name)) is not None})}"

    def recent(self, now: datetime, hours: float = 24) -> Request:
        return replace(self, starttime=now - timedelta(hours=hours), endtime=now)

    def updated_since(self, since: datetime) -> Request:
        return replace(self, updatedafter=since)

    def around_new_zealand(self) -> Request:
        return replace(self, **NEW_ZEALAND)


def read_answers(lines: DataFrame) -> DataFrame:
    """Events, with failures, of the lines (value) of answers; an unreadable depth is null and a warning."""
    return read_lines(lines, delimiter="|", order="iso", comment="#", names=COLUMNS)


# Columns of a temporary network's file, which has no header.
TEMPORARY = ("id", "time", "latitude", "longitude", "depth", "author", "catalog", "contributor", "contributor_id", "magnitude_type", "magnitude", "magnitude_author", "location_name")


def read_temporary(lines: DataFrame, network: str | None = None) -> DataFrame:
    """Events, with failures, of a temporary network's lines (value): thirteen or more columns between bars; blank lines and those that begin with # are passed over, shorter ones fail."""
    kept = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.col("value").alias("line"), F.explode(F.array(F.transform(F.split("value", r"\|", -1), lambda x: F.trim(x)))).alias("_parts"))
    at = {name: k for k, name in enumerate(TEMPORARY)}
    raw = {field: F.get("_parts", F.lit(at[field])) for field in ("id", "time", "latitude", "longitude", "depth", "author", "magnitude_type", "magnitude", "location_name")}
    raw["agency_id"] = F.lit(network).cast("string") if network else F.get("_parts", F.lit(at["contributor"]))
    events = typed(kept.withColumn("_width", F.size("_parts") >= len(TEMPORARY)), raw, "iso", keep=("line", "_width"))
    width = F.struct(F.lit("width").alias("name"), F.lit("line").alias("field"), F.lit("error").alias("severity"))
    return events.withColumn("failures", F.when(F.col("_width"), F.col("failures")).otherwise(F.array(width))).drop("_width")
