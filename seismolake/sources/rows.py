"""Rows of source text made typed events: what all file formats share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismolake.functions import text as read
from seismolake.operators.validation import has_error, row_failures
from seismolake.plans.fields import ALIASES, COUNTS, NUMBERS

ALWAYS = ("id", "time", "latitude", "longitude", "depth", "magnitude")


def typed(frame: DataFrame, raw: dict[str, Column], order: str = "us", keep: tuple[str, ...] = ()) -> DataFrame:
    """Events from source text by field, with `failures` (see row_failures). Columns in `keep` stay.

    Every field in `raw`, and those of ALWAYS, become columns; text that can't be read is null and a failure.
    """
    # Generators keep the optimizer from writing the reading of a text anew into each column that uses it.
    texts = F.struct(*[c.alias(field) for field, c in raw.items()]) if raw else F.struct(F.lit(None).cast("string").alias("id"))
    frame = frame.select(*keep, F.explode(F.array(texts)).alias("_raw"))

    def value(field: str) -> Column:
        if field not in raw:
            return F.lit(None).cast("timestamp" if field == "time" else "string" if field == "id" else "double")
        source = F.col(f"_raw.{field}")
        if field == "time":
            return read.timestamp(source, order)
        if field in COUNTS:
            return read.number(source).cast("int")
        return read.number(source) if field in NUMBERS else F.nullif(F.trim(source), F.lit(""))

    fields = [f for f in ALIASES if f in raw or f in ALWAYS]
    frame = frame.select(*keep, "_raw", F.inline(F.array(F.struct(*[value(f).alias(f) for f in fields]))))
    return frame.withColumn("failures", row_failures({f: F.col(f"_raw.{f}") for f in raw})).drop("_raw")


def accepted(events: DataFrame) -> DataFrame:
    return events.where(~has_error(F.col("failures"))).drop("failures")


def rejected(events: DataFrame) -> DataFrame:
    return events.where(has_error(F.col("failures")))


#: Fields that are stored of an event, in order, beside its key; others are dropped.
STORED = (
    "source_id", "time", "latitude", "longitude", "magnitude", "depth", "region", "location_name", "event_public_id", "event_type", "event_type_certainty", "time_uncertainty", "latitude_uncertainty", "longitude_uncertainty", "depth_uncertainty",
    "magnitude_type", "magnitude_uncertainty", "magnitude_station_count", "azimuthal_gap", "minimum_distance", "used_phase_count", "used_station_count", "standard_error", "evaluation_mode", "evaluation_status", "author", "agency_id",
)


def ingested(events: DataFrame, catalogue_id: int) -> DataFrame:
    """Events as they are stored: those of STORED that are there, the source's id as source_id, and a key of catalogue, source id, time and place, the same if the import runs again."""
    named = events.withColumn("source_id", F.col("id").cast("string")) if "source_id" not in events.columns else events
    key = F.sha2(F.concat_ws("|", F.lit(catalogue_id), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_id", "time", "latitude", "longitude")]), 256)
    return named.select(key.alias("id"), F.lit(catalogue_id).alias("catalogue_id"), *[c for c in STORED if c in named.columns])
