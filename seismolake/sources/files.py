"""A file of events by its name's ending, or by its first character where that says nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import delimited, json_files, quakeml

# Formats by ending.
ENDINGS = {"csv": "delimited", "txt": "delimited", "dat": "delimited", "tsv": "delimited", "json": "json", "geojson": "geojson", "ndjson": "json lines", "xml": "quakeml", "qml": "quakeml"}


def kind_of(spark: SparkSession, path: str) -> str:
    kind = ENDINGS.get(path.rsplit(".", 1)[-1].lower())
    if kind and kind != "json":
        return kind
    first = spark.read.text(path).where(delimited.NO_BLANK).head(1)
    start = first[0].value.lstrip()[:1] if first else ""
    if start in ("{", "["):
        return "geojson" if is_geojson(spark, path) else "json"
    return "quakeml" if start == "<" else "delimited"


def is_geojson(spark: SparkSession, path: str) -> bool:
    kinds = json_files.texts_of(spark, path).select(F.get_json_object("value", "$.type").alias("t")).head(1)
    return bool(kinds) and kinds[0]["t"] in ("FeatureCollection", "Feature")


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """Events with failures of a file of any known format. rows.accepted and rows.rejected part them."""
    kind = kind_of(spark, path)
    if kind == "quakeml":
        return quakeml.read_quakeml(spark, path)
    if kind == "geojson":
        return json_files.read_features(json_files.texts_of(spark, path))
    if kind == "json":
        return json_files.read_records(json_files.texts_of(spark, path), **options)
    return delimited.read_delimited(spark, path, **options)
