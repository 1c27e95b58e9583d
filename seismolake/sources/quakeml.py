"""QuakeML events: Spark's own XML functions with an explicit nested schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seismolake.functions import text as read
from seismolake.operators.validation import failing, row_failures

_QUANTITY = "struct<value:double,uncertainty:double,lowerUncertainty:double,upperUncertainty:double,confidenceLevel:double>"
_PLANE = f"struct<strike:{_QUANTITY},dip:{_QUANTITY},rake:{_QUANTITY}>"
EVENT = (
    "_publicID string, type string, typeCertainty string, preferredOriginID string, preferredMagnitudeID string, description array<struct<text:string,type:string>>, "
    "comment array<struct<text:string>>, creationInfo struct<agencyID:string,author:string,creationTime:string>, "
    f"origin array<struct<_publicID:string,time:struct<value:string,uncertainty:double>,latitude:{_QUANTITY},longitude:{_QUANTITY},depth:{_QUANTITY},depthType:string,methodID:string,earthModelID:string,"
    "quality:struct<usedPhaseCount:int,usedStationCount:int,associatedPhaseCount:int,associatedStationCount:int,depthPhaseCount:int,standardError:double,azimuthalGap:double,minimumDistance:double,maximumDistance:double>,"
    "originUncertainty:struct<horizontalUncertainty:double>,evaluationMode:string,evaluationStatus:string>>, "
    f"magnitude array<struct<_publicID:string,mag:{_QUANTITY},type:string,stationCount:int,methodID:string,evaluationMode:string,evaluationStatus:string>>, "
    f"focalMechanism array<struct<_publicID:string,nodalPlanes:struct<nodalPlane1:{_PLANE},nodalPlane2:{_PLANE}>>>"
)


def event_texts(texts: DataFrame) -> DataFrame:
    """A row an event element (value) of whole QuakeML texts; prefixes of names are dropped."""
    plain = F.regexp_replace("value", r"(</?)[A-Za-z]\w*:", "$1")
    return texts.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)(<event\b.*?</event>)"), F.lit(1))).alias("value"))


def _preferred(all_: Column, wanted: Column) -> Column:
    """The element with the wanted public id, else the first."""
    return F.coalesce(F.get(F.filter(all_, lambda x: x["_publicID"] == wanted), F.lit(0)), F.get(all_, F.lit(0)))


def flattened(events: DataFrame) -> DataFrame:
    """Events (columns of EVENT) as flat rows with failures, which also name a missing origin, magnitude or preferred one; depth in km."""
    e = events.select("*", _preferred(F.col("origin"), F.col("preferredOriginID")).alias("o"), _preferred(F.col("magnitude"), F.col("preferredMagnitudeID")).alias("m"))
    c = F.col
    q = {"used_phase_count": "usedPhaseCount", "used_station_count": "usedStationCount", "standard_error": "standardError", "azimuthal_gap": "azimuthalGap", "minimum_distance": "minimumDistance", "maximum_distance": "maximumDistance"}
    lost = lambda kind, wanted: c(wanted).isNotNull() & ~F.exists(F.coalesce(c(kind), F.array().cast(events.schema[kind].dataType)), lambda x: x["_publicID"] == c(wanted))
    flat = e.select(
        F.regexp_extract("_publicID", r"([^/=]+)$", 1).alias("id"), c("_publicID").alias("event_public_id"), read.timestamp(c("o.time.value")).alias("time"), c("o.latitude.value").alias("latitude"), c("o.longitude.value").alias("longitude"),
        (c("o.depth.value") / 1000).alias("depth"), c("m.mag.value").alias("magnitude"), c("m.type").alias("magnitude_type"), c("m.mag.uncertainty").alias("magnitude_uncertainty"), c("m.stationCount").alias("magnitude_station_count"),
        c("type").alias("event_type"), c("typeCertainty").alias("event_type_certainty"), F.get("description", F.lit(0))["text"].alias("region"), c("creationInfo.agencyID").alias("agency_id"), c("creationInfo.author").alias("author"),
        c("o.latitude.uncertainty").alias("latitude_uncertainty"), c("o.longitude.uncertainty").alias("longitude_uncertainty"), (c("o.depth.uncertainty") / 1000).alias("depth_uncertainty"), c("o.originUncertainty.horizontalUncertainty").alias("horizontal_uncertainty"),
        c("o.evaluationMode").alias("evaluation_mode"), c("o.evaluationStatus").alias("evaluation_status"), *[c(f"o.quality.{name}").alias(field) for field, name in q.items()],
        c("o.time.uncertainty").alias("time_uncertainty"), F.transform("comment", lambda x: x["text"]).alias("comments"),
        F.struct(*[c(f"{side}.{name}").alias(name) for side, name in (("o", "latitude"), ("o", "longitude"), ("o", "depth"), ("m", "mag"))]).alias("quantities"),
        *[F.get("focalMechanism", F.lit(0))["nodalPlanes"]["nodalPlane1"][x]["value"].alias(x) for x in ("strike", "dip", "rake")],
        failing([
            ("no_public_id", "event", "error", F.coalesce(c("_publicID"), F.lit("")) == ""), ("no_origin", "origin", "error", F.coalesce(F.size("origin"), F.lit(0)) <= 0), ("no_magnitude", "magnitude", "error", F.coalesce(F.size("magnitude"), F.lit(0)) <= 0),
            ("unknown_preferred", "origin", "error", lost("origin", "preferredOriginID")), ("unknown_preferred", "magnitude", "error", lost("magnitude", "preferredMagnitudeID")),
            ("negative_depth", "depth", "error", c("o.depth.value") < 0), ("unusual_magnitude", "magnitude", "warning", ~c("m.mag.value").between(-2, 10)),
            ("no_depth", "depth", "warning", c("o.depth.value").isNull()), ("no_quality", "quality", "warning", c("o.quality").isNull()),
        ]).alias("_structure"),
    )
    return flat.withColumn("failures", F.concat("_structure", row_failures({}))).drop("_structure")


def read_events(texts: DataFrame) -> DataFrame:
    """Flat events of rows that hold one event element each (value)."""
    return flattened(texts.select(F.inline(F.array(F.from_xml("value", EVENT, {"mode": "PERMISSIVE"})))))


def read_quakeml(spark: SparkSession, path: str) -> DataFrame:
    """Flat events of QuakeML files; files are split at event elements, so a large one is read by several tasks."""
    return flattened(spark.read.format("xml").option("rowTag", "event").schema(EVENT).load(path))


def document_problems(texts: DataFrame) -> DataFrame:
    """texts (value) with `problems` of the whole document: no root, no events, no namespace, tags that don't balance."""
    v = F.col("value")
    count = lambda p: F.regexp_count(v, F.lit(p))
    opened = count(r"<[A-Za-z][^>]*>") - count(r"<[A-Za-z][^>]*/>")
    return texts.withColumn("problems", failing([
        ("no_root", "document", "error", ~v.rlike(r"<(\w+:)?quakeml\b")), ("no_events", "document", "error", ~v.rlike(r"<(\w+:)?event\b")),
        ("no_namespace", "document", "warning", ~v.contains("xmlns")), ("unbalanced", "document", "error", opened != count(r"</[A-Za-z]")),
    ]))
