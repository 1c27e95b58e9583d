"""Events as text in export formats: each a column that executors compute, so an export of any size is written in parallel."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
# Folders of a map by magnitude.
FOLDERS = ((3.0, "Below 3"), (4.0, "3 to 4"), (5.0, "4 to 5"), (6.0, "5 to 6"), (7.0, "6 to 7"))
TOP_FOLDER = "7 and above"
QUAKEML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<q:quakeml xmlns:q="http://quakeml.org/xmlns/quakeml/1.2" xmlns="http://quakeml.org/xmlns/bed/1.2">\n<eventParameters publicID="smi:local/{name}">'
QUAKEML_TAIL = "</eventParameters>\n</q:quakeml>"
CSV_COLUMNS = ("id", "time", "latitude", "longitude", "depth", "magnitude", "magnitude_type", "region", "stations", "phases", "gap", "rms", "evaluation_mode", "evaluation_status")


# Columns of the short table, by their heads.
SHORT_COLUMNS = {"Time": "time", "Latitude": "latitude", "Longitude": "longitude", "Magnitude": "magnitude", "Depth": "depth", "Source": "source"}


def iso(time: Column) -> Column:
    return F.date_format(time.cast("timestamp"), TIME)


def xml_escaped(value: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


def csv_field(value: Column) -> Column:
    """A value quoted where it holds a comma, quote or line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(columns: tuple[str, ...] = CSV_COLUMNS) -> Column:
    return F.concat_ws(",", *[csv_field(iso(F.col(c)) if c == "time" else F.col(c)) for c in columns])


def short_csv_line() -> Column:
    """A line of the short table: a zero depth is a value, a missing source is unknown."""
    said = {"time": iso(F.col("time")), "source": F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown"))}
    return F.concat_ws(",", *[csv_field(said.get(c, F.col(c))) for c in SHORT_COLUMNS.values()])


def csv_head(name: str, metadata: dict[str, object], columns: tuple[str, ...] = CSV_COLUMNS) -> str:
    """Comment lines of metadata and the header line."""
    return "\n".join([f"# Catalogue: {name}", *[f"# {k}: {v}" for k, v in metadata.items()], ",".join(columns)])


def json_record() -> Column:
    c = F.col
    return F.to_json(F.struct(
        c("id"), iso(c("time")).alias("time"), F.struct("latitude", "longitude", "depth").alias("location"), F.struct(c("magnitude").alias("value"), c("magnitude_type").alias("type"), c("magnitude_uncertainty").alias("uncertainty")).alias("magnitude"),
        F.struct(c("horizontal_uncertainty").alias("horizontal"), c("depth_uncertainty").alias("depth")).alias("uncertainties"), F.struct("gap", "stations", "phases", "rms").alias("quality"), F.struct(c("evaluation_mode").alias("mode"), c("evaluation_status").alias("status")).alias("evaluation"), c("region"),
    ))


def geojson_feature() -> Column:
    """A point feature whose third coordinate is the depth in km, as the reader takes it."""
    c = F.col
    place = F.array_compact(F.array(c("longitude"), c("latitude"), c("depth")))
    properties = F.struct(iso(c("time")).alias("time"), c("magnitude"), c("depth"), c("magnitude_type"), c("region"), c("evaluation_mode"), c("evaluation_status"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), c("id").cast("string").alias("id"), F.struct(F.lit("Point").alias("type"), place.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def folder(magnitude: Column) -> Column:
    """The map folder of a magnitude; negative ones are in the first, missing ones in Unknown."""
    out = F.lit(TOP_FOLDER)
    for bound, name in reversed(FOLDERS):
        out = F.when(magnitude < bound, name).otherwise(out)
    return F.when(magnitude.isNull(), "Unknown").otherwise(out)


def kml_placemark() -> Column:
    c = F.col
    say = lambda name: F.coalesce(c(name).cast("string"), F.lit("unknown"))
    return F.concat(
        F.lit("<Placemark><name>M"), say("magnitude"), F.lit("</name><description>"), xml_escaped(F.concat_ws(", ", F.concat(F.lit("depth "), say("depth"), F.lit(" km")), c("region"))), F.lit("</description><TimeStamp><when>"), iso(c("time")),
        F.lit("</when></TimeStamp><Point><coordinates>"), say("longitude"), F.lit(","), say("latitude"), F.lit(","), F.coalesce(-c("depth") * 1000, F.lit(0.0)).cast("string"), F.lit("</coordinates></Point></Placemark>"),
    )


def kml_folders(events: DataFrame) -> DataFrame:
    """folder and number of events: the counts of a document's folders."""
    return events.groupBy(folder(F.col("magnitude")).alias("folder")).agg(F.count("*").alias("n"))


def kml_lines(events: DataFrame) -> DataFrame:
    """The folders of a map document as lines (value), in order: each folder's head with its count, its placemarks by id, its end. The frame of FRAMES goes around them."""
    names = [*[name for _, name in FOLDERS], TOP_FOLDER, "Unknown"]
    place = lambda c: F.array_position(F.array(*map(F.lit, names)), c)
    counts = kml_folders(events)
    heads = counts.select(place(F.col("folder")).alias("at"), F.lit(0).alias("part"), F.lit(None).cast("string").alias("key"), F.concat(F.lit("<Folder><name>"), "folder", F.format_string(" (%d events)", "n"), F.lit("</name>")).alias("value"))
    ends = counts.select(place(F.col("folder")).alias("at"), F.lit(2).alias("part"), F.lit(None).cast("string").alias("key"), F.lit("</Folder>").alias("value"))
    marks = events.select(place(folder(F.col("magnitude"))).alias("at"), F.lit(1).alias("part"), F.lpad(F.col("id").cast("string"), 20, "0").alias("key"), kml_placemark().alias("value"))
    return heads.unionByName(marks).unionByName(ends).orderBy("at", "part", "key").select("value")


def _tag(name: str, value: Column) -> Column:
    """An element, or an empty text where the value is null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), xml_escaped(value.cast("string")), F.lit(f"</{name}>")), F.lit(""))


def _quantity(name: str, value: Column, uncertainty: Column) -> Column:
    """An element of a value and, where it is there, its uncertainty; an empty text where the value is null."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"<{name}>"), _tag("value", value), _tag("uncertainty", uncertainty), F.lit(f"</{name}>")))


def quakeml_event(prefix: str = "smi:local/", mechanism: bool = False) -> Column:
    """An event element with its uncertainties; mechanism: with strike, dip and rake as a focal mechanism where they are there."""
    c = F.col
    ident = F.concat(F.lit(f"{prefix}event/"), c("id").cast("string"))
    quality = F.concat(_tag("usedPhaseCount", c("phases")), _tag("usedStationCount", c("stations")), _tag("standardError", c("rms")), _tag("azimuthalGap", c("gap")), _tag("minimumDistance", c("minimum_distance")))
    origin = F.concat(
        F.lit('<origin publicID="'), ident, F.lit('/origin">'), _quantity("time", iso(c("time")), c("time_uncertainty")), _quantity("latitude", c("latitude"), c("latitude_uncertainty")), _quantity("longitude", c("longitude"), c("longitude_uncertainty")),
        _quantity("depth", c("depth") * 1000, c("depth_uncertainty") * 1000), F.coalesce(F.concat(F.lit("<originUncertainty>"), F.nullif(_tag("horizontalUncertainty", c("horizontal_uncertainty")), F.lit("")), F.lit("</originUncertainty>")), F.lit("")),
        F.lit("<quality>"), quality, F.lit("</quality>"), _tag("evaluationMode", c("evaluation_mode")), _tag("evaluationStatus", c("evaluation_status")), F.lit("</origin>"),
    )
    magnitude = F.concat(F.lit('<magnitude publicID="'), ident, F.lit('/magnitude">'), _quantity("mag", c("magnitude"), c("magnitude_uncertainty")), _tag("type", c("magnitude_type")), _tag("stationCount", c("magnitude_stations")), F.lit("</magnitude>"))
    text = F.coalesce(F.concat(F.lit("<description>"), F.nullif(_tag("text", F.nullif(c("region"), F.lit(""))), F.lit("")), F.lit("</description>")), F.lit(""))
    planes = F.lit("")
    if mechanism:
        plane = F.concat(*[F.concat(F.lit(f"<{x}>"), F.lit("<value>"), c(x).cast("string"), F.lit(f"</value></{x}>")) for x in ("strike", "dip", "rake")])
        planes = F.coalesce(F.concat(F.lit('<focalMechanism publicID="'), ident, F.lit('/mechanism"><nodalPlanes><nodalPlane1>'), plane, F.lit("</nodalPlane1></nodalPlanes></focalMechanism>")), F.lit(""))
    return F.concat(F.lit('<event publicID="'), ident, F.lit('">'), F.lit("<preferredOriginID>"), ident, F.lit("/origin</preferredOriginID><preferredMagnitudeID>"), ident, F.lit("/magnitude</preferredMagnitudeID>"), _tag("type", c("event_type")), text, origin, magnitude, planes, F.lit("</event>"))


def _each(values: Column, element: Callable[[Column], Column]) -> Column:
    """The elements of an array one after another; an empty text where it is null or empty."""
    return F.coalesce(F.array_join(F.transform(values, element), ""), F.lit(""))


def _open(name: str, ident: Column) -> Column:
    return F.concat(F.lit(f'<{name} publicID="'), xml_escaped(ident), F.lit('">'))


def quakeml_full_event() -> Column:
    """An event element with all of its parts: arrays origins (with their arrivals), magnitudes, picks, amplitudes and comments of structs, any of them null or empty.

    The preferred origin and magnitude are the first ones. A part without a public id gets one of its event's and its place.
    """
    ident = F.concat(F.lit("smi:local/event/"), F.col("id").cast("string"))
    named = lambda x, kind, k: F.coalesce(x["public_id"], F.concat(ident, F.lit(f"/{kind}/"), (k + 1).cast("string")))
    measured = lambda x, *names: F.concat(*[_quantity(name, iso(x[name]) if name == "time" else x[name] * 1000 if name == "depth" else x[name], x[f"{name}_uncertainty"] * (1000 if name == "depth" else 1)) for name in names])

    def arrival(x: Column) -> Column:
        return F.concat(_open("arrival", F.concat(x["pick_id"], F.lit("/arrival"))), _tag("pickID", x["pick_id"]), _tag("phase", x["phase"]), _tag("azimuth", x["azimuth"]), _tag("distance", x["distance"]), _tag("timeResidual", x["time_residual"]), _tag("timeWeight", x["time_weight"]), F.lit("</arrival>"))

    def origin(x: Column, k: Column) -> Column:
        return F.concat(_open("origin", named(x, "origin", k)), measured(x, "time", "latitude", "longitude", "depth"), _tag("evaluationMode", x["evaluation_mode"]), _tag("evaluationStatus", x["evaluation_status"]), _each(x["arrivals"], arrival), F.lit("</origin>"))

    def magnitude(x: Column, k: Column) -> Column:
        return F.concat(_open("magnitude", named(x, "magnitude", k)), _quantity("mag", x["mag"], x["uncertainty"]), _tag("type", x["type"]), _tag("stationCount", x["station_count"]), _tag("originID", x["origin_id"]), F.lit("</magnitude>"))

    def pick(x: Column, k: Column) -> Column:
        codes = F.concat(*[F.coalesce(F.concat(F.lit(f' {name}="'), xml_escaped(x[field]), F.lit('"')), F.lit("")) for name, field in (("networkCode", "network"), ("stationCode", "station"), ("locationCode", "location"), ("channelCode", "channel"))])
        return F.concat(_open("pick", named(x, "pick", k)), _quantity("time", iso(x["time"]), x["time_uncertainty"]), F.lit("<waveformID"), codes, F.lit("/>"), _tag("onset", x["onset"]), _tag("phaseHint", x["phase"]), _tag("polarity", x["polarity"]), F.lit("</pick>"))

    def amplitude(x: Column, k: Column) -> Column:
        return F.concat(_open("amplitude", named(x, "amplitude", k)), _quantity("genericAmplitude", x["value"], x["uncertainty"]), _tag("type", x["type"]), _tag("unit", x["unit"]), _tag("pickID", x["pick_id"]), F.lit("</amplitude>"))

    preferred = lambda name, values, kind: F.when(F.size(values) > 0, _tag(name, named(F.get(values, F.lit(0)), kind, F.lit(0)))).otherwise("")
    c = F.col
    return F.concat(
        _open("event", ident), F.coalesce(preferred("preferredOriginID", c("origins"), "origin"), F.lit("")), F.coalesce(preferred("preferredMagnitudeID", c("magnitudes"), "magnitude"), F.lit("")), _tag("type", c("event_type")),
        _each(c("comments"), lambda x: F.concat(F.lit("<comment>"), _tag("text", x), F.lit("</comment>"))), _each(c("origins"), origin), _each(c("magnitudes"), magnitude), _each(c("picks"), pick), _each(c("amplitudes"), amplitude), F.lit("</event>"),
    )


FORMATS = {"json": json_record, "geojson": geojson_feature, "kml": kml_placemark, "quakeml": quakeml_event, "quakeml_full": quakeml_full_event, "csv": csv_line}
#: What stands before, between and after the records of a whole document.
FRAMES = {
    "json": ('{{"name": {name}, "events": [', ",", "]}}"), "geojson": ('{{"type": "FeatureCollection", "name": {name}, "features": [', ",", "]}}"),
    "kml": ('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{text}</name>', "", "</Document></kml>"), "quakeml": (QUAKEML_HEAD.replace("{name}", "{text}"), "", QUAKEML_TAIL),
    "csv": ("{head}", "", ""),
}
FRAMES["quakeml_full"] = FRAMES["quakeml"]


def write_records(events: DataFrame, path: str, kind: str) -> None:
    """One record a line, in as many part files as the frame has partitions."""
    events.select(FORMATS[kind]().alias("value")).write.text(path)


def write_store(events: DataFrame, path: str, mode: str = "append") -> None:
    """The event store: Parquet by catalogue, in time order within files, so that reads by catalogue and time skip the rest. Rows out of range stop the write."""
    checked = events.where(F.assert_true(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.col("magnitude").between(-3, 10) & (F.col("depth").isNull() | F.col("depth").between(-5, 1000)), F.lit("an event is out of range")).isNull())
    checked.repartition("catalogue_id", F.to_date("time")).sortWithinPartitions("catalogue_id", "time").write.mode(mode).partitionBy("catalogue_id").parquet(path)


def document(parts: list[str], kind: str, name: str) -> str:
    """A whole document of records in memory: for small downloads; write_document writes large ones."""
    first, between, last = _frame(kind, name)
    return first + ("\n" if kind == "csv" else "") + (between + "\n").join(parts) + last


def _frame(kind: str, name: str) -> tuple[str, str, str]:
    first, between, last = FRAMES[kind]
    said = {"name": json.dumps(name), "text": re.sub(r"[<>&]", "", name), "head": csv_head(name, {})}
    return first.format(**said), between, last.format(**said)


def document_lines(events: DataFrame, kind: str, name: str) -> DataFrame:
    """The lines (value) of a whole document in order: its head, the records by time and id, its tail. Separators stand before all records but the first."""
    head, between, tail = _frame(kind, name)
    # Equal records are counted and dealt out by number, so that each key is there once and a second reading finds the same first one.
    counted = events.select(F.col("time").cast("timestamp").alias("time"), F.col("id").cast("string").alias("id"), FORMATS[kind]().alias("record")).groupBy("time", "id", "record").count()
    placed = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("place"))
    keyed = placed.select(F.struct("time", "id", F.xxhash64("record").alias("hash"), "place").alias("key"), "record")
    first = keyed.agg(F.min("key").alias("first"))  # one row
    led = F.when(F.col("key") == F.col("first"), F.col("record")).otherwise(F.concat(F.lit(between), "record")) if between else F.col("record")
    records = keyed.join(F.broadcast(first)).select(F.lit(1).alias("part"), "key", led.alias("value"))
    none = F.lit(None).cast(keyed.schema["key"].dataType)
    ends = lambda part, text: events.sparkSession.range(1).select(F.lit(part).alias("part"), none.alias("key"), F.lit(text).alias("value"))
    return ends(0, head).unionByName(records).unionByName(ends(2, tail) if tail else ends(2, tail).limit(0)).orderBy("part", "key").select("value")


def write_document(events: DataFrame, path: str, kind: str, name: str) -> None:
    """Writes one document as part files, by as many tasks as the order's ranges make; read in the order of their names they are the document. The parts become visible all at once, when every task is done; a failed write leaves nothing."""
    document_lines(events, kind, name).write.text(path)


def join_parts(spark: SparkSession, path: str, to: str) -> None:
    """The part files of write_document as one file, copied in order by a stream of small blocks, and given its name only when it is whole."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(to)
    files, unfinished = folder.getFileSystem(conf), jvm.org.apache.hadoop.fs.Path(f"{to}._unfinished")
    store = target.getFileSystem(conf)
    out = store.create(unfinished, True)
    try:
        for part in sorted(str(x.getPath()) for x in files.listStatus(folder) if x.getPath().getName().startswith("part-")):
            source = files.open(jvm.org.apache.hadoop.fs.Path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()
    if not store.rename(unfinished, target):
        raise OSError(f"{to} could not be written")


def file_name(name: str, kind: str, day: date) -> str:
    """A name for a download: letters, digits, dashes and underscores, the day, and the format's ending."""
    plain = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_-]", "_", name)).strip("_")[:100] or "catalogue"
    return f"{plain}_{day.isoformat()}.{ {'quakeml': 'xml'}.get(kind, kind)}"


def content_disposition(name: str) -> str:
    return f'attachment; filename="{name}"'
