"""JSON and GeoJSON: whole texts are cut into records on the executors, by the shapes that are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seismolake.functions.geo import held
from seismolake.plans.fields import lookup

from .rows import typed

# Keys that may hold the records of an object.
KEYS = ("events", "data", "features", "earthquakes", "results")
RECORDS = "array<map<string,string>>"
FEATURE = "struct<type:string,id:string,geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>"


def records(texts: DataFrame) -> DataFrame:
    """A row a record (map of text by key) of texts (value) that hold an array, or an object with one under a known key."""
    v = F.col("value")
    inside = F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in KEYS])
    array = F.when(F.ltrim(v).startswith("["), v).otherwise(inside)
    return texts.select(F.explode(F.from_json(array, RECORDS)).alias("record"))


def read_records(texts: DataFrame, order: str = "us", names: dict[str, str] | None = None) -> DataFrame:
    """Events of JSON texts (value), with failures. Fields are found from the keys that occur, or given by names (field by key)."""
    rows = records(texts)
    names = field_names(rows.select(F.map_keys("record").alias("keys"))) if names is None else names
    return typed(rows, {field: F.try_element_at("record", F.lit(source)) for source, field in names.items()}, order)


def field_names(keys: DataFrame) -> dict[str, str]:
    """field by key, from all keys (keys) that occur: one row a different key comes to the driver."""
    found = keys.select(F.explode("keys").alias("key")).groupBy("key").count().orderBy("key").collect()
    return {source: field for field, source in lookup(sorted((r.key for r in found), key=lambda k: (len(k), k))).items()}


def features(texts: DataFrame) -> DataFrame:
    """A row a feature of GeoJSON texts: FeatureCollections and single features; other types give none."""
    v = F.col("value")
    kind = F.get_json_object(v, "$.type")
    many = F.from_json(F.get_json_object(v, "$.features"), f"array<{FEATURE}>")
    one = F.array(F.from_json(v, FEATURE))
    return texts.select(F.explode(F.when(kind == "FeatureCollection", many).when(kind == "Feature", one)).alias("feature"))


def read_features(texts: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Events of GeoJSON points, with failures: longitude, latitude and depth from the coordinates, all else from properties.

    A feature that is no point, or has fewer than two coordinates, has no place and so fails.
    """
    rows = features(texts)
    names = field_names(rows.select(F.map_keys("feature.properties").alias("keys"))) if names is None else names
    f = F.col("feature")
    place = lambda k: F.when((f["geometry"]["type"] == "Point") & (F.size(f["geometry"]["coordinates"]) >= 2), F.get(f["geometry"]["coordinates"], F.lit(k))).cast("string")
    raw = {field: F.try_element_at(f["properties"], F.lit(source)) for source, field in names.items()}
    depth = F.coalesce(place(2), raw.get("depth", F.lit(None).cast("string")))
    identity = F.coalesce(f["id"], raw.get("id", F.lit(None).cast("string")))
    return typed(rows, raw | {"id": identity, "longitude": place(0), "latitude": place(1), "depth": depth})


def texts_of(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as texts (value). A file is one row: large ones belong in a format of records a line."""
    return spark.read.text(path, wholetext=True)


def read_json_lines(lines: DataFrame, names: dict[str, str], order: str = "us") -> DataFrame:
    """Events of lines that hold one JSON object each; batch or stream. names: field by key."""
    rows = lines.select(F.from_json("value", "map<string,string>").alias("record"))
    return typed(rows, {field: F.try_element_at("record", F.lit(source)) for source, field in names.items()}, order)


FAULT = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"


def read_faults(texts: DataFrame, name: str = "name") -> DataFrame:
    """A row a line of a GeoJSON FeatureCollection's faults: name, its properties and points (longitude, latitude). A MultiLineString gives a row for each of its lines; texts that are no collection give none."""
    each = texts.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), f"array<{FAULT}>")).alias("f"))
    shape, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    lines = F.when(shape == "LineString", F.array(F.from_json(text, "array<array<double>>"))).when(shape == "MultiLineString", F.from_json(text, "array<array<array<double>>>"))
    return each.select(F.try_element_at("f.properties", F.lit(name)).alias("name"), F.col("f.properties").alias("properties"), F.explode(lines).alias("points")).where(F.size("points") > 0)


# Large documents


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Files cut after each closing brace, by as many tasks as they have splits: value (without the brace), file, block and place, which order them; and of each piece the quotes, the text outside of strings and the change of depth, were it to begin outside of a string (0) or within one (1)."""
    read = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("place", F.monotonically_increasing_id())
    parts = held(read, parts=F.split(F.regexp_replace("value", r"\\.", ""), '"', -1))
    outside = lambda k: F.array_join(F.filter("parts", lambda x, i: i % 2 == k), " ")
    bare = held(parts, quotes=F.size("parts") - 1, bare0=outside(0), bare1=outside(1)).drop("parts")
    change = lambda k: F.length(f"bare{k}") - F.length(F.replace(f"bare{k}", F.lit("{"))) - (F.col("quotes") % 2 == k).cast("int")
    return held(bare, change0=change(0).cast("long"), change1=change(1).cast("long"))


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row (value) for each record of JSON files that are an array of objects, or an object with one under a known key, however large: read by splits, in no task whole.

    Whether a split begins within a string, and how deep, follows from the splits before it: each is summed up for both cases, and only these sums, a row a split, are put in
    order. Then records are numbered by the objects that end at their depth, and their pieces brought together. Objects before and after the array are left out; a file of another shape gives no rows.
    """
    pieces = _pieces(spark, path)
    in_block = Window.partitionBy("file", "block").orderBy("place")
    before, earlier = in_block.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    odd = zero(F.sum("quotes").over(before)) % 2
    pieces = pieces.withColumn("odd", odd).withColumns({"even_start": F.when(F.col("odd") == 0, F.col("change0")).otherwise(F.col("change1")), "odd_start": F.when(F.col("odd") == 0, F.col("change1")).otherwise(F.col("change0"))})
    # A row a split.
    blocks = pieces.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum("even_start").alias("even"), F.sum("odd_start").alias("odd"))
    blocks = blocks.withColumn("begins_in", zero(F.sum("quotes").over(earlier)) % 2)
    blocks = blocks.select("file", "block", "begins_in", zero(F.sum(F.when(F.col("begins_in") == 0, F.col("even")).otherwise(F.col("odd"))).over(earlier)).alias("begins_at"))
    known = pieces.join(blocks, ["file", "block"]).withColumn("within", (F.col("begins_in") + F.col("odd")) % 2)
    known = known.withColumn("change", F.when(F.col("within") == 0, F.col("change0")).otherwise(F.col("change1")))
    known = known.withColumn("depth", F.col("begins_at") + zero(F.sum("change").over(before))).select("file", "block", "place", "value", "within", "depth", "change", F.when(F.col("within") == 0, F.col("bare0")).otherwise(F.col("bare1")).alias("bare"))
    at = F.struct("block", "place")
    keyed = F.col("value").rlike(rf'"(?:{"|".join(KEYS)})"\s*:\s*\[') & (F.col("depth") <= 1) & (F.col("within") == 0)
    shape = known.groupBy("file").agg(F.min_by("value", at).alias("head"), F.min(F.when(keyed, at)).alias("first"))
    shape = shape.select("file", F.when(F.ltrim("head").startswith("["), 0).when(F.col("first").isNotNull(), 1).alias("base"), "first").where("base is not null")
    known = known.join(shape, "file")
    done = known.where((F.col("base") == 1) & (at > F.col("first")) & (F.col("depth") == 1) & F.col("bare").rlike(r"^[^{]*\]")).groupBy("file").agg(F.min(at).alias("last"))
    known = known.join(done, "file", "left").where((F.col("base") == 0) | (at >= F.col("first")) & (F.col("last").isNull() | (at < F.col("last"))))
    known = known.withColumn("ends", ((F.col("depth") + F.col("change") == F.col("base")) & (F.col("depth") + F.col("change") >= 0) & F.col("bare").isNotNull()).cast("long"))
    ended = known.groupBy("file", "block").agg(F.sum("ends").alias("ends")).select("file", "block", zero(F.sum("ends").over(earlier)).alias("ended"))
    numbered = known.join(ended, ["file", "block"]).withColumn("record", F.col("ended") + zero(F.sum("ends").over(before)))
    whole = numbered.groupBy("file", "record", "base").agg(F.array_sort(F.collect_list(F.struct("block", "place", "value", "ends"))).alias("pieces"))
    whole = whole.where(F.element_at("pieces", -1)["ends"] == 1)
    text = F.concat(F.array_join(F.transform("pieces", lambda x: x["value"]), "}"), F.lit("}"))
    led = F.when((F.col("record") == 0) & (F.col("base") == 1), F.regexp_replace(text, rf'(?s)^.*?"(?:{"|".join(KEYS)})"\s*:\s*\[', "")).otherwise(text)
    return whole.select(F.regexp_replace(led, r"^[\s,\[]*", "").alias("value")).where(F.col("value").startswith("{"))


def read_large_records(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Events of JSON files as in read_records, each file read by as many tasks as it has splits."""
    return read_records(record_texts(spark, path).select(F.concat(F.lit("["), "value", F.lit("]")).alias("value")), names=names)


def read_large_features(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """Events of GeoJSON collections as in read_features, each file read by as many tasks as it has splits."""
    return read_features(record_texts(spark, path), names)
