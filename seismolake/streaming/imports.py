"""Incremental imports as Structured Streaming: files or lines in, typed events out, merged into a store batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from seismolake.operators.search import classify_import
from seismolake.sources import json_files, quakeml
from seismolake.sources.delimited import parsed, split_head
from seismolake.sources.rows import accepted


def delimited_stream(spark: SparkSession, folder: str, header: str, delimiter: str = ",", names: dict[str, str] | None = None, files: int = 10, order: str = "us") -> DataFrame:
    """Events, with failures (also of lines of another width), of files that arrive in a folder, each with the same header line; `files` at most a batch."""
    from seismolake.plans.fields import lookup

    columns = split_head(header, delimiter)
    found = lookup(columns) | {field: source for source, field in (names or {}).items()}
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder).where((F.trim("value") != "") & (F.trim("value") != header.strip()))
    return parsed(lines, columns, delimiter, {field: columns.index(source) for field, source in found.items()}, order)


def json_stream(spark: SparkSession, folder: str, names: dict[str, str], files: int = 10) -> DataFrame:
    """Events, with failures, of files of one JSON object a line."""
    return json_files.read_json_lines(spark.readStream.option("maxFilesPerTrigger", files).text(folder), names)


def quakeml_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Events, with failures, of QuakeML documents that arrive whole."""
    return quakeml.read_events(quakeml.event_texts(spark.readStream.option("maxFilesPerTrigger", files).text(folder, wholetext=True)))


def first_arrivals(events: DataFrame, late: str = "1 day", key: str = "id") -> DataFrame:
    """Each id once: repeats within the watermark are dropped, and the state of older ones is let go."""
    return events.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late).dropDuplicatesWithinWatermark([key])


def rates(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and largest magnitude of each window of time, final once the watermark has passed it."""
    timed = events.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late)
    return timed.groupBy(F.window("time", window)).agg(F.count("*").alias("n"), F.max("magnitude").alias("largest")).select("window.start", "n", "largest")


#: Buckets of ids that a catalogue's part of a version is cut into.
BUCKETS = 256


def bucket(ident: Column) -> Column:
    return F.pmod(F.xxhash64(ident.cast("string")), F.lit(BUCKETS)).cast("int")


#: Columns of an import's counts, by action.
HISTORY = {"added": "new", "updated": "updated", "skipped": "skipped", "errors": "error"}


def merge_batch(store: str, catalogue_id: int, update: bool = True, history: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: new events are added, known ones replaced (or left), invalid ones passed over.

    The store keeps versions: a batch adds a folder of its own, written again if the batch is, and readers take the last version of
    an id (see read_store). So nothing is rewritten in place, and a batch that runs twice changes nothing.
    history: a table that gets a row a batch, again if the batch is: how many events were new, updated, skipped and in error, counted as they are written.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        events = accepted(batch).dropDuplicates(["id"]).withColumn("catalogue_id", F.lit(catalogue_id))
        # Of the store only this catalogue's ids are read, and their versions merged for the ids of the batch alone.
        known = read_store(spark, store, events, before=number, catalogue_id=catalogue_id, ids=events.select("id"))
        seen = Observation()
        counts = [F.count_if(F.col("action") == action).alias(name) for name, action in HISTORY.items()]
        marked = classify_import(known, events, update).observe(seen, *counts).where(F.col("action").isin("new", "updated"))
        marked.drop("action").withColumn("bucket", bucket(F.col("id"))).write.mode("overwrite").partitionBy("catalogue_id", "bucket").parquet(f"{store}/version={number}")
        if history is not None:
            row = spark.range(1).select(F.lit(catalogue_id).cast("long").alias("catalogue_id"), F.current_timestamp().alias("created"), *[F.lit(seen.get[name]).alias(name) for name in HISTORY])
            row.write.mode("overwrite").parquet(f"{history}/catalogue={catalogue_id}/batch={number}")

    return merge


def read_history(spark: SparkSession, history: str) -> DataFrame:
    """The rows of imports that merge_batch has left, for `latest_imports`."""
    return spark.read.parquet(history).drop("catalogue")


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def compacted(spark: SparkSession, store: str) -> int | None:
    """The version up to which a store is compacted, which its manifest says; None if it never was."""
    if not _there(spark, f"{store}/_manifest"):
        return None
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/_manifest")
    said = spark._jvm.java.util.Scanner(manifest.getFileSystem(spark._jsc.hadoopConfiguration()).open(manifest))
    try:
        return said.nextInt()
    finally:
        said.close()


def read_store(spark: SparkSession, store: str, like: DataFrame, before: int | None = None, catalogue_id: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The last version of each event of a store that merge_batch writes; empty if there is none yet. `like` has its columns; catalogue_id: of one catalogue, whose folders alone are read; ids: of these ids only, whose buckets alone are read.

    What has been compacted is read from its own folder, and only the versions since then beside it.
    """
    if not _there(spark, store):
        return spark.createDataFrame([], like.schema)
    schema = like.drop("version", "bucket").schema
    since = compacted(spark, store)
    rows = spark.read.schema(StructType([*schema.fields]).add("bucket", "integer").add("version", "integer")).parquet(store)
    if since is not None:
        whole = spark.read.schema(StructType([*schema.fields]).add("bucket", "integer")).parquet(f"{store}/_compacted/{since}").withColumn("version", F.lit(since))
        rows = rows.where(F.col("version") > since).unionByName(whole)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    if catalogue_id is not None:
        rows = rows.where(F.col("catalogue_id") == catalogue_id)
    if ids is not None:
        touched = [r.bucket for r in ids.select(bucket(F.col("id")).alias("bucket")).distinct().collect()]  # at most BUCKETS numbers
        rows = rows.where(F.col("bucket").isin(touched)).join(ids, "id", "left_semi").select(*rows.columns)
    fields = [c for c in rows.columns if c not in ("version", "bucket")]
    last = rows.groupBy("catalogue_id", "id").agg(F.max_by(F.struct(*fields), "version").alias("row"))
    return last.select("row.*")


def _number(spark: SparkSession, store: str) -> int | None:
    """The last version in a store's folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store)
    names = [x.getPath().getName() for x in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=None)


def compact(spark: SparkSession, store: str, like: DataFrame) -> int | None:
    """Brings all versions of a store together in its own folder, so that reading costs no more with the batches that there have been; gives the version up to which it did.

    The manifest is changed last and at once: until then readers see the versions, after it what was made of them. Batches that are written meanwhile are later versions and
    stay. The folders that are no longer read can be removed by `drop_compacted`, once no reader that began before is left.
    """
    last = _number(spark, store)
    if last is None or last == compacted(spark, store):
        return None
    rows = read_store(spark, store, like, before=last + 1).withColumn("bucket", bucket(F.col("id")))
    rows.repartition("catalogue_id", "bucket").write.mode("overwrite").partitionBy("catalogue_id", "bucket").parquet(f"{store}/_compacted/{last}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    new = path(f"{store}/_manifest.{last}")
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(str(last).encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(store).toUri(), conf).rename(new, path(f"{store}/_manifest"), over)
    return last


def drop_compacted(spark: SparkSession, store: str) -> None:
    """Removes the versions, and earlier compactions, that a store's manifest has done away with."""
    since = compacted(spark, store)
    if since is None:
        return
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = path(store).getFileSystem(conf)
    for x in [*files.listStatus(path(store)), *files.listStatus(path(f"{store}/_compacted"))]:
        number = x.getPath().getName().removeprefix("version=")
        if number.isdigit() and (int(number) < since or int(number) == since and x.getPath().getName() != number):
            files.delete(x.getPath(), True)


def start_import(events: DataFrame, store: str, checkpoint: str, catalogue_id: int, update: bool = True, history: str | None = None) -> StreamingQuery:
    """Merges all that has arrived into the store, then stops; the next start goes on from there."""
    return events.writeStream.foreachBatch(merge_batch(store, catalogue_id, update, history)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bounds(spark: SparkSession, store: str, like: DataFrame) -> DataFrame:
    """The box of each catalogue of a store, counted anew from its events: exact also after events have moved or gone."""
    from seismolake.operators.statistics import bounds as of

    return of(read_store(spark, store, like))


#: Columns of kept bounds.
BOUNDS = "catalogue_id bigint, south double, north double, west double, east double, first timestamp, last timestamp, n bigint"


def start_bounds(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keeps the box, the span of time and the number of arrivals of each catalogue of a stream of events (catalogue_id, latitude, longitude, time), until all that has arrived is taken in.

    They are the state of the stream: one row a catalogue, so a batch costs what it holds, whatever has been imported before. The catalogues that a batch changes
    become a version of the table, written again if the batch is. Boxes only grow; `bounds` counts anew.
    """
    time = F.col("time").cast("timestamp")
    grown = events.groupBy(F.col("catalogue_id").cast("long").alias("catalogue_id")).agg(
        F.min("latitude").alias("south"), F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"),
    )
    write = lambda batch, number: batch.coalesce(1).write.mode("overwrite").parquet(f"{table}/version={number}")
    return grown.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_bounds(spark: SparkSession, table: str) -> DataFrame:
    """The last bounds of each catalogue that start_bounds has written; empty if there are none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], BOUNDS)
    rows = spark.read.schema(f"{BOUNDS}, version int").parquet(table)
    fields = [c for c in rows.columns if c != "version"]
    return rows.groupBy("catalogue_id").agg(F.max_by(F.struct(*fields), "version").alias("row")).select("row.*")
