"""What the training-data operators share: tables, scratch tables in the shared folder, word rules."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, and what it separates, as classes for Java.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one on a single machine, as in tests; an error on a cluster, whose executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Scratch tables of this process that are still there, in the order in which they were made.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Whether Spark removes a query's shuffle files once it is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """The frame as a table written once in the shared folder: it cuts lineage and outlives executors. The shuffle files of its making go as soon as it is written. options: of the Parquet writer."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(frame.schema).parquet(path)
    out._scratch = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes scratch tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if path in _made:
            _made.remove(path)


@contextlib.contextmanager
def cleared(spark: SparkSession, *kept: str) -> Iterator[None]:
    """Removes the scratch tables that are made within, but for those kept, once what reads them is written."""
    before = set(_made)
    yield
    discard(spark, *[path for path in _made if path not in before and path not in kept])


#: Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 250, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches, by rows and by bytes, so that long texts don't fill a Python worker. Never raises them, so that frames which are made earlier or later keep within them too."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"\s*(-?\d+)\s*[bB]?\s*$", spark.conf.get(key) or "")
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def held(frame: DataFrame, **columns: Column) -> DataFrame:
    """frame with columns that are evaluated once a row. A generator holds them: unlike a projection's, its columns are never written anew into the filters and lambdas that use them."""
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def numbered(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs with its columns renamed to _0, _1 and so on, so that no name can clash, and a struct `row` of them by their names, for the end."""
    names = docs.columns
    return docs.toDF(*[f"_{k}" for k in range(len(names))]), F.struct(*[F.col(f"_{k}").alias(name) for k, name in enumerate(names)]).alias("row")


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Deals out by the keys over as many partitions as the session shuffles to."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def running_sums(frame: DataFrame, name: str, values: str, chunk: int = 256, plus: Callable[[Column, Column], Column] = lambda a, b: a + b) -> DataFrame:
    """frame with the array `name`: for each element of the array `values` (long) the sum of those before it, 0 at first. Sums of chunks come first, so that the work is not the square of the array's length. plus: another operation for which 0 is neutral."""
    n = F.size(values)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), plus)
    part = lambda c, k: F.slice(F.col(values), c * chunk + 1, k)
    chunks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).otherwise(F.array().cast("array<int>"))
    frame = held(frame, **{f"{name}_chunks": F.transform(chunks, lambda c: total(part(c, F.lit(chunk))))})
    frame = held(frame, **{f"{name}_starts": F.transform(f"{name}_chunks", lambda x, c: total(F.slice(F.col(f"{name}_chunks"), F.lit(1), c)))})

    def scan(start: Column, c: Column) -> Column:
        own = F.sequence(F.lit(0), F.least(F.lit(chunk), n - c * chunk) - 1)
        return F.transform(own, lambda k: plus(start, total(part(c, k))))

    return held(frame, **{name: F.flatten(F.transform(f"{name}_starts", scan))}).drop(f"{name}_chunks", f"{name}_starts")
