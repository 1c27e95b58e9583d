"""Token ids as Parquet list columns, written in document order and read back by need.

One row a document: the file's number, the ids before it in the file, its own count and its ids.
Ids are dictionary-encoded (49 thousand values fit a dictionary page) and so bit-packed; doc_id,
row_start and n_tokens are delta-encoded by version 2 of the format, without dictionaries. Row
groups and pages are small enough for the page index to skip most of a file when a reader asks for
a few documents; the token column is not touched by readers of the other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
PAGE_ROWS = 1000


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, metadata: tuple[str, ...] = ()) -> None:
    """Writes the ids of all documents (doc_id, text), files and rows in ascending doc_id, nulls first.

    Rows with equal ids are ordered by their text. A null or empty text has the end id alone. metadata: other columns that
    are kept beside the ids as meta_<name>, for readers that pick documents by them; columns that are not named are not read. An empty
    table gives files without rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", *[F.col(f"`{name}`").alias(f"meta_{name}") for name in metadata])
    kind = docs.schema["doc_id"].dataType.simpleString()
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    end = int(end_id).to_bytes(4, "little")

    def encoded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .token_words import encoder

        encode = encoder(tokenizer).encode
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [encode(text.as_py()) + end for text in batch.column(1)]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            starts = before + np.r_[0, counts.cumsum()]
            tokens = pa.ListArray.from_arrays(pa.array((starts - before).astype(np.int32)), pa.Array.from_buffers(pa.int32(), int(counts.sum()), [None, pa.py_buffer(b"".join(ids))]))
            before = int(starts[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), batch.column(0), pa.array(starts[:-1]), pa.array(counts), tokens, *batch.columns[2:]], ["part", "doc_id", "row_start", "n_tokens", "tokens", *batch.schema.names[2:]])

    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    writer = ordered.mapInArrow(encoded, f"part int, doc_id {kind}, row_start long, n_tokens long, tokens array<int>{kept}").write
    settings = {"parquet.writer.version": "v2", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "true"}
    settings |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "row_start", "n_tokens")}
    for key, value in settings.items():
        writer = writer.option(key, str(value))
    writer.option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, part and the metadata columns: reads no ids."""
    rows = spark.read.parquet(path).drop("tokens")
    return rows.join(_file_starts(rows), "part").select("doc_id", (F.col("file_start") + F.col("row_start")).alias("start"), "n_tokens", "part", *[c for c in rows.columns if c.startswith("meta_")])


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """doc_id and tokens of the documents that a condition on doc_id, part, n_tokens or metadata picks; Parquet's statistics and page index skip the rest."""
    rows = spark.read.parquet(path)
    return (rows if where is None else rows.where(where)).select("doc_id", "tokens")


def _file_starts(rows: DataFrame) -> DataFrame:
    """Ids before each file. One row a file comes together here, whatever the number of documents."""
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("file_start"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids of each document, from the files."""
    rows = spark.read.parquet(path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def crcs(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            tokens = batch.column(3)
            offsets = tokens.offsets.to_numpy().tolist()
            raw = memoryview(np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([b - a for a, b in zip(offsets, offsets[1:], strict=False)], pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "row_start", "n_tokens", "ids_crc32"])

    read = rows.select("part", "doc_id", "row_start", "tokens").mapInArrow(crcs, f"part int, doc_id {kind}, row_start long, n_tokens long, ids_crc32 long")
    return read.join(_file_starts(rows), "part").select("doc_id", (F.col("file_start") + F.col("row_start")).alias("start"), "n_tokens", "ids_crc32")
