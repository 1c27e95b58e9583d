"""A corpus from documents: cleaned, without near-duplicates, without personal data, mixed, packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet and reads
again as the next one's docs. All but the last give the columns of documents, extra ones too, whatever their names. Rows with a null
id, source or language go through like others, and an empty table gives an empty one; what becomes of null
and empty texts, ties and repeated rows is said by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seismolake.llm import line_rules, mixing, packing, pseudonyms, simhash
from seismolake.llm.common import cleared, scratch_path, table
from seismolake.llm.queries import KEY, tokenizer_file

# The rows hold line verdicts, fingerprints' components, pseudonyms, a schedule and token ids, which SQL can't express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines. Null, empty and blank texts go; rows that repeat stay repeated."""
    return line_rules.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; rows equal in id and text are one document, rows without an id stay."""
    return simhash.keep_first(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal data, row by row; null and empty texts stay as they are."""
    return pseudonyms.replace_private(docs, KEY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for each time round in which the mix takes half of it or more, in the schedule's order; documents without words go."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, in the order of docs but for the filling of gaps; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer_file())


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("private data", private), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with cleared(spark, path):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
