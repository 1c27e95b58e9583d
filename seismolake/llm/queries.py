"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, kd_shards, line_rules, mixing, packing, prefix_forest, pseudonyms, secrets, simhash, spelling, substrings, token_files, url_rules
from .common import scratch_path, table

TOKENIZER = "word_bpe_49k.json"
#: The key of pseudonyms in queries; a deployment passes its own secret.
KEY = "query-key"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The rules of the query: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return token_files.digests(spark, path)


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines")
    return judged.select(F.col("row.doc_id").alias("doc_id"), *[F.col(f"quality.{name}").alias(name) for name in names])


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards.shard_by_bytes(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    return done.select(F.col("row.doc_id").alias("doc_id"), "private.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return found.select(F.col("row.doc_id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(spelling.damaged_runs(table(spark, sf_dir, "documents"))))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = alignment.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(BYTE_LEVEL), tokenizer_file(PIECES))
    return done.select(F.col("_0").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _url_sql() -> str:
    upper, lower = url_rules.UPPER, url_rules.LOWER
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"""
        WITH rests AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
        parts AS (SELECT page_id, translate(raw, '{upper}', '{lower}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
        rules(verdict, rule_host, rule_path) AS (VALUES {rules}),
        addresses AS (SELECT DISTINCT host, path FROM parts),
        best AS (
            SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
            FROM addresses JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)
    """


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_simhash, op3_token_files, op4_line_rules, op5_prefix_forest, op6_kd_shards, op7_pseudonyms, op8_mixing, op9_substrings, op10_secrets, op11_spelling, op12_url_rules, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    """The addresses' alone: the other results hold fingerprints, token ids, checksums, line verdicts or schedules that SQL can't express; tests/llm hold them against brute force."""
    return {"op12_url_rules": _url_sql()}
