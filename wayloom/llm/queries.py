"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayloom.llm import curriculum, quality_rules
from wayloom.llm.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("op3_quality_rules", quality_rules.ORACLE)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality_rules.verdict(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy")


@query("op8_mix_sources", curriculum.ORACLE)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(_table(spark, sf_dir, "documents"))
    place = lambda i: F.round(F.get("positions", F.lit(i)), 6)
    return curriculum.training_order(mixed).select(
        "doc_id", "size", "source", "source_size", "target", "taken", place(0).alias("position"), place(1).alias("position_2"), place(2).alias("position_3"))


@query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumns({"lcs_share": F.round("lcs_share", 6), "answer_share": F.round("answer_share", 6)})


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm import secrets

    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def _remainder(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm import language_id

    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = language_id.train(docs.where(~held))
    return language_id.identify(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")


@query("op4_pitman_yor")
def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm import pitman_yor

    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(_remainder(5) == 1, F.lit(False))
    scored = pitman_yor.score(docs, trained=~held)
    return scored.withColumn("held_out", held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op1_warc_roundtrip", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, true AS intact FROM f""")
def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm import warc

    _, whole = warc.archive_pages(_table(spark, sf_dir, "pages"))
    found = warc.verified(Scratch(spark, "records").save(whole.drop("payload"), "records"))
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), warc.page_of(F.col("refers_to")).alias("refers_to"), "intact")


@query("op6_html_consensus")
def op6_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm import html_consensus

    return html_consensus.main_text(_table(spark, sf_dir, "pages"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayloom.llm import token_counts

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))
