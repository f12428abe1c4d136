"""Five corpus stages over ``documents``: rules, near duplicates, benchmark leaks, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; an empty table stays empty, columns beside those of documents are not read.  ``run`` writes each stage as Parquet in the shared folder and rereads it.
The stages use MinHash and a latent space, which SQL cannot express, so
ORACLE_SQL is None and the tests hold the stages against brute force.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from wayloom.llm import curriculum, decontaminate, near_dedup, quality_rules, secrets
from wayloom.llm.scratch import Scratch, recorded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "_row"


_tables: list[Scratch] = []  # of the stage that ran last


def stage(f: Stage) -> Stage:
    """A stage whose inner tables go when the next stage begins, since its result has been written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release()
        with recorded() as own:
            out = f(spark, docs, sf_dir)
        _tables.extend(own)
        return out

    return run_stage


def _release() -> None:
    while _tables:
        _tables.pop().clean()


def _keyed(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """The documents with a written row key, which tells rows apart that have no id or share one."""
    return Scratch(spark, name).save(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)), "rows")


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger keeps.

    Null and empty texts fail for having too few words; every row is judged
    alone, whatever its id; columns beside those of documents go.
    """
    return quality_rules.accepted(docs.select(*COLUMNS))


@stage
def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id.

    Rows without an id, and rows that share one, are documents of their own:
    repeated rows leave one, and a row with an id stays before one without.
    Texts without a word are in no group and stay.
    """
    keyed = _keyed(spark, docs, "dedup")
    group = near_dedup.near_duplicates(keyed, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW).alias("row")))
    stays = keyed.select(ROW, "doc_id").join(group.hint("merge"), ROW).groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias(ROW))
    return keyed.join(stays.hint("merge"), ROW, "left_semi").select(*COLUMNS)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, rows without an id included; null texts hold none."""
    keyed = _keyed(spark, docs, "decontaminated")
    found = decontaminate.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW).select(F.col("doc_id").alias(ROW)).distinct()
    return keyed.join(found.hint("merge"), ROW, "left_anti").select(*COLUMNS)


@stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by the name of their kind; n_chars follows the new text (null for a null text)."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, one row for each time the mix takes them; those it leaves out are last and have no position.

    A null source is a source of its own; texts without a word are taken never.
    """
    return curriculum.training_order(curriculum.training_rows(docs, extra=("lang", "text", "n_chars")))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", dedup),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("mix_sources", mixed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        before, docs = docs, scratch.save(step(spark, docs, sf_dir), name)
        scratch.drop(before)
    _release()
    return docs
