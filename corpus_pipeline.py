"""The corpus pipeline: language, quality, near duplicates, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefold.llm.bbit_minhash import near_duplicates
from cuefold.llm.best_fit import packed_documents
from cuefold.llm.common import ROW, by_row, numbered, table, tokenizer_path, without
from cuefold.llm.host_rules import host_quality
from cuefold.llm.language_fusion import evidence, identify
from cuefold.llm.positional_index import decontaminate
from cuefold.session import durable

#: Documents that go to a Python worker at once. A batch of whole texts is held by the JVM and by the worker, of every task.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """The session's batches for Python workers are of `BATCH` rows at most from now on; smaller ones stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages told apart, with the columns they came with.

    Null and empty texts have no evidence of a language in them and go unless what is declared decides. Every row is judged on
    its own, also where ids are null or repeat. An empty table stays empty.
    """
    small_batches(spark)
    rows = numbered(docs)
    return without(rows, identify(evidence(by_row(rows))).where("NOT kept"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and their host's verdict.

    Null and empty texts have no words and go. A null source is a host of its own. Every row is judged on its
    own, also where ids are null or repeat.
    """
    small_batches(spark)
    rows = numbered(docs)
    return without(rows, host_quality(by_row(rows)).where("NOT kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id, a null id last, of equal ids any one.

    Null texts and texts without words are like no other and stay. Rows that repeat an id are documents of their own.
    """
    small_batches(spark)
    rows = numbered(docs)
    found = durable(near_duplicates(by_row(rows)).select("doc_id", "component_id"))
    ids = rows.select(F.col(ROW).alias("doc_id"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row")).alias("own"))
    # Only groups of more than one are compared.
    groups = found.where("doc_id <> component_id").select("component_id").distinct()
    grouped = durable(found.join(groups, "component_id", "left_semi").join(ids, "doc_id"))
    first = grouped.groupBy("component_id").agg(F.min("own").alias("first"))
    return without(rows, grouped.join(first, "component_id").where("own.row <> first.row"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of any benchmark item.

    Null and empty texts have none and stay. Every row is judged on its own, also where ids are null or repeat.
    """
    small_batches(spark)
    rows = numbered(docs)
    return without(rows, decontaminate(by_row(rows), table(spark, sf_dir, "benchmark")).where("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences; rows that repeat an id are packed one by one."""
    small_batches(spark)
    return packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages on tokens and likelihoods can't be stated in SQL; tests hold each stage to a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
