"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Stages: quality rules, language ID, one document of each group of near copies, benchmark
decontamination, packing. All but the last return the columns of documents; the last returns pieces
with their places in sequences. Part of subpackage llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paceline.llm import decontaminate, jaccard_join, language_id, packing, quality
from paceline.llm.shared import documents, materialize
from paceline.llm.tokens import default_path


#: Most documents of an Arrow batch: of Spark's 10,000, each task would hold some 34 MB several times over.
BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, from here on as plans read it when they run; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(name, "10000"))
    if not 0 < given <= BATCH:
        spark.conf.set(name, str(BATCH))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counting rules and look like their language."""
    small_batches(spark)
    return quality.filter_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    small_batches(spark)
    return language_id.filter_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: that with the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule doesn't call contaminated."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 4096 ids."""
    return packing.pack(docs, default_path())


STAGES = [("quality rules", quality_rules), ("language ID", language), ("near copies", near_copies), ("decontamination", benchmark_free), ("packing", packed)]

#: Language ID and packing are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
