"""Tables that driver and executors share, and checks of what callers give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from paceline.scratch import discard, materialize, new_path, shared_dir, unused

__all__ = ["discard", "documents", "integer_ids", "materialize", "new_path", "shared_dir", "unused"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def integer_ids(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs, if its ids are whole numbers; a clear error at once otherwise."""
    kind = docs.schema[column].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{column} must be a whole number, not {kind.simpleString()}")
    return docs
