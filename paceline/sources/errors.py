"""Read errors of FIT files as rows: what kind, at which byte, and the detail.

The decoder and the sanitizer raise ``ReadError`` for one file; their tasks turn it into a struct column,
so that a damaged file is a row like any other and errors can be counted per kind by Spark.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of errors, by whether the file is no sound FIT file or a sound one of a shape that isn't supported.
INVALID = ("no_header", "empty_body", "truncated", "wrong_checksum", "malformed", "no_messages", "no_time", "time_out_of_range")
UNSUPPORTED = ("several_sessions",)
PROBLEM = "struct<kind: string, offset: bigint, detail: string>"
ARROW = pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("detail", pa.string())])


class ReadError(ValueError):
    def __init__(self, kind: str, offset: int | None, detail: str):
        super().__init__(detail)
        if kind not in INVALID + UNSUPPORTED:
            raise AssertionError(kind)
        self.kind, self.offset, self.detail = kind, offset, detail

    def row(self) -> dict:
        return {"kind": self.kind, "offset": self.offset, "detail": self.detail}


def group(kind: Column) -> Column:
    """invalid or unsupported."""
    return F.when(kind.isin(*UNSUPPORTED), "unsupported").when(kind.isNotNull(), "invalid")


def text(problem: Column) -> Column:
    """A line of a problem: its group, detail and byte."""
    return F.when(problem.isNotNull(), F.concat(group(problem["kind"]), F.lit(": "), problem["detail"], F.coalesce(F.concat(F.lit(" at byte "), problem["offset"].cast("string")), F.lit(""))))


def counted(failed: DataFrame) -> DataFrame:
    """failed (a problem each) as kind, error_class, n: one row per kind."""
    return failed.where("problem is not null").groupBy(F.col("problem.kind").alias("kind")).agg(F.count("*").alias("n")).select("kind", group(F.col("kind")).alias("error_class"), "n")
