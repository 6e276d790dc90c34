"""Batches: which sources are written where, what is skipped, and the named files themselves."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def output_collisions(plans: DataFrame, existing: DataFrame) -> DataFrame:
    """plans (source, output_path) of one new output: output_path, sources, for those with several."""
    new = plans.join(existing.select("output_path").distinct(), "output_path", "left_anti")
    return new.groupBy("output_path").agg(F.array_sort(F.collect_list("source")).alias("sources"), F.count("*").alias("n")).where("n > 1")


def plan_statuses(plans: DataFrame, existing: DataFrame) -> DataFrame:
    """plans (source, output_path, legacy_path, decode_error) with status: failed, skipped, collision or pending.

    An output that is there already, by its present or its older name, is skipped and collides with nothing.
    """
    had = existing.select("output_path").distinct()
    known = plans.join(had.withColumn("has", F.lit(True)), "output_path", "left").join(had.select(F.col("output_path").alias("legacy_path"), F.lit(True).alias("has_legacy")), "legacy_path", "left")
    skipped = F.coalesce(F.col("has") | F.col("has_legacy"), F.col("has"), F.col("has_legacy"), F.lit(False))
    known = known.withColumn("skipped", skipped)
    clash = output_collisions(known.where("decode_error is null and not skipped").select("source", "output_path"), existing).select("output_path", F.lit(True).alias("clash"))
    status = F.when(F.col("decode_error").isNotNull(), "failed").when(F.col("skipped"), "skipped").when(F.col("clash"), "collision").otherwise("pending")
    return known.join(clash, "output_path", "left").select("source", "output_path", "decode_error", status.alias("status"))


def by_source(sources: DataFrame, folder: str) -> DataFrame:
    """Plans of sources (source, decode_error): the source's name with .md in folder."""
    name = F.concat(F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", ""), F.lit(".md"))
    return sources.select("source", F.concat(F.lit(f"{folder}/"), name).alias("output_path"), F.lit(None).cast("string").alias("legacy_path"), "decode_error")


def by_activity_time(sources: DataFrame, folder: str) -> DataFrame:
    """Plans of sources (source, start_time, decode_error): the start to the minute; a source without a start fails."""
    named = lambda pattern: F.concat(F.lit(f"{folder}/"), F.date_format("start_time", pattern), F.lit(".md"))
    error = F.coalesce("decode_error", F.when(F.col("start_time").isNull(), "no start time to name the report by"))
    return sources.select("source", named("yyyy-MM-dd HH-mm").alias("output_path"), named("yyyy-MM-dd HH:mm").alias("legacy_path"), error.alias("decode_error"))


def outputs_in(spark: SparkSession, folder: str) -> DataFrame:
    """output_path of the .md files in folder, none if it isn't there; only the listing is read."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).select("path")
    except AnalysisException:
        return spark.createDataFrame([], "output_path string")
    return found.select(F.concat(F.lit(f"{folder}/"), F.element_at(F.split("path", "/"), -1)).alias("output_path"))


def write_files(rows: DataFrame) -> DataFrame:
    """rows (output_path, content: string or binary) as one file each, written by the tasks; output_path and error.

    A file appears under its name only when it is whole (written beside it, then moved), so that a task
    that runs again does no harm. Any file system that pyarrow knows by its URI will do.
    """

    def write(batches):
        for batch in batches:
            errors = []
            for path, content in zip(batch.column("output_path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
                    parent, _, name = inside.rpartition("/")
                    system.create_dir(parent, recursive=True)
                    part = f"{parent}/.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(part) as out:
                        out.write(content.encode() if isinstance(content, str) else content)
                    system.move(part, f"{parent}/{name}")
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pa.record_batch({"output_path": batch.column("output_path"), "error": pa.array(errors, pa.string())})

    return rows.select("output_path", "content").mapInArrow(write, "output_path string, error string")
