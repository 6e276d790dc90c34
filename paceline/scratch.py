"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on a local master that has none, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, rows_per_file: int = 0, small: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors. rows_per_file: at most, if not 0; a file's rows are read together. small: on less disk, for more time."""
    spark = df.sparkSession
    path = new_path(spark, label)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")  # what the write has shuffled isn't needed after it
    try:
        writer = df.write.option("maxRecordsPerFile", rows_per_file)
        (writer.option("compression", "zstd") if small else writer).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def bucketed(df: DataFrame, label: str, by: str, order: str | None = None, buckets: int | None = None) -> DataFrame:
    """Like ``materialize``, but rows lie in buckets by a column: joins, groups and windows on it need no exchange any more."""
    spark = df.sparkSession
    path, buckets = new_path(spark, label), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).option("path", path)
    (writer.sortBy(order) if order else writer).saveAsTable(name)
    out = spark.table(name)
    out._scratch_path, out._scratch_name = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        path, name = table.__dict__.pop("_scratch_path", None), table.__dict__.pop("_scratch_name", None)
        if path:
            spark = table.sparkSession
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(name: str, *tables: DataFrame) -> str:
    """name, or with underscores before it until no table has such a column, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
