"""Incremental ingestion: FIT files are decoded as they arrive, late or again, into versioned activity tables.

New files come by a stream with a bound on the files of a trigger; its checkpoint knows them by their names.
A file that is replaced under its name is no news to the stream: ``refresh`` compares the folder's listing with
the ledger of files and decodes what is newer, in rounds of the same bound. Either way a batch writes
its tables first and its part of the ledger last, each to a folder named by the batch. A batch that is run again
overwrites its own folders, one that ended halfway isn't in the ledger, and ``current`` reads of each activity
only the version that the ledger says is the latest. Nothing but counts goes to the driver.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from paceline.schema import Activities
from paceline.scratch import discard, materialize
from paceline.session import ship
from paceline.sources import errors
from paceline.sources.fit import decoded, tables

#: Files of one batch, which bounds what is decoded at once.
FILES = 1000
LISTING = "path string, modificationTime timestamp, length long, content binary"
LEDGER = f"activity_id string, modified_at timestamp, length long, problem {errors.PROBLEM}, batch string"


def append(files: DataFrame, target: str, batch: str) -> None:
    """Decode files (see LISTING) into the tables under target as one batch; the ledger's part is written when all else is there."""
    found = materialize(decoded(files), "decoded")
    activities, failed = tables(found)
    for f in fields(Activities):
        getattr(activities, f.name).write.mode("overwrite").parquet(f"{target}/{f.name}/batch={batch}")
    seen = files.select(F.col("path").alias("activity_id"), F.col("modificationTime").alias("modified_at"), "length")
    seen.join(failed.select("activity_id", "problem"), "activity_id", "left").write.mode("overwrite").parquet(f"{target}/files/batch={batch}")
    discard(found)


def ledger(spark: SparkSession, target: str) -> DataFrame:
    """All versions of all files: activity_id, modified_at, length, problem, batch."""
    empty = spark.createDataFrame([], LEDGER)
    try:
        return empty.unionByName(spark.read.schema(LEDGER).parquet(f"{target}/files"))
    except AnalysisException:
        return empty


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The ledger's latest version of each activity; of equal times the later batch."""
    newest = Window.partitionBy("activity_id").orderBy(F.desc("modified_at"), F.desc("batch"))
    return ledger(spark, target).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def current(spark: SparkSession, target: str) -> tuple[Activities, DataFrame]:
    """The tables of the latest versions, and the files that can't be read (activity_id, problem)."""
    good = latest(spark, target).where("problem is null").select("activity_id", "batch")
    read = lambda name: spark.read.parquet(f"{target}/{name}").withColumn("batch", F.col("batch").cast("string")).join(good, ["activity_id", "batch"], "left_semi").drop("batch")
    return Activities(*(read(f.name) for f in fields(Activities))), latest(spark, target).where("problem is not null").select("activity_id", "problem")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True, files: int = FILES) -> StreamingQuery:
    """Start appending the .fit files of source to the tables under target; once: what is there now, then stop."""
    ship(spark)
    stream = spark.readStream.format("binaryFile").schema(LISTING).option("pathGlobFilter", "*.[fF][iI][tT]").option("maxFilesPerTrigger", files).load(source)

    def step(batch: DataFrame, number: int) -> None:
        append(batch, target, f"s{number:012d}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def refresh(spark: SparkSession, source: str, target: str, files: int = FILES) -> int:
    """Decode files of source that are newer than what the ledger has of them; how many there were. Files that the ledger hasn't are the stream's."""
    ship(spark)
    done = 0
    while True:
        here = spark.read.format("binaryFile").option("pathGlobFilter", "*.[fF][iI][tT]").load(source)
        known = latest(spark, target).select(F.col("activity_id").alias("path"), "modified_at", F.col("length").alias("had"))
        newer = here.select("path", "modificationTime", "length").join(known, "path").where("modificationTime > modified_at or modificationTime = modified_at and length != had")
        some = materialize(newer.select("path").orderBy("path").limit(files), "replaced")
        n = some.count()
        if not n:
            return done
        rounds = spark.createDataFrame([], LEDGER).unionByName(ledger(spark, target)).where("batch like 't%'").select("batch").distinct().count()
        append(here.join(some, "path", "left_semi"), target, f"t{rounds:012d}")
        discard(some)
        done += n
