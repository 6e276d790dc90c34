"""A ledger of provider calls on shared storage: what was asked, when, and what came back.

The task that makes a call writes its answer at once, as one small file under the run's folder, moved into
place when it is whole. So a run that loses an executor goes on where it was, a repeated run asks only for
what has no good answer yet, and the driver can count a run's calls while they are made. ``compact`` turns
the files of ended runs into Parquet.
"""

from __future__ import annotations

import json
import sys
import threading
import time
import uuid
from contextlib import contextmanager
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.scratch import new_path

CALL = "call_key string, run string, host string, called_at double, url string, status_code int, payload string, transport_error string"
GOOD = 200


def call_key(url: Column, body: Column) -> Column:
    """Names a call; equal calls have equal keys."""
    return F.sha2(F.concat_ws("\n", url, F.coalesce(body, F.lit(""))), 256)


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


class RunFolder:
    """A run's calls as tasks see them: one file per call. A plain value, so that it can be sent to tasks."""

    def __init__(self, folder: str, run: str):
        self.folder, self.run = folder, run

    def told(self, key: str) -> dict | None:
        """The answer that this run already has, perhaps of a task that was lost."""
        store, root = store_of(self.folder)
        if store.get_file_info(f"{root}/{key}.json").type == fs.FileType.NotFound:
            return None
        with store.open_input_file(f"{root}/{key}.json") as f:
            return json.loads(f.read())

    def tell(self, key: str, url: str, answer: tuple[int | None, str | None, str | None]) -> dict:
        store, root = store_of(self.folder)
        store.create_dir(root, recursive=True)
        row = {"call_key": key, "run": self.run, "host": urlsplit(url).netloc, "called_at": time.time(), "url": url, "status_code": answer[0], "payload": answer[1], "transport_error": answer[2]}
        part = f"{root}/.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as f:
            f.write(json.dumps(row).encode())
        store.move(part, f"{root}/{key}.json")
        return row

    def count(self) -> int:
        """Calls answered so far."""
        store, root = store_of(self.folder)
        return sum(i.base_name.endswith(".json") for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)))


class Ledger:
    """All runs' calls under path (any file system that Spark and pyarrow both know)."""

    def __init__(self, spark: SparkSession, path: str | None = None, run: str | None = None):
        self.spark, self.path, self.run = spark, (path or new_path(spark, "provider-calls")).rstrip("/"), run or uuid.uuid4().hex
        self.here = RunFolder(f"{self.path}/calls/{self.run}", self.run)

    def _has(self, name: str) -> bool:
        store, root = store_of(f"{self.path}/{name}")
        return bool(store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)))

    def calls(self) -> DataFrame:
        """Every call of every run (see CALL)."""
        kept = self.spark.createDataFrame([], CALL)
        if self._has("answers"):
            kept = kept.unionByName(self.spark.read.schema(CALL).parquet(f"{self.path}/answers"))
        if self._has("calls"):
            kept = kept.unionByName(self.spark.read.schema(CALL).json(f"{self.path}/calls/*"))
        return kept

    def answers(self) -> DataFrame:
        """One row per call_key that needn't be asked: this run's own answer, else the latest good one."""
        mine = F.col("run") == self.run
        best = Window.partitionBy("call_key").orderBy(F.desc(mine), F.desc("called_at"))
        usable = self.calls().where(mine | (F.col("status_code") == GOOD))
        return usable.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best")

    def statistics(self) -> DataFrame:
        """Per run and host: calls, good, refused (quota), without_answer, first and last time."""
        bad = lambda c: F.count_if(c)
        return self.calls().groupBy("run", "host").agg(
            F.count("*").alias("calls"), bad(F.col("status_code") == GOOD).alias("good"), bad(F.col("status_code") == 429).alias("refused"), bad(F.col("status_code").isNull()).alias("without_answer"),
            F.min("called_at").alias("first_at"), F.max("called_at").alias("last_at"),
        )

    def compact(self) -> None:
        """Files of other runs become Parquet; only for runs that have ended. If it stops halfway, calls are there twice, which ``answers`` doesn't mind."""
        store, root = store_of(f"{self.path}/calls")
        ended = [i.base_name for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name != self.run]
        if ended:
            self.spark.read.schema(CALL).json([f"{self.path}/calls/{run}" for run in ended]).write.mode("append").parquet(f"{self.path}/answers")
            for run in ended:
                store.delete_dir(f"{root}/{run}")

    @contextmanager
    def progress(self, what: str, total: int, every_s: float = 1.0):
        """While the block runs, a line on stderr whenever the number of this run's calls has changed, looked at every every_s."""
        began, done = self.here.count(), threading.Event()

        def watch():
            last = 0
            while True:
                ended = done.wait(every_s)
                now = self.here.count() - began
                if now != last:
                    print(f"{what}: {now} of {total} requests", file=sys.stderr, flush=True)
                    last = now
                if ended:
                    return

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()
