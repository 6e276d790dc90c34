"""Provider calls: one per question, kept in a ledger, in slots that all lanes share."""

import os
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paceline.sources import requests
from paceline.sources.ledger import Ledger


def noted(folder, status=200, wait=0.0, dies=None):
    """A transport that leaves a file per call; dies: the attempt number below which a task with that url fails after the call."""

    def send(url, body):
        time.sleep(wait)
        with open(f"{folder}/{time.time_ns()}-{os.getpid()}", "w") as f:
            f.write(f"{url} {body}")
        from pyspark import TaskContext

        if dies and url.endswith(dies) and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("the executor is lost")
        return status, f"answer to {url} {body}", None

    return send


def calls_of(spark, n):
    return spark.range(n).select(F.format_string("a%03d", "id").alias("activity_id"), F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"), F.lit(None).cast("string").alias("body"))


def made(folder):
    return len(list(Path(folder).iterdir()))


@pytest.fixture
def folders(tmp_path):
    out = tmp_path / "calls", tmp_path / "ledger"
    out[0].mkdir()
    return str(out[0]), str(out[1])


def test_second_run_asks_for_what_failed_only(spark, folders):
    told, path = folders
    first = Ledger(spark, path)
    assert requests.fetch(calls_of(spark, 6), noted(told), 3, ledger=first).where("status_code = 200").count() == 6 and made(told) == 6
    refused = requests.fetch(calls_of(spark, 9).where("activity_id >= 'a006'"), noted(told, 429), 3, ledger=first)
    assert {(r["activity_id"], r["status_code"]) for r in refused.collect()} == {("a006", 429), ("a007", 429), ("a008", 429)} and made(told) == 9
    assert requests.fetch(calls_of(spark, 9), noted(told), 3, ledger=first).where("status_code = 429").count() == 3 and made(told) == 9  # the same run doesn't ask again
    second = Ledger(spark, path)
    again = requests.fetch(calls_of(spark, 9), noted(told), 3, ledger=second)
    assert made(told) == 12 and {r["payload"] for r in again.collect()} == {f"answer to http://h/{k} None" for k in range(9)}
    stats = {r["run"]: (r["host"], r["calls"], r["good"], r["refused"], r["without_answer"]) for r in second.statistics().collect()}
    assert stats == {first.run: ("h", 9, 6, 3, 0), second.run: ("h", 3, 3, 0, 0)}
    third = Ledger(spark, path)
    third.compact()
    assert not list(Path(path, "calls").iterdir())
    assert requests.fetch(calls_of(spark, 9), noted(told), 3, ledger=third).where("status_code = 200").count() == 9 and made(told) == 12


def test_many_activities_share_a_call(spark, folders):
    told, path = folders
    at = spark.range(1000).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("activity_id"), F.lit("2020-01-01 10:00:00").cast("timestamp").alias("start_time"), F.timestamp_seconds(F.lit(1577880000) + F.col("id")).alias("end_time"), (F.lit(46.123456) + F.col("id") * 1e-9).alias("latitude_deg"), F.lit(8.5).alias("longitude_deg"))
    found = requests.fetch(requests.weather_requests(at), noted(told), 4, ledger=Ledger(spark, path))
    assert found.where("payload like '%latitude=46.12345%'").select("activity_id").distinct().count() == 1000 and made(told) in (1, 2)
    near = at.withColumn("latitude_deg", F.lit(46.0) + F.rand(1) * 0.004)
    assert requests.weather_requests(near).select("url").distinct().count() > 500 and requests.weather_requests(near, decimals=1).select("url").distinct().count() == 1


def test_lanes_keep_the_hosts_interval_together(spark, folders):
    told, path = folders
    requests.fetch(calls_of(spark, 8), noted(told), 3, 0.25, Ledger(spark, path))
    at = sorted(int(p.name.split("-")[0]) / 1e9 for p in Path(told).iterdir())
    assert len(at) == 8 and min(b - a for a, b in zip(at, at[1:], strict=False)) > 0.2
    assert requests.slot(10.0, 10.0, 0, 3, 1.0) == 10.0 and requests.slot(10.1, 10.0, 0, 3, 1.0) == 13.0 and requests.slot(10.1, 10.0, 2, 3, 1.0) == 12.0 and requests.slot(16.0, 10.0, 0, 3, 1.0) == 16.0


def test_a_lost_task_goes_on_where_it_was(spark, folders):
    """A task that ends after some calls, and its next attempt: what the ledger has isn't asked again."""
    told, path = folders
    ledger = Ledger(spark, path)
    with pytest.raises(Exception, match="the executor is lost"):  # a local master has one attempt
        requests.fetch(calls_of(spark, 12), noted(told, dies="/11"), 1, ledger=ledger)
    before = made(told)
    assert ledger.here.count() == before - 1
    requests.fetch(calls_of(spark, 12), noted(told), 1, ledger=Ledger(spark, path, ledger.run))
    assert made(told) == 13 and ledger.here.count() == 12


def test_progress_lines(spark, folders, capsys):
    told, path = folders
    requests.fetch(calls_of(spark, 5), noted(told, wait=0.5), 1, ledger=Ledger(spark, path), what="elevation", every_s=0.2)
    lines = [re.fullmatch(r"elevation: (\d) of 5 requests", x) for x in capsys.readouterr().err.splitlines() if x.startswith("elevation")]
    assert len(lines) >= 3 and [int(m[1]) for m in lines] == sorted({int(m[1]) for m in lines}) and lines[-1][1] == "5"


def test_quota_counts_what_the_run_has_asked(spark, folders, monkeypatch):
    told, path = folders
    monkeypatch.setattr(requests, "MOST_CALLS", 6)
    samples = spark.createDataFrame([(a, k) for a, n in (("a", 300), ("b", 200), ("c", 200)) for k in range(0, n, 100)], "activity_id string, idx long").selectExpr("*", "cast(idx + ascii(activity_id) as double) AS latitude_deg", "2.0D AS longitude_deg")
    first = Ledger(spark, path)
    calls, without = requests.elevation_requests(samples, ledger=first)
    assert {r[0] for r in calls.select("activity_id").distinct().collect()} == {"a", "b"} and [r[0] for r in without.collect()] == ["c"]
    requests.fetch(calls, noted(told), 2, ledger=first)
    assert made(told) == 5 and requests.elevation_requests(samples, ledger=first)[1].count() == 1  # one call is left, c needs two
    second = Ledger(spark, path)
    calls, without = requests.elevation_requests(samples, ledger=second)
    assert calls.select("activity_id").distinct().count() == 3 and without.count() == 0
    requests.fetch(calls, noted(told), 2, ledger=second)
    assert made(told) == 7
