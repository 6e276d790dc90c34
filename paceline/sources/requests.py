"""Requests to elevation and weather providers as rows, and a fetcher that answers them on the executors.

Requests are made in Spark, one row per activity and call; equal calls are made once and answer all rows that
ask for them. ``fetch`` deals calls to lanes (partitions). Time is cut into slots of the host's interval, dealt to the lanes in
turn, and a call starts at the beginning of one of its lane's slots: calls of all lanes together keep the interval, also
after a lane was lost and began again. Answers go into a ledger as they come (``ledger.py``). The transport
is a parameter, so that everything can be run without a network.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from contextlib import nullcontext
from http.client import HTTPException
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.scratch import materialize
from paceline.sources.ledger import Ledger, call_key
from paceline.sources.providers import HOURLY, MOST_CALLS, elevation_batches

#: The public hosts, and the interval that the elevation host asks for.
ELEVATION_HOST = "https://api.opentopodata.org"
WEATHER_URL = "https://archive-api.open-meteo.com/v1/archive"
INTERVAL_S = 1.0
TIMEOUT_S = 10
#: A call: url and body (null: GET) to status (null: no answer), payload and error.
Transport = Callable[[str, str | None], tuple[int | None, str | None, str | None]]


def http(url: str, body: str | None) -> tuple[int | None, str | None, str | None]:
    """One call over HTTP; failures of the network or the host are answers too, others are raised."""
    request = Request(url, data=body.encode() if body is not None else None, headers={"Content-Type": "application/json"} if body is not None else {}, method="GET" if body is None else "POST")
    try:
        with urlopen(request, timeout=TIMEOUT_S) as answer:
            return 200, answer.read().decode("utf-8", "replace"), None
    except HTTPError as e:
        return e.code, None, f"HTTP {e.code}: {e.reason}"
    except (HTTPException, OSError) as e:
        return None, None, str(e)


def is_public(base_url: str) -> bool:
    return base_url.rstrip("/") == ELEVATION_HOST


def elevation_requests(samples: DataFrame, base_url: str = ELEVATION_HOST, dataset: str = "eudem25m", interpolation: str = "bilinear", ledger: Ledger | None = None) -> tuple[DataFrame, DataFrame]:
    """Requests (activity_id, batch, expected, url, body) for route samples, and activities that go without any.

    The public host allows a number of calls in a run: activities are served in the order of their ids,
    one that would exceed the rest is left out whole and a later smaller one may still fit. Calls that the ledger
    answers cost nothing, calls that this run made before count. Only the call counts of activities are ordered in one
    place, and only as many as there are calls can be served.
    """
    batches = elevation_batches(samples)
    body = F.to_json(F.struct("locations", F.lit(interpolation).alias("interpolation"), F.lit("null").alias("nodata_value")))
    made = batches.select("activity_id", "batch", "expected", F.lit(f"{base_url.rstrip('/')}/v1/{dataset}").alias("url"), body.alias("body"))
    left_out = made.where("false").select("activity_id", F.lit("quota_exceeded").alias("kind"))
    if not is_public(base_url):
        return made, left_out
    costs, most = made.select("activity_id", call_key(F.col("url"), F.col("body")).alias("call_key")), MOST_CALLS
    if ledger is not None:
        costs = costs.join(ledger.answers().select("call_key"), "call_key", "left_anti")
        most -= ledger.here.count()
    free = made.select("activity_id").distinct().join(costs, "activity_id", "left_anti")
    calls = costs.groupBy("activity_id").count().where(F.col("count") <= most)
    # of those with n calls only the first most / n can be served; the constant limit cuts them down before the shuffle
    ranked = calls.withColumn("same", F.row_number().over(Window.partitionBy("count").orderBy("activity_id"))).where(F.col("same") <= MOST_CALLS)
    ranked = ranked.where(F.col("same") <= most / F.col("count"))
    served, used = [], 0
    for r in ranked.orderBy("activity_id").collect():  # at most the sum of MOST_CALLS / n, under 8,000 rows
        if used + r["count"] <= most:
            used += r["count"]
            served.append((r["activity_id"],))
    allowed = made.sparkSession.createDataFrame(served, "activity_id string").unionByName(free)
    without = made.select("activity_id").distinct().join(allowed, "activity_id", "left_anti").select("activity_id", F.lit("quota_exceeded").alias("kind"))
    return made.join(allowed, "activity_id", "left_semi"), without


def weather_requests(activities: DataFrame, base_url: str = WEATHER_URL, decimals: int = 6) -> DataFrame:
    """Requests (activity_id, url, body) for activities (activity_id, start_time, end_time, latitude_deg, longitude_deg): whole days in UTC; nothing without a start or a position.

    Places are told to six decimals; fewer decimals round them first, so that more activities share a call.
    """
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    end = F.greatest(F.coalesce("end_time", "start_time"), "start_time")
    known = activities.where("start_time is not null and latitude_deg is not null and longitude_deg is not null")
    query = F.format_string(
        f"{base_url}?latitude=%.6f&longitude=%.6f&start_date=%s&end_date=%s&hourly={'%%2C'.join(HOURLY)}&timezone=UTC&temperature_unit=celsius&wind_speed_unit=kmh",
        *(F.round(c, decimals) if decimals < 6 else F.col(c) for c in ("latitude_deg", "longitude_deg")), day("start_time"), day(end),
    )
    return known.select("activity_id", query.alias("url"), F.lit(None).cast("string").alias("body"))


def slot(now: float, began: float, lane: int, lanes: int, interval_s: float) -> float:
    """When the lane's next slot begins, at now or later; slots of interval_s go round the lanes from began on."""
    turn = lanes * interval_s
    first = began + lane * interval_s
    return first + max(0, math.ceil((now - first) / turn - 1e-9)) * turn


def fetch(requests: DataFrame, send: Transport = http, lanes: int = 1, interval_s: float = 0.0, ledger: Ledger | None = None, what: str | None = None, every_s: float = 1.0) -> DataFrame:
    """requests with status_code, payload and transport_error. Sends what the ledger (one for this call, if none is given) has no answer for; what: names progress lines on stderr."""
    ledger = ledger or Ledger(requests.sparkSession)
    here, began = ledger.here, time.time()

    def ask(batches):
        lane = TaskContext.get().partitionId()
        for batch in batches:
            n = 0
            for key, url, body in zip(*(batch.column(c).to_pylist() for c in ("call_key", "url", "body")), strict=True):
                if here.told(key) is None:
                    if interval_s:
                        time.sleep(max(0.0, slot(time.time(), began, lane, lanes, interval_s) - time.time()))
                    here.tell(key, url, send(url, body))
                    n += 1
            yield pa.record_batch({"sent": pa.array([n], pa.int64())})

    keyed = requests.withColumn("call_key", call_key(F.col("url"), F.col("body")))
    calls = keyed.groupBy("call_key").agg(F.first("url").alias("url"), F.first("body").alias("body"))
    open_ = materialize(calls.join(ledger.answers().select("call_key"), "call_key", "left_anti"), "calls")
    total = open_.count()
    if total:
        with ledger.progress(what, total, every_s) if what else nullcontext():
            materialize(open_.repartition(lanes, "call_key").mapInArrow(ask, "sent long"), "sent")
    answers = ledger.answers().select("call_key", "status_code", "payload", "transport_error")
    return keyed.join(answers, "call_key", "left").drop("call_key")
