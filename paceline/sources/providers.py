"""Answers of providers (elevation, weather) as lookup tables.

``requests.py`` makes and sends the calls; the JSON answers, one row per batch or activity, are parsed
here with from_json and higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 100
MOST_CALLS = 1000
HOURLY = ["temperature_2m", "apparent_temperature", "weather_code", "wind_speed_10m", "wind_direction_10m"]
NAMES = ["temperature_c", "apparent_temperature_c", "weather_code", "wind_speed_kmh", "wind_direction_deg"]


def elevation_batches(samples: DataFrame, size: int = BATCH) -> DataFrame:
    """activity_id, batch, locations ("lat,lon|lat,lon" with six decimals), expected: the requests for route samples (activity_id, idx, latitude_deg, longitude_deg)."""
    point = F.format_string("%.6f,%.6f", "latitude_deg", "longitude_deg")
    grouped = samples.groupBy("activity_id", F.floor(F.col("idx") / size).cast("int").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("idx", point.alias("p")))).alias("x"))  # at most size each
    return grouped.select("activity_id", "batch", F.array_join("x.p", "|").alias("locations"), F.size("x").alias("expected"))


def over_quota(batches: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """Activities whose batches would exceed the number of calls allowed in a run."""
    return batches.groupBy("activity_id").count().where(F.col("count") > most)


def elevations(answers: DataFrame, size: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """answers (activity_id, batch, expected, status_code, payload) as lookup rows (activity_id, idx, elevation_m) and diagnostics, the first of each kind per activity.

    A short answer's tail is missing, a long one is cut; a malformed item is null and the others stay.
    """
    p = answers.withColumn("j", F.from_json("payload", "struct<status: string, error: string, results: array<struct<elevation: string>>>"))
    value = lambda x: F.when(F.abs(x.try_cast("double")) < float("inf"), x.try_cast("double"))
    good = (F.col("status_code") == 200) & (F.col("j.status") == "OK") & F.col("j.results").isNotNull()
    values = F.when(good, F.transform("j.results.elevation", value)).otherwise(F.array().cast("array<double>"))
    p = p.withColumns({"good": F.coalesce(good, F.lit(False)), "v": values})
    p = p.withColumn("v", F.slice(F.concat("v", F.array_repeat(F.lit(None).cast("double"), F.col("expected"))), 1, F.col("expected")))
    rows = p.select("activity_id", "batch", F.posexplode("v").alias("k", "elevation_m")).select("activity_id", (F.col("batch").cast("long") * size + F.col("k")).alias("idx"), "elevation_m")
    text = F.lower(F.coalesce("j.error", F.lit("")))
    kind = (
        F.when(F.col("status_code") == 429, "quota_exceeded").when(F.col("status_code").isNull() | (F.col("status_code") != 200), "unavailable").when(F.col("j").isNull() | F.col("j.status").isNull(), "invalid_response")
        .when((F.col("j.status") != "OK") & (text.contains("rate limit") | text.contains("quota")), "quota_exceeded").when(F.col("j.status") != "OK", "unavailable").when(~F.col("good") | (F.size("j.results") != F.col("expected")), "invalid_response")
    )
    own = p.withColumn("kind", kind).where("kind is not null").groupBy("activity_id", "kind").agg(F.min("batch").alias("first_batch"))
    covered = rows.groupBy("activity_id").agg(F.count("elevation_m").alias("have"), F.count("*").alias("want"))
    gaps = covered.join(own.select("activity_id").distinct().withColumn("told", F.lit(True)), "activity_id", "left")
    more = gaps.withColumn("kind", F.when((F.col("have") == 0) & F.col("told").isNull(), "no_coverage").when((F.col("have") > 0) & (F.col("have") < F.col("want")), "partial_coverage")).where("kind is not null")
    return rows, own.select("activity_id", "kind", "first_batch").unionByName(more.select("activity_id", "kind", F.lit(0).alias("first_batch")))


def hourly_weather(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers (activity_id, payload) as hourly rows, and activities whose payload is not usable or partly malformed (activity_id, kind)."""
    series = ", ".join(f"{n}: array<string>" for n in HOURLY)
    p = answers.withColumn("h", F.from_json("payload", f"struct<hourly: struct<time: array<string>, {series}>>")["hourly"])
    n = F.size("h.time")
    level = lambda c: F.slice(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.array_repeat(F.lit(None).cast("string"), n)), 1, n)
    rows = p.where("h.time is not null").select("activity_id", F.explode(F.arrays_zip(F.col("h.time").alias("time"), *[level(F.col(f"h.{c}")).alias(c) for c in HOURLY])).alias("z"))
    number = lambda c: F.when(F.abs(F.col(f"z.{c}").try_cast("double")) < float("inf"), F.col(f"z.{c}").try_cast("double"))
    ts = F.try_to_timestamp(F.col("z.time"), F.lit("yyyy-MM-dd'T'HH:mm"))
    hourly = rows.select("activity_id", ts.alias("ts"), *[number(c).alias(n) if n != "weather_code" else number(c).cast("int").alias(n) for c, n in zip(HOURLY, NAMES, strict=True)])
    odd = rows.where(ts.isNull() | (F.greatest(*[(F.col(f"z.{c}").isNotNull() & number(c).isNull()).cast("int") for c in HOURLY]) > 0)).select("activity_id").distinct()
    return hourly, p.where("h.time is null").select("activity_id", F.lit("invalid_response").alias("kind")).unionByName(odd.withColumn("kind", F.lit("malformed_values")))
