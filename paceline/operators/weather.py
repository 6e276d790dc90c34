"""Historical weather of activities from hourly lookup rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import compass, finite, weather_label

HOURLY = ["temperature_c", "apparent_temperature_c", "wind_speed_kmh", "wind_direction_deg"]


def usable(hourly: DataFrame) -> DataFrame:
    """Rows with a time and any usable value; non-finite values become null, and so do codes without a label."""
    clean = hourly.withColumns({c: F.when(finite(F.col(c)), F.col(c)) for c in HOURLY} | {"weather_code": F.when(weather_label(F.col("weather_code")).isNotNull(), F.col("weather_code"))})
    return clean.where("ts is not null").where(F.coalesce(*[F.col(c).cast("double") for c in [*HOURLY, "weather_code"]]).isNotNull())


def circular_mean(degrees):
    """Mean direction in degrees, an aggregate; null without values or if they cancel out exactly."""
    s, c = F.sum(F.sin(F.radians(degrees))), F.sum(F.cos(F.radians(degrees)))
    return F.when((s != 0) | (c != 0), F.pmod(F.degrees(F.atan2(s, c)) + 360, F.lit(360.0)))


def weather(activities: DataFrame, hourly: DataFrame) -> DataFrame:
    """activities (activity_id, start_time, end_time) with the weather of their hours, else of the nearest hour.

    Temperature, feels-like and condition are those of the hour nearest to the start; wind is averaged over
    the window. Hourly rows are keyed by activity, so the join is local to it.
    """
    a = activities.where("start_time is not null").select("activity_id", "start_time", F.greatest(F.coalesce("end_time", "start_time"), "start_time").alias("end_time"))
    j = usable(hourly).join(a, "activity_id")
    j = j.withColumns({"inside": (F.col("ts") >= F.date_trunc("hour", "start_time")) & (F.col("ts") <= F.date_trunc("hour", "end_time")), "away": F.abs(F.unix_micros("ts") - F.unix_micros("start_time"))})
    nearest = F.min_by(F.struct("ts", *HOURLY, "weather_code"), F.struct(~F.col("inside"), F.col("away"), F.col("ts")))
    within = lambda c: F.when(F.col("inside"), F.col(c))
    g = j.groupBy("activity_id").agg(nearest.alias("near"), F.count_if("inside").alias("n"), F.avg(within("wind_speed_kmh")).alias("wind"), circular_mean(within("wind_direction_deg")).alias("direction"), F.min(within("temperature_c")).alias("low"), F.max(within("temperature_c")).alias("high"))
    any_inside = F.col("n") > 0
    pick = lambda a, b: F.when(any_inside, F.col(a)).otherwise(F.col(b))
    return g.select(
        "activity_id", F.lit("historical").alias("source"), F.col("near.temperature_c").alias("temperature_c"), F.col("near.apparent_temperature_c").alias("apparent_temperature_c"), weather_label(F.col("near.weather_code")).alias("condition_summary"),
        pick("wind", "near.wind_speed_kmh").alias("wind_speed_kmh"), pick("direction", "near.wind_direction_deg").alias("wind_direction_deg"), compass(pick("direction", "near.wind_direction_deg")).alias("wind_direction_label"),
        pick("low", "near.temperature_c").alias("temperature_min_c"), pick("high", "near.temperature_c").alias("temperature_max_c"),
    )
