"""Session summaries: per column the session's value, else the records', else (distance, time, climb, temperature) the laps'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import activity_type, finite, half_even, km_per_hour, plus_seconds, seconds
from paceline.operators.elevation import LEAST_CHANGE_M, SMOOTHING_M, elevation_totals


def start_times(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """activity_id, start_time: the session's, else the earliest record, else end minus elapsed, else the end."""
    first = records.groupBy("activity_id").agg(F.min("ts").alias("first_ts"))
    elapsed = F.col("total_elapsed_time_s")
    usable = finite(elapsed) & (elapsed >= 0) & (elapsed < 1e11)
    back = F.when(usable, plus_seconds(F.col("end_time"), -elapsed))
    return sessions.join(first, "activity_id", "left").select("activity_id", F.coalesce("start_time", "first_ts", back, "end_time").alias("start_time"))


def summaries(sessions: DataFrame, records: DataFrame, laps: DataFrame, prefer_records: bool | DataFrame = False, smoothing_m: float = SMOOTHING_M, least_change_m: float = LEAST_CHANGE_M) -> DataFrame:
    """One row per activity. records: with elapsed_s; prefer_records: whether climb comes from them first, or the activities (activity_id) where it does."""
    whole = lambda c: half_even(F.avg(F.col(c).cast("int")))
    r = records.groupBy("activity_id").agg(
        F.count("*").alias("r_n"), F.count("distance_m").alias("r_nd"), (F.max("distance_m") - F.min("distance_m")).alias("r_span"), F.count("elapsed_s").alias("r_ne"), (F.max("elapsed_s") - F.min("elapsed_s")).alias("r_elapsed"),
        F.min_by("ts", "pos").alias("r_first"), F.max_by("ts", "pos").alias("r_last"), whole("heart_rate_bpm").alias("r_hr"), F.max("heart_rate_bpm").alias("r_hr_max"), whole("cadence_spm").alias("r_cad"),
        F.avg("temperature_c").alias("r_t"), F.min("temperature_c").alias("r_t_min"), F.max("temperature_c").alias("r_t_max"),
    )
    l = laps.groupBy("activity_id").agg(
        F.sum("total_distance_m").alias("l_m"), F.sum("total_timer_time_s").alias("l_s"), F.sum("total_ascent_m").alias("l_up"), F.sum("total_descent_m").alias("l_down"),
        F.avg("avg_temperature_c").alias("l_t"), F.min("min_temperature_c").alias("l_t_min"), F.max("max_temperature_c").alias("l_t_max"),
    )
    fold = elevation_totals(records, smoothing_m, least_change_m).select("activity_id", F.col("ascent_m").alias("f_up"), F.col("descent_m").alias("f_down"))
    j = sessions.drop("start_time").join(start_times(sessions, records), "activity_id")
    for part in (r, l, fold):
        j = j.join(part, "activity_id", "left")
    r_time = F.when(F.col("r_ne") >= 2, F.col("r_elapsed")).when(F.col("r_n") >= 2, seconds(F.col("r_last"), F.col("r_first")))
    distance = F.coalesce("total_distance_m", F.when(F.col("r_nd") >= 2, F.col("r_span")), "l_m")
    j = j.withColumns({"distance_m": distance, "timer_s": F.coalesce("total_timer_time_s", r_time, "l_s")})
    if isinstance(prefer_records, DataFrame):
        j = j.join(prefer_records.select("activity_id").distinct().withColumn("preferred", F.lit(True)), "activity_id", "left")
    else:
        j = j.withColumn("preferred", F.lit(prefer_records))
    climb = lambda side, total: F.coalesce(F.when(F.col("preferred"), F.col(f"f_{side}")), total, f"l_{side}", f"f_{side}")
    kind = activity_type(F.col("sport"), F.col("sub_sport"))
    return j.select(
        "activity_id", "start_time", kind.alias("activity_type"), "distance_m", "timer_s", F.coalesce(F.when(F.col("total_elapsed_time_s") != 0, F.col("total_elapsed_time_s")), "timer_s").alias("elapsed_s"),
        climb("up", "total_ascent_m").alias("ascent_m"), climb("down", "total_descent_m").alias("descent_m"), F.coalesce("avg_heart_rate_bpm", "r_hr").alias("avg_heart_rate_bpm"), F.coalesce("max_heart_rate_bpm", "r_hr_max").alias("max_heart_rate_bpm"),
        F.coalesce("avg_cadence_spm", "r_cad").alias("avg_cadence_spm"), F.coalesce(F.col("avg_speed_mps") * 3.6, km_per_hour(F.col("distance_m"), F.col("timer_s"))).alias("avg_speed_kmh"),
        F.coalesce("avg_temperature_c", "r_t", "l_t").alias("avg_temperature_c"), F.coalesce("min_temperature_c", "r_t_min", "l_t_min").alias("min_temperature_c"), F.coalesce("max_temperature_c", "r_t_max", "l_t_max").alias("max_temperature_c"),
    )
