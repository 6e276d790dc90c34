"""Schemas of the normalised activity tables; all are keyed by activity_id and ordered by pos."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

SESSIONS = (
    "activity_id string, sport string, sub_sport string, start_time timestamp, end_time timestamp, start_latitude_deg double, start_longitude_deg double, "
    "total_distance_m double, total_timer_time_s double, total_elapsed_time_s double, total_ascent_m double, total_descent_m double, "
    "avg_heart_rate_bpm int, max_heart_rate_bpm int, avg_cadence_spm int, avg_speed_mps double, avg_temperature_c double, min_temperature_c double, max_temperature_c double"
)
RECORDS = (
    "activity_id string, pos long, ts timestamp, distance_m double, latitude_deg double, longitude_deg double, heart_rate_bpm int, cadence_spm int, "
    "fractional_cadence double, speed_mps double, altitude_m double, grade_percent double, temperature_c double"
)
DURATION = "struct<kind: string, value: double>"
TARGET = "struct<kind: string, lower: double, upper: double>"
STEP = f"struct<identity: string, label: string, role: string, duration: {DURATION}, target: {TARGET}, secondary: {TARGET}, issues: array<string>>"
LAPS = (
    "activity_id string, pos long, lap_index int, start_time timestamp, end_time timestamp, total_distance_m double, total_timer_time_s double, total_ascent_m double, total_descent_m double, "
    "avg_heart_rate_bpm int, max_heart_rate_bpm int, avg_cadence_spm int, avg_temperature_c double, min_temperature_c double, max_temperature_c double, intensity string, wkt_step_index string, "
    f"role string, label string, workout_step {STEP}, workout_issues array<string>"
)
TIMER_EVENTS = "activity_id string, pos long, ts timestamp, event_type string"
STEPS = (
    "activity_id string, pos long, message_index string, wkt_step_name string, intensity string, duration_type string, duration_time double, duration_distance double, "
    "target_type string, target_speed_zone int, target_cadence_zone int, custom_target_speed_low double, custom_target_speed_high double, custom_target_cadence_low double, custom_target_cadence_high double, secondary_target_type string"
)


@dataclass(frozen=True)
class Activities:
    """The tables of a set of activities."""

    sessions: DataFrame
    records: DataFrame
    laps: DataFrame
    timer_events: DataFrame
    steps: DataFrame

    def write(self, folder: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Activities:
        return cls(*(spark.read.schema(s).parquet(f"{folder}/{f.name}") for f, s in zip(fields(cls), (SESSIONS, RECORDS, LAPS, TIMER_EVENTS, STEPS), strict=True)))
