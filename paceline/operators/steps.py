"""Planned workout steps: definitions, and their link to native laps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import finite, lap_role, step_index
from paceline.schema import DURATION, TARGET


def _duration() -> Column:
    kind = F.col("duration_type")
    timed = lambda name, unit: F.when((kind == name) & finite(F.col(f"duration_{name}")) & (F.col(f"duration_{name}") > 0), F.struct(F.lit(unit).alias("kind"), F.col(f"duration_{name}").alias("value")))
    return F.coalesce(F.when(kind == "open", F.struct(F.lit("open").alias("kind"), F.lit(None).cast("double").alias("value"))), timed("time", "seconds"), timed("distance", "meters")).cast(DURATION)


def _target() -> Column:
    kind = F.col("target_type")
    nothing = F.lit(None).cast("double")

    def ranged(name: str, unit: str) -> Column:
        low, high = F.col(f"custom_target_{name}_low"), F.col(f"custom_target_{name}_high")
        ok = (kind == name) & (F.col(f"target_{name}_zone") == 0) & finite(low) & finite(high) & (low >= 0) & (high > 0) & (low <= high)
        return F.when(ok, F.struct(F.lit(unit).alias("kind"), low.alias("lower"), high.alias("upper")))

    return F.coalesce(F.when(kind == "open", F.struct(F.lit("open").alias("kind"), nothing.alias("lower"), nothing.alias("upper"))), ranged("speed", "speed_mps"), ranged("cadence", "cadence_rpm")).cast(TARGET)


def definitions(steps: DataFrame) -> DataFrame:
    """activity_id, step_id, n (definitions of that id), control, step: of ids defined once, the parsed step."""
    second = F.col("secondary_target_type")
    open_second = F.when(second == "open", F.struct(F.lit("open").alias("kind"), F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper")).cast(TARGET))
    s = steps.withColumns({"step_id": step_index(F.col("message_index")), "duration": _duration(), "target": _target()}).where("step_id is not null")
    issues = F.filter(
        F.array(F.when(F.col("duration").isNull(), "unsupported_duration"), F.when(F.col("target").isNull() | (second.isNotNull() & (second != "open")), "unsupported_target")), lambda x: x.isNotNull()
    )
    label = F.nullif(F.trim(F.regexp_replace("wkt_step_name", r"\s+", " ")), F.lit(""))
    step = F.struct(F.col("step_id").cast("string").alias("identity"), label.alias("label"), lap_role(F.col("intensity")).alias("role"), "duration", "target", open_second.alias("secondary"), issues.alias("issues"))
    return s.groupBy("activity_id", "step_id").agg(F.count("*").alias("n"), F.first(F.coalesce(F.col("duration_type").startswith("repeat_until_"), F.lit(False))).alias("control"), F.first(step).alias("step"))


def attach_steps(laps: DataFrame, steps: DataFrame) -> DataFrame:
    """laps with role, label, workout_step and workout_issues; a link counts only if it is valid and its definition unique."""
    base = laps.drop("role", "label", "workout_step", "workout_issues").withColumn("step_id", step_index(F.col("wkt_step_index")))
    j = base.join(definitions(steps), ["activity_id", "step_id"], "left")
    own = lap_role(F.col("intensity"))
    problem = (
        F.when(F.col("wkt_step_index").isNull(), "missing_association").when(F.col("step_id").isNull(), "invalid_association").when(F.col("n").isNull(), "missing_definition")
        .when(F.col("n") > 1, "ambiguous_definition").when(F.col("control"), "control_step")
    )
    j = j.withColumns({"own_role": own, "problem": problem}).withColumn("workout_step", F.when(F.col("problem").isNull(), F.col("step")))
    conflict = F.when((F.col("own_role") != "unknown") & (F.col("workout_step.role") != "unknown") & (F.col("own_role") != F.col("workout_step.role")), F.array(F.lit("role_conflict"))).otherwise(F.array().cast("array<string>"))
    issues = F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(F.concat(F.col("workout_step.issues"), conflict))
    return j.select(
        *[c for c in laps.columns if c not in ("role", "label", "workout_step", "workout_issues")], F.when(F.col("own_role") == "unknown", F.coalesce("workout_step.role", F.lit("unknown"))).otherwise(F.col("own_role")).alias("role"),
        F.col("workout_step.label").alias("label"), "workout_step", issues.alias("workout_issues"),
    )
