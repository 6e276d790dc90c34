"""Kilometre segments, splits and per-kilometre dynamics.

Records are looked up by elapsed_s; ``active_time.clocked`` gives activities without it the wall clock first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.interpolate import interpolate
from paceline.functions.scalars import finite, half_even, lerp, plus_seconds, seconds
from paceline.operators.elevation import estimated_grade

KILOMETRE_M = 1000.0
ALIGNMENT_M = 25.0
STEP_S = 30.0
NOTE = "Intermediate samples unavailable: pause timing was not recorded."


def segments(records: DataFrame, unit: float = KILOMETRE_M) -> DataFrame:
    """One row per full unit of distance and the rest, with both boundaries (ts, elapsed, altitude) and the distance of the origin.

    Each pair of consecutive distance records gives the unit marks it passes and the last record the rest, so marks
    cost one row each and no range join; of several pairs that pass a mark the first counts. Marks after a missing one
    and the rest are dropped. All steps go by activity: records that lie by activity need no exchange.
    """
    d = records.where("distance_m is not null")
    if "wall_origin" not in d.columns:
        d = d.withColumn("wall_origin", F.lit(None).cast("timestamp"))
    w = Window.partitionBy("activity_id").orderBy("pos")
    whole_run = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.struct("distance_m", "ts", "elapsed_s", "altitude_m")
    d = d.select("activity_id", "pos", "distance_m", "ts", "elapsed_s", "altitude_m", "wall_origin", F.lead(here).over(w).alias("next"), F.first(here).over(whole_run).alias("first"), F.last(here).over(whole_run).alias("final"))
    d = d.where("final.distance_m > first.distance_m").withColumn("full", F.floor((F.col("final.distance_m") - F.col("first.distance_m")) / unit).cast("int"))
    origin = F.col("first.distance_m")
    low = F.greatest(F.lit(1), F.ceil((F.col("distance_m") - origin) / unit).cast("int"))
    high = F.least(F.col("full"), F.floor((F.col("next.distance_m") - origin) / unit).cast("int"))
    none = F.array().cast("array<int>")
    passes = F.when((F.col("distance_m") < F.col("next.distance_m")) & (low <= high), F.sequence(low, high)).otherwise(none)
    rest = F.when(F.col("next").isNull() & ((F.col("final.distance_m") - origin) - F.col("full") * unit > 0), F.array(F.col("full") + 1)).otherwise(none)
    marks = d.withColumn("kilometer", F.explode(F.concat(passes, rest))).withColumns({"mark": origin + F.col("kilometer") * unit, "whole": F.col("kilometer") <= F.col("full")})
    ratio = (F.col("mark") - F.col("distance_m")) / (F.col("next.distance_m") - F.col("distance_m"))
    passed = plus_seconds(F.col("ts"), seconds(F.col("next.ts"), F.col("ts")) * ratio)
    point = F.struct(
        F.col("mark").alias("distance_m"), passed.alias("ts"),
        F.when(F.col("wall_origin").isNotNull(), seconds(passed, F.col("wall_origin"))).otherwise(lerp(F.col("elapsed_s"), F.col("next.elapsed_s"), ratio)).alias("elapsed_s"), lerp(F.col("altitude_m"), F.col("next.altitude_m"), ratio).alias("altitude_m"),
    )
    point = F.when(F.col("whole"), point).otherwise(F.col("final"))
    every = marks.groupBy("activity_id", "kilometer").agg(F.min_by(F.struct(point.alias("end"), "whole", "first"), "pos").alias("x")).select("activity_id", "kilometer", "x.*")
    by_km = Window.partitionBy("activity_id").orderBy("kilometer")
    every = every.withColumns({"k": F.row_number().over(by_km), "start": F.lag("end").over(by_km)}).where("k = kilometer").withColumn("start", F.coalesce("start", "first"))
    return every.select(
        "activity_id", "kilometer", F.when(F.col("whole"), F.lit(unit)).otherwise(F.col("end.distance_m") - F.col("start.distance_m")).alias("distance_m"), (~F.col("whole")).alias("is_partial"),
        "start", "end", F.col("first.distance_m").alias("origin_m"), (F.col("end.elapsed_s") - F.col("start.elapsed_s")).alias("record_duration_s"),
    )


def timed(segs: DataFrame, records: DataFrame, laps: DataFrame, unit: float = KILOMETRE_M) -> DataFrame:
    """segments with duration_s: the native lap's timer where records have no pause timing and the laps so far match the segments exactly.

    An activity's laps are one array, so that both joins are on the activity alone.
    """
    timing = records.groupBy("activity_id").agg(F.bool_or("has_active_timing").alias("paused"))
    native = laps.groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("total_distance_m").alias("m"), F.col("total_timer_time_s").alias("s")))).alias("native"))
    j = segs.join(timing, "activity_id").join(native, "activity_id", "left").withColumn("lap", F.try_element_at("native", F.col("kilometer")))
    exact = F.forall(F.slice("native", F.lit(1), F.col("kilometer") - 1), lambda x: F.coalesce(x["m"] == unit, F.lit(False)))
    fits = F.when(F.col("distance_m") == unit, F.col("lap.m") == unit).otherwise((F.col("kilometer") == F.size("native")) & (F.abs(F.col("lap.m") - F.col("distance_m")) <= ALIGNMENT_M))
    use = ~F.col("paused") & (F.col("origin_m") == 0) & exact & fits & finite(F.col("lap.s")) & (F.col("lap.s") > 0) & (F.col("lap.s") <= F.col("record_duration_s"))
    return j.withColumn("duration_s", F.when(F.coalesce(use, F.lit(False)), F.col("lap.s")).otherwise(F.col("record_duration_s"))).drop("paused", "native", "lap")


def record_splits(records: DataFrame, laps: DataFrame, unit: float = KILOMETRE_M) -> DataFrame:
    """Splits of activities whose records give segments; a record counts for the segment with start < elapsed <= end."""
    segs = timed(segments(records, unit), records, laps, unit)
    # sorted together, each record meets the next segment end at or after it; the end itself brings the segment to its group
    seg = F.struct("kilometer", "distance_m", "is_partial", "duration_s", "start", "end")
    ends = segs.select("activity_id", F.col("end.elapsed_s").alias("x"), F.lit(1).alias("kind"), seg.alias("own"), F.lit(None).alias("r"))
    rows = records.select("activity_id", F.col("elapsed_s").alias("x"), F.lit(0).alias("kind"), F.lit(None).alias("own"), F.struct("heart_rate_bpm", "cadence_spm").alias("r"))
    w = Window.partitionBy("activity_id").orderBy("x", "kind", F.col("own.kilometer")).rowsBetween(0, Window.unboundedFollowing)
    met = F.first(F.when(F.col("kind") == 1, F.struct("own.kilometer", F.col("own.start.elapsed_s").alias("from"))), ignorenulls=True).over(w)
    placed = rows.unionByName(ends).withColumn("met", met).where("kind = 1 or x > met.from")
    found = placed.groupBy("activity_id", F.coalesce("own.kilometer", "met.kilometer").alias("kilometer")).agg(
        F.max("own").alias("own"), half_even(F.avg("r.heart_rate_bpm")).alias("avg_heart_rate_bpm"), F.max("r.heart_rate_bpm").alias("max_heart_rate_bpm"), half_even(F.avg("r.cadence_spm")).alias("avg_cadence_spm")
    )
    return found.select(
        "activity_id", "kilometer", "own.distance_m", "own.is_partial", F.col("own.duration_s").alias("time_seconds"), F.when(F.col("own.distance_m") > 0, F.col("own.duration_s") / (F.col("own.distance_m") / 1000)).alias("pace_seconds_per_km"),
        (F.col("own.end.altitude_m") - F.col("own.start.altitude_m")).alias("elevation_delta_m"), "avg_heart_rate_bpm", "max_heart_rate_bpm", "avg_cadence_spm",
    )


def aligned_laps(laps: DataFrame, sessions: DataFrame, unit: float = KILOMETRE_M) -> DataFrame:
    """The longest run of leading laps that follow the units within the tolerance, each and in sum, and a last shorter lap if the session's distance agrees."""
    w = Window.partitionBy("activity_id").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    l = laps.withColumns({"kilometer": F.row_number().over(w), "n_laps": F.count("*").over(Window.partitionBy("activity_id")), "sum_m": F.sum("total_distance_m").over(run)})
    usable = F.col("total_timer_time_s").isNotNull() & F.col("total_distance_m").isNotNull()
    ok = usable & (F.abs(F.col("total_distance_m") - unit) <= ALIGNMENT_M) & (F.abs(F.col("sum_m") - F.col("kilometer") * unit) <= ALIGNMENT_M)
    l = l.withColumn("aligned", F.min(F.coalesce(ok, F.lit(False)).cast("int")).over(run))
    l = l.withColumn("before", F.coalesce(F.lag("aligned").over(w), F.lit(1))).join(sessions.select("activity_id", F.col("total_distance_m").alias("session_m")), "activity_id", "left")
    tail = (F.col("aligned") == 0) & (F.col("before") == 1) & (F.col("kilometer") == F.col("n_laps")) & usable & (F.col("total_distance_m") > 0) & (F.col("total_distance_m") < unit) & (F.abs(F.col("session_m") - F.col("sum_m")) <= ALIGNMENT_M)
    return l.where((F.col("aligned") == 1) | F.coalesce(tail, F.lit(False)))


def lap_splits(laps: DataFrame, sessions: DataFrame, unit: float = KILOMETRE_M) -> DataFrame:
    rise, fall = F.col("total_ascent_m"), F.col("total_descent_m")
    return aligned_laps(laps, sessions, unit).select(
        "activity_id", "kilometer", F.col("total_distance_m").alias("distance_m"), ((F.col("aligned") == 0) | (F.col("kilometer") == F.col("n_laps")) & (F.col("total_distance_m") < unit)).alias("is_partial"), F.col("total_timer_time_s").alias("time_seconds"),
        F.when(F.col("total_distance_m") > 0, F.col("total_timer_time_s") / (F.col("total_distance_m") / 1000)).alias("pace_seconds_per_km"),
        F.when(rise.isNotNull() | fall.isNotNull(), F.coalesce(rise, F.lit(0.0)) - F.coalesce(fall, F.lit(0.0))).alias("elevation_delta_m"), "avg_heart_rate_bpm", "max_heart_rate_bpm", "avg_cadence_spm",
    )


def splits(records: DataFrame, laps: DataFrame, sessions: DataFrame, unit: float = KILOMETRE_M) -> DataFrame:
    """Record splits, and lap splits of activities that have none."""
    own = record_splits(records, laps, unit)
    return own.unionByName(lap_splits(laps, sessions, unit).join(own.select("activity_id").distinct(), "activity_id", "left_anti"))


def dynamics(records: DataFrame, laps: DataFrame, step_s: float = STEP_S, unit: float = KILOMETRE_M, smoothing_m: float = 170.0, grade_m: float = 200.0) -> DataFrame:
    """Samples of each segment at 0, step, .. and its end: heart rate, speed, grade; only both ends where a lap's timer replaced the records'.

    from_km and to_km name a partial segment and are null for a full one; texts of them are made with the report, whose format rounds to even.
    """
    segs = timed(segments(records, unit), records, laps, unit).where("duration_s > 0").withColumn("uncertain", F.col("duration_s") != F.col("record_duration_s"))
    n = F.floor(F.col("duration_s") / step_s).cast("int")
    grid = F.transform(F.sequence(F.lit(0), n), lambda i: i * F.lit(float(step_s)))
    grid = F.when(F.col("uncertain"), F.array(F.lit(0.0), F.col("duration_s"))).when(F.element_at(grid, -1) == F.col("duration_s"), grid).otherwise(F.array_append(grid, F.col("duration_s")))
    edge = lambda name: F.when(F.col("is_partial"), (F.col(f"{name}.distance_m") - F.col("origin_m")) / 1000)
    targets = segs.select("activity_id", "kilometer", edge("start").alias("from_km"), edge("end").alias("to_km"), "uncertain", "duration_s", "record_duration_s", F.col("start.elapsed_s").alias("from"), F.explode(grid).alias("elapsed_seconds"))
    offset = F.when(F.col("uncertain") & (F.col("elapsed_seconds") == F.col("duration_s")), F.col("record_duration_s")).otherwise(F.col("elapsed_seconds"))
    targets = targets.select("activity_id", "kilometer", "from_km", "to_km", "uncertain", "elapsed_seconds", (F.col("from") + offset).alias("at"))
    found = interpolate(records, targets, "activity_id", "elapsed_s", "pos", "at", ["distance_m", "speed_mps", "grade_percent"], ["heart_rate_bpm"]).where("found")
    graded = estimated_grade(found.withColumn("sample_id", F.struct("kilometer", "elapsed_seconds")), records, smoothing_m, grade_m)
    return graded.select(
        "activity_id", "kilometer", "from_km", "to_km", "elapsed_seconds", "heart_rate_bpm", (F.col("speed_mps") * 3.6).alias("speed_kmh"), F.coalesce("grade_percent", "estimated_grade").alias("grade_percent"), F.when(F.col("uncertain"), NOTE).alias("sampling_note")
    )
