"""Coverage spans, native laps, zones, repetitions and recoveries.

Records meet laps by the time at which their span begins: a lap that other laps don't overlap is found
by one sort (the last lap begun), so there is no records x laps product; only laps without a
boundary issue take part, and these don't overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import half_even, native_positive, native_total, seconds, zone_index
from paceline.operators.active_time import active_seconds, at_active_offset

CAP_S = 5.0
ZONES = (130, 145, 160, 175)
RECOVERY_S = 60.0


def chronological(records: DataFrame) -> DataFrame:
    """One row per timestamp, the last in source order with all its values, nulls included."""
    others = [c for c in records.columns if c not in ("activity_id", "ts")]
    return records.groupBy("activity_id", "ts").agg(F.max_by(F.struct(*others), "pos").alias("r")).select("activity_id", "ts", *[F.col(f"r.{c}").alias(c) for c in others])


def sample_spans(records: DataFrame, timelines: DataFrame, columns: list[str], cap_s: float = CAP_S) -> DataFrame:
    """activity_id, s, e, columns: each sample with a valid value covers until the next one, cap_s at most, within active intervals; the last covers nothing."""
    w = Window.partitionBy("activity_id").orderBy("ts")
    rows = chronological(records).select("activity_id", "ts", F.lead("ts").over(w).alias("next"), *[native_positive(F.col(c)).alias(c) for c in columns]).where("next is not null").where(F.coalesce(*[F.col(c).cast("double") for c in columns]).isNotNull())
    rows = rows.withColumn("stop", F.least("next", F.timestamp_micros(F.unix_micros("ts") + round(cap_s * 1e6))))
    active = timelines.where("source != 'unknown'").select("activity_id", "intervals")
    parts = F.filter(F.transform("intervals", lambda i: F.struct(F.greatest(i["s"], F.col("ts")).alias("s"), F.least(i["e"], F.col("stop")).alias("e"))), lambda x: x["s"] < x["e"])
    return rows.join(active, "activity_id").select("activity_id", F.explode(parts).alias("x"), *columns).select("activity_id", "x.s", "x.e", *columns)


def spans(records: DataFrame, timelines: DataFrame, value: str = "heart_rate_bpm", cap_s: float = CAP_S) -> DataFrame:
    """activity_id, s, e, value: sample_spans of one column."""
    return sample_spans(records, timelines, [value], cap_s).withColumnRenamed(value, "value")


def lap_issues(laps: DataFrame) -> DataFrame:
    """laps with boundary_issue: missing_lap_boundaries, reversed_lap_boundaries, overlapping_laps or null.

    Valid laps are sorted by start; one overlaps if an earlier one ends after its start or the next starts before its end.
    """
    missing = F.col("start_time").isNull() | F.col("end_time").isNull()
    own = F.when(missing, "missing_lap_boundaries").when(F.col("end_time") <= F.col("start_time"), "reversed_lap_boundaries")
    marked = laps.withColumn("own", own)
    w = Window.partitionBy("activity_id", F.col("own").isNull()).orderBy("start_time", "pos")
    before = F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start_time")
    after = F.lead("start_time").over(w) < F.col("end_time")
    overlap = F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), "overlapping_laps")
    return marked.withColumn("boundary_issue", F.coalesce("own", overlap)).drop("own")


def in_laps(rows: DataFrame, laps: DataFrame, start: str, end: str) -> DataFrame:
    """rows cut to the laps they lie in: lap_pos, with start and end clipped to the lap; laps must not overlap.

    A row that reaches into several laps gives a piece for each.
    """
    safe = laps.select("activity_id", F.col("pos").alias("lap_pos"), "start_time", "end_time")
    other = [c for c in rows.columns if c not in ("activity_id", start, end)]
    # one sort of lap starts and rows: a row meets the last lap begun, and a lap start the last row begun before it
    marks = safe.select("activity_id", F.col("start_time").alias("_x"), F.lit(0).alias("_k"), F.struct("lap_pos", "start_time", "end_time").alias("_lap"), F.lit(None).alias("_row"))
    given = rows.select("activity_id", F.col(start).alias("_x"), F.lit(1).alias("_k"), F.lit(None).alias("_lap"), F.struct(start, end, *other).alias("_row"))
    w = Window.partitionBy("activity_id").orderBy("_x", "_k").rowsBetween(Window.unboundedPreceding, 0)
    met = marks.unionByName(given).select("activity_id", "_k", F.last("_lap", ignorenulls=True).over(w).alias("_lap"), F.last("_row", ignorenulls=True).over(w).alias("_row")).select("activity_id", "_k", "_row.*", "_lap.*")
    met = met.where((F.col("_k") == 1) | (F.col(start) < F.col("start_time")))
    return met.withColumns({start: F.greatest(start, "start_time"), end: F.least(end, "end_time")}).where(F.col(start) < F.col(end)).select("activity_id", "lap_pos", start, end, *other)


def distance_at_edges(records: DataFrame, edges: DataFrame, timelines: DataFrame, cap_s: float = CAP_S) -> DataFrame:
    """edges (activity_id, lap_pos, side, at) with edge_m: an exact record's distance, else between neighbours at most cap_s apart inside one active interval."""
    from paceline.functions.interpolate import neighbours

    points = chronological(records).withColumn("x", F.unix_micros("ts")).select("activity_id", "x", "ts", "distance_m", "pos")
    t = edges.withColumn("ax", F.unix_micros("at"))
    n = neighbours(points, t, "activity_id", "x", "pos", ["ts", "distance_m"], "ax").join(timelines.select("activity_id", "intervals"), "activity_id", "left")
    exact = F.col("p.last.x") == F.col("ax")
    left, right = native_total(F.col("p.last.distance_m")), native_total(F.col("q.distance_m"))
    gap = (F.col("q.x") - F.col("p.last.x")) / 1e6
    together = F.exists("intervals", lambda i: (i["s"] <= F.col("p.last.ts")) & (F.col("q.ts") <= i["e"]))
    between = F.when((right >= left) & (gap <= cap_s) & together, left + (right - left) * (F.col("ax") - F.col("p.last.x")) / 1e6 / gap)
    return n.select(*edges.columns, F.when(exact, left).otherwise(between).alias("edge_m"))


def lap_rows(laps: DataFrame, records: DataFrame, timelines: DataFrame, cap_s: float = CAP_S) -> DataFrame:
    """One row per native lap: native values first, derived ones where boundaries are safe and active time is known."""
    issued = lap_issues(laps).join(timelines.select("activity_id", "source", "intervals"), "activity_id", "left").withColumn("known", F.coalesce(F.col("source") != "unknown", F.lit(False)))
    issued = issued.withColumn("safe", F.col("boundary_issue").isNull() & F.col("known"))
    safe = issued.where("safe")
    cut = in_laps(sample_spans(records, timelines, ["heart_rate_bpm", "cadence_spm"], cap_s), safe, "s", "e").withColumn("sec", seconds(F.col("e"), F.col("s")))
    parts = []
    for column, name in (("heart_rate_bpm", "hr"), ("cadence_spm", "cadence")):
        sec = F.when(F.col(column).isNotNull(), F.col("sec"))
        parts += [F.sum(sec).alias(f"{name}_seconds"), F.try_divide(F.sum(F.col(column) * sec), F.sum(sec)).alias(f"{name}_mean")]
    sums = cut.groupBy("activity_id", "lap_pos").agg(*parts)
    # a record belongs to the lap with start <= ts < end; distance checks also take ts = end
    rows = chronological(records).join(timelines.select("activity_id", "intervals"), "activity_id")
    point = rows.withColumns({"s": F.col("ts"), "e": F.timestamp_micros(F.unix_micros("ts") + 1), "in_active": F.exists("intervals", lambda i: (i["s"] <= F.col("ts")) & (F.col("ts") < i["e"]))}).drop("intervals")
    inside = in_laps(point.select("activity_id", "s", "e", "ts", "pos", "heart_rate_bpm", "distance_m", "in_active"), safe, "s", "e")
    top = inside.where("in_active").groupBy("activity_id", "lap_pos").agg(F.max(native_positive(F.col("heart_rate_bpm"))).alias("top_hr"))
    at_end = rows.select("activity_id", F.col("ts").alias("end_time"), F.col("distance_m").alias("d")).join(safe.select("activity_id", "end_time", F.col("pos").alias("lap_pos")), ["activity_id", "end_time"]).select("activity_id", "lap_pos", F.col("end_time").alias("ts"), "d")
    trace = inside.select("activity_id", "lap_pos", "ts", F.col("distance_m").alias("d")).unionByName(at_end)
    wl = Window.partitionBy("activity_id", "lap_pos").orderBy("ts")
    checked = trace.withColumn("falls", F.col("d") < F.lag("d").over(wl)).groupBy("activity_id", "lap_pos").agg(F.bool_or(native_total(F.col("d")).isNull() | F.coalesce("falls", F.lit(False))).alias("bad"), F.min("d").alias("d_min"), F.max("d").alias("d_max"))
    edges = safe.where(native_total(F.col("total_distance_m")).isNull()).select("activity_id", F.col("pos").alias("lap_pos"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("start_time").alias("at")), F.struct(F.lit("b").alias("side"), F.col("end_time").alias("at")))).alias("x")).select("activity_id", "lap_pos", "x.*")
    ends = distance_at_edges(records, edges, timelines, cap_s).groupBy("activity_id", "lap_pos").agg(F.max(F.when(F.col("side") == "a", F.col("edge_m"))).alias("d0"), F.max(F.when(F.col("side") == "b", F.col("edge_m"))).alias("d1"))
    any_records = records.select("activity_id").distinct().withColumn("has_records", F.lit(True))
    j = issued.withColumnRenamed("pos", "lap_pos").join(any_records, "activity_id", "left")
    for part in (sums, top, checked, ends):
        j = j.join(part, ["activity_id", "lap_pos"], "left")
    derived_reason = (
        F.when(F.col("has_records").isNull(), "no_records").when(F.coalesce("bad", F.lit(False)), "invalid_distance_trace").when(F.col("d0").isNull() | F.col("d1").isNull(), "distance_boundary_unavailable")
        .when((F.col("d1") < F.col("d0")) | (F.col("d_min") < F.col("d0")) | (F.col("d_max") > F.col("d1")), "invalid_distance_trace")
    )
    native_m = native_total(F.col("total_distance_m"))
    j = j.withColumns({"distance_reason": F.when(F.col("safe") & native_m.isNull(), derived_reason), "derived_s": F.when(F.col("safe"), active_seconds(F.col("intervals"), F.col("start_time"), F.col("end_time")))})
    j = j.withColumns({
        "distance_m": F.coalesce(native_m, F.when(F.col("safe") & F.col("distance_reason").isNull(), F.col("d1") - F.col("d0"))),
        "active_duration_s": F.coalesce(native_total(F.col("total_timer_time_s")), "derived_s"), "hr_seconds": F.coalesce("hr_seconds", F.lit(0.0)), "cadence_seconds": F.coalesce("cadence_seconds", F.lit(0.0)),
    })
    moving = (F.col("distance_m") > 0) & (F.col("active_duration_s") > 0)
    reason = F.coalesce("boundary_issue", F.when(~F.col("known"), "active_timing_unavailable"))
    issue = lambda metric, c: F.when(c.isNotNull(), F.struct(F.lit(metric).alias("metric"), c.alias("reason")))
    unknown_time = F.when(F.col("boundary_issue").isNull() & ~F.col("known"), F.lit("active_timing_unavailable"))
    return j.select(
        "activity_id", "lap_pos", "lap_index", "label", "role", "workout_step", "workout_issues", "start_time", "end_time", "distance_m", "active_duration_s",
        F.when(moving, F.col("active_duration_s") * 1000 / F.col("distance_m")).alias("pace_seconds_per_km"), F.when(moving, F.col("distance_m") * 3.6 / F.col("active_duration_s")).alias("speed_kmh"),
        F.coalesce(native_positive(F.col("avg_heart_rate_bpm")), half_even(F.col("hr_mean"))).alias("avg_heart_rate_bpm"), F.coalesce(native_positive(F.col("max_heart_rate_bpm")), "top_hr").alias("max_heart_rate_bpm"),
        F.coalesce(native_total(F.col("avg_cadence_spm")), half_even(F.col("cadence_mean"))).alias("avg_cadence_spm"), "hr_seconds", F.coalesce(reason, F.when(F.col("hr_seconds") == 0, "no_hr_coverage")).alias("hr_reason"),
        "cadence_seconds", F.coalesce(reason, F.when(F.col("cadence_seconds") == 0, "no_cadence_coverage")).alias("cadence_reason"),
        F.filter(F.array(issue("lap", F.col("boundary_issue")), issue("timing", unknown_time), issue("distance", F.col("distance_reason"))), lambda x: x.isNotNull()).alias("issues"),
        "boundary_issue", "known", native_total(F.col("total_timer_time_s")).alias("native_s"),
    )


def zone_summary(covered: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, z1..z5, covered_s, total_s, coverage_percent, unknown_s, reason. covered: keys, zone, sec; totals: keys, total_s, unavailable."""
    z = covered.groupBy(*keys).agg(*[F.sum(F.when(F.col("zone") == k, F.col("sec")).otherwise(0.0)).alias(f"z{k + 1}") for k in range(5)], F.sum("sec").alias("covered_s"))
    j = totals.join(z, keys, "left")
    shown = F.col("unavailable").isNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    cov, total = zero("covered_s"), F.col("total_s")
    off = cov > total + 1
    percent = F.when(total.isNull() | off, None).when(total > 0, F.least(cov * 100 / total, F.lit(100.0))).when(cov > 0, 100.0)
    reason = F.coalesce("unavailable", F.when(cov == 0, "no_hr_coverage"), F.when(total.isNull(), "total_active_time_unavailable"), F.when(off, "inconsistent_timing"))
    return j.select(
        *keys, *[F.when(shown, zero(f"z{k}")).alias(f"z{k}_s") for k in range(1, 6)], *[F.when(shown & (cov > 0), zero(f"z{k}") * 100 / cov).alias(f"z{k}_percent") for k in range(1, 6)], F.when(shown, cov).alias("covered_s"), "total_s",
        F.when(shown, percent).alias("coverage_percent"), F.when(shown & total.isNotNull() & ~off, F.greatest(total - cov, F.lit(0.0))).alias("unknown_s"), reason.alias("reason"),
    )


def session_zones(sessions: DataFrame, records: DataFrame, timelines: DataFrame, thresholds: tuple[int, ...] = ZONES, cap_s: float = CAP_S) -> DataFrame:
    t = sessions.select("activity_id", native_total(F.col("total_timer_time_s")).alias("native")).join(timelines.select("activity_id", "source", "intervals"), "activity_id", "left")
    known = F.coalesce(F.col("source") != "unknown", F.lit(False))
    own = F.aggregate("intervals", F.lit(0.0), lambda a, i: a + seconds(i["e"], i["s"]))
    totals = t.select("activity_id", F.coalesce("native", F.when(known, own)).alias("total_s"), F.when(~known, "active_timing_unavailable").alias("unavailable"))
    covered = spans(records, timelines, cap_s=cap_s).select("activity_id", zone_index(F.col("value"), thresholds).alias("zone"), seconds(F.col("e"), F.col("s")).alias("sec"))
    return zone_summary(covered, totals, ["activity_id"])


def lap_zones(laps: DataFrame, records: DataFrame, timelines: DataFrame, thresholds: tuple[int, ...] = ZONES, cap_s: float = CAP_S) -> DataFrame:
    issued = lap_issues(laps).join(timelines.select("activity_id", "source", "intervals"), "activity_id", "left")
    known = F.coalesce(F.col("source") != "unknown", F.lit(False))
    unavailable = F.coalesce("boundary_issue", F.when(~known, "active_timing_unavailable"))
    total = F.coalesce(native_total(F.col("total_timer_time_s")), F.when(unavailable.isNull(), active_seconds(F.col("intervals"), F.col("start_time"), F.col("end_time"))))
    totals = issued.select("activity_id", F.col("pos").alias("lap_pos"), total.alias("total_s"), unavailable.alias("unavailable"))
    cut = in_laps(spans(records, timelines, cap_s=cap_s), issued.where(F.col("boundary_issue").isNull()), "s", "e")
    return zone_summary(cut.select("activity_id", "lap_pos", zone_index(F.col("value"), thresholds).alias("zone"), seconds(F.col("e"), F.col("s")).alias("sec")), totals, ["activity_id", "lap_pos"])


def _repetition_rows(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    j = rows.where("role = 'work'").join(sessions.select("activity_id", (F.lower(F.trim(F.coalesce("sport", F.lit("")))) == "running").alias("running")), "activity_id", "left")
    step = F.col("workout_step")
    value = F.when(F.col("running"), F.col("pace_seconds_per_km")).otherwise(F.col("speed_kmh"))
    blank = step.isNull() | (F.trim(F.coalesce(step["identity"], F.lit(""))) == "")
    vague = step["duration"].isNull() | step["target"].isNull() | (F.size(F.coalesce(step["issues"], F.array().cast("array<string>"))) > 0)
    valid = F.coalesce((value > 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False))
    reason = F.when(blank, "missing_step_association").when(vague, "incomparable_definition").when(F.coalesce(F.col("boundary_issue") == "overlapping_laps", F.lit(False)), "overlapping_lap").when(~valid, "invalid_measurement")
    key = F.struct(step["identity"].alias("identity"), step["duration"].alias("duration"), step["target"].alias("target"), step["secondary"].alias("secondary"))
    return j.select("activity_id", "lap_pos", "lap_index", "running", key.alias("key"), value.alias("value"), reason.alias("reason"))


def repetitions(rows: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of comparable work laps (two or more), and the work laps that are left out with their reasons. rows: of lap_rows."""
    r = _repetition_rows(rows, sessions)
    groups = r.where("reason is null").groupBy("activity_id", "key").agg(
        F.count("*").alias("n"), F.min("lap_pos").alias("first_pos"), F.first("running").alias("running"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_pop("value").alias("sd"),
        F.array_sort(F.collect_list(F.struct("lap_pos", "lap_index"))).alias("members"),
    )
    fast, slow = F.when(F.col("running"), F.col("low")).otherwise(F.col("high")), F.when(F.col("running"), F.col("high")).otherwise(F.col("low"))
    out = r.where("reason in ('overlapping_lap', 'invalid_measurement')").groupBy("activity_id", "key").agg(F.array_sort(F.collect_list(F.struct("lap_pos", "lap_index", "reason"))).alias("excluded"))
    full = groups.where("n >= 2").alias("g").join(out.alias("o"), F.expr("g.activity_id = o.activity_id and g.key <=> o.key"), "left")
    found = full.select(
        "g.activity_id", "g.key", "n", "first_pos", F.when(F.col("running"), "pace_seconds_per_km").otherwise("speed_kmh").alias("metric"), "mean", fast.alias("fastest"), slow.alias("slowest"), (100 * F.col("sd") / F.col("mean")).alias("coefficient_variation_percent"), "members", "excluded"
    )
    few = groups.where("n < 2").select("activity_id", F.explode("members").alias("m"), F.lit("insufficient_repetitions").alias("reason"), F.lit(1).alias("late")).select("activity_id", "m.lap_pos", "m.lap_index", "reason", "late")
    left_out = r.where("reason is not null").select("activity_id", "lap_pos", "lap_index", "reason", F.lit(0).alias("late")).unionByName(few)
    order = Window.partitionBy("activity_id").orderBy("late", "lap_pos")
    return found, left_out.withColumn("exclusion_no", F.row_number().over(order)).drop("late")


def repetition_status(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """activity_id, n_groups, reason (no_work_laps, insufficient_repetitions or null)."""
    groups, _ = repetitions(rows, sessions)
    work = rows.groupBy("activity_id").agg(F.count_if(F.coalesce(F.col("role") == "work", F.lit(False))).alias("n_work"))
    j = sessions.select("activity_id").join(work, "activity_id", "left").join(groups.groupBy("activity_id").agg(F.count("*").alias("n_groups")), "activity_id", "left")
    n = F.coalesce("n_groups", F.lit(0))
    return j.select("activity_id", n.alias("n_groups"), F.when(F.coalesce("n_work", F.lit(0)) == 0, "no_work_laps").when(n == 0, "insufficient_repetitions").alias("reason"))


def recoveries(rows: DataFrame, records: DataFrame, timelines: DataFrame, offset_s: float = RECOVERY_S, gap_s: float = CAP_S) -> DataFrame:
    """One row per recovery lap: heart rates at its start and after offset_s active seconds, or the first reason why not."""
    w = Window.partitionBy("activity_id").orderBy("lap_pos")
    prev = rows.withColumn("prev", F.lag(F.struct("role", "lap_index", "boundary_issue", "end_time")).over(w)).where("role = 'recovery'").join(timelines.select("activity_id", "intervals"), "activity_id", "left")
    s, e = F.col("start_time"), F.col("end_time")
    j = prev.withColumn("sec", F.when(F.col("known") & s.isNotNull() & e.isNotNull() & (e >= s), active_seconds(F.col("intervals"), s, e)))
    unclear = F.col("prev.boundary_issue").isNotNull() | F.col("boundary_issue").isNotNull() | F.col("prev.end_time").isNull() | s.isNull() | e.isNull() | (F.col("prev.end_time") > s)
    early = (
        F.when(F.col("prev").isNull() | (F.col("prev.role") != "work") | F.col("prev.role").isNull(), "not_preceded_by_work").when(unclear, "ambiguous_lap_timing").when(~F.col("known"), "active_timing_unavailable")
        .when(F.abs(F.col("native_s") - F.col("sec")) > 1, "inconsistent_duration").when(F.col("sec") < offset_s, "under_60_active_seconds")
    )
    j = j.withColumn("early", early)
    j = j.withColumns({"t0": F.when(F.col("early").isNull(), at_active_offset(F.col("intervals"), s, e, 0)), "t60": F.when(F.col("early").isNull(), at_active_offset(F.col("intervals"), s, e, offset_s))})
    first = lambda c: F.try_element_at(c, F.lit(1))
    in_start = lambda t: F.filter("intervals", lambda i: (i["s"] <= t) & (t < i["e"]))
    in_end = lambda t: F.filter("intervals", lambda i: (i["s"] < t) & (t <= i["e"]))
    j = j.withColumns({"i0": first(in_start(F.col("t0"))), "i60": F.coalesce(first(in_end(F.col("t60"))), first(in_start(F.col("t60"))))})
    targets = j.where("t0 is not null and t60 is not null and i0 is not null and i60 is not null").select(
        "activity_id", "lap_pos", "start_time", "end_time",
        F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("t0").alias("t"), F.col("i0").alias("i")), F.struct(F.lit(1).alias("k"), F.col("t60").alias("t"), F.col("i60").alias("i")))).alias("x"),
    ).select("activity_id", "lap_pos", "start_time", "end_time", "x.*")
    found = nearest_observation(records, targets, gap_s)
    wide = found.groupBy("activity_id", "lap_pos").agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("hr", "obs")])
    j = j.join(wide, ["activity_id", "lap_pos"], "left")
    reason = (
        F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("t0").isNull(), "start_target_unavailable").when(F.col("t60").isNull(), "sixty_second_target_unavailable").when(F.col("i0").isNull() | F.col("i60").isNull(), "ambiguous_lap_timing")
        .when(F.col("hr0").isNull(), "start_hr_unavailable").when(F.col("hr1").isNull(), "sixty_second_hr_unavailable")
    )
    start_known = F.col("hr0").isNotNull()
    return j.select(
        "activity_id", "lap_pos", "lap_index", F.col("prev.lap_index").alias("preceding_lap_index"), F.col("t0").alias("start_target_time"), F.col("t60").alias("sixty_second_target_time"), F.col("hr0").alias("start_hr_bpm"),
        seconds(F.col("obs0"), F.col("t0")).alias("start_offset_s"), F.when(start_known, F.col("hr1")).alias("hr_60_bpm"), F.when(start_known, seconds(F.col("obs1"), F.col("t60"))).alias("sixty_second_offset_s"), (F.col("hr1") - F.col("hr0")).alias("delta_bpm"), reason.alias("reason"),
    )


def nearest_observation(records: DataFrame, targets: DataFrame, gap_s: float = CAP_S) -> DataFrame:
    """targets (activity_id, lap_pos, k, t, i: interval, start_time, end_time) with the nearest valid heart rate (hr, obs) at most gap_s away in the interval and the lap (its end only for k = 1); earlier ones win ties.

    The nearest usable record is the last usable at or before the target or the first usable after it.
    """
    from paceline.functions.interpolate import neighbours

    points = chronological(records).withColumn("hr", native_positive(F.col("heart_rate_bpm"))).where("hr is not null").withColumn("x", F.unix_micros("ts"))
    n = neighbours(points, targets.withColumn("tx", F.unix_micros("t")), "activity_id", "x", "pos", ["ts", "hr"], "tx")

    def usable(c: Column) -> Column:
        ts = c["ts"]
        inside = (F.col("start_time") <= ts) & ((ts < F.col("end_time")) | ((F.col("k") == 1) & (ts == F.col("end_time"))))
        return inside & (F.col("i.s") <= ts) & (ts <= F.col("i.e")) & (F.abs(c["x"] - F.col("tx")) <= gap_s * 1e6)

    a, b = F.col("p.last"), F.col("q")
    take_a = F.coalesce(usable(a), F.lit(False)) & (~F.coalesce(usable(b), F.lit(False)) | (F.abs(a["x"] - F.col("tx")) <= F.abs(b["x"] - F.col("tx"))))
    best = F.when(take_a, a).when(F.coalesce(usable(b), F.lit(False)), b)
    return n.select("activity_id", "lap_pos", "k", "t", best["hr"].cast("double").alias("hr"), best["ts"].alias("obs"))
