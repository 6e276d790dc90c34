"""Active time: timer intervals, the strict timeline, elapsed seconds and offsets.

An activity's timer events and intervals are few, so they are folded as one array per activity; records
never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import finite, seconds

#: Timer event types.
START_TYPES = ("start",)
STOP_TYPES = ("stop", "stop_all", "stop_disable", "stop_disable_all")
INTERVALS = "array<struct<s: timestamp, e: timestamp>>"
NONE = f"cast(array() as {INTERVALS})"
TOLERANCE_S = 1.0


def with_state(events: DataFrame) -> DataFrame:
    """state: start or stop; null for event types that are neither."""
    return events.withColumn("state", F.when(F.col("event_type").isin(*START_TYPES), "start").when(F.col("event_type").isin(*STOP_TYPES), "stop"))


def tolerant_intervals(events: DataFrame, records: DataFrame) -> DataFrame:
    """activity_id, intervals: repeated starts are ignored, a leading stop opens at the first record, an open end closes at the last; all within first and last record."""
    ends = records.groupBy("activity_id").agg(F.min_by("ts", "pos").alias("first_ts"), F.max_by("ts", "pos").alias("last_ts"))
    listed = with_state(events).where("state is not null").groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct("ts", "pos", "state"))).alias("ev"))
    fold = f"""
      aggregate(ev, named_struct('open', cast(null as timestamp), 'out', {NONE}),
        (a, x) -> case
          when x.state = 'start' then named_struct('open', coalesce(a.open, greatest(x.ts, first_ts)), 'out', a.out)
          when a.open is not null then named_struct('open', cast(null as timestamp), 'out',
            if(least(x.ts, last_ts) >= a.open, concat(a.out, array(named_struct('s', a.open, 'e', least(x.ts, last_ts)))), a.out))
          when size(a.out) = 0 and least(x.ts, last_ts) > first_ts then named_struct('open', cast(null as timestamp), 'out', array(named_struct('s', first_ts, 'e', least(x.ts, last_ts))))
          else a end,
        a -> if(a.open is not null and last_ts >= a.open, concat(a.out, array(named_struct('s', a.open, 'e', last_ts))), a.out))"""
    return ends.join(listed, "activity_id").select("activity_id", F.expr(fold).alias("intervals"))


def elapsed_at(ts: Column, intervals: Column) -> Column:
    """Active seconds before ts; constant during pauses."""
    return F.aggregate(intervals, F.lit(0.0), lambda a, i: a + F.when(ts <= i["s"], 0.0).otherwise(seconds(F.least(ts, i["e"]), i["s"])))


def with_elapsed(records: DataFrame, events: DataFrame) -> DataFrame:
    """records with elapsed_s and has_active_timing (false: wall seconds from the first record)."""
    first = records.groupBy("activity_id").agg(F.min_by("ts", "pos").alias("_first"))
    intervals = tolerant_intervals(events, records).where("size(intervals) > 0")
    joined = records.join(first, "activity_id").join(intervals, "activity_id", "left")
    return joined.select(
        *records.columns, F.when(F.col("intervals").isNull(), seconds(F.col("ts"), F.col("_first"))).otherwise(elapsed_at(F.col("ts"), F.col("intervals"))).alias("elapsed_s"),
        F.col("intervals").isNotNull().alias("has_active_timing"),
    )


def strict_timeline(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """activity_id, source, issue, intervals; the first reason that applies is the issue, and then there are no intervals."""
    stated = with_state(events)
    listed = stated.groupBy("activity_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("state").isNotNull() & F.col("ts").isNotNull(), F.struct("ts", "state")))).alias("ev"), F.bool_or(F.col("state").isNull() | F.col("ts").isNull()).alias("odd"),
    )
    s = sessions.select("activity_id", F.col("start_time").alias("t0"), F.col("end_time").alias("t1"), F.col("total_timer_time_s").alias("timer"), F.col("total_elapsed_time_s").alias("elapsed"))
    j = s.join(listed, "activity_id", "left").withColumns({"ev": F.coalesce("ev", F.expr("cast(array() as array<struct<ts: timestamp, state: string>>)")), "odd": F.coalesce("odd", F.lit(False)), "wall": seconds(F.col("t1"), F.col("t0"))})
    fold = f"""
      aggregate(ev, named_struct('open', cast(null as timestamp), 'last', cast(null as timestamp), 'bad', false, 'out', {NONE}),
        (a, x) -> case
          when a.bad or x.ts = a.last or (x.state = 'start') = (a.open is not null) then named_struct('open', a.open, 'last', x.ts, 'bad', true, 'out', a.out)
          when x.state = 'start' then named_struct('open', x.ts, 'last', x.ts, 'bad', false, 'out', a.out)
          else named_struct('open', cast(null as timestamp), 'last', x.ts, 'bad', false, 'out', concat(a.out, array(named_struct('s', a.open, 'e', x.ts)))) end)"""
    j = j.withColumn("f", F.expr(fold))
    j = j.withColumn("ivs", F.expr("if(f.open is not null and t1 > f.open, concat(f.out, array(named_struct('s', f.open, 'e', t1))), f.out)"))
    j = j.withColumn("active", F.aggregate("ivs", F.lit(0.0), lambda a, i: a + seconds(i["e"], i["s"])))
    ok = lambda c: F.coalesce(finite(F.col(c)) & (F.col(c) >= 0), F.lit(False))
    timer, elapsed, wall, active = (F.col(c) for c in ("timer", "elapsed", "wall", "active"))
    totals_off = (timer.isNotNull() & (~ok("timer") | (F.abs(active - timer) > TOLERANCE_S))) | (elapsed.isNotNull() & (~ok("elapsed") | (elapsed < active - TOLERANCE_S) | (elapsed > wall + TOLERANCE_S)))
    issue = (
        F.when(F.col("t0").isNull() | F.col("t1").isNull() | (wall < 0), "invalid_bounds")
        .when(F.exists("ev", lambda x: (x["ts"] < F.col("t0")) | (x["ts"] > F.col("t1"))) | F.col("odd"), "invalid_events")
        .when((F.size("ev") == 0) & ~(ok("timer") & ok("elapsed")), "missing_evidence")
        .when((F.size("ev") == 0) & ((F.abs(timer - elapsed) > TOLERANCE_S) | (F.abs(elapsed - wall) > TOLERANCE_S)), "inconsistent_totals")
        .when(F.size("ev") == 0, F.lit(None))
        .when(F.col("f.bad"), "invalid_events")
        .when(F.col("f.open").isNotNull() & ~ok("timer"), "missing_evidence")
        .when(totals_off, "inconsistent_totals")
    )
    j = j.withColumn("issue", issue)
    whole = F.expr(f"if(t1 > t0, array(named_struct('s', t0, 'e', t1)), {NONE})")
    return j.select(
        "activity_id", F.when(F.col("issue").isNotNull(), "unknown").when(F.size("ev") == 0, "session_totals").otherwise("timer_events").alias("source"), "issue",
        F.when(F.col("issue").isNotNull(), F.expr(NONE)).when(F.size("ev") == 0, whole).otherwise(F.col("ivs")).alias("intervals"),
    )


def active_seconds(intervals: Column, start: Column, end: Column) -> Column:
    """Active seconds within [start, end)."""
    return F.aggregate(intervals, F.lit(0.0), lambda a, i: a + F.greatest(F.lit(0.0), seconds(F.least(i["e"], end), F.greatest(i["s"], start))))


def at_active_offset(intervals: Column, start: Column, end: Column, offset_s: float) -> Column:
    """Wall time at which offset_s active seconds of [start, end] have passed; offset 0 needs an interval that holds start."""
    if offset_s == 0:
        return F.when(F.exists(intervals, lambda i: (i["s"] <= start) & (start < i["e"]) & (start < end)), start)
    clipped = F.filter(F.transform(intervals, lambda i: F.struct(F.greatest(i["s"], start).alias("s"), F.least(i["e"], end).alias("e"))), lambda i: i["s"] < i["e"])
    goal = F.lit(round(offset_s * 1e6)).cast("long")
    length = lambda i: F.unix_micros(i["e"]) - F.unix_micros(i["s"])
    zero = F.struct(F.lit(0).cast("long").alias("done"), F.lit(None).cast("timestamp").alias("at"))

    def step(a: Column, i: Column) -> Column:
        here = F.when(a["at"].isNull() & (a["done"] + length(i) >= goal), F.timestamp_micros(F.unix_micros(i["s"]) + goal - a["done"])).otherwise(a["at"])
        return F.struct((a["done"] + length(i)).alias("done"), here.alias("at"))

    return F.aggregate(clipped, zero, step, lambda a: a["at"])


def clocked(records: DataFrame) -> DataFrame:
    """records whose elapsed_s is the wall time since the activity's first record where the activity has no elapsed_s at all; wall_origin: that record's time there, else null.

    Splits and samples then look records up by one clock per activity, in one sort for both kinds. Within an activity that
    has elapsed_s, records without it stay out of lookups.
    """
    own = Window.partitionBy("activity_id")
    r = records.withColumn("wall_origin", F.when(F.max("elapsed_s").over(own).isNull(), F.min("ts").over(own)))
    return r.withColumn("elapsed_s", F.coalesce("elapsed_s", seconds(F.col("ts"), F.col("wall_origin"))))
