"""Registered queries: each operator on the testbed, with its DuckDB form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.scalars import WEATHER_LABELS, activity_type, compass, seconds
from paceline.operators import active_time, elevation, laps, splits, steps, summary, weather
from paceline.plans import batch
from paceline.plans.oracles import BASE, LAPS, SEGMENTS, SPANS, STRICT, TOLERANT
from paceline.sources.testbed import CAP_S, activities, lying, prepared, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles rounded, for comparison between engines that add in different orders."""
    return df.select(*[nearest(F.col(c), n).alias(c) if t == "double" else c for c, t in df.dtypes])


def nearest(c: Column, n: int) -> Column:
    """c rounded as SQL rounds: the product with 10**n to the nearest whole number, halves away from zero.

    ``F.round`` goes by the shortest decimal text instead, so that 47.660312499999994 goes down although its product ends in .5.
    """
    unit = F.lit(10.0**n)
    return F.round(c * unit, 0) / unit


def micros(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.unix_micros(n) for n in names})


@query(BASE + TOLERANT + SEGMENTS + """
w AS (SELECT sg.aid, km, round_even(avg(hr), 0)::INT AS ahr, max(hr) AS mhr, round_even(avg(cad), 0)::INT AS acad FROM sg JOIN el ON el.aid = sg.aid AND el.x > sx AND el.x <= mx WHERE km > 0 GROUP BY sg.aid, km)
SELECT sg.aid AS activity_id, CAST(sg.km AS INT) AS kilometer, round(CASE WHEN part THEN t - st ELSE 1000 END, 6) AS distance_m, part AS is_partial, round(mx - sx, 6) AS time_seconds,
  round((mx - sx) / (CASE WHEN part THEN t - st ELSE 1000 END / 1000), 6) AS pace_seconds_per_km, round(malt - salt, 6) AS elevation_delta_m, ahr AS avg_heart_rate_bpm, mhr AS max_heart_rate_bpm, acad AS avg_cadence_spm
FROM sg LEFT JOIN w ON w.aid = sg.aid AND w.km = sg.km WHERE sg.km > 0""")
def km_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, records, _ = prepared(spark, sf_dir)
    return rounded(splits.record_splits(records, a.laps))


@query(BASE + TOLERANT + """
f0 AS (SELECT aid, count(*) AS rn, count(d) AS rnd, max(d) - min(d) AS span, max(x) - min(x) AS ex, min(ts) AS f0ts, round_even(avg(hr), 0)::INT AS ahr, max(hr) AS mhr, round_even(avg(cad), 0)::INT AS acad, avg(temp) AS avt, min(temp) AS mnt, max(temp) AS mxt FROM el GROUP BY aid),
l0 AS (SELECT aid, sum(up) AS up, sum(down) AS down FROM lap GROUP BY aid),
q AS (SELECT ses.*, f0.*, l0.up AS lup, l0.down AS ldown, coalesce(m, CASE WHEN rnd >= 2 THEN span END) AS dm, coalesce(timer, CASE WHEN rn >= 2 THEN ex END) AS tm FROM ses JOIN f0 ON f0.aid = ses.aid LEFT JOIN l0 ON l0.aid = ses.aid)
SELECT aid AS activity_id, epoch_us(coalesce(s0, f0ts)) AS start_time, CASE WHEN sub = 'generic' THEN upper(sport[1]) || sport[2:] ELSE 'Trail Run-X' END AS activity_type, round(dm, 6) AS distance_m, round(tm, 6) AS timer_s,
  round(coalesce(nullif(elapsed, 0), tm), 6) AS elapsed_s, round(coalesce(up, lup), 6) AS ascent_m, round(coalesce(down, ldown), 6) AS descent_m, coalesce(hr, ahr) AS avg_heart_rate_bpm, coalesce(hr_max, mhr) AS max_heart_rate_bpm, acad AS avg_cadence_spm,
  round(coalesce(speed * 3.6, CASE WHEN dm <> 0 AND tm <> 0 THEN dm / tm * 3.6 END), 6) AS avg_speed_kmh, round(avt, 6) AS avg_temperature_c, round(mnt, 6) AS min_temperature_c, round(mxt, 6) AS max_temperature_c FROM q""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, records, _ = prepared(spark, sf_dir)
    return micros(rounded(summary.summaries(a.sessions, records, a.laps)), "start_time")


SMOOTH = """
al AS (SELECT aid, list(alt ORDER BY pos) AS a, count(*) AS n, count(d) AS nd, max(d) - min(d) AS span FROM rec WHERE alt IS NOT NULL GROUP BY aid HAVING count(*) >= 2),
wn AS (SELECT *, CASE WHEN n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END < 3 THEN 1 ELSE least(w0 + CASE WHEN w0 % 2 = 0 THEN 1 ELSE 0 END, 51, n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) END AS w
  FROM (SELECT *, CAST(greatest(3, coalesce(CASE WHEN span > 0 THEN round_even(170.0 / (span / (nd - 1)), 0) END, 3)) AS INT) AS w0 FROM al)),
sm AS (SELECT aid, w, [list_avg(a[greatest(1, i - w // 2):least(n, i + w // 2)]) FOR i IN generate_series(1, n)] AS s, n FROM wn),
"""


@query(BASE + SMOOTH + """
fo AS (SELECT aid, w, s, n, 1::BIGINT AS i, s[1] AS last, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM sm
  UNION ALL SELECT aid, w, s, n, i + 1, CASE WHEN abs(s[i + 1] - last) >= 0.4 THEN s[i + 1] ELSE last END, up + CASE WHEN s[i + 1] - last >= 0.4 THEN s[i + 1] - last ELSE 0 END, down + CASE WHEN last - s[i + 1] >= 0.4 THEN last - s[i + 1] ELSE 0 END FROM fo WHERE i < n)
SELECT aid AS activity_id, CAST(w AS INT) AS "window", round(up, 6) AS ascent_m, round(down, 6) AS descent_m FROM fo WHERE i = n""")
def elevation_gain_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elevation.elevation_totals(activities(spark, sf_dir).records))


@query(BASE + TOLERANT + "z AS (SELECT 1) SELECT aid AS activity_id, epoch_us(s) AS s, epoch_us(e) AS e FROM iv")
def active_intervals_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activities(spark, sf_dir)
    found = active_time.tolerant_intervals(a.timer_events, a.records).select("activity_id", F.explode("intervals").alias("i"))
    return found.select("activity_id", F.unix_micros("i.s").alias("s"), F.unix_micros("i.e").alias("e"))


@query(BASE + TOLERANT + "z AS (SELECT 1) SELECT aid AS activity_id, CAST(pos AS BIGINT) AS pos, round(x, 6) AS elapsed_s, paused AS has_active_timing FROM el")
def elapsed_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prepared(spark, sf_dir)[1].select("activity_id", "pos", "elapsed_s", "has_active_timing"))


@query(BASE + STRICT + """
t AS (SELECT aid, count(*) AS n_intervals, sum((epoch_us(e) - epoch_us(s)) / 1e6) AS active_s FROM tiv GROUP BY aid)
SELECT tl.aid AS activity_id, CASE WHEN issue IS NOT NULL THEN 'unknown' WHEN n = 0 THEN 'session_totals' ELSE 'timer_events' END AS source, issue, CAST(coalesce(n_intervals, 0) AS INT) AS n_intervals, round(coalesce(active_s, 0), 6) AS active_s FROM tl LEFT JOIN t ON t.aid = tl.aid""")
def active_timeline_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = prepared(spark, sf_dir)[2]
    return rounded(t.select("activity_id", "source", "issue", F.size("intervals").alias("n_intervals"), F.aggregate("intervals", F.lit(0.0), lambda x, i: x + seconds(i["e"], i["s"])).alias("active_s")))


@query(BASE + STRICT + SPANS + "z AS (SELECT 1) SELECT aid AS activity_id, epoch_us(s) AS s, epoch_us(e) AS e, CAST(v AS INT) AS value FROM spn")
def hr_coverage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, records, timelines = prepared(spark, sf_dir)
    return micros(laps.spans(records, timelines, cap_s=CAP_S), "s", "e")


ZONES = ", ".join(f"round(CASE WHEN ua IS NULL THEN coalesce(z{k}, 0) END, 6) AS z{k}_s, round(CASE WHEN ua IS NULL AND cov > 0 THEN z{k} * 100 / cov END, 6) AS z{k}_percent" for k in range(1, 6)) + """,
  round(CASE WHEN ua IS NULL THEN coalesce(cov, 0) END, 6) AS covered_s, round(total, 6) AS total_s,
  round(CASE WHEN ua IS NOT NULL OR total IS NULL OR coalesce(cov, 0) > total + 1 THEN NULL WHEN total > 0 THEN least(coalesce(cov, 0) * 100 / total, 100) WHEN cov > 0 THEN 100 END, 6) AS coverage_percent,
  round(CASE WHEN ua IS NULL AND coalesce(cov, 0) <= total + 1 THEN greatest(total - coalesce(cov, 0), 0) END, 6) AS unknown_s,
  coalesce(ua, CASE WHEN coalesce(cov, 0) = 0 THEN 'no_hr_coverage' WHEN total IS NULL THEN 'total_active_time_unavailable' WHEN cov > total + 1 THEN 'inconsistent_timing' END) AS reason"""
ZSUMS = ", ".join(f"sum(CASE WHEN z = {k} THEN sec ELSE 0 END) AS z{k + 1}" for k in range(5)) + ", sum(sec) AS cov"
ZOF = "(v >= 130)::INT + (v >= 145)::INT + (v >= 160)::INT + (v >= 175)::INT AS z, (epoch_us(e) - epoch_us(s)) / 1e6 AS sec"


@query(BASE + STRICT + SPANS + f"""
zz AS (SELECT aid, {ZSUMS} FROM (SELECT aid, {ZOF} FROM spn) GROUP BY aid),
own AS (SELECT aid, sum((epoch_us(e) - epoch_us(s)) / 1e6) AS a FROM tiv GROUP BY aid),
q AS (SELECT ses.aid, coalesce(timer, CASE WHEN tl.issue IS NULL THEN coalesce(a, 0) END) AS total, CASE WHEN tl.issue IS NOT NULL THEN 'active_timing_unavailable' END AS ua, zz.* EXCLUDE (aid) FROM ses JOIN tl ON tl.aid = ses.aid LEFT JOIN own ON own.aid = ses.aid LEFT JOIN zz ON zz.aid = ses.aid)
SELECT aid AS activity_id, {ZONES} FROM q""")
def hr_zones_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, records, timelines = prepared(spark, sf_dir)
    return rounded(laps.session_zones(a.sessions, records, timelines, cap_s=CAP_S))


@query(BASE + STRICT + SPANS + LAPS + f"""
cut AS (SELECT lsf.aid, pos, greatest(spn.s, lsf.s) AS s, least(spn.e, lsf.e) AS e, v FROM lsf JOIN spn ON spn.aid = lsf.aid WHERE lsf.issue IS NULL AND greatest(spn.s, lsf.s) < least(spn.e, lsf.e)),
zz AS (SELECT aid, pos, {ZSUMS} FROM (SELECT aid, pos, {ZOF} FROM cut) GROUP BY aid, pos),
own AS (SELECT lsf.aid, pos, coalesce(sum((epoch_us(least(tiv.e, lsf.e)) - epoch_us(greatest(tiv.s, lsf.s))) / 1e6), 0) AS a FROM lsf LEFT JOIN tiv ON tiv.aid = lsf.aid AND greatest(tiv.s, lsf.s) < least(tiv.e, lsf.e) WHERE safe GROUP BY lsf.aid, pos),
q AS (SELECT lsf.aid, lsf.pos, coalesce(timer, a) AS total, coalesce(lsf.issue, CASE WHEN NOT known THEN 'active_timing_unavailable' END) AS ua, zz.* EXCLUDE (aid, pos) FROM lsf LEFT JOIN own ON own.aid = lsf.aid AND own.pos = lsf.pos LEFT JOIN zz ON zz.aid = lsf.aid AND zz.pos = lsf.pos)
SELECT aid AS activity_id, pos AS lap_pos, {ZONES} FROM q""")
def hr_zones_lap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, records, timelines = prepared(spark, sf_dir)
    return rounded(laps.lap_zones(a.laps, records, timelines, cap_s=CAP_S))


ROWS = """
lsum AS (SELECT lsf.aid, pos, sum(sec) AS sec, sum(v * sec) / sum(sec) AS mean FROM (SELECT lsf.aid, pos, v, (epoch_us(least(spn.e, lsf.e)) - epoch_us(greatest(spn.s, lsf.s))) / 1e6 AS sec FROM lsf JOIN spn ON spn.aid = lsf.aid WHERE safe AND greatest(spn.s, lsf.s) < least(spn.e, lsf.e)) lsf GROUP BY ALL),
csum AS (SELECT lsf.aid, pos, sum(sec) AS sec, sum(v * sec) / sum(sec) AS mean FROM (SELECT lsf.aid, pos, v, (epoch_us(least(cspn.e, lsf.e)) - epoch_us(greatest(cspn.s, lsf.s))) / 1e6 AS sec FROM lsf JOIN cspn ON cspn.aid = lsf.aid WHERE safe AND greatest(cspn.s, lsf.s) < least(cspn.e, lsf.e)) lsf GROUP BY ALL),
ltop AS (SELECT lsf.aid, lsf.pos, max(smp.hr) AS top FROM lsf JOIN smp ON smp.aid = lsf.aid AND smp.ts >= lsf.s AND smp.ts < lsf.e WHERE safe AND EXISTS (SELECT 1 FROM tiv WHERE tiv.aid = lsf.aid AND tiv.s <= smp.ts AND smp.ts < tiv.e) GROUP BY ALL),
lact AS (SELECT lsf.aid, pos, coalesce(sum((epoch_us(least(tiv.e, lsf.e)) - epoch_us(greatest(tiv.s, lsf.s))) / 1e6), 0) AS a FROM lsf LEFT JOIN tiv ON tiv.aid = lsf.aid AND greatest(tiv.s, lsf.s) < least(tiv.e, lsf.e) WHERE safe GROUP BY lsf.aid, pos),
edge AS (SELECT lsf.aid, lsf.pos, k.side, CASE WHEN k.side = 0 THEN lsf.s ELSE lsf.e END AS t FROM lsf, (VALUES (0), (1)) k(side) WHERE safe AND m IS NULL),
enb AS (SELECT edge.*, (SELECT max(ts) FROM smp WHERE smp.aid = edge.aid AND ts <= t) AS tb, (SELECT min(ts) FROM smp WHERE smp.aid = edge.aid AND ts > t) AS ta FROM edge),
edm AS (SELECT enb.aid, enb.pos, side, CASE WHEN tb = t THEN b.d WHEN a.d >= b.d AND (epoch_us(ta) - epoch_us(tb)) / 1e6 <= 43200 AND EXISTS (SELECT 1 FROM tiv WHERE tiv.aid = enb.aid AND tiv.s <= tb AND ta <= tiv.e)
  THEN b.d + (a.d - b.d) * ((epoch_us(t) - epoch_us(tb)) / 1e6) / ((epoch_us(ta) - epoch_us(tb)) / 1e6) END AS dm FROM enb LEFT JOIN smp b ON b.aid = enb.aid AND b.ts = tb LEFT JOIN smp a ON a.aid = enb.aid AND a.ts = ta),
lend AS (SELECT aid, pos, max(CASE WHEN side = 0 THEN dm END) AS d0, max(CASE WHEN side = 1 THEN dm END) AS d1 FROM edm GROUP BY aid, pos),
ltr AS (SELECT lsf.aid, lsf.pos, min(smp.d) AS dn, max(smp.d) AS dx FROM lsf JOIN smp ON smp.aid = lsf.aid AND smp.ts >= lsf.s AND smp.ts <= lsf.e WHERE safe GROUP BY ALL),
lrow AS (SELECT lsf.*, lsum.sec AS hsec, lsum.mean AS hmean, csum.sec AS csec, csum.mean AS cmean, ltop.top, lact.a,
    CASE WHEN safe AND m IS NULL THEN CASE WHEN d0 IS NULL OR d1 IS NULL THEN 'distance_boundary_unavailable' WHEN d1 < d0 OR dn < d0 OR dx > d1 THEN 'invalid_distance_trace' END END AS dissue, coalesce(m, CASE WHEN safe AND d1 >= d0 AND NOT coalesce(dn < d0 OR dx > d1, false) THEN d1 - d0 END) AS dist, coalesce(timer, a) AS dur
  FROM lsf LEFT JOIN lsum USING (aid, pos) LEFT JOIN csum USING (aid, pos) LEFT JOIN ltop USING (aid, pos) LEFT JOIN lact USING (aid, pos) LEFT JOIN lend USING (aid, pos) LEFT JOIN ltr USING (aid, pos)),
lap_out AS (SELECT *, CASE WHEN dist > 0 AND dur > 0 THEN dur * 1000 / dist END AS pace, CASE WHEN dist > 0 AND dur > 0 THEN dist * 3.6 / dur END AS kmh FROM lrow),
"""


def _lap_rows(spark: SparkSession, sf_dir: str):
    a, records, timelines = prepared(spark, sf_dir)
    return a, records, timelines, stored(spark, sf_dir, "lap-rows", lambda: lying(spark, sf_dir, laps.lap_rows(a.laps, records, timelines, CAP_S), "lap-rows"))


@query(BASE + STRICT + SPANS + LAPS + ROWS + """z AS (SELECT 1)
SELECT aid AS activity_id, pos AS lap_pos, role, workout_issues, round(dist, 6) AS distance_m, round(dur, 6) AS active_duration_s, round(pace, 6) AS pace_seconds_per_km, round(kmh, 6) AS speed_kmh,
  CAST(coalesce(hr, round_even(hmean, 0)) AS INT) AS avg_heart_rate_bpm, CAST(coalesce(hr_max, top) AS INT) AS max_heart_rate_bpm, CAST(coalesce(cad, round_even(cmean, 0)) AS INT) AS avg_cadence_spm,
  round(coalesce(hsec, 0), 6) AS hr_seconds, coalesce(issue, CASE WHEN NOT known THEN 'active_timing_unavailable' WHEN hsec IS NULL THEN 'no_hr_coverage' END) AS hr_reason,
  round(coalesce(csec, 0), 6) AS cadence_seconds, coalesce(issue, CASE WHEN NOT known THEN 'active_timing_unavailable' WHEN csec IS NULL THEN 'no_cadence_coverage' END) AS cadence_reason,
  concat_ws(',', 'lap:' || issue, CASE WHEN issue IS NULL AND NOT known THEN 'timing:active_timing_unavailable' END, 'distance:' || dissue) AS issues FROM lap_out""")
def lap_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lap_rows(spark, sf_dir)[3]
    issues = F.array_join(F.transform("issues", lambda x: F.concat_ws(":", x["metric"], x["reason"])), ",")
    return rounded(rows.withColumns({"issues": issues, "workout_issues": F.array_join("workout_issues", ",")}).select("activity_id", "lap_pos", "role", "workout_issues", "distance_m", "active_duration_s", "pace_seconds_per_km", "speed_kmh", "avg_heart_rate_bpm", "max_heart_rate_bpm", "avg_cadence_spm", "hr_seconds", "hr_reason", "cadence_seconds", "cadence_reason", "issues"))


@query(BASE + LAPS.replace("lsf AS", "unused AS").replace("FROM lis JOIN tl ON tl.aid = lis.aid", "FROM lis, (SELECT NULL AS issue) tl") + "z AS (SELECT 1) SELECT aid AS activity_id, pos AS lap_pos, issue FROM lis")
def lap_overlap_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laps.lap_issues(activities(spark, sf_dir).laps).select("activity_id", F.col("pos").alias("lap_pos"), F.col("boundary_issue").alias("issue"))


REPS = """
rp AS (SELECT lap_out.*, sport = 'running' AS running, CASE WHEN sport = 'running' THEN pace ELSE kmh END AS val FROM lap_out JOIN ses USING (aid) WHERE role = 'work'),
rr AS (SELECT *, CASE WHEN problem IS NOT NULL THEN 'missing_step_association' WHEN no_duration THEN 'incomparable_definition' WHEN issue = 'overlapping_laps' THEN 'overlapping_lap' WHEN val IS NULL OR val <= 0 THEN 'invalid_measurement' END AS why FROM rp),
gr AS (SELECT aid, id, count(*) AS n, min(pos) AS first_pos, any_value(running) AS running, avg(val) AS mean, min(val) AS lo, max(val) AS hi, stddev_pop(val) AS sd FROM rr WHERE why IS NULL GROUP BY aid, id),
"""


@query(BASE + STRICT + SPANS + LAPS + ROWS + REPS + """z AS (SELECT 1)
SELECT aid AS activity_id, CAST(id AS VARCHAR) AS step_identity, n, first_pos, CASE WHEN running THEN 'pace_seconds_per_km' ELSE 'speed_kmh' END AS metric, round(mean, 6) AS mean, round(CASE WHEN running THEN lo ELSE hi END, 6) AS fastest,
  round(CASE WHEN running THEN hi ELSE lo END, 6) AS slowest, round(100 * sd / mean, 6) AS coefficient_variation_percent FROM gr WHERE n >= 2""")
def repetition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, _, rows = _lap_rows(spark, sf_dir)
    found, _ = laps.repetitions(rows, a.sessions)
    return rounded(found.select("activity_id", F.col("key.identity").alias("step_identity"), "n", "first_pos", "metric", "mean", "fastest", "slowest", "coefficient_variation_percent"))


@query(BASE + STRICT + SPANS + LAPS + ROWS + REPS + """
ex AS (SELECT aid, pos, why, 0 AS late FROM rr WHERE why IS NOT NULL UNION ALL SELECT rr.aid, rr.pos, 'insufficient_repetitions', 1 FROM rr JOIN gr ON gr.aid = rr.aid AND gr.id = rr.id WHERE why IS NULL AND gr.n < 2)
SELECT aid AS activity_id, pos AS lap_pos, CAST(pos + 1 AS INT) AS lap_index, why AS reason, CAST(row_number() OVER (PARTITION BY aid ORDER BY late, pos) AS INT) AS exclusion_no FROM ex""")
def repetition_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, _, rows = _lap_rows(spark, sf_dir)
    return laps.repetitions(rows, a.sessions)[1]


@query(BASE + STRICT + SPANS + LAPS + ROWS + REPS + """
st AS (SELECT ses.aid, (SELECT count(*) FROM lap_out WHERE lap_out.aid = ses.aid AND role = 'work') AS w, (SELECT count(*) FROM gr WHERE gr.aid = ses.aid AND gr.n >= 2) AS n FROM ses)
SELECT aid AS activity_id, n AS n_groups, CASE WHEN w = 0 THEN 'no_work_laps' WHEN n = 0 THEN 'insufficient_repetitions' END AS reason FROM st""")
def repetition_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _, _, rows = _lap_rows(spark, sf_dir)
    return laps.repetition_status(rows, a.sessions)


#: Active seconds after which a recovery is measured on the testbed.
OFFSET_S = 36_000.0
RECOVERY = """
pv AS (SELECT *, lag(role) OVER w AS prole, lag(pos) OVER w AS ppos, lag(issue) OVER w AS pissue, lag(e) OVER w AS pe FROM lap_out WINDOW w AS (PARTITION BY aid ORDER BY pos)),
rc AS (SELECT *, CASE WHEN prole IS NULL OR prole <> 'work' THEN 'not_preceded_by_work' WHEN pissue IS NOT NULL OR issue IS NOT NULL OR pe IS NULL OR s IS NULL OR e IS NULL OR pe > s THEN 'ambiguous_lap_timing' WHEN NOT known THEN 'active_timing_unavailable'
  WHEN abs(timer - a) > 1 THEN 'inconsistent_duration' WHEN a < 36000 THEN 'under_60_active_seconds' END AS early FROM pv WHERE role = 'recovery'),
ci AS (SELECT rc.aid, pos, greatest(tiv.s, rc.s) AS s, least(tiv.e, rc.e) AS e FROM rc JOIN tiv ON tiv.aid = rc.aid WHERE early IS NULL AND greatest(tiv.s, rc.s) < least(tiv.e, rc.e)),
cu AS (SELECT *, sum(epoch_us(e) - epoch_us(s)) OVER (PARTITION BY aid, pos ORDER BY s) AS done FROM ci),
t6 AS (SELECT aid, pos, min_by(make_timestamp(CAST(epoch_us(e) - (done - 36000000000) AS BIGINT)), s) AS t60 FROM cu WHERE done >= 36000000000 GROUP BY aid, pos),
tt AS (SELECT rc.*, CASE WHEN early IS NULL AND EXISTS (SELECT 1 FROM tiv WHERE tiv.aid = rc.aid AND tiv.s <= rc.s AND rc.s < tiv.e) THEN rc.s END AS t0, t60 FROM rc LEFT JOIN t6 USING (aid, pos)),
ti AS (SELECT tt.*, i0.s AS i0s, i0.e AS i0e, coalesce(i6.s, i7.s) AS i6s, coalesce(i6.e, i7.e) AS i6e FROM tt LEFT JOIN tiv i0 ON i0.aid = tt.aid AND i0.s <= t0 AND t0 < i0.e LEFT JOIN tiv i6 ON i6.aid = tt.aid AND i6.s < t60 AND t60 <= i6.e LEFT JOIN tiv i7 ON i7.aid = tt.aid AND i7.s <= t60 AND t60 < i7.e),
o0 AS (SELECT ti.aid, ti.pos, smp.hr, smp.ts FROM ti JOIN smp ON smp.aid = ti.aid AND smp.hr > 0 AND smp.ts >= ti.s AND smp.ts < ti.e AND smp.ts BETWEEN i0s AND i0e AND abs(epoch_us(smp.ts) - epoch_us(t0)) <= 43200000000 WHERE t0 IS NOT NULL AND t60 IS NOT NULL AND i6s IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ti.aid, ti.pos ORDER BY abs(epoch_us(smp.ts) - epoch_us(t0)), smp.ts) = 1),
o6 AS (SELECT ti.aid, ti.pos, smp.hr, smp.ts FROM ti JOIN smp ON smp.aid = ti.aid AND smp.hr > 0 AND smp.ts >= ti.s AND smp.ts <= ti.e AND smp.ts BETWEEN i6s AND i6e AND abs(epoch_us(smp.ts) - epoch_us(t60)) <= 43200000000 WHERE t0 IS NOT NULL AND t60 IS NOT NULL AND i0s IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ti.aid, ti.pos ORDER BY abs(epoch_us(smp.ts) - epoch_us(t60)), smp.ts) = 1),
"""


@query(BASE + STRICT + SPANS + LAPS + ROWS + RECOVERY + """z AS (SELECT 1)
SELECT ti.aid AS activity_id, ti.pos AS lap_pos, CAST(ti.pos + 1 AS INT) AS lap_index, CAST(ppos + 1 AS INT) AS preceding_lap_index, epoch_us(t0) AS start_target_time, epoch_us(CASE WHEN early IS NULL THEN t60 END) AS sixty_second_target_time, CAST(o0.hr AS DOUBLE) AS start_hr_bpm,
  round((epoch_us(o0.ts) - epoch_us(t0)) / 1e6, 6) AS start_offset_s, CASE WHEN o0.hr IS NOT NULL THEN CAST(o6.hr AS DOUBLE) END AS hr_60_bpm, round(CASE WHEN o0.hr IS NOT NULL THEN (epoch_us(o6.ts) - epoch_us(t60)) / 1e6 END, 6) AS sixty_second_offset_s,
  CAST(o6.hr - o0.hr AS DOUBLE) AS delta_bpm, CASE WHEN early IS NOT NULL THEN early WHEN t0 IS NULL THEN 'start_target_unavailable' WHEN t60 IS NULL THEN 'sixty_second_target_unavailable' WHEN i0s IS NULL OR i6s IS NULL THEN 'ambiguous_lap_timing' WHEN o0.hr IS NULL THEN 'start_hr_unavailable' WHEN o6.hr IS NULL THEN 'sixty_second_hr_unavailable' END AS reason
FROM ti LEFT JOIN o0 ON o0.aid = ti.aid AND o0.pos = ti.pos LEFT JOIN o6 ON o6.aid = ti.aid AND o6.pos = ti.pos""")
def recovery_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records, timelines, rows = _lap_rows(spark, sf_dir)
    return micros(rounded(laps.recoveries(rows, records, timelines, OFFSET_S, CAP_S)), "start_target_time", "sixty_second_target_time")


@query(BASE + LAPS.split("lis AS")[0] + "z AS (SELECT 1) SELECT aid AS activity_id, pos AS lap_pos, role, CASE WHEN problem IS NULL THEN 'step ' || id END AS label, CASE WHEN problem IS NULL THEN CAST(id AS VARCHAR) END AS step_identity, workout_issues FROM lrl")
def step_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activities(spark, sf_dir).laps.select("activity_id", F.col("pos").alias("lap_pos"), "role", "label", F.col("workout_step.identity").alias("step_identity"), F.array_join("workout_issues", ",").alias("workout_issues"))


#: Splits by native laps on the testbed: the unit is a lap's usual distance.
@query(BASE + """
al AS (SELECT *, row_number() OVER w AS km, count(*) OVER (PARTITION BY aid) AS nl, sum(m) OVER w AS cum FROM lap WINDOW w AS (PARTITION BY aid ORDER BY pos)),
ok AS (SELECT *, coalesce(timer IS NOT NULL AND m IS NOT NULL AND abs(m - 500) <= 25 AND abs(cum - km * 500) <= 25, false) AS ok FROM al),
pf AS (SELECT *, bool_and(ok) OVER (PARTITION BY aid ORDER BY pos) AS pre, coalesce(bool_and(ok) OVER (PARTITION BY aid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS pre0 FROM ok)
SELECT pf.aid AS activity_id, CAST(km AS INT) AS kilometer, round(pf.m, 6) AS distance_m, (NOT pre OR (km = nl AND pf.m < 500)) AS is_partial, round(pf.timer, 6) AS time_seconds, round(pf.timer / (pf.m / 1000), 6) AS pace_seconds_per_km,
  CASE WHEN pf.up IS NOT NULL OR pf.down IS NOT NULL THEN coalesce(pf.up, 0) - coalesce(pf.down, 0) END AS elevation_delta_m, pf.hr AS avg_heart_rate_bpm, pf.hr_max AS max_heart_rate_bpm, pf.cad AS avg_cadence_spm
FROM pf LEFT JOIN ses ON ses.aid = pf.aid WHERE pre OR (pre0 AND km = nl AND pf.timer IS NOT NULL AND pf.m > 0 AND pf.m < 500 AND abs(ses.m - cum) <= 25)""")
def aligned_laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activities(spark, sf_dir)
    return rounded(splits.lap_splits(a.laps, a.sessions, 500.0))


#: Splits of half a kilometre: a third of the activities have no distances in their records and go by laps, whose distances are near the unit and whose timers are all known here.
@query(BASE + TOLERANT + SEGMENTS.replace("1000", "500").replace("FROM el GROUP BY aid HAVING", "FROM el WHERE u % 3 <> 1 GROUP BY aid HAVING") + """
w AS (SELECT sg.aid, km, round_even(avg(hr), 0)::INT AS ahr, max(hr) AS mhr, round_even(avg(cad), 0)::INT AS acad FROM sg JOIN el ON el.aid = sg.aid AND el.x > sx AND el.x <= mx WHERE km > 0 GROUP BY sg.aid, km),
al AS (SELECT *, row_number() OVER w AS km, count(*) OVER (PARTITION BY aid) AS nl, sum(m) OVER w AS cum FROM (SELECT * REPLACE ((478 + (u * 7 + pos * 13) % 47)::DOUBLE AS m, coalesce(timer, 300 + pos)::DOUBLE AS timer) FROM lap) WINDOW w AS (PARTITION BY aid ORDER BY pos)),
ok AS (SELECT *, coalesce(timer IS NOT NULL AND abs(m - 500) <= 25 AND abs(cum - km * 500) <= 25, false) AS ok FROM al),
pf AS (SELECT *, bool_and(ok) OVER (PARTITION BY aid ORDER BY pos) AS pre, coalesce(bool_and(ok) OVER (PARTITION BY aid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS pre0 FROM ok)
SELECT sg.aid AS activity_id, CAST(sg.km AS INT) AS kilometer, round(CASE WHEN part THEN t - st ELSE 500 END, 6) AS distance_m, part AS is_partial, round(mx - sx, 6) AS time_seconds,
  round((mx - sx) / (CASE WHEN part THEN t - st ELSE 500 END / 1000), 6) AS pace_seconds_per_km, round(malt - salt, 6) AS elevation_delta_m, ahr AS avg_heart_rate_bpm, mhr AS max_heart_rate_bpm, acad AS avg_cadence_spm
FROM sg LEFT JOIN w ON w.aid = sg.aid AND w.km = sg.km WHERE sg.km > 0
UNION ALL SELECT pf.aid, CAST(km AS INT), round(pf.m, 6), (NOT pre OR (km = nl AND pf.m < 500)), round(pf.timer, 6), round(pf.timer / (pf.m / 1000), 6),
  CASE WHEN pf.up IS NOT NULL OR pf.down IS NOT NULL THEN coalesce(pf.up, 0) - coalesce(pf.down, 0) END, pf.hr, pf.hr_max, pf.cad
FROM pf LEFT JOIN ses ON ses.aid = pf.aid WHERE (pre OR (pre0 AND km = nl AND pf.timer IS NOT NULL AND pf.m < 500 AND abs(ses.m - cum) <= 25)) AND pf.aid NOT IN (SELECT aid FROM sg WHERE km > 0)""")
def splits_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, records, _ = prepared(spark, sf_dir)
    u = F.col("activity_id").cast("long")
    measured = records.withColumn("distance_m", F.when(u % 3 != 1, F.col("distance_m")))
    near = a.laps.withColumns({"total_distance_m": (478 + (u * 7 + F.col("pos") * 13) % 47).cast("double"), "total_timer_time_s": F.coalesce("total_timer_time_s", (300 + F.col("pos")).cast("double"))})
    return rounded(splits.splits(measured, near, a.sessions, 500.0))


@query(BASE + "z AS (SELECT 1) SELECT aid AS activity_id, epoch_us(ts) AS ts, CAST(pos AS BIGINT) AS pos, hr AS heart_rate_bpm FROM (SELECT aid, pos, to_timestamp(floor(epoch_us(ts) / 3.6e10) * 36000)::TIMESTAMP AS ts, hr FROM rec) QUALIFY row_number() OVER (PARTITION BY aid, ts ORDER BY pos DESC) = 1")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = activities(spark, sf_dir).records.withColumn("ts", F.timestamp_seconds(F.floor(F.unix_micros("ts") / 3.6e10) * 36000))
    return micros(laps.chronological(coarse).select("activity_id", "ts", "pos", "heart_rate_bpm"), "ts")


@query(BASE + """
o AS (SELECT ses.aid, 'out/' || (u % 40) AS p FROM ses),
ex AS (SELECT 'out/' || i AS p FROM range(0, 40, 7) t(i))
SELECT p AS output_path, list_aggregate(list_sort(list(aid)), 'string_agg', ',') AS sources, count(*) AS n FROM o WHERE p NOT IN (SELECT p FROM ex) GROUP BY p HAVING count(*) > 1""")
def output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = activities(spark, sf_dir).sessions.select(F.col("activity_id").alias("source"), F.concat(F.lit("out/"), F.col("activity_id").cast("long") % 40).alias("output_path"))
    existing = spark.range(0, 40, 7).select(F.concat(F.lit("out/"), F.col("id")).alias("output_path"))
    return batch.output_collisions(plans, existing).withColumn("sources", F.array_join("sources", ","))


@query("""SELECT user_id AS id, degrees_in, (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[CAST(((CAST(round_even(degrees_in / 22.5, 0) AS INT) % 16) + 16) % 16 AS INT) + 1] AS label
FROM (SELECT user_id, CAST(user_id AS DOUBLE) * 11.25 AS degrees_in FROM (SELECT DISTINCT user_id FROM events))""")
def compass_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id")).distinct()
    return ids.withColumn("degrees_in", F.col("id").cast("double") * 11.25).withColumn("label", compass(F.col("degrees_in")))


HOURLY = """
hr0 AS (SELECT aid, date_trunc('hour', ts) AS ts, min(pos) AS pos FROM rec GROUP BY ALL),
hw AS (SELECT hr0.aid, hr0.ts, e.k * 0.3::DOUBLE AS t, CASE WHEN e.k % 4 <> 0 THEN e.k * 0.25::DOUBLE END AS f, e.k AS code, 5.0::DOUBLE + e.k AS ws, (e.k * 37) % 360 + 0.5::DOUBLE AS wd FROM hr0 JOIN e ON e.aid = hr0.aid AND e.pos = hr0.pos WHERE e.k % 5 <> 0),
"""
CONDITION = "CASE code " + " ".join(f"WHEN {code} THEN '{label}'" for code, label in WEATHER_LABELS.items()) + " END"


@query(BASE + HOURLY + f"""
wa AS (SELECT aid, t0 AS s, t0 + INTERVAL 3 DAY AS e FROM ses WHERE u % 2 = 0),
wj AS (SELECT hw.*, wa.s, ts >= date_trunc('hour', wa.s) AND ts <= date_trunc('hour', wa.e) AS inside, abs(epoch_us(ts) - epoch_us(wa.s)) AS away FROM hw JOIN wa ON wa.aid = hw.aid),
wr AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY NOT inside, away, ts) AS r FROM wj),
wg AS (SELECT aid, count(*) FILTER (inside) AS n, avg(ws) FILTER (inside) AS ws, (degrees(atan2(sum(sin(radians(wd))) FILTER (inside), sum(cos(radians(wd))) FILTER (inside))) + 360) AS wd, min(t) FILTER (inside) AS lo, max(t) FILTER (inside) AS hi FROM wj GROUP BY aid)
SELECT wg.aid AS activity_id, round(wr.t, 6) AS temperature_c, round(f, 6) AS apparent_temperature_c, {CONDITION} AS condition_summary, round(CASE WHEN n > 0 THEN wg.ws ELSE wr.ws END, 6) AS wind_speed_kmh,
  round(CASE WHEN n > 0 THEN wg.wd - 360 * floor(wg.wd / 360) ELSE wr.wd END, 6) AS wind_direction_deg, round(CASE WHEN n > 0 THEN lo ELSE wr.t END, 6) AS temperature_min_c, round(CASE WHEN n > 0 THEN hi ELSE wr.t END, 6) AS temperature_max_c FROM wg JOIN wr ON wr.aid = wg.aid AND r = 1""")
def weather_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activities(spark, sf_dir)
    k = (F.col("heart").cast("int"))
    rows = a.records.select("activity_id", F.date_trunc("hour", "ts").alias("ts"), "pos", F.bround((F.col("speed_mps") - 2.0) * 50, 0).cast("int").alias("heart"))
    first = rows.groupBy("activity_id", "ts").agg(F.min_by("heart", "pos").alias("heart")).where(k % 5 != 0)
    hourly = first.select("activity_id", "ts", (k * 0.3).alias("temperature_c"), F.when(k % 4 != 0, k * 0.25).alias("apparent_temperature_c"), k.alias("weather_code"), (5.0 + k).alias("wind_speed_kmh"), ((k * 37) % 360 + 0.5).alias("wind_direction_deg"))
    even = a.records.groupBy("activity_id").agg(F.min("ts").alias("start_time")).where(F.col("activity_id").cast("long") % 2 == 0).withColumn("end_time", F.expr("start_time + interval 3 days"))
    found = weather.weather(even, hourly)
    return rounded(found.select("activity_id", "temperature_c", "apparent_temperature_c", "condition_summary", "wind_speed_kmh", "wind_direction_deg", "temperature_min_c", "temperature_max_c"))


ROUTE = """
rt AS (SELECT aid, min_by(d, pos) AS d0, max_by(d, pos) AS d1 FROM rec GROUP BY aid),
ra AS (SELECT aid, d0, d1, 0 AS idx, d0 AS apt FROM rt WHERE d1 > d0 UNION ALL SELECT aid, d0, d1, idx + 1, apt + 30.0::DOUBLE FROM ra WHERE apt + 30.0::DOUBLE < d1),
rg AS (SELECT aid, idx, apt FROM ra UNION ALL SELECT aid, max(idx) + 1, any_value(d1) FROM ra GROUP BY aid),
rp AS (SELECT *, lead(d) OVER w AS nd, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon FROM rec WINDOW w AS (PARTITION BY aid ORDER BY pos)),
rs AS (SELECT rg.aid, idx, apt, CASE WHEN d = apt THEN lat ELSE lat + (nlat - lat) * ((apt - d) / (nd - d)) END AS lat, CASE WHEN d = apt THEN lon ELSE lon + (nlon - lon) * ((apt - d) / (nd - d)) END AS lon
  FROM rg JOIN rp ON rp.aid = rg.aid AND d <= apt AND (apt < nd OR nd IS NULL AND d = apt)),
dm AS (SELECT aid, idx, apt, CASE WHEN lag(el) OVER w IS NOT NULL OR lead(el) OVER w IS NOT NULL THEN el END AS alt FROM (SELECT aid, idx, apt, CASE WHEN (idx * 7 + 3) % 10 < 8 THEN 20 + 10 * sin(idx / 9.0::DOUBLE) END AS el FROM rs) WINDOW w AS (PARTITION BY aid ORDER BY idx)),
"""


def _lookup(samples: DataFrame) -> DataFrame:
    """A made-up terrain with gaps."""
    return samples.where((F.col("idx") * 7 + 3) % 10 < 8).select("activity_id", "idx", (20 + 10 * F.sin(F.col("idx") / 9.0)).alias("elevation_m"))


@query(BASE + ROUTE + "z AS (SELECT 1) SELECT aid AS activity_id, CAST(idx AS INT) AS idx, round(apt, 6) AS distance_m, round(lat, 6) AS latitude_deg, round(lon, 6) AS longitude_deg FROM rs")
def route_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(elevation.route_samples(activities(spark, sf_dir).records))


@query(BASE + ROUTE + "z AS (SELECT 1) SELECT aid AS activity_id, CAST(idx AS INT) AS idx, round(alt, 6) AS altitude_m FROM dm")
def dem_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = elevation.route_samples(activities(spark, sf_dir).records)
    return rounded(elevation.terrain(samples, _lookup(samples)).select("activity_id", "idx", "altitude_m"))


@query(BASE + ROUTE + """
fp AS (SELECT *, lead(d) OVER w AS nd, lead(alt) OVER w AS nalt, count(*) OVER (PARTITION BY aid) AS np FROM rec WHERE alt IS NOT NULL WINDOW w AS (PARTITION BY aid ORDER BY pos)),
bo AS (SELECT dm.aid, idx, dm.alt AS dem, CASE WHEN d = apt THEN fp.alt WHEN nd IS NOT NULL THEN fp.alt + (nalt - fp.alt) * ((apt - d) / (nd - d)) END AS fit FROM dm LEFT JOIN fp ON fp.aid = dm.aid AND d <= apt AND (apt < nd OR nd IS NULL) AND np >= 5),
sgm AS (SELECT *, sum(CASE WHEN dem IS NULL OR fit IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY aid ORDER BY idx) AS sg FROM bo),
mv AS (SELECT *, fit - lag(fit) OVER w AS df, dem - lag(dem) OVER w AS dd, count(*) OVER (PARTITION BY aid, sg) AS len FROM sgm WHERE dem IS NOT NULL AND fit IS NOT NULL WINDOW w AS (PARTITION BY aid, sg ORDER BY idx)),
fl AS (SELECT aid, sg, (df > 0) <> lag(df > 0) OVER (PARTITION BY aid, sg ORDER BY idx) AS flip FROM mv WHERE abs(df) >= 0.5 AND len >= 3),
fr AS (SELECT aid, count(*) FILTER (flip) AS flips, count(flip) AS ch FROM fl GROUP BY aid),
ag AS (SELECT aid, count(*) AS pairs, coalesce(sum(abs(df)), 0) AS tf, coalesce(sum(abs(dd)), 0) AS td, avg(abs(fit - dem)) AS ad FROM mv GROUP BY aid)
SELECT ag.aid AS activity_id, pairs >= 5 AND tf >= greatest(td * 2, td + 20) AND ad >= 8 AND coalesce(CASE WHEN ch > 0 THEN flips / ch END, 0) >= 0.3 AS "replace" FROM ag LEFT JOIN fr ON fr.aid = ag.aid""")
def hybrid_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = activities(spark, sf_dir).records
    samples = elevation.route_samples(records)
    return elevation.replaces_recorded(records, elevation.terrain(samples, _lookup(samples)))


@query(BASE + ROUTE + """
dn AS (SELECT *, lead(apt) OVER w AS nat, lead(alt) OVER w AS nalt FROM dm WINDOW w AS (PARTITION BY aid ORDER BY idx)),
en AS (SELECT rec.aid, rec.pos, rec.alt, rec.grade, CASE WHEN dn.apt = rec.d THEN dn.alt ELSE dn.alt + (nalt - dn.alt) * ((rec.d - dn.apt) / (nat - dn.apt)) END AS t FROM rec LEFT JOIN dn ON dn.aid = rec.aid AND dn.apt <= rec.d AND (rec.d < nat OR nat IS NULL AND dn.apt = rec.d))
SELECT aid AS activity_id, CAST(pos AS BIGINT) AS pos, round(coalesce(t, alt), 6) AS altitude_m, round(CASE WHEN t IS NULL THEN grade END, 6) AS grade_percent FROM en""")
def dem_enriched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = activities(spark, sf_dir).records
    return rounded(elevation.enrich(records, _lookup(elevation.route_samples(records))).select("activity_id", "pos", "altitude_m", "grade_percent"))


#: Samples of segments over elapsed seconds.
DYNAMICS = SEGMENTS + SMOOTH.replace("FROM rec WHERE alt", "FROM rec WHERE d IS NOT NULL AND alt") + """
sp AS (SELECT sm.aid, unnest(generate_series(1, sm.n)) AS i, unnest(sm.s) AS alt FROM sm),
ar AS (SELECT aid, d, row_number() OVER (PARTITION BY aid ORDER BY pos) AS i FROM rec WHERE alt IS NOT NULL),
prf AS (SELECT sp.aid, ar.i, ar.d, sp.alt, lead(ar.d) OVER w AS nd, lead(sp.alt) OVER w AS nalt FROM sp JOIN ar ON ar.aid = sp.aid AND ar.i = sp.i WINDOW w AS (PARTITION BY sp.aid ORDER BY ar.i)),
gs AS (SELECT sg.aid, km, sx, mx - sx AS dur, unnest(list_distinct(list_append(generate_series(0::BIGINT, CAST(floor((mx - sx) / 86400) AS BIGINT)), -1))) AS q FROM sg WHERE km > 0 AND mx > sx),
gt AS (SELECT DISTINCT aid, km, CASE WHEN q < 0 THEN dur ELSE q * 86400.0 END AS off, sx + CASE WHEN q < 0 THEN dur ELSE q * 86400.0 END AS apt FROM gs),
pt AS (SELECT aid, x, min_by(struct_pack(hr, speed, grade, d), pos) AS f, max_by(struct_pack(hr, speed, grade, d), pos) AS l FROM el GROUP BY aid, x),
pn AS (SELECT *, lead(x) OVER w AS nx, lead(f) OVER w AS nf FROM pt WINDOW w AS (PARTITION BY aid ORDER BY x)),
sa AS (SELECT gt.aid, km, off, x = apt AS hit, (apt - x) / (nx - x) AS r, f, l, nf FROM gt JOIN pn ON pn.aid = gt.aid AND x <= apt AND (apt < nx OR nx IS NULL AND x = apt)),
sb AS (SELECT aid, km, off, CASE WHEN hit THEN f.hr ELSE CAST(round_even(coalesce(l.hr + (nf.hr - l.hr) * r, l.hr, nf.hr), 0) AS INT) END AS hr, CASE WHEN hit THEN f.speed ELSE coalesce(l.speed + (nf.speed - l.speed) * r, l.speed, nf.speed) END AS speed,
  CASE WHEN hit THEN f.grade ELSE coalesce(l.grade + (nf.grade - l.grade) * r, l.grade, nf.grade) END AS grade, CASE WHEN hit THEN f.d ELSE coalesce(l.d + (nf.d - l.d) * r, l.d, nf.d) END AS d FROM sa),
go AS (SELECT sb.aid, km, off, o, CASE WHEN prf.d = sb.d + o THEN prf.alt ELSE prf.alt + (nalt - prf.alt) * ((sb.d + o - prf.d) / (nd - prf.d)) END AS a FROM sb, (VALUES (-100.0), (100.0), (-200.0), (0.0), (200.0)) k(o) JOIN prf ON prf.aid = sb.aid AND prf.d <= sb.d + o AND (sb.d + o < nd OR nd IS NULL AND prf.d = sb.d + o) WHERE speed > 0),
gg AS (SELECT aid, km, off, coalesce(max(a) FILTER (o = 100) - max(a) FILTER (o = -100), max(a) FILTER (o = 0) - max(a) FILTER (o = -200), max(a) FILTER (o = 200) - max(a) FILTER (o = 0)) / 200 * 100 AS g FROM go GROUP BY ALL)
SELECT sb.aid AS activity_id, CAST(sb.km AS INT) AS kilometer, round(sb.off, 6) AS elapsed_seconds, hr AS heart_rate_bpm, round(speed * 3.6, 6) AS speed_kmh, round(coalesce(grade, g), 6) AS grade_percent,
  CASE WHEN part THEN round((st - d0) / 1000, 6) END AS from_km, CASE WHEN part THEN round((t - d0) / 1000, 6) END AS to_km FROM sb JOIN sg ON sg.aid = sb.aid AND sg.km = sb.km JOIN de ON de.aid = sb.aid LEFT JOIN gg ON gg.aid = sb.aid AND gg.km = sb.km AND gg.off = sb.off"""


@query(BASE + TOLERANT + DYNAMICS)
def dynamics_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, records, _ = prepared(spark, sf_dir)
    return rounded(splits.dynamics(records, a.laps, 86_400.0).select("activity_id", "kilometer", "from_km", "to_km", "elapsed_seconds", "heart_rate_bpm", "speed_kmh", "grade_percent"))


#: Every third activity without elapsed seconds.
MIXED = TOLERANT.replace("CASE WHEN EXISTS (SELECT 1 FROM iv WHERE iv.aid = rec.aid)\n    THEN", "CASE WHEN rec.u % 3 <> 0 AND EXISTS (SELECT 1 FROM iv WHERE iv.aid = rec.aid)\n    THEN")


def _mixed(records: DataFrame) -> DataFrame:
    """Records by one clock each; boundaries stay seconds as in the SQL, not times of whole microseconds."""
    return active_time.clocked(records.withColumn("elapsed_s", F.when(F.col("activity_id").cast("long") % 3 != 0, F.col("elapsed_s")))).drop("wall_origin")


@query("SELECT activity_id, kilometer, round(elapsed_seconds, 3) AS elapsed_seconds, heart_rate_bpm, speed_kmh FROM (" + BASE + MIXED + DYNAMICS + ")")
def mixed_clock_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples where every third activity has no elapsed seconds and goes by the wall clock."""
    a, records, _ = prepared(spark, sf_dir)
    found = splits.dynamics(_mixed(records), a.laps, 86_400.0).withColumn("elapsed_seconds", nearest(nearest(F.col("elapsed_seconds"), 6), 3))  # as the SQL, which rounds twice
    return rounded(found.select("activity_id", "kilometer", "elapsed_seconds", "heart_rate_bpm", "speed_kmh"))


@query("SELECT activity_id, kilometer, is_partial, round(time_seconds, 3) AS time_seconds, avg_heart_rate_bpm, max_heart_rate_bpm FROM (" + BASE + MIXED + SEGMENTS + """
w AS (SELECT sg.aid, km, round_even(avg(hr), 0)::INT AS ahr, max(hr) AS mhr FROM sg JOIN el ON el.aid = sg.aid AND el.x > sx AND el.x <= mx WHERE km > 0 GROUP BY sg.aid, km)
SELECT sg.aid AS activity_id, CAST(sg.km AS INT) AS kilometer, part AS is_partial, mx - sx AS time_seconds, ahr AS avg_heart_rate_bpm, mhr AS max_heart_rate_bpm FROM sg LEFT JOIN w ON w.aid = sg.aid AND w.km = sg.km WHERE sg.km > 0)""")
def mixed_clock_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, records, _ = prepared(spark, sf_dir)
    return rounded(splits.record_splits(_mixed(records), a.laps).select("activity_id", "kilometer", "is_partial", "time_seconds", "avg_heart_rate_bpm", "max_heart_rate_bpm"), 3)


@query(BASE + """
pl AS (SELECT aid, u, 'out/' || (u % 40) AS p, CASE WHEN u % 5 = 0 THEN 'old/' || (u % 40) END AS lg, CASE WHEN u % 13 = 4 THEN 'invalid: no FIT header' END AS err FROM ses),
ex AS (SELECT 'out/' || i AS p FROM range(0, 40, 7) t(i) UNION ALL SELECT 'old/' || i FROM range(0, 40, 10) t(i)),
kn AS (SELECT *, p IN (SELECT p FROM ex) OR coalesce(lg IN (SELECT p FROM ex), false) AS had FROM pl)
SELECT aid AS source, p AS output_path, err AS decode_error, CASE WHEN err IS NOT NULL THEN 'failed' WHEN had THEN 'skipped' WHEN count(*) FILTER (err IS NULL AND NOT had) OVER (PARTITION BY p) > 1 THEN 'collision' ELSE 'pending' END AS status FROM kn""")
def output_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folder run does with each source."""
    u = F.col("activity_id").cast("long")
    slot = (u % 40).cast("string")
    plans = activities(spark, sf_dir).sessions.select(
        F.col("activity_id").alias("source"), F.concat(F.lit("out/"), slot).alias("output_path"), F.when(u % 5 == 0, F.concat(F.lit("old/"), slot)).alias("legacy_path"), F.when(u % 13 == 4, "invalid: no FIT header").alias("decode_error")
    )
    there = [spark.range(0, 40, step).select(F.concat(F.lit(f"{folder}/"), F.col("id").cast("string")).alias("output_path")) for folder, step in (("out", 7), ("old", 10))]
    return batch.plan_statuses(plans, there[0].unionByName(there[1]))


@query("SELECT DISTINCT user_id AS id, CASE WHEN user_id % 4 = 0 THEN 'Bike-Ride' WHEN user_id % 4 = 1 THEN 'Trail Run' WHEN user_id % 4 = 2 THEN 'Running' END AS label FROM events")
def activity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id")).distinct()
    k = F.col("id") % 4
    sub = F.when(k == 0, "bike-ride").when(k == 1, " TRAIL_run ").when(k == 2, "Generic").otherwise("none")
    return ids.select("id", activity_type(F.when(k == 2, "running"), sub).alias("label"))
