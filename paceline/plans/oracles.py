"""DuckDB forms of the registered queries, over the driver's events table."""

from __future__ import annotations

#: The testbed's tables.
BASE = r"""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS aid, user_id AS u, row_number() OVER w AS pos, ts, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cm,
    CAST(regexp_extract(props, '"k": ?(\d+)', 1) AS INT) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
rec AS (SELECT aid, u, pos, ts, cm / 100.0::DOUBLE AS d, 47 + k / 100.0::DOUBLE AS lat, 8 + cm / 1e6 AS lon, CASE WHEN k % 17 <> 0 THEN 100 + k END AS hr, CASE WHEN k % 11 <> 0 THEN 70 + k % 30 END AS cad, 2.0::DOUBLE + k / 50.0::DOUBLE AS speed,
    CASE WHEN k % 13 <> 0 THEN k * 0.5::DOUBLE END AS alt, CASE WHEN k % 2 = 0 THEN k / 10.0::DOUBLE END AS grade, CASE WHEN k % 3 = 0 THEN k / 4.0::DOUBLE END AS temp FROM e),
g AS (SELECT aid, u, min(ts) AS t0, max(ts) AS t1, max(cm) AS cm, max(pos) AS n, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS wall0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS wall FROM e GROUP BY aid, u),
tev AS (SELECT aid, ts, state, row_number() OVER (PARTITION BY aid ORDER BY ts, pos) AS rn FROM (SELECT e.aid, e.ts, e.pos, CASE WHEN e.u % 4 = 0 THEN CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' END
    WHEN e.u % 4 >= 2 THEN CASE WHEN pos % 10 = 1 THEN 'start' WHEN pos % 10 = 8 OR (pos = g.n AND pos % 10 BETWEEN 2 AND 7) THEN 'stop' END END AS state FROM e JOIN g ON g.aid = e.aid) WHERE state IS NOT NULL),
ses AS (SELECT aid, u, CASE WHEN u % 2 = 0 THEN 'running' ELSE 'cycling' END AS sport, CASE WHEN u % 3 = 0 THEN 'trail_run-x' ELSE 'generic' END AS sub, CASE WHEN u % 11 <> 1 THEN t0 END AS s0, t0, t1, wall,
    CASE WHEN u % 3 = 1 THEN cm / 100.0::DOUBLE END AS m, CASE WHEN u % 4 < 2 AND u % 5 < 4 THEN wall END AS timer, CASE WHEN u % 2 = 0 OR u % 4 = 1 THEN wall END AS elapsed,
    CASE WHEN u % 7 = 0 THEN 61.0::DOUBLE END AS up, CASE WHEN u % 7 = 1 THEN 56.0::DOUBLE END AS down, CASE WHEN u % 5 = 0 THEN 150 END AS hr, CASE WHEN u % 5 = 1 THEN 190 END AS hr_max, CASE WHEN u % 6 = 0 THEN 3.0::DOUBLE END AS speed FROM g),
lap0 AS (SELECT aid, u, CAST(floor((pos - 1) / 10.0) AS BIGINT) AS pos, min(ts) AS s, max(ts) AS m1, max(k) AS k, max(cm) - min(cm) AS cm FROM e GROUP BY ALL),
lap1 AS (SELECT *, pos + u AS j, coalesce(lead(s) OVER (PARTITION BY aid ORDER BY pos), m1 + INTERVAL 1 SECOND) AS nx FROM lap0),
lap AS (SELECT aid, u, pos, j, s, CASE WHEN j % 23 = 5 THEN nx + INTERVAL 1 SECOND WHEN j % 29 = 7 THEN s WHEN j % 31 = 3 THEN NULL ELSE nx END AS e, CASE WHEN j % 3 <> 0 THEN cm / 100.0::DOUBLE END AS m,
    CASE WHEN j % 2 = 0 THEN round_even((epoch_us(m1) - epoch_us(s)) / 1e6, 3)::DOUBLE END AS timer, CASE WHEN pos % 2 = 0 THEN 3.0::DOUBLE END AS up, CASE WHEN pos % 3 = 0 THEN 2.0::DOUBLE END AS down, CASE WHEN j % 4 = 0 THEN 140 END AS hr, CASE WHEN j % 4 = 1 THEN 180 END AS hr_max,
    CASE WHEN j % 4 = 2 THEN 80 END AS cad, CASE WHEN pos % 2 = 0 THEN 'work' WHEN k < 97 THEN 'recovery' ELSE 'unknown' END AS own_role, CASE WHEN j % 7 = 6 THEN NULL WHEN j % 11 = 10 THEN '70000' ELSE CAST(pos % 4 AS VARCHAR) END AS ref FROM lap1),
stp AS (SELECT aid, u, k.i AS n, CASE WHEN k.i = 4 THEN CASE WHEN u % 5 = 0 THEN 2 END ELSE k.i END AS id FROM g, range(5) k(i)),
def AS (SELECT aid, id, count(*) AS n, min(n) AS n0 FROM (SELECT * FROM stp WHERE id IS NOT NULL AND NOT (u % 9 = 0 AND id = 1)) GROUP BY aid, id),
"""

#: Tolerant timer intervals, one row each, and elapsed seconds per record.
TOLERANT = r"""
ends AS (SELECT aid, min_by(ts, pos) AS f, max_by(ts, pos) AS l FROM rec GROUP BY aid),
fold AS (SELECT aid, 0::BIGINT AS rn, CAST(NULL AS TIMESTAMP) AS op, 0 AS n, CAST(NULL AS TIMESTAMP) AS s, CAST(NULL AS TIMESTAMP) AS e FROM ends
  UNION ALL SELECT aid, rn, nop, n + CASE WHEN ns IS NULL THEN 0 ELSE 1 END, ns, ne FROM (SELECT fold.aid, tev.rn, fold.n,
    CASE WHEN state = 'start' THEN coalesce(op, greatest(ts, f)) END AS nop,
    CASE WHEN state = 'stop' AND op IS NOT NULL AND least(ts, l) >= op THEN op WHEN state = 'stop' AND op IS NULL AND n = 0 AND least(ts, l) > f THEN f END AS ns, least(ts, l) AS ne
    FROM fold JOIN tev ON tev.aid = fold.aid AND tev.rn = fold.rn + 1 JOIN ends ON ends.aid = fold.aid)),
iv AS (SELECT aid, s, e FROM fold WHERE s IS NOT NULL UNION ALL
  SELECT fold.aid, op, l FROM fold JOIN ends ON ends.aid = fold.aid WHERE op IS NOT NULL AND l >= op AND rn = (SELECT max(rn) FROM tev WHERE tev.aid = fold.aid)),
el AS (SELECT rec.*, f, EXISTS (SELECT 1 FROM iv WHERE iv.aid = rec.aid) AS paused, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE iv.aid = rec.aid)
    THEN (SELECT sum(CASE WHEN rec.ts <= iv.s THEN 0 ELSE (epoch_us(least(rec.ts, iv.e)) - epoch_us(iv.s)) / 1e6 END) FROM iv WHERE iv.aid = rec.aid) ELSE (epoch_us(rec.ts) - epoch_us(f)) / 1e6 END AS x FROM rec JOIN ends ON ends.aid = rec.aid),
"""

#: The strict timeline: source, issue, and intervals of known ones.
STRICT = r"""
sev AS (SELECT DISTINCT aid, ts, state FROM tev),
seq AS (SELECT *, row_number() OVER w AS rn, lag(state) OVER w AS before, lag(ts) OVER w AS ts0, lead(ts) OVER w AS ts1 FROM sev WINDOW w AS (PARTITION BY aid ORDER BY ts, state)),
bad AS (SELECT aid, bool_or((before IS NULL AND state = 'stop') OR before = state OR ts = ts0) AS bad, count(*) AS n, max_by(state, rn) AS last_state, max_by(ts, rn) AS last_ts FROM seq GROUP BY aid),
civ AS (SELECT seq.aid, seq.ts AS s, coalesce(ts1, t1) AS e FROM seq JOIN ses ON ses.aid = seq.aid WHERE state = 'start' AND coalesce(ts1, t1) > seq.ts),
act AS (SELECT aid, sum((epoch_us(e) - epoch_us(s)) / 1e6) AS active FROM civ GROUP BY aid),
tl AS (SELECT ses.aid, coalesce(n, 0) AS n, CASE WHEN s0 IS NULL THEN 'invalid_bounds' WHEN EXISTS (SELECT 1 FROM sev WHERE sev.aid = ses.aid AND (sev.ts < s0 OR sev.ts > t1)) THEN 'invalid_events'
    WHEN n IS NULL AND (timer IS NULL OR elapsed IS NULL) THEN 'missing_evidence' WHEN n IS NULL AND (abs(timer - elapsed) > 1 OR abs(elapsed - wall) > 1) THEN 'inconsistent_totals' WHEN n IS NULL THEN NULL
    WHEN bad THEN 'invalid_events' WHEN last_state = 'start' AND timer IS NULL THEN 'missing_evidence' WHEN abs(coalesce(active, 0) - timer) > 1 OR elapsed < coalesce(active, 0) - 1 OR elapsed > wall + 1 THEN 'inconsistent_totals' END AS issue
  FROM ses LEFT JOIN bad ON bad.aid = ses.aid LEFT JOIN act ON act.aid = ses.aid),
tiv AS (SELECT civ.* FROM civ JOIN tl ON tl.aid = civ.aid WHERE issue IS NULL AND n > 0 UNION ALL SELECT ses.aid, s0, t1 FROM ses JOIN tl ON tl.aid = ses.aid WHERE issue IS NULL AND n = 0 AND t1 > s0),
"""

#: Heart-rate and cadence spans of known timelines.
SPANS = r"""
smp AS (SELECT *, lead(ts) OVER (PARTITION BY aid ORDER BY ts) AS nx FROM (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY aid, ts ORDER BY pos DESC) = 1)),
spn AS (SELECT smp.aid, greatest(smp.ts, tiv.s) AS s, least(nx, smp.ts + INTERVAL 43200 SECOND, tiv.e) AS e, hr AS v FROM smp JOIN tiv ON tiv.aid = smp.aid WHERE hr IS NOT NULL AND nx IS NOT NULL AND greatest(smp.ts, tiv.s) < least(nx, smp.ts + INTERVAL 43200 SECOND, tiv.e)),
cspn AS (SELECT smp.aid, greatest(smp.ts, tiv.s) AS s, least(nx, smp.ts + INTERVAL 43200 SECOND, tiv.e) AS e, cad AS v FROM smp JOIN tiv ON tiv.aid = smp.aid WHERE cad IS NOT NULL AND nx IS NOT NULL AND greatest(smp.ts, tiv.s) < least(nx, smp.ts + INTERVAL 43200 SECOND, tiv.e)),
"""

#: Laps with step links and boundary issues.
LAPS = r"""
lnk AS (SELECT lap.*, CASE WHEN ref IS NULL THEN 'missing_association' WHEN ref = '70000' THEN 'invalid_association' WHEN def.n IS NULL THEN 'missing_definition' WHEN def.n > 1 THEN 'ambiguous_definition' WHEN def.id = 3 THEN 'control_step' END AS problem, def.id
  FROM lap LEFT JOIN def ON def.aid = lap.aid AND CAST(def.id AS VARCHAR) = lap.ref),
lst AS (SELECT *, CASE WHEN problem IS NULL THEN CASE WHEN id % 2 = 0 THEN 'work' ELSE 'recovery' END END AS step_role, CASE WHEN problem IS NULL AND id % 2 = 0 AND u % 8 = 0 THEN true ELSE false END AS no_duration FROM lnk),
lrl AS (SELECT *, CASE WHEN own_role = 'unknown' THEN coalesce(step_role, 'unknown') ELSE own_role END AS role, CASE WHEN problem IS NOT NULL THEN problem ELSE
    concat_ws(',', CASE WHEN no_duration THEN 'unsupported_duration' END, CASE WHEN own_role <> 'unknown' AND own_role <> step_role THEN 'role_conflict' END) END AS workout_issues FROM lst),
lis AS (SELECT a.*, CASE WHEN a.s IS NULL OR a.e IS NULL THEN 'missing_lap_boundaries' WHEN a.e <= a.s THEN 'reversed_lap_boundaries' WHEN EXISTS (SELECT 1 FROM lap b WHERE b.aid = a.aid AND b.pos <> a.pos AND b.s < b.e AND a.s < b.e AND b.s < a.e) THEN 'overlapping_laps' END AS issue FROM lrl a),
lsf AS (SELECT lis.*, tl.issue IS NULL AS known, lis.issue IS NULL AND tl.issue IS NULL AS safe FROM lis JOIN tl ON tl.aid = lis.aid),
"""

#: Distance segments with interpolated boundaries.
SEGMENTS = r"""
de AS (SELECT aid, min_by(d, pos) AS d0, max_by(d, pos) AS d1, CAST(floor((max_by(d, pos) - min_by(d, pos)) / 1000) AS INT) AS full_n FROM el GROUP BY aid HAVING count(*) >= 2),
pr AS (SELECT *, lead(d) OVER w AS nd, lead(x) OVER w AS nxx, lead(alt) OVER w AS nalt FROM el WINDOW w AS (PARTITION BY aid ORDER BY pos)),
mk AS (SELECT de.aid, km, d0, full_n, pr.pos, d0 + km * 1000.0 AS t, x + (nxx - x) * (d0 + km * 1000.0 - d) / (nd - d) AS mx, coalesce(alt + (nalt - alt) * (d0 + km * 1000.0 - d) / (nd - d), alt, nalt) AS malt
  FROM de, LATERAL (SELECT unnest(generate_series(1, full_n)) AS km) k JOIN pr ON pr.aid = de.aid AND pr.d < pr.nd AND pr.d <= d0 + km * 1000.0 AND d0 + km * 1000.0 <= pr.nd QUALIFY row_number() OVER (PARTITION BY de.aid, km ORDER BY pr.pos) = 1),
bd AS (SELECT aid, km, t, mx, malt, false AS part FROM mk UNION ALL SELECT de.aid, full_n + 1, d1, max_by(x, pos), arg_max_null(alt, pos), true FROM de JOIN el ON el.aid = de.aid WHERE d1 - d0 - full_n * 1000 > 0 GROUP BY de.aid, full_n, d1
  UNION ALL SELECT de.aid, 0, d0, min_by(x, pos), arg_min_null(alt, pos), false FROM de JOIN el ON el.aid = de.aid WHERE d1 > d0 GROUP BY de.aid, d0),
sg AS (SELECT *, lag(t) OVER w AS st, lag(mx) OVER w AS sx, lag(malt) OVER w AS salt FROM bd WINDOW w AS (PARTITION BY aid ORDER BY km)),
"""

