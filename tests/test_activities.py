"""Operators on hand-computed tables and on a synthetic workout."""

import struct
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from paceline import schema
from paceline.functions.interpolate import interpolate
from paceline.operators import active_time, elevation, laps, splits, steps, summary
from paceline.plans import batch, report
from paceline.sources import fit

T0 = datetime(2020, 1, 1, 12, tzinfo=timezone.utc)


def at(s):
    return None if s is None else T0 + timedelta(seconds=s)


def table(spark, fields, rows):
    """Rows of dicts; what is left out is null."""
    return spark.createDataFrame([r for r in rows], fields) if not rows else spark.createDataFrame([tuple(r.get(f.split()[0]) for f in _names(fields)) for r in rows], fields)


def _names(fields):
    depth, out, now = 0, [], ""
    for ch in fields + ",":
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return out


def records(spark, rows, a="a"):
    return table(spark, schema.RECORDS, [{"activity_id": a, "pos": k, **r, "ts": at(r["ts"])} for k, r in enumerate(rows)])


def events(spark, rows, a="a"):
    return table(spark, schema.TIMER_EVENTS, [{"activity_id": a, "pos": k, "ts": at(t), "event_type": e} for k, (t, e) in enumerate(rows)])


def session(spark, start=0, end=100, a="a", **more):
    return table(spark, schema.SESSIONS, [{"activity_id": a, "start_time": at(start), "end_time": at(end), **more}])


def lap_table(spark, rows, a="a"):
    return table(spark, schema.LAPS, [{"activity_id": a, "pos": k, "lap_index": k + 1, **r, "start_time": at(r.get("start_time")), "end_time": at(r.get("end_time"))} for k, r in enumerate(rows)])


@pytest.mark.parametrize(
    ("evs", "totals", "issue", "spans"),
    [
        ([(100, "stop"), (0, "start"), (20, "stop"), (0, "start"), (40, "start")], (80.0, None), None, [(0, 20), (40, 100)]),
        ([(5, "stop")], (None, None), "invalid_events", []), ([(0, "start"), (5, "start")], (None, None), "invalid_events", []), ([(5, "stop"), (5, "start")], (None, None), "invalid_events", []), ([(101, "start")], (None, None), "invalid_events", []),
        ([(0, "start")], (100.0, None), None, [(0, 100)]), ([(0, "start")], (None, None), "missing_evidence", []), ([(0, "start")], (90.0, None), "inconsistent_totals", []), ([(0, "pause")], (100.0, 100.0), "invalid_events", []),
        ([], (99.0, 100.0), None, [(0, 100)]), ([], (98.0, 100.0), "inconsistent_totals", []), ([], (None, 100.0), "missing_evidence", []), ([], (float("nan"), 100.0), "missing_evidence", []),
    ],
)
def test_strict_timeline(spark, evs, totals, issue, spans):
    r = active_time.strict_timeline(session(spark, total_timer_time_s=totals[0], total_elapsed_time_s=totals[1]), events(spark, evs)).select("issue", F.transform("intervals", lambda i: F.struct(F.unix_seconds(i["s"]).alias("s"), F.unix_seconds(i["e"]).alias("e"))).alias("i")).first()
    base = int(T0.timestamp())
    assert r["issue"] == issue and [(x["s"] - base, x["e"] - base) for x in r["i"]] == spans


def test_offsets(spark):
    t = active_time.strict_timeline(session(spark, 0, 20, total_timer_time_s=14.0), events(spark, [(0, "start"), (4, "stop"), (10, "start"), (20, "stop")]))
    s, e = (F.lit(at(x)) for x in (0, 20))
    ivs = F.col("intervals")
    r = t.select(active_time.active_seconds(ivs, F.lit(at(2)), F.lit(at(12))).alias("a"), active_time.at_active_offset(ivs, s, e, 4).alias("b"), active_time.at_active_offset(ivs, F.lit(at(5)), e, 0).alias("c"), active_time.at_active_offset(ivs, s, e, 5).alias("d"), active_time.at_active_offset(ivs, s, e, 15).alias("e")).first()
    stamp = lambda x: None if x is None else (x.replace(tzinfo=timezone.utc) - T0).total_seconds() if x.tzinfo is None else (x - T0).total_seconds()
    assert (r["a"], r["c"], r["e"]) == (4.0, None, None)
    assert t.select((F.unix_seconds(active_time.at_active_offset(ivs, s, e, 4)) - int(T0.timestamp())).alias("x")).first()["x"] == 4 and t.select((F.unix_seconds(active_time.at_active_offset(ivs, s, e, 5)) - int(T0.timestamp())).alias("x")).first()["x"] == 11
    assert stamp(None) is None


def test_spans_and_dedupe(spark):
    r = records(spark, [{"ts": 0, "heart_rate_bpm": 100}, {"ts": 10}, {"ts": 12, "heart_rate_bpm": 140}, {"ts": 17, "heart_rate_bpm": 150}, {"ts": 19, "heart_rate_bpm": 160}])
    t = active_time.strict_timeline(session(spark, 0, 20, total_timer_time_s=15.0), events(spark, [(0, "start"), (3, "stop"), (8, "start"), (20, "stop")]))
    base = int(T0.timestamp())
    found = sorted((x["s"] - base, x["e"] - base, x["value"]) for x in laps.spans(r, t).select(F.unix_seconds("s").alias("s"), F.unix_seconds("e").alias("e"), "value").collect())
    assert found == [(0, 3, 100), (12, 17, 140), (17, 19, 150)]
    again = laps.chronological(records(spark, [{"ts": 5, "heart_rate_bpm": 130}, {"ts": 0}, {"ts": 5, "heart_rate_bpm": 150}, {"ts": 0}]))
    assert sorted((x["pos"], x["heart_rate_bpm"]) for x in again.collect()) == [(2, 150), (3, None)]


def test_zones(spark):
    r = records(spark, [{"ts": k, "heart_rate_bpm": v} for k, v in enumerate([129, 130, 145, 160, 175, 175, 175])])
    s = session(spark, 0, 6, total_timer_time_s=6.0, total_elapsed_time_s=6.0)
    z = laps.session_zones(s, r, active_time.strict_timeline(s, events(spark, []))).first()
    assert [z[f"z{k}_s"] for k in range(1, 6)] == [1, 1, 1, 1, 2] and (z["coverage_percent"], z["unknown_s"], z["reason"]) == (100, 0, None)


def test_lap_issues(spark):
    found = laps.lap_issues(lap_table(spark, [{"start_time": 0, "end_time": 10}, {"start_time": 8, "end_time": 20}, {"start_time": 20, "end_time": 19}, {}, {"start_time": 30, "end_time": 40}, {"start_time": 40, "end_time": 50}])).orderBy("pos").collect()
    assert [r["boundary_issue"] for r in found] == ["overlapping_laps", "overlapping_laps", "reversed_lap_boundaries", "missing_lap_boundaries", None, None]


def test_splits_and_smoothing(spark):
    r = active_time.with_elapsed(records(spark, [{"ts": 0, "distance_m": 0.0, "heart_rate_bpm": 130}, {"ts": 100, "distance_m": 250.0}, {"ts": 200, "distance_m": 1250.0}, {"ts": 300, "distance_m": 2250.0, "heart_rate_bpm": 150}]), events(spark, []))
    found = splits.record_splits(r, lap_table(spark, [])).orderBy("kilometer").collect()
    assert [(x["kilometer"], x["time_seconds"], x["is_partial"]) for x in found] == [(1, 175, False), (2, 100, False), (3, 25, True)]
    whole = active_time.with_elapsed(records(spark, [{"ts": 0, "distance_m": 0.0}, {"ts": 9, "distance_m": 2000.0}]), events(spark, []))
    assert splits.record_splits(whole, lap_table(spark, [])).count() == 2
    up = records(spark, [{"ts": k, "distance_m": 100.0 * k, "altitude_m": 100.0 + k} for k in range(11)])
    e = elevation.elevation_totals(up).first()
    assert e["window"] == 3 and e["ascent_m"] == pytest.approx(9.0) and e["descent_m"] == 0


def test_aligned_laps(spark):
    km = lambda *rows: lap_table(spark, [{"total_distance_m": float(m), "total_timer_time_s": float(s)} for m, s in rows])
    got = lambda rows, total=None: [(x["kilometer"], x["time_seconds"], x["is_partial"]) for x in splits.lap_splits(rows, session(spark, total_distance_m=total)).orderBy("kilometer").collect()]
    assert got(km((990, 300), (1010, 310))) == [(1, 300, False), (2, 310, False)]
    assert got(km((1000, 300), (772.07, 240)), 1772.07) == [(1, 300, False), (2, 240, True)]
    assert got(km((990, 300), (980, 310)), 1970.0) == [(1, 300, False), (2, 310, True)]
    assert got(km((250, 90), (1000, 300))) == [] and len(got(km((1000, 300), (200, 60), (1000, 300)))) == 1


def test_step_links(spark):
    s = table(spark, schema.STEPS, [{"activity_id": "a", "pos": 0, "message_index": "3", "duration_type": "repeat_until_steps_cmplt"}, {"activity_id": "a", "pos": 1, "message_index": "1", "duration_type": "distance", "duration_distance": 400.0, "target_type": "open", "intensity": "active", "wkt_step_name": " 400 m\n effort "}])
    refs = [None, "999", "x", "true", "-1", "65535", "65536", "4097", "1.0", "[]", "3", "1", "32769"]
    found = [(r["workout_issues"], r["label"]) for r in steps.attach_steps(lap_table(spark, [{"wkt_step_index": r, "intensity": "active"} for r in refs]), s).orderBy("pos").collect()]
    bad = (["invalid_association"], None)
    assert found == [(["missing_association"], None), (["missing_definition"], None), *[bad] * 8, (["control_step"], None), ([], "400 m effort"), ([], "400 m effort")]


def workout(spark):
    """14 laps, 5600 m, 1560 s: 1000 m, six times 400 m and 200 m, the last replaced by 1000 m."""
    plan = [("warmup", 1000, 120)] + [("active", 400, 100), ("recovery", 200, 120)] * 6 + [("cooldown", 1000, 120)]
    rows, natives, t, d = [], [], 0, 0.0
    for kind, m, s in plan:
        natives.append({"start_time": t, "end_time": t + s, "total_distance_m": float(m), "total_timer_time_s": float(s), "avg_heart_rate_bpm": 160 if kind == "active" else 140, "max_heart_rate_bpm": 170, "avg_cadence_spm": 170, "intensity": kind, "wkt_step_index": {"active": "1", "recovery": "2"}.get(kind)})
        for k in range(0, s, 5):
            rows.append({"ts": t + k, "distance_m": d + m * k / s, "speed_mps": m / s, "cadence_spm": 170, "altitude_m": 100.0, "heart_rate_bpm": 170 if kind == "active" else max(130, 170 - k // 2)})
        t, d = t + s, d + m
    rows.append({"ts": t, "distance_m": d, "speed_mps": 1000 / 120, "cadence_spm": 170, "altitude_m": 100.0, "heart_rate_bpm": 130})
    defs = table(spark, schema.STEPS, [{"activity_id": "a", "pos": 0, "message_index": "1", "duration_type": "distance", "duration_distance": 400.0, "target_type": "open", "intensity": "active", "wkt_step_name": "400 m effort"}, {"activity_id": "a", "pos": 1, "message_index": "2", "duration_type": "time", "duration_time": 120.0, "target_type": "open", "intensity": "recovery", "wkt_step_name": "Recovery"}])
    s = session(spark, 0, t, sport="running", total_distance_m=d, total_timer_time_s=float(t), total_elapsed_time_s=float(t), avg_heart_rate_bpm=150, max_heart_rate_bpm=170, avg_speed_mps=d / t)
    return schema.Activities(s, records(spark, rows), steps.attach_steps(lap_table(spark, natives), defs), events(spark, [(0, "start"), (t, "stop_all")]), defs)


def test_workout(spark):
    a = workout(spark)
    found = report.results(a)
    split = found["splits"].orderBy("kilometer").collect()
    assert [round(x["time_seconds"]) for x in split] == [120, 320, 390, 390, 268, 72] and [x["avg_heart_rate_bpm"] for x in split] == [144, 160, 154, 154, 156, 134]
    group = found["repetitions"].collect()
    assert len(group) == 1 and (group[0]["n"], group[0]["mean"], group[0]["coefficient_variation_percent"]) == (6, 250.0, 0.0)
    change = found["recoveries"].collect()
    assert [x["delta_bpm"] for x in change] == [-30.0] * 6
    z = found["zones"].first()
    assert [z[f"z{k}_s"] for k in range(1, 6)] == [0, 520, 240, 800, 0] and z["covered_s"] == 1560
    text = report.rendered(report.assembled(a, found), True, (130, 145, 160, 175)).first()["markdown"]
    assert text.startswith("# FIT Report: 2020-01-01 Running\n\n## Session Summary\n- **Start Time:** 2020-01-01 12:00:00+00:00\n- **Activity Type:** Running\n- **Total Distance:** 5.60 km\n- **Total Time:** 26:00\n")
    assert "| 2 | 400 m effort | work | 0.40 km | 1:40 | 4:10/km | 160 | 170 | 170 |" in text and "- Laps 1, 14:" not in text
    assert "| Step 1 | 400 m; open target | 6 | 4:10/km | 4:10/km | 4:10/km | 0.0% | 0 |" in text and "Excluded work laps: 0." in text
    assert "| 3 | 2 | 160 bpm | 130 bpm | -30 bpm |" in text or "-30 bpm" in text
    assert "| Z2 | 130–<145 bpm | 8:40 | 33.3% |" in text and "26:00 covered / 26:00 active (100.0%); unknown active time 0:00." in text and "**Per-lap zones**" in text
    assert "| 5.00–5.60 | 0.60 km | 1:12 | 2:00 | +0m | 134 | 145 | 170 |" in text and "  - 4:28: 146 bpm (Pace: 1:59/km, Grade: 0.00%)" in text and "- **Km 5.00–5.60**" in text


def fit_file(spark_rows):
    """A small file: a definition and data per message, as (number, [(field, code, base, value)])."""
    body = b""
    for number, values in spark_rows:
        body += struct.pack("<BBBHB", 0x40, 0, 0, number, len(values)) + b"".join(struct.pack("<BBB", f, struct.calcsize(c), base) for f, c, base, _ in values)
        body += b"\0" + b"".join(struct.pack("<" + c, v) for _, c, _, v in values)
    head = struct.pack("<BBHI4s", 14, 16, 2100, len(body), b".FIT")
    head += struct.pack("<H", fit.crc16(head))
    return head + body + struct.pack("<H", fit.crc16(head + body))


def test_fit_source(spark, tmp_path):
    t = int(T0.timestamp()) - fit.EPOCH
    rows = [(12, [(0, "B", 0, 1)]), (27, [(254, "H", 0x84, 1), (0, "8s", 7, b"effort"), (1, "B", 0, 1), (2, "I", 0x86, 40000), (3, "B", 0, 2), (7, "B", 0, 0)])]
    rows += [(20, [(253, "I", 0x86, t + k), (5, "I", 0x86, 100 * k * 10), (3, "B", 2, 150 + k if k else 0xFF), (4, "B", 2, 85), (6, "H", 0x84, 3500), (2, "H", 0x84, 3000)]) for k in range(3)]
    rows += [(21, [(253, "I", 0x86, t), (0, "B", 0, 0), (1, "B", 0, 0)]), (19, [(253, "I", 0x86, t + 2), (2, "I", 0x86, t), (8, "I", 0x86, 2000), (9, "I", 0x86, 2000), (23, "B", 0, 0), (71, "H", 0x84, 1)]), (18, [(253, "I", 0x86, t + 2), (2, "I", 0x86, t), (7, "I", 0x86, 2000), (8, "I", 0x86, 2000), (5, "B", 0, 1)])]
    (tmp_path / "a.FIT").write_bytes(fit_file(rows))
    (tmp_path / "b.fit").write_bytes(b"not a fit file at all")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "d.fit").write_bytes(fit_file([*rows, rows[-1]]))
    a, failed = fit.read_activities(spark, str(tmp_path))
    assert sorted(r["error"].split(":")[0] for r in failed.collect()) == ["invalid", "unsupported"]
    found = a.records.orderBy("pos").collect()
    assert [(r["distance_m"], r["heart_rate_bpm"], r["cadence_spm"], r["speed_mps"], r["altitude_m"]) for r in found] == [(0.0, None, 170, 3.5, 100.0), (10.0, 151, 170, 3.5, 100.0), (20.0, 152, 170, 3.5, 100.0)]
    lap = a.laps.first()
    assert (lap["role"], lap["label"], lap["workout_step"]["duration"]["value"], lap["total_distance_m"]) == ("work", "effort", 400.0, 20.0)
    assert a.sessions.first()["sport"] == "running" and a.timer_events.first()["event_type"] == "start"
    a.write(str(tmp_path / "tables"))
    assert schema.Activities.read(spark, str(tmp_path / "tables")).records.count() == 3


def test_start_times_and_batches(spark):
    s = table(spark, schema.SESSIONS, [{"activity_id": "a", "start_time": at(5)}, {"activity_id": "b", "end_time": at(60), "total_elapsed_time_s": 50.0}, {"activity_id": "c", "end_time": at(60), "total_elapsed_time_s": float("nan")}, {"activity_id": "d"}])
    found = {r["activity_id"]: r["x"] for r in summary.start_times(s, records(spark, [])).select("activity_id", (F.unix_seconds("start_time") - int(T0.timestamp())).alias("x")).collect()}
    assert found == {"a": 5, "b": 10, "c": 60, "d": None}
    plans = spark.createDataFrame([("1.fit", "x", "old1", None), ("2.fit", "x", "old2", None), ("3.fit", "y", "old3", None), ("4.fit", "z", "z0", None), ("5.fit", "w", "w0", "invalid"), ("6.fit", "v", "v0", None)], "source string, output_path string, legacy_path string, decode_error string")
    had = spark.createDataFrame([("y",), ("z0",)], "output_path string")
    assert {r["source"]: r["status"] for r in batch.plan_statuses(plans, had).collect()} == {"1.fit": "collision", "2.fit": "collision", "3.fit": "skipped", "4.fit": "skipped", "5.fit": "failed", "6.fit": "pending"}


def test_route_marks_add_up(spark):
    """Marks are the sums that adding the spacing again and again gives, to the last bit."""
    rows = [(a, k, d, 46.0 + k / 100, 8.0 - k / 50) for a, d0 in (("a", 0.3), ("b", 1e6 / 3)) for k, d in enumerate((d0, d0 + 100.1, d0 + 100.1, d0 + 777.7))]
    records = spark.createDataFrame([*rows, ("c", 0, 5.0, 1.0, 1.0), ("c", 1, 5.0, 1.0, 1.0), ("d", 0, 0.0, 1.0, 1.0), ("d", 1, 0.7, 2.0, 3.0)], "activity_id string, pos long, distance_m double, latitude_deg double, longitude_deg double")
    found = {}
    for r in elevation.route_samples(records, 0.1).orderBy("activity_id", "idx").collect():
        found.setdefault(r["activity_id"], []).append(r["distance_m"])
    for name, first, last in (("a", 0.3, 0.3 + 777.7), ("b", 1e6 / 3, 1e6 / 3 + 777.7), ("d", 0.0, 0.7)):
        marks, at = [], first
        while at < last:
            marks.append(at)
            at += 0.1
        assert found[name] == [*marks, last]
    assert "c" not in found and found["d"] != [0.1 * k for k in range(7)] + [0.7]


def test_clocks_by_activity(spark):
    """An activity with elapsed seconds goes by them, one without by the wall clock, in one plan."""
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("e", 0, at(0), 0.0, 100), ("e", 1, at(50), None, 999), ("e", 2, at(400), 100.0, 120), ("w", 0, at(7), None, 100), ("w", 1, at(57), None, 150), ("w", 2, at(107), None, 120)]
    records = active_time.clocked(spark.createDataFrame(rows, "activity_id string, pos long, ts timestamp, elapsed_s double, heart_rate_bpm int"))
    targets = spark.createDataFrame([(a, x) for a in "ew" for x in (0.0, 25.0, 50.0, 100.0, 101.0)], "activity_id string, at double")
    found = interpolate(records, targets, "activity_id", "elapsed_s", "pos", "at", [], ["heart_rate_bpm"])
    assert {(r["activity_id"], r["at"]): r["heart_rate_bpm"] for r in found.collect()} == {("e", 0.0): 100, ("e", 25.0): 105, ("e", 50.0): 110, ("e", 100.0): 120, ("e", 101.0): None, ("w", 0.0): 100, ("w", 25.0): 125, ("w", 50.0): 150, ("w", 100.0): 120, ("w", 101.0): None}
    origins = {r["activity_id"]: r["wall_origin"] for r in records.select("activity_id", "wall_origin").distinct().collect()}
    assert origins["e"] is None and origins["w"] is not None
