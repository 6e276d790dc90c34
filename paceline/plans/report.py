"""Reports: all results of each activity as one nested row, and its Markdown text.

The numbers come from the operators; only the last step, text, is Python, per activity and in Arrow
batches, because Spark's format_string rounds halves up where the report's format rounds to even.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.scalars import plus_seconds
from paceline.operators.active_time import strict_timeline, with_elapsed
from paceline.operators.elevation import LEAST_CHANGE_M, SMOOTHING_M
from paceline.operators.laps import CAP_S, ZONES, lap_rows, lap_zones, recoveries, repetitions, session_zones
from paceline.operators.splits import STEP_S, dynamics, splits
from paceline.operators.summary import summaries
from paceline.plans.workout_text import clock, shown, workout_lines, zone_lines
from paceline.schema import Activities
from paceline.sources.fit import reportable

#: The columns of splits; the labels in ``markdown`` are fixed as well.
HEADER = ["| Km | Distance | Time | Pace | Elev +/- | Avg HR | Max HR | Avg Cad |", "|---|---|---|---|---|---|---|---|"]


def results(a: Activities, step_s: float = STEP_S, thresholds: tuple[int, ...] = ZONES, cap_s: float = CAP_S, prefer_records: bool = False, enriched: DataFrame | None = None, smoothing_m: float = SMOOTHING_M, least_change_m: float = LEAST_CHANGE_M) -> dict[str, DataFrame]:
    """The result sets by name: summary, splits, dynamics, laps, repetitions, exclusions, recoveries, zones.

    enriched: records with terrain altitudes (``operators.elevation.enrich``); summary, splits and dynamics are
    made from them, and activities they change prefer their totals to the session's. Laps keep what was recorded.
    """
    samples = with_elapsed(a.records, a.timer_events)
    records = reportable(samples if enriched is None else with_elapsed(enriched, a.timer_events))
    preferred = prefer_records if enriched is None else changed(a.records, enriched)
    timelines = strict_timeline(a.sessions, a.timer_events)
    rows = lap_rows(a.laps, samples, timelines, cap_s)
    groups, left_out = repetitions(rows, a.sessions)
    return {
        "summary": summaries(a.sessions, records, a.laps, preferred, smoothing_m, least_change_m), "splits": splits(records, a.laps, a.sessions), "dynamics": dynamics(records, a.laps, step_s), "laps": rows, "repetitions": groups, "exclusions": left_out,
        "recoveries": recoveries(rows, samples, timelines), "zones": session_zones(a.sessions, samples, timelines, thresholds, cap_s), "lap_zones": lap_zones(a.laps, samples, timelines, thresholds, cap_s),
    }


def changed(records: DataFrame, enriched: DataFrame) -> DataFrame:
    """activity_id of those with any record that enrichment changed."""
    old = records.select("activity_id", "pos", F.struct("altitude_m", "grade_percent").alias("old"))
    both = enriched.select("activity_id", "pos", F.struct("altitude_m", "grade_percent").alias("new")).join(old, ["activity_id", "pos"])
    return both.where(~F.col("new").eqNullSafe(F.col("old"))).select("activity_id").distinct()


def weather_wanted(a: Activities, summary: DataFrame) -> DataFrame:
    """activity_id, start_time, end_time, latitude_deg, longitude_deg of activities without a temperature of their own."""
    s = summary.where("start_time is not null and coalesce(avg_temperature_c, min_temperature_c, max_temperature_c) is null").select("activity_id", "start_time", "elapsed_s")
    place = a.sessions.select("activity_id", "end_time", F.col("start_latitude_deg").alias("latitude_deg"), F.col("start_longitude_deg").alias("longitude_deg"))
    j = s.join(place, "activity_id").where("latitude_deg is not null and longitude_deg is not null")
    return j.select("activity_id", "start_time", F.coalesce("end_time", plus_seconds(F.col("start_time"), F.col("elapsed_s"))).alias("end_time"), "latitude_deg", "longitude_deg")


def assembled(a: Activities, found: dict[str, DataFrame], weather: DataFrame | None = None) -> DataFrame:
    """One row per activity: sport, summary, zones and weather as structs, all other results as arrays in order."""
    listed = lambda name, *order: found[name].groupBy("activity_id").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in found[name].columns if c not in (*order, "activity_id")]))).alias(name))
    s = found["summary"]
    out = a.sessions.select("activity_id", "sport").join(s.select("activity_id", F.struct(*[c for c in s.columns if c != "activity_id"]).alias("summary")), "activity_id")
    out = out.join(listed("splits", "kilometer"), "activity_id", "left").join(listed("dynamics", "kilometer", "elapsed_seconds"), "activity_id", "left")
    for name, *order in (("laps", "lap_pos"), ("repetitions", "first_pos"), ("exclusions", "exclusion_no"), ("recoveries", "lap_pos"), ("lap_zones", "lap_pos")):
        out = out.join(listed(name, *order), "activity_id", "left")
    z = found["zones"]
    out = out.join(z.select("activity_id", F.struct(*[c for c in z.columns if c != "activity_id"]).alias("zones")), "activity_id", "left")
    if weather is None:
        return out.withColumn("weather", F.lit(None).cast("struct<source: string>"))
    return out.join(weather.select("activity_id", F.struct(*[c for c in weather.columns if c != "activity_id"]).alias("weather")), "activity_id", "left")


def speed(kmh: float | None, pace: bool) -> str:
    if pace:
        return f"{clock(3600 / kmh)}/km" if kmh is not None and kmh > 0 else "-"
    return shown(kmh, "{:.2f} km/h")


def signed(value: float | None, sign: str | None = None) -> str:
    return "-" if value is None else f"{sign or ('+' if value >= 0 else '-')}{abs(value):.0f}m"


def weather_text(s: dict, w: dict | None) -> str:
    own = [s[f"{k}_temperature_c"] for k in ("avg", "min", "max")]
    if any(x is not None for x in own):
        return " / ".join(f"{k} {shown(x, '{:.1f}C')}" for k, x in zip(("Avg", "Min", "Max"), own, strict=True)) + " [fit]"
    if not w:
        return "FIT and historical weather data unavailable"
    wind = [shown(w["wind_speed_kmh"], "{:.1f} km/h")] * (w["wind_speed_kmh"] is not None) + [w["wind_direction_label"]] * (w["wind_direction_label"] is not None)
    parts = [shown(w["temperature_c"], "{:.1f}C"), *[f"feels like {x:.1f}C" for x in [w["apparent_temperature_c"]] if x is not None], *filter(None, [w["condition_summary"]]), *[" ".join(["Wind", *wind])] * bool(wind)]
    return f"{', '.join(parts)} [{w['source']}]"


def segment_label(x: dict) -> str:
    return f"Km {x['kilometer']}" if x["from_km"] is None else f"Km {x['from_km']:.2f}–{x['to_km']:.2f}"


def markdown(row: dict, workout: bool = False, thresholds: tuple[int, ...] | None = None) -> str:
    """The report of one assembled row; workout: with laps, repetitions and recoveries; thresholds: with zones."""
    s, pace = row["summary"], (row["sport"] or "").strip().casefold() == "running"
    start, kind = s["start_time"], s["activity_type"]
    lines = [f"# FIT Report: {start:%Y-%m-%d} {kind or 'Activity'}" if start else f"# FIT Report: unknown-date {kind or 'Activity'}", "", "## Session Summary"]
    facts = [
        ("Start Time", start.isoformat(sep=" ", timespec="seconds") if start else "-"), ("Activity Type", kind or "-"), ("Total Distance", shown(s["distance_m"] / 1000 if s["distance_m"] is not None else None, "{:.2f} km")), ("Total Time", clock(s["timer_s"])),
        ("Elapsed Time", clock(s["elapsed_s"])), ("Elevation Gain/Loss", f"{signed(s['ascent_m'], '+')} / {signed(s['descent_m'], '-')}"), ("Avg/Max HR", f"{shown(s['avg_heart_rate_bpm'])} / {shown(s['max_heart_rate_bpm'])} bpm"),
        ("Avg Cadence", f"{shown(s['avg_cadence_spm'])} spm"), ("Avg Pace" if pace else "Avg Speed", speed(s["avg_speed_kmh"], pace)), ("Weather", weather_text(s, row["weather"])),
    ]
    lines += [f"- **{k}:** {v}" for k, v in facts] + ["", "## Kilometric Splits"]
    for x in row["splits"] or ():
        km = x["kilometer"] - 1
        label = f"{km:.2f}–{km + x['distance_m'] / 1000:.2f}" if x["is_partial"] else str(x["kilometer"])
        cells = [label, f"{x['distance_m'] / 1000:.2f} km", clock(x["time_seconds"]), clock(x["pace_seconds_per_km"]), signed(x["elevation_delta_m"]), *[shown(x[c]) for c in ("avg_heart_rate_bpm", "max_heart_rate_bpm", "avg_cadence_spm")]]
        lines += HEADER * (x is row["splits"][0]) + [f"| {' | '.join(cells)} |"]
    lines += ["No split data available."] * (not row["splits"]) + ["", "## Heart Rate Dynamics (Per Kilometer)"]
    last = None
    for x in row["dynamics"] or ():
        if x["kilometer"] != last:
            lines += [f"- **{segment_label(x)}**", *[f"  - {x['sampling_note']}"] * (x["sampling_note"] is not None)]
            last = x["kilometer"]
        grade = [f"Grade: {g:.2f}%" for g in [x["grade_percent"]] if g is not None]
        lines.append(f"  - {clock(x['elapsed_seconds'])}: {shown(x['heart_rate_bpm'])} bpm ({', '.join([('Pace: ' if pace else 'Speed: ') + speed(x['speed_kmh'], pace), *grade])})")
    lines += ["No transition samples available."] * (not row["dynamics"])
    if workout:
        lines += workout_lines(row, pace, thresholds is not None)
    if thresholds is not None:
        lines += zone_lines(row, thresholds, workout)
    return "\n".join(lines).rstrip() + "\n"


def rendered(rows: DataFrame, workout: bool = False, thresholds: tuple[int, ...] | None = None) -> DataFrame:
    """activity_id, markdown."""

    def texts(batches):
        for batch in batches:
            yield pa.record_batch({"activity_id": batch.column("activity_id"), "markdown": pa.array([markdown(r, workout, thresholds) for r in batch.to_pylist()], pa.string())})

    return rows.mapInArrow(texts, "activity_id string, markdown string")


def build_reports(a: Activities, **options) -> DataFrame:
    """activity_id, markdown of every activity."""
    return rendered(assembled(a, results(a, **options)))
