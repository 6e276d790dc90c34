"""Provider payloads, option files, and the command line end to end."""

import json
import time

import pytest
from pyspark.sql import functions as F

from paceline import __main__ as command
from paceline.sources import options, providers, requests
from test_activities import T0, fit_file
from paceline.sources.fit import EPOCH, decode


def test_elevations(spark):
    samples = spark.range(250).select(F.lit("a").alias("activity_id"), F.col("id").alias("idx"), (F.col("id") / 1000).alias("latitude_deg"), F.lit(8.1234567).alias("longitude_deg"))
    batches = providers.elevation_batches(samples).orderBy("batch").collect()
    assert [b["expected"] for b in batches] == [100, 100, 50] and batches[0]["locations"].startswith("0.000000,8.123457|0.001000,")
    assert providers.over_quota(providers.elevation_batches(samples), 2).count() == 1
    ok = json.dumps({"status": "OK", "results": [{"elevation": 5}, {"elevation": "x"}, {"elevation": None}]})
    answers = spark.createDataFrame([("a", 0, 4, 200, ok), ("a", 1, 2, 429, ""), ("b", 0, 1, 200, "no json"), ("c", 0, 1, 200, json.dumps({"status": "OK", "results": [{"elevation": None}]}))], "activity_id string, batch int, expected int, status_code int, payload string")
    rows, told = providers.elevations(answers, 4)
    assert sorted(((r["activity_id"], r["idx"], r["elevation_m"]) for r in rows.collect()), key=str) == sorted([("a", 0, 5.0), ("a", 1, None), ("a", 2, None), ("a", 3, None), ("a", 4, None), ("a", 5, None), ("b", 0, None), ("c", 0, None)], key=str)
    assert {(r["activity_id"], r["kind"]) for r in told.collect()} == {("a", "invalid_response"), ("a", "quota_exceeded"), ("a", "partial_coverage"), ("b", "invalid_response"), ("c", "no_coverage")}


def test_hourly_weather(spark):
    good = {"hourly": {"time": ["2020-01-01T11:00", "2020-01-01T12:00"], "temperature_2m": [15.2, "warm"], "weather_code": [0]}}
    rows, told = providers.hourly_weather(spark.createDataFrame([("a", json.dumps(good)), ("b", "[]")], "activity_id string, payload string"))
    assert sorted((r["temperature_c"] or 0, r["weather_code"] is None) for r in rows.collect()) == [(0, True), (15.2, False)]
    assert {(r["activity_id"], r["kind"]) for r in told.collect()} == {("a", "malformed_values"), ("b", "invalid_response")}


def test_options(tmp_path):
    f = tmp_path / "o.conf"
    f.write_text("# comment\n\n--dynamics_step = 60\nzones=100,120,140,160\n")
    assert options.read_options(str(f), {"dynamics-step", "zones"}) == {"dynamics-step": "60", "zones": "100,120,140,160"}
    for bad in ("x = 1", "zones =", "zones = 1\nzones = 2"):
        f.write_text(bad)
        with pytest.raises(options.OptionFileError):
            options.read_options(str(f), {"zones"})


def run_file(distance=25_000, extra=()):
    t = int(T0.timestamp()) - EPOCH
    # 0.01 degrees of latitude in all
    rows = [(20, [(253, "I", 0x86, t + 60 * k), (5, "I", 0x86, distance * k), (3, "B", 2, 150), (0, "i", 0x85, 557_000_000 + 23_860 * k), (1, "i", 0x85, 100_000_000)]) for k in range(6)]
    return fit_file([*rows, *extra, (18, [(253, "I", 0x86, t + 300), (2, "I", 0x86, t), (8, "I", 0x86, 300_000), (5, "B", 0, 1), (3, "i", 0x85, 557_000_000), (4, "i", 0x85, 100_000_000)])])


def test_command_folder(spark, tmp_path, capsys):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    out.mkdir()
    for name in ("run.fit", "old.fit", "two.fit", "two.FIT"):
        (source / name).write_bytes(run_file())
    (source / "bad.fit").write_bytes(b"bad")
    (out / "old.md").write_text("kept")
    assert command.run([str(source), "-o", str(out), "--dynamics-step-size", "60"], spark) == 1
    said = capsys.readouterr()
    assert "| 1 | 1.00 km | 4:00 | 4:00 | - | 150 | 150 | - |" in (out / "run.md").read_text() and (out / "old.md").read_text() == "kept"
    assert sorted(p.name for p in out.glob("*.md")) == ["old.md", "run.md"] and not list(out.glob(".*.part"))
    assert "bad.fit" in said.err and "one report for several sources" in said.err and "two.FIT, " in said.err and not said.out
    assert command.run([str(source), "-o", str(tmp_path / "none")], spark) == 2 and command.run([str(tmp_path / "none.fit")], spark) == 2
    assert command.run([str(source / "run.fit"), "-o", str(source / "run.fit")], spark) == 2


def test_command_providers(spark, tmp_path, capsys):
    (tmp_path / "run.fit").write_bytes(run_file())
    (tmp_path / "o.conf").write_text("output-by-activity-time = yes\nelevation-source = dem\ndem-sample-distance = 250\nweather-mode = auto\nopentopodata-base-url = http://terrain.test\n")
    hours = [f"2020-01-01T{h:02d}:00" for h in range(24)]
    hourly = {"time": hours, "temperature_2m": [15.0] * 24, "apparent_temperature": [14.0] * 24, "weather_code": [3] * 24, "wind_speed_10m": [7.0] * 24, "wind_direction_10m": [90.0] * 24}

    def send(url, body):
        if url.startswith("http://terrain.test/v1/eudem25m"):
            asked = json.loads(body)
            assert asked["interpolation"] == "bilinear" and asked["nodata_value"] == "null"
            return 200, json.dumps({"status": "OK", "results": [{"elevation": 100.0 + 10 * k} for k in range(len(asked["locations"].split("|")))]}), None
        assert "latitude=46.6" in url and "start_date=2020-01-01&end_date=2020-01-01" in url and "hourly=temperature_2m%2Capparent" in url
        return 200, json.dumps({"hourly": hourly}), None

    assert command.run([str(tmp_path / "run.fit"), "--config", str(tmp_path / "o.conf")], spark, send) == 0
    said = capsys.readouterr()
    text = (tmp_path / "2020-01-01 12-00.md").read_text()
    assert said.out == text and "elevation requests in this run: 1\n" in said.err
    assert "15.0C, feels like 14.0C, Overcast, Wind 7.0 km/h E [historical]" in text
    assert "| 1 | 1.00 km | 4:00 | 4:00 | +40m |" in text
    assert command.run([str(tmp_path / "run.fit"), "-o", str(tmp_path / "x.md"), "--weather-mode", "auto"], spark, lambda url, body: (429, None, "HTTP 429")) == 0
    assert "weather: quota_exceeded" in capsys.readouterr().err and "weather data unavailable" in (tmp_path / "x.md").read_text()
    (tmp_path / "o.conf").write_text("output-by-activity-time = maybe\n")
    with pytest.raises(SystemExit):
        command.run([str(tmp_path / "run.fit"), "--config", str(tmp_path / "o.conf")], spark)


def test_public_elevation_quota(spark):
    samples = spark.createDataFrame([(a, k) for a, n in (("a", 500), ("b", 100_001), ("c", 99_400), ("d", 100), ("e", 1)) for k in range(0, n, 100)], "activity_id string, idx long").selectExpr("*", "1.0 AS latitude_deg", "2.0 AS longitude_deg")
    calls, without = requests.elevation_requests(samples)
    assert {r["activity_id"] for r in without.collect()} == {"b", "e"} and calls.count() == 1000
    assert requests.elevation_requests(samples, "http://terrain.test")[0].count() == 5 + 1001 + 994 + 1 + 1


def test_fetch_keeps_the_interval(spark):
    calls = spark.createDataFrame([("a", "u1", None), ("b", "u2", "x"), ("c", "u3", None)], "activity_id string, url string, body string")
    began = time.monotonic()
    found = requests.fetch(calls, lambda url, body: (200, f"{url}{body}", None), 1, 0.2).collect()
    assert time.monotonic() - began >= 0.4 and {r["payload"] for r in found} == {"u1None", "u2x", "u3None"}


def test_sanitize_command(spark, tmp_path, capsys):
    (tmp_path / "a.fit").write_bytes(run_file())
    out = tmp_path / "copy.fit"
    assert command.run(["sanitize", str(tmp_path / "a.fit"), "-o", str(out), "--start-at", "2021-05-05T00:00:00+02:00"], spark) == 0
    first = next(n for m, n, _ in decode(out.read_bytes()) if m == "record")
    assert first["timestamp"] + EPOCH == 1_620_165_600 and "1 copies" in capsys.readouterr().out
    assert command.run(["sanitize", str(tmp_path / "none.fit"), "-o", str(out)], spark) == 2
    with pytest.raises(SystemExit):
        command.run(["sanitize", str(tmp_path / "a.fit"), "-o", str(out), "--start-at", "2021-05-05T00:00:00"], spark)


def test_repeated_fields_are_unknown():
    data = fit_file([(20, [(253, "I", 0x86, 1000), (3, "B", 2, 150), (3, "B", 2, 151), (4, "B", 2, 80)])])
    assert [(n, t) for _, n, t in decode(data)] == [({"timestamp": 1000.0, "cadence": 80.0}, {})]
