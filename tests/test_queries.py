"""Registered queries against their SQL on the smallest data."""

import re
from collections import Counter

import duckdb
import pytest

from paceline import scratch
from paceline.plans.queries import ORACLES, QUERIES, rounded
from paceline.sources import testbed

LIGHT = ["km_splits", "session_summary", "elevation_gain_loss", "active_intervals_tolerant", "active_timeline_strict", "hr_zones_session", "step_link", "aligned_laps", "weather_lookup", "dynamics_samples", "hybrid_decision", "dem_enriched_records", "output_collisions", "output_statuses", "mixed_clock_samples", "mixed_clock_splits", "route_resample", "dem_isolation", "repetition_stats", "recovery_change", "dedupe_last_wins", "splits_union"]
#: On the smallest data these have no rows.
LARGER = ["aligned_laps", "output_collisions"]


def same(x):
    return round(x, 5) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", LIGHT)
def test_query(spark, sf_dir, name):
    sf_dir = "/root/testdata/sf0.01" if name in LARGER else sf_dir
    found = QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf_dir}/events.parquet'")
    sql = con.sql(ORACLES[name])
    names = sorted(sql.columns)
    assert sorted(found.columns) == names
    rows = lambda cols, data: Counter(tuple(same(r[cols.index(c)]) for c in names) for r in data)
    expected = rows(sql.columns, sql.fetchall())
    assert expected and rows(found.columns, [tuple(r) for r in found.collect()]) == expected


@pytest.fixture(scope="session")
def edgy(spark, tmp_path_factory):
    """Activities with values whose rounding hangs on their last bits."""
    folder = tmp_path_factory.mktemp("edgy")
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    events.where("user_id in (91, 336, 617, 636, 659, 812, 1055, 1109, 1182, 1194, 1400)").coalesce(1).write.mode("overwrite").parquet(str(folder / "events.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["dynamics_samples", "mixed_clock_samples", "mixed_clock_splits", "route_resample", "km_splits"])
def test_query_to_the_last_digit(spark, edgy, name):
    """Exactly the SQL's numbers, summed in one thread so that it adds intervals in their order."""
    found = QUERIES[name](spark, edgy)
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{edgy}/events.parquet/*.parquet'")
    sql = con.sql(ORACLES[name])
    expected = Counter(sql.select(*[duckdb.ColumnExpression(c) for c in found.columns]).fetchall())
    assert expected and Counter(tuple(r) for r in found.collect()) == expected


def test_rounded_as_sql_rounds(spark):
    values = [47.660312499999994, 0.0000005, -2.5e-6, 447016.7695, 0.49999999999999994e-6, -0.0, 1e300]
    found = [tuple(r)[0] for r in rounded(spark.createDataFrame([(v,) for v in values], "x double")).collect()]
    assert found == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_plans_have_no_products_or_python(spark, sf_dir):
    for name in ("km_splits", "hr_zones_lap", "dynamics_samples"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInArrow"))


@pytest.mark.parametrize("name,scans,exchanges", [("km_splits", 5, 1), ("dynamics_samples", 5, 3), ("dem_enriched_records", 8, 3), ("hr_zones_session", 5, 3), ("lap_breakdown", 1, 0), ("repetition_stats", 4, 3)])
def test_stored_tables_lie_by_activity(spark, sf_dir, name, scans, exchanges):
    """Scans and shuffles that a plan may have at most."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", plan)) <= scans and len(re.findall("Exchange hashpartitioning", plan)) <= exchanges and "Exchange SinglePartition" not in plan


def test_stored_tables_follow_their_data(spark, tmp_path):
    """A folder whose data change, or whose stored tables are gone, is read anew."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    put = lambda part: part.write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    put(events.where("user_id < 5"))
    first = testbed.activities(spark, str(tmp_path))
    assert testbed.activities(spark, str(tmp_path)) is first and first.sessions.count() == 5
    put(events.where("user_id < 7"))
    second = testbed.activities(spark, str(tmp_path))
    assert second.sessions.count() == 7
    scratch.discard(second.records)
    with pytest.raises(Exception):  # noqa: B017
        second.records.count()
    assert QUERIES["session_summary"](spark, str(tmp_path)).count() == 7


def test_entry_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "paceline", tmp_path / "paceline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n.startswith('op') and n[2:3].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
