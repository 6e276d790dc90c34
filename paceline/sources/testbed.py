"""Activities made from the events table, so that every operator runs on the driver's data.

This mapping is our own: a user is an activity, running value sums are distances, signups and errors
start and stop the timer, every ten events are a native lap. Some values are left out on purpose.

The tables are written once per application to the shared scratch folder, as a store of decoded
recordings would have them, and every query reads them from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.operators.active_time import strict_timeline, with_elapsed
from paceline.operators.steps import attach_steps
from paceline.schema import Activities
from paceline.scratch import bucketed, shared_dir

#: Seconds that one sample covers at most here; events of one user are hours apart.
CAP_S = 43_200.0
PER_LAP = 10
#: Events of one bucket, and the most buckets that Spark allows by default.
ROWS, MOST_BUCKETS = 1_000_000, 100_000


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    if dict(e.dtypes)["ts"] == "timestamp_ntz":  # taken as UTC, whatever the session's zone
        e = e.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("int")
    return e.select(F.col("user_id").cast("string").alias("activity_id"), "user_id", F.row_number().over(w).cast("long").alias("pos"), "ts", "event_type", F.sum(F.round(F.col("value") * 100).cast("long")).over(w).alias("cm"), k.alias("k"))


def mapped(spark: SparkSession, sf_dir: str) -> Activities:
    """The tables as plans over events."""
    e = _events(spark, sf_dir)
    k = F.col("k")
    none = F.lit(None).cast("double")
    records = e.select(
        "activity_id", "pos", "ts", (F.col("cm") / 100.0).alias("distance_m"), (47 + k / 100.0).alias("latitude_deg"), (8 + F.col("cm") / 1e6).alias("longitude_deg"), F.when(k % 17 != 0, 100 + k).alias("heart_rate_bpm"), F.when(k % 11 != 0, 70 + k % 30).alias("cadence_spm"),
        none.alias("fractional_cadence"), (2.0 + k / 50.0).alias("speed_mps"), F.when(k % 13 != 0, k * 0.5).alias("altitude_m"), F.when(k % 2 == 0, k / 10.0).alias("grade_percent"), F.when(k % 3 == 0, k / 4.0).alias("temperature_c"),
    )
    # a quarter of the users have noisy timer events, a quarter none, the rest proper pauses
    u = F.col("user_id")
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("user_id"))
    noisy = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "stop_all")
    proper = F.when(F.col("pos") % 10 == 1, "start").when((F.col("pos") % 10 == 8) | (last & (F.col("pos") % 10).between(2, 7)), "stop")
    timer = e.select("activity_id", "pos", "ts", F.when(u % 4 == 0, noisy).when(u % 4 >= 2, proper).alias("event_type")).where("event_type is not null")
    g = e.groupBy("activity_id", "user_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.max("cm").alias("cm"))
    wall = (F.unix_micros("t1") - F.unix_micros("t0")) / F.lit(1e6)
    sessions = g.select(
        "activity_id", F.when(u % 2 == 0, "running").otherwise("cycling").alias("sport"), F.when(u % 3 == 0, "trail_run-x").otherwise("generic").alias("sub_sport"), F.when(u % 11 != 1, F.col("t0")).alias("start_time"), F.col("t1").alias("end_time"),
        none.alias("start_latitude_deg"), none.alias("start_longitude_deg"), F.when(u % 3 == 1, F.col("cm") / 100.0).alias("total_distance_m"), F.when((u % 4 < 2) & (u % 5 < 4), wall).alias("total_timer_time_s"), F.when((u % 2 == 0) | (u % 4 == 1), wall).alias("total_elapsed_time_s"),
        F.when(u % 7 == 0, 61.0).alias("total_ascent_m"), F.when(u % 7 == 1, 56.0).alias("total_descent_m"), F.when(u % 5 == 0, 150).alias("avg_heart_rate_bpm"), F.when(u % 5 == 1, 190).alias("max_heart_rate_bpm"), F.lit(None).cast("int").alias("avg_cadence_spm"),
        F.when(u % 6 == 0, 3.0).alias("avg_speed_mps"), none.alias("avg_temperature_c"), none.alias("min_temperature_c"), none.alias("max_temperature_c"),
    )
    lap = e.groupBy("activity_id", "user_id", F.floor((F.col("pos") - 1) / PER_LAP).cast("long").alias("pos")).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.max("k").alias("k"), (F.max("cm") - F.min("cm")).alias("cm"))
    next_t0 = F.coalesce(F.lead("t0").over(Window.partitionBy("activity_id").orderBy("pos")), F.timestamp_micros(F.unix_micros("t1") + 1_000_000))
    p, j = F.col("pos"), F.col("pos") + F.col("user_id")
    end = F.when(j % 23 == 5, F.timestamp_micros(F.unix_micros(next_t0) + 1_000_000)).when(j % 29 == 7, F.col("t0")).when(j % 31 == 3, F.lit(None)).otherwise(next_t0)
    laps = lap.select(
        "activity_id", p, (p + 1).cast("int").alias("lap_index"), F.col("t0").alias("start_time"), end.alias("end_time"), F.when(j % 3 != 0, F.col("cm") / 100.0).alias("total_distance_m"), F.when(j % 2 == 0, F.bround((F.unix_micros("t1") - F.unix_micros("t0")) / F.lit(1e6), 3)).alias("total_timer_time_s"),
        F.when(p % 2 == 0, 3.0).alias("total_ascent_m"), F.when(p % 3 == 0, 2.0).alias("total_descent_m"), F.when(j % 4 == 0, 140).alias("avg_heart_rate_bpm"), F.when(j % 4 == 1, 180).alias("max_heart_rate_bpm"), F.when(j % 4 == 2, 80).alias("avg_cadence_spm"), none.alias("avg_temperature_c"),
        none.alias("min_temperature_c"), none.alias("max_temperature_c"), F.when(p % 2 == 0, "active").when(F.col("k") < 97, "recovery").alias("intensity"), F.when(j % 7 == 6, None).when(j % 11 == 10, "70000").otherwise((p % 4).cast("string")).alias("wkt_step_index"),
    )
    users = g.select("activity_id", "user_id")
    step = users.select("activity_id", "user_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n")).withColumn("id", F.when(F.col("n") == 4, F.when(u % 5 == 0, 2)).otherwise(F.col("n"))).where("id is not null and not (user_id % 9 = 0 and id = 1)")
    n = F.col("n")
    speed = (n == 2) | (n == 4)
    steps = step.select(
        "activity_id", n.cast("long").alias("pos"), F.col("id").cast("string").alias("message_index"), F.concat(F.lit(" step  "), F.col("id")).alias("wkt_step_name"), F.when(n % 2 == 0, "active").otherwise("recovery").alias("intensity"),
        F.when(n == 3, "repeat_until_steps_cmplt").when(n == 1, "time").otherwise("distance").alias("duration_type"), F.lit(120.0).alias("duration_time"), F.when(u % 8 != 0, 400.0).alias("duration_distance"), F.when(speed, "speed").otherwise("open").alias("target_type"), F.lit(0).alias("target_speed_zone"),
        F.lit(None).cast("int").alias("target_cadence_zone"), F.lit(2.5).alias("custom_target_speed_low"), F.lit(3.5).alias("custom_target_speed_high"), none.alias("custom_target_cadence_low"), none.alias("custom_target_cadence_high"), F.lit(None).cast("string").alias("secondary_target_type"),
    )
    return Activities(sessions, records, attach_steps(laps, steps), timer, steps)


#: Stored tables by application, folder, state of the folder's data, and name.
_STORED: dict[tuple[str, str, tuple, str], DataFrame | Activities] = {}


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, sizes and times of the files behind the testbed, and the shared folder; a change of any of them makes the tables anew."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = system.listStatus(where)
    return (shared_dir(spark), *sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def _there(spark: SparkSession, table: DataFrame | Activities) -> bool:
    """Whether a stored table's folder still exists."""
    path = (table.records if isinstance(table, Activities) else table).__dict__.get("_scratch_path")
    if path is None:
        return False
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame | Activities:
    """What make gives, written once as long as the data behind it stay as they are."""
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, sf_dir), name)
    if key not in _STORED or not _there(spark, _STORED[key]):
        _STORED[key] = make()
    return _STORED[key]


def lying(spark: SparkSession, sf_dir: str, df: DataFrame, name: str) -> DataFrame:
    """df written in buckets by activity, as many for all tables of a folder: one per ROWS events, but one for each core at least."""
    rows = stored_count(spark, sf_dir)
    return bucketed(df, name, "activity_id", buckets=min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))))


_COUNTS: dict[tuple, int] = {}


def stored_count(spark: SparkSession, sf_dir: str) -> int:
    """Number of events, from the files' footers, once per state of the folder."""
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, sf_dir))
    if key not in _COUNTS:
        _COUNTS[key] = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    return _COUNTS[key]


def activities(spark: SparkSession, sf_dir: str) -> Activities:
    """The stored tables, each in buckets by activity."""

    def make() -> Activities:
        a = mapped(spark, sf_dir)
        return Activities(*(lying(spark, sf_dir, t, name) for t, name in ((a.sessions, "sessions"), (a.records, "records"), (a.laps, "laps"), (a.timer_events, "timer-events"), (a.steps, "steps"))))

    return stored(spark, sf_dir, "activities", make)


def prepared(spark: SparkSession, sf_dir: str) -> tuple[Activities, DataFrame, DataFrame]:
    """The tables, records with elapsed_s, and strict timelines; stored as well."""
    a = activities(spark, sf_dir)
    records = stored(spark, sf_dir, "elapsed", lambda: lying(spark, sf_dir, with_elapsed(a.records, a.timer_events), "elapsed"))
    return a, records, stored(spark, sf_dir, "timelines", lambda: lying(spark, sf_dir, strict_timeline(a.sessions, a.timer_events), "timelines"))
