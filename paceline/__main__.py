"""python -m paceline SOURCE [-o OUTPUT]: Markdown reports of FIT files. python -m paceline sanitize: shareable copies."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.operators.elevation import LEAST_CHANGE_M, SMOOTHING_M, enrich, route_samples
from paceline.operators.laps import ZONES
from paceline.operators.splits import STEP_S
from paceline.operators.summary import start_times, summaries
from paceline.operators.active_time import with_elapsed
from paceline.operators.weather import weather
from paceline.plans.batch import by_activity_time, by_source, outputs_in, plan_statuses, write_files
from paceline.plans.report import assembled, rendered, results, weather_wanted
from paceline.schema import Activities
from paceline.scratch import materialize, new_path
from paceline.sources import requests
from paceline.sources.fit import EPOCH, fit_files, messages, reportable, tables
from paceline.sources.ledger import Ledger
from paceline.sources.options import OptionFileError, read_options
from paceline.sources.providers import elevations, hourly_weather
from paceline.session import ship
from paceline.sources.errors import counted
from paceline.sources.sanitize import SameFile, copy_names, sanitized

#: Names of options in a file, and the words of its switches.
OPTIONS = {
    "output", "output-by-activity-time", "dynamics-step-size", "weather-mode", "elevation-smoothing-distance", "elevation-min-change", "elevation-source", "dem-sample-distance",
    "opentopodata-dataset", "opentopodata-base-url", "workout-report", "hr-zone-boundaries",
}
SWITCHES = {"output-by-activity-time": {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}}


def whole(text: str) -> int:
    value = int(text)
    if value <= 0:
        raise argparse.ArgumentTypeError("a whole number above 0")
    return value


def positive(text: str) -> float:
    value = float(text)
    if not 0 < value < float("inf"):
        raise argparse.ArgumentTypeError("a finite number above 0")
    return value


def not_negative(text: str) -> float:
    value = float(text)
    if not 0 <= value < float("inf"):
        raise argparse.ArgumentTypeError("a finite number of 0 or more")
    return value


def zones(text: str) -> tuple[int, ...]:
    parts = [p.strip() for p in text.split(",")]
    values = tuple(int(p) for p in parts if p.isascii() and p.isdigit())
    if len(parts) != 4 or len(values) != 4 or values[0] <= 0 or any(a >= b for a, b in zip(values, values[1:], strict=False)):
        raise argparse.ArgumentTypeError("four increasing whole numbers, as 130,145,160,175")
    return values


def moment(text: str) -> datetime:
    try:
        value = datetime.fromisoformat(text)
    except ValueError:
        raise argparse.ArgumentTypeError("an ISO date and time") from None
    if value.tzinfo is None:
        raise argparse.ArgumentTypeError("a date and time with its offset from UTC")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paceline", description=__doc__)
    p.add_argument("source", help="a FIT file or a folder of them")
    p.add_argument("--config", help="a file of options, as name = value")
    p.add_argument("-o", "--output", help="the report of a file, or the folder for those of a folder; beside the source if not given")
    p.add_argument("--output-by-activity-time", action=argparse.BooleanOptionalAction, default=False, help="name reports by the activity's start")
    p.add_argument("--dynamics-step-size", "--transition-sample-interval", type=whole, default=int(STEP_S), help="seconds between samples")
    p.add_argument("--weather-mode", choices=("auto", "fit"), default="fit", help="auto: ask for the weather of activities without a temperature")
    p.add_argument("--elevation-smoothing-distance", type=positive, default=SMOOTHING_M)
    p.add_argument("--elevation-min-change", type=not_negative, default=LEAST_CHANGE_M)
    p.add_argument("--elevation-source", choices=("fit", "dem", "hybrid"), default="fit", help="recorded altitudes, terrain, or terrain where recorded ones look noisy")
    p.add_argument("--dem-sample-distance", type=positive, default=25.0)
    p.add_argument("--opentopodata-dataset", default="eudem25m")
    p.add_argument("--opentopodata-base-url", default=requests.ELEVATION_HOST)
    p.add_argument("--workout-report", choices=("off", "laps"), default="off", help="laps: add native laps, repetitions and recoveries")
    p.add_argument("--hr-zone-boundaries", type=zones, help="four heart-rate thresholds; adds the zones")
    p.add_argument("--stdout", action="store_true", help="print the reports of a folder as well, as those of a file are")
    p.add_argument("--provider-ledger", help="folder to keep providers' answers in, so that a later run doesn't ask again")
    p.add_argument("--tables", help="folder to keep the activity tables in, as Parquet")
    return p


def arguments(argv: list[str]) -> argparse.Namespace:
    """Options of the command line, before them those of the option file."""
    p = parser()
    args = p.parse_args(argv)
    if not args.config:
        return args
    extra = []
    try:
        for name, value in read_options(args.config, OPTIONS).items():
            if name not in SWITCHES:
                extra += [f"--{name}", value]
            elif value.casefold() in SWITCHES[name]:
                extra.append(f"--{name}" if SWITCHES[name][value.casefold()] else f"--no-{name}")
            else:
                raise OptionFileError(f"{args.config}: {name} is yes or no, not {value!r}")
    except (OSError, OptionFileError) as e:
        p.error(str(e))
    return p.parse_args(extra + argv)


def told(kinds: DataFrame, provider: str) -> None:
    """Warnings on stderr: a line per kind and its number of activities."""
    for r in kinds.groupBy("kind").agg(F.countDistinct("activity_id").alias("n"), F.min("activity_id").alias("first")).orderBy("kind").collect():  # a few kinds
        print(f"warning: {provider}: {r['kind']}: {r['n']} activities, as {r['first']}", file=sys.stderr)


def terrain_records(a: Activities, args: argparse.Namespace, send: requests.Transport, ledger: Ledger) -> DataFrame | None:
    """Records with the terrain's altitudes, and what the provider said on stderr."""
    if args.elevation_source == "fit":
        return None
    public = requests.is_public(args.opentopodata_base_url)
    samples = materialize(route_samples(reportable(a.records), args.dem_sample_distance), "route-samples")
    calls, without = requests.elevation_requests(samples, args.opentopodata_base_url, args.opentopodata_dataset, ledger=ledger)
    before, lanes = ledger.here.count(), a.records.sparkSession.sparkContext.defaultParallelism
    answers = materialize(requests.fetch(calls, send, lanes, requests.INTERVAL_S if public else 0.0, ledger, "elevation"), "elevation-answers")
    rows, kinds = elevations(answers)
    told(kinds.select("activity_id", "kind").unionByName(without), "elevation")
    limit = f" of {requests.MOST_CALLS}" if public else ""
    print(f"elevation requests in this run: {ledger.here.count() - before}{limit}", file=sys.stderr)
    return materialize(enrich(reportable(a.records), rows, args.elevation_source, args.dem_sample_distance), "terrain-records")


def asked_weather(a: Activities, summary: DataFrame, send: requests.Transport, ledger: Ledger) -> DataFrame:
    wanted = materialize(weather_wanted(a, summary), "weather-wanted")
    lanes = a.records.sparkSession.sparkContext.defaultParallelism
    answers = materialize(requests.fetch(requests.weather_requests(wanted), send, lanes, ledger=ledger, what="weather"), "weather-answers")
    failed = F.when(F.col("status_code") == 429, "quota_exceeded").when(F.col("status_code").isNull() | (F.col("status_code") != 200), "unavailable")
    hourly, kinds = hourly_weather(answers.where("status_code = 200").select("activity_id", "payload"))
    told(kinds.unionByName(answers.select("activity_id", failed.alias("kind")).where("kind is not null")), "weather")
    return weather(wanted.select("activity_id", "start_time", "end_time"), hourly)


def failures(rows: DataFrame) -> None:
    """A line on stderr per kind of read error (rows: problem), as there are a handful of kinds."""
    for r in counted(rows).orderBy("kind").collect():
        print(f"{r['error_class']}: {r['kind']}: {r['n']} files", file=sys.stderr)


def session() -> SparkSession:
    return SparkSession.builder.appName("paceline").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.maxRecordsPerBatch", "64").getOrCreate()


def run(argv: list[str], spark: SparkSession | None = None, send: requests.Transport = requests.http) -> int:
    """0: all written or there already; 1: some files failed; 2: wrong arguments."""
    if argv[:1] == ["sanitize"]:
        return run_sanitize(argv[1:], spark)
    args = arguments(argv)
    remote = "://" in args.source
    folder = not args.source.lower().endswith(".fit") if remote else os.path.isdir(args.source)
    if not remote and not os.path.exists(args.source):
        print(f"no such file or folder: {args.source}", file=sys.stderr)
        return 2
    if folder and args.output and "://" not in args.output and not os.path.isdir(args.output):
        print(f"not a folder: {args.output}", file=sys.stderr)
        return 2
    if not folder and args.output and os.path.realpath(args.output) == os.path.realpath(args.source):
        print(f"the report would overwrite its source: {args.output}", file=sys.stderr)
        return 2
    spark = ship(spark or session())
    source = args.source if remote else os.path.realpath(args.source)
    target = (args.output if args.output is None or "://" in args.output else os.path.realpath(args.output)) if folder else None
    target = (target or (source if folder else os.path.dirname(source))).rstrip("/")
    existing = outputs_in(spark, target) if folder else spark.createDataFrame([], "output_path string")
    files = fit_files(spark, source).select(F.col("path").alias("source"), F.lit(None).cast("string").alias("decode_error"))
    only = None
    if folder and not args.output_by_activity_time:  # what need not be written need not be decoded
        only = plan_statuses(by_source(files, target), existing).where("status = 'pending'").select(F.col("source").alias("path"))
    decoded = materialize(messages(spark, source, only), "messages")
    found, failed = tables(decoded)
    kept = args.tables or new_path(spark, "tables")
    found.write(kept)
    a = Activities.read(spark, kept)

    errors = failed.select(F.col("activity_id").alias("source"), F.col("error").alias("known_error"))
    sources = files.drop("decode_error").join(errors, "source", "left").withColumnRenamed("known_error", "decode_error")
    if args.output_by_activity_time and not (args.output and not folder):
        starts = start_times(a.sessions, reportable(a.records)).withColumnRenamed("activity_id", "source")
        plans = by_activity_time(sources.join(starts, "source", "left"), target)
    else:
        plans = by_source(sources, target)
        if args.output and not folder:
            plans = plans.withColumn("output_path", F.lit(args.output if "://" in args.output else os.path.realpath(args.output)))
    statuses = materialize(plan_statuses(plans, existing), "statuses")
    pending = statuses.where("status = 'pending'")

    ids = pending.select(F.col("source").alias("activity_id"))
    a = Activities(*(t.join(ids, "activity_id", "left_semi") for t in (a.sessions, a.records, a.laps, a.timer_events, a.steps)))
    ledger = Ledger(spark, args.provider_ledger)
    enriched = terrain_records(a, args, send, ledger)
    named = results(a, float(args.dynamics_step_size), args.hr_zone_boundaries or ZONES, enriched=enriched, smoothing_m=args.elevation_smoothing_distance, least_change_m=args.elevation_min_change)
    sky = asked_weather(a, summaries(a.sessions, reportable(with_elapsed(a.records, a.timer_events)), a.laps), send, ledger) if args.weather_mode == "auto" else None
    texts = rendered(assembled(a, named, sky), args.workout_report == "laps", args.hr_zone_boundaries)
    texts = materialize(texts.withColumnRenamed("activity_id", "source").join(pending.select("source", "output_path"), "source").withColumnRenamed("markdown", "content"), "reports")
    written = materialize(write_files(texts), "written")

    failures(failed)
    bad = statuses.where("status = 'failed'").select("source", F.col("decode_error").alias("error"))
    bad = bad.unionByName(written.where("error is not null").select(F.col("output_path").alias("source"), F.concat(F.lit("not written: "), "error").alias("error")))
    clashes = statuses.where("status = 'collision'").groupBy("output_path").agg(F.array_join(F.array_sort(F.collect_list("source")), ", ").alias("all"))
    bad = bad.unionByName(clashes.select(F.col("output_path").alias("source"), F.concat(F.lit("one report for several sources: "), "all").alias("error")))
    code = 0
    for r in bad.orderBy("source").toLocalIterator():
        print(f"{r['source']}: {r['error']}", file=sys.stderr)
        code = 1
    if not folder or args.stdout:
        for r in texts.orderBy("source").toLocalIterator():
            sys.stdout.write(r["content"])
    return code


def run_sanitize(argv: list[str], spark: SparkSession | None = None) -> int:
    """0: all copies written; 1: some files failed; 2: wrong arguments."""
    p = argparse.ArgumentParser(prog="paceline sanitize", description="Copies of FIT files without personal data, moved in time.")
    p.add_argument("source", help="a FIT file or a folder of them")
    p.add_argument("-o", "--output", required=True, help="the copy of a file, or the folder for those of a folder")
    p.add_argument("--start-at", type=moment, default=datetime(2020, 1, 1, 12, tzinfo=UTC), help="new start, ISO with an offset")
    args = p.parse_args(argv)
    if not os.path.exists(args.source) and "://" not in args.source:
        print(f"no such file or folder: {args.source}", file=sys.stderr)
        return 2
    target = args.output if "://" in args.output else os.path.realpath(args.output)
    try:
        named = copy_names(args.source, target)
    except SameFile as e:
        print(str(e), file=sys.stderr)
        return 2
    spark = ship(spark or session())
    rows = materialize(sanitized(spark, args.source, int(args.start_at.timestamp()) - EPOCH), "sanitized")
    good = rows.where("error is null")
    written = materialize(write_files(good.select(named(F.col("path")).alias("output_path"), "content")), "written")
    bad = rows.where("error is not null").select("path", "error").unionByName(written.where("error is not null").select(F.col("output_path").alias("path"), "error"))
    failures(rows)
    code = 0
    for r in bad.toLocalIterator():
        print(f"{r['path']}: {r['error']}", file=sys.stderr)
        code = 1
    sums = good.agg(F.count("*").alias("n"), F.sum("messages_removed").alias("m"), F.sum("fields_removed").alias("f")).first()
    print(f"{sums['n']} copies written to {args.output}; {sums['m'] or 0} messages and {sums['f'] or 0} field values removed")
    return code


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
