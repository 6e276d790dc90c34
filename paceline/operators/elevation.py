"""Altitude smoothing, elevation totals, grades, and terrain elevations from a lookup table.

Altitudes of one activity are an array where an operator folds them in order or averages over a frame
whose width differs by activity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.interpolate import interpolate

SMOOTHING_M, LEAST_CHANGE_M = 170.0, 0.4
LEAST_WINDOW, MOST_WINDOW = 3, 51
GRADE_M = 200.0
DEM_SPACING_M = 30.0


def smoothing_window(n: Column, n_distances: Column, span_m: Column, smoothing_m: float) -> Column:
    """Odd number of rows that span smoothing_m, within 3 and 51 and at most n; 1 for fewer than 3 rows."""
    largest = n - F.when(n % 2 == 0, 1).otherwise(0)
    spacing = F.when((n_distances >= 2) & (span_m > 0), span_m / (n_distances - 1))
    rows = F.coalesce(F.bround(smoothing_m / spacing, 0), F.lit(float(LEAST_WINDOW)))
    rows = F.greatest(F.lit(float(LEAST_WINDOW)), F.least(rows, F.lit(1e6))).cast("int")
    odd = rows + F.when(rows % 2 == 0, 1).otherwise(0)
    return F.when(largest < LEAST_WINDOW, 1).otherwise(F.least(odd, F.lit(MOST_WINDOW), largest)).cast("int")


def altitude_arrays(records: DataFrame, smoothing_m: float, need_distance: bool = False) -> DataFrame:
    """activity_id, points (pos, distance_m, altitude_m in order), window, smoothed (altitudes); activities with 2 altitudes or more."""
    rows = records.where("altitude_m is not null" + " and distance_m is not null" * need_distance)
    a = rows.groupBy("activity_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "distance_m", "altitude_m"))).alias("points"), F.count("*").alias("n"), F.count("distance_m").alias("nd"), (F.max("distance_m") - F.min("distance_m")).alias("span")
    ).where("n >= 2")
    a = a.withColumns({"window": smoothing_window(F.col("n"), F.col("nd"), F.col("span"), smoothing_m), "alts": F.col("points.altitude_m")}).withColumn("r", F.floor(F.col("window") / 2).cast("int"))
    frame = lambda i: F.slice("alts", F.greatest(F.lit(1), i - F.col("r")), F.least(F.size("alts"), i + F.col("r")) - F.greatest(F.lit(1), i - F.col("r")) + 1)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x, lambda s: s) / F.size(xs)
    smoothed = F.when(F.col("window") <= 1, F.col("alts")).otherwise(F.transform(F.sequence(F.lit(1), F.size("alts")), lambda i: mean(frame(i))))
    return a.select("activity_id", "points", "window", smoothed.alias("smoothed"))


def elevation_totals(records: DataFrame, smoothing_m: float = SMOOTHING_M, least_change_m: float = LEAST_CHANGE_M) -> DataFrame:
    """activity_id, ascent_m, descent_m: smoothed altitude changes against the last accepted altitude, counted from least_change_m on."""
    a = altitude_arrays(records, smoothing_m)
    zero = F.struct(F.element_at("smoothed", 1).alias("last"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def step(s: Column, x: Column) -> Column:
        d = x - s["last"]
        taken = F.abs(d) >= least_change_m
        return F.struct(F.when(taken, x).otherwise(s["last"]).alias("last"), F.when(taken & (d > 0), s["up"] + d).otherwise(s["up"]).alias("up"), F.when(taken & (d < 0), s["down"] - d).otherwise(s["down"]).alias("down"))

    folded = a.select("activity_id", "window", F.aggregate(F.slice("smoothed", 2, F.size("smoothed")), zero, step).alias("s"))
    return folded.select("activity_id", "window", F.col("s.up").alias("ascent_m"), F.col("s.down").alias("descent_m"))


def smoothed_profile(records: DataFrame, smoothing_m: float = SMOOTHING_M) -> DataFrame:
    """activity_id, pos, distance_m, altitude_m (smoothed)."""
    a = altitude_arrays(records, smoothing_m, need_distance=True)
    return a.select("activity_id", F.explode(F.arrays_zip("points", "smoothed")).alias("z")).select("activity_id", "z.points.pos", "z.points.distance_m", F.col("z.smoothed").alias("altitude_m"))


def estimated_grade(samples: DataFrame, records: DataFrame, smoothing_m: float = SMOOTHING_M, grade_m: float = GRADE_M) -> DataFrame:
    """samples (activity_id, sample_id, distance_m, speed_mps, ..) with estimated_grade in percent: over +-half, before, or after; whichever lies in the profile first."""
    offsets = [-grade_m / 2, grade_m / 2, -grade_m, 0.0, grade_m]
    moving = F.coalesce(F.col("distance_m").isNotNull() & (F.col("speed_mps") > 0), F.lit(False))
    # a sample travels with its lookups and is put together from them again, so that all stays by activity; one that stands still has a lookup of nothing
    spots = F.transform(F.array(*map(F.lit, offsets)), lambda o: F.struct(o.alias("o"), (F.col("distance_m") + o).alias("at")))
    nothing = F.array(F.struct(F.lit(None).cast("double").alias("o"), F.lit(None).cast("double").alias("at")))
    targets = samples.select("activity_id", "sample_id", F.struct(*samples.columns).alias("sample"), F.explode(F.when(moving, spots).otherwise(nothing)).alias("x")).select("activity_id", "sample_id", "sample", "x.o", "x.at")
    alts = interpolate(smoothed_profile(records, smoothing_m), targets, "activity_id", "distance_m", "pos", "at", ["altitude_m"])
    at = lambda o: F.max(F.when(F.col("o") == o, F.col("altitude_m")))
    wide = alts.groupBy("activity_id", "sample_id").agg(F.first("sample").alias("sample"), *[at(o).alias(f"a{k}") for k, o in enumerate(offsets)])
    rise = F.coalesce(F.col("a1") - F.col("a0"), F.col("a3") - F.col("a2"), F.col("a4") - F.col("a3"))
    return wide.select(*[F.col("sample")[c].alias(c) for c in samples.columns], (rise / grade_m * 100).alias("estimated_grade"))


def route_samples(records: DataFrame, spacing_m: float = DEM_SPACING_M) -> DataFrame:
    """activity_id, idx, distance_m, latitude_deg, longitude_deg every spacing_m from the first located record and at the last.

    Marks add up: each is the one before plus spacing_m, rounded as doubles are, not its number times spacing_m. A running sum
    adds in the window's order, so marks are linear in their number.
    """
    located = records.where("distance_m is not null and latitude_deg is not null and longitude_deg is not null")
    ends = located.groupBy("activity_id").agg(F.min_by("distance_m", "pos").alias("d0"), F.max_by("distance_m", "pos").alias("d1")).where("d1 > d0")
    most = (F.ceil((F.col("d1") - F.col("d0")) / spacing_m) + 1).cast("int")  # one more than can lie before d1, as sums may fall short
    added = F.sum(F.when(F.col("k") == 0, F.col("d0")).otherwise(F.lit(float(spacing_m)))).over(Window.partitionBy("activity_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    marks = ends.select("activity_id", "d0", "d1", F.explode(F.sequence(F.lit(0), most)).alias("k")).withColumn("at", added)
    before = marks.where("at < d1").select("activity_id", F.col("k").alias("idx"), "at")
    last = ends.select("activity_id", F.lit(2147483647).alias("idx"), F.col("d1").alias("at"))
    found = interpolate(located, before.unionByName(last), "activity_id", "distance_m", "pos", "at", ["latitude_deg", "longitude_deg"]).where("found")
    w = Window.partitionBy("activity_id").orderBy("idx")
    return found.select("activity_id", (F.row_number().over(w) - 1).alias("idx"), F.col("at").alias("distance_m"), "latitude_deg", "longitude_deg")


def terrain(samples: DataFrame, lookup: DataFrame) -> DataFrame:
    """samples with altitude_m of the lookup (activity_id, idx, elevation_m); a value without a known neighbour is dropped."""
    w = Window.partitionBy("activity_id").orderBy("idx")
    j = samples.join(lookup.select("activity_id", "idx", "elevation_m"), ["activity_id", "idx"], "left")
    known = F.lag("elevation_m").over(w).isNotNull() | F.lead("elevation_m").over(w).isNotNull()
    return j.withColumn("altitude_m", F.when(known, F.col("elevation_m"))).drop("elevation_m")


def replaces_recorded(records: DataFrame, dem: DataFrame) -> DataFrame:
    """activity_id, replace: whether the recorded altitude is so much rougher than the terrain that hybrid mode takes the latter."""
    profile = records.where("distance_m is not null and altitude_m is not null")
    enough = profile.groupBy("activity_id").count().where("count >= 5").select("activity_id")
    targets = dem.select("activity_id", "idx", F.col("distance_m").alias("at"), F.col("altitude_m").alias("dem_m"))
    both = interpolate(profile, targets, "activity_id", "distance_m", "pos", "at", ["altitude_m"])
    w = Window.partitionBy("activity_id").orderBy("idx")
    gap = F.col("dem_m").isNull() | F.col("altitude_m").isNull()
    seg = both.withColumn("seg", F.sum(gap.cast("int")).over(w)).where(~gap)
    ws = Window.partitionBy("activity_id", "seg").orderBy("idx")
    seg = seg.withColumns({"df": F.col("altitude_m") - F.lag("altitude_m").over(ws), "dd": F.col("dem_m") - F.lag("dem_m").over(ws), "len": F.count("*").over(Window.partitionBy("activity_id", "seg"))})
    moves = seg.where("abs(df) >= 0.5 and len >= 3").withColumn("up", F.col("df") > 0).withColumn("flip", F.col("up") != F.lag("up").over(ws)).groupBy("activity_id").agg(F.coalesce(F.sum(F.col("flip").cast("int")), F.lit(0)).alias("flips"), F.count("flip").alias("changes"))
    sums = seg.groupBy("activity_id").agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.abs("df")), F.lit(0.0)).alias("tv_fit"), F.coalesce(F.sum(F.abs("dd")), F.lit(0.0)).alias("tv_dem"), F.avg(F.abs(F.col("altitude_m") - F.col("dem_m"))).alias("diff"))
    j = sums.join(enough, "activity_id").join(moves, "activity_id", "left").withColumn("ratio", F.coalesce(F.try_divide("flips", "changes"), F.lit(0.0)))
    rough = (F.col("tv_fit") >= F.greatest(F.col("tv_dem") * 2, F.col("tv_dem") + 20)) & (F.col("diff") >= 8) & (F.col("ratio") >= 0.3)
    return j.select("activity_id", ((F.col("pairs") >= 5) & rough).alias("replace"))


def enrich(records: DataFrame, lookup: DataFrame, mode: str = "dem", spacing_m: float = DEM_SPACING_M) -> DataFrame:
    """records with terrain altitudes where both neighbours are known (their grade becomes null), in mode hybrid only where it replaces the recorded one."""
    if mode not in ("dem", "hybrid"):
        raise ValueError("mode: dem or hybrid")
    dem = terrain(route_samples(records, spacing_m), lookup)
    if mode == "hybrid":
        dem = dem.join(replaces_recorded(records, dem).where("replace").select("activity_id"), "activity_id", "left_semi")
    targets = records.select("activity_id", F.struct(*records.columns).alias("record"), F.col("distance_m").alias("at"))  # records travel with their lookups
    found = interpolate(dem, targets, "activity_id", "distance_m", "idx", "at", ["altitude_m"], bridge_nulls=False).withColumnRenamed("altitude_m", "dem_m")
    new = {"altitude_m": F.coalesce("dem_m", "record.altitude_m"), "grade_percent": F.when(F.col("dem_m").isNull(), F.col("record.grade_percent"))}
    return found.select(*[new.get(c, F.col("record")[c]).alias(c) for c in records.columns])
