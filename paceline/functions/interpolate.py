"""As-of and interpolating lookups by one sort per key, without range joins.

Points and targets of a key are sorted together; windows then give each target its neighbours. The cost
is that of a sort, whatever the numbers of points and targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalars import lerp, lerp_int


def neighbours(points: DataFrame, targets: DataFrame, key: str, x: str, order: str, columns: list[str], at: str) -> DataFrame:
    """targets with p (last point with x <= at; its field ``first`` is the first point of equal x) and q (first point with x > at), as structs of x and columns."""
    same = Window.partitionBy(key, x).orderBy(order)
    point = F.struct(x, *columns)
    p = points.where(F.col(x).isNotNull()).select(key, F.col(x).cast("double").alias("_x"), F.lit(0).alias("_kind"), F.col(order).cast("long").alias("_o"), F.struct(point.alias("last"), F.first(point).over(same).alias("first")).alias("_p"), F.lit(None).alias("_t"))
    t = targets.select(key, F.col(at).cast("double").alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_o"), F.lit(None).alias("_p"), F.struct(*targets.columns).alias("_t"))
    both = p.unionByName(t)
    w = Window.partitionBy(key).orderBy("_x", "_kind", "_o")
    found = both.select("*", F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.first("_p", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("q"))
    own = [F.col(c) if c == key else F.col("_t")[c].alias(c) for c in targets.columns]  # the key itself, so that what comes next knows that rows lie by it
    return found.where("_kind = 1").select(*own, "p", F.col("q.last").alias("q"))


def interpolate(points: DataFrame, targets: DataFrame, key: str, x: str, order: str, at: str, floats: list[str], ints: list[str] = (), bridge_nulls: bool = True) -> DataFrame:
    """targets with the points' columns at ``at``: a point's own values where x = at (the first such point), else interpolated; null outside. bridge_nulls: a missing side gives the other one."""
    found = neighbours(points, targets, key, x, order, [*floats, *ints], at)
    hit = F.col(f"p.last.{x}") == F.col(at)
    inside = F.col("p").isNotNull() & F.col("q").isNotNull()
    ratio = F.try_divide(F.col(at) - F.col(f"p.last.{x}"), F.col(f"q.{x}") - F.col(f"p.last.{x}"))

    def value(c: str, whole: bool) -> Column:
        a, b = F.col(f"p.last.{c}"), F.col(f"q.{c}")
        mixed = (lerp_int if whole else lerp)(a, b, ratio)
        return F.when(hit, F.col(f"p.first.{c}")).when(inside if bridge_nulls else inside & a.isNotNull() & b.isNotNull(), mixed).alias(c)

    return found.select(*targets.columns, (hit | inside).alias("found"), *[value(c, False) for c in floats], *[value(c, True) for c in ints])
