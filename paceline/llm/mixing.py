"""Operator 11: mix sources to target weights, cut at exact budgets, in epochs.

Every row gets a random key, the first 60 bits of an MD5 over seed, doc_id and text, so a rerun draws the
same order. Sizes are counted once into a narrow table; texts are never shuffled. Within a source the keys
are sorted by range: a bucket holds an equal share of the key space, so buckets are even whatever the
source's share, and there are about as many buckets as a bucket of one source has rows at most (the square
root of the rows). Prefix sums are sums before the bucket (over one row per bucket) plus sums within it.

Targets fill up by weight: a source that would pass ``most`` times its size stops there, and the excess goes
to the others by weight. That is ``min(most * size, weight * level)`` with one level for all; sorted by
``most * size / weight`` the stopped sources come first, so the level needs one pass over the sources
(integers, one division).

A source's budget is its target rounded to a whole number; whole epochs come first, and the last epoch takes
documents in key order up to the budget, the last of them in part. So a document is taken between
floor and ceil of budget / size of source times.

Defined cases: null text has size 0; a null source is a source of its own, after all others; rows without
words are taken 0 times; rows equal in doc_id and text are rows of their own, which of them the cut takes first is
open, what all of them together give isn't; null doc_ids are spread by their texts; a source without words
has target 0; an empty table gives no rows; other columns stay out of ``mix`` and don't matter.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.shared import documents, materialize

#: Words of a text; sizes count them.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST = 3


def _place(name: str) -> Column:
    """A source as a text that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(name)), F.lit("t"))


def sizes(docs: DataFrame, seed: str = "") -> DataFrame:
    """doc_id, source (see ``_place``), key and size of every row."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    return docs.select(
        "doc_id",
        _place("source").alias("source"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: tuple[int, int] = (1, 1)) -> DataFrame:
    """Per source of totals (source, source_size): target, double. All share ``share`` (a fraction) of all sizes.

    One row per source goes through one task.
    """
    every = Window.partitionBy()
    number = F.row_number().over(Window.orderBy("source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int")).cast("decimal(20,0)")
    cap = (F.col("source_size") * most * share[1]).cast("decimal(20,0)")
    wide = totals.withColumns({"weight": weight, "cap": cap}).withColumn("whole", (F.sum("source_size").over(every) * share[0]).cast("decimal(20,0)"))
    # sources in the order in which a rising level meets their caps; whole and cap are both scaled by the share's lower part
    before = Window.orderBy((F.col("cap") / F.col("weight")).cast("double"), "source").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumns({
        "room": F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    wide = wide.withColumn("stopped", F.col("cap") * F.col("open") <= F.col("weight") * F.col("room"))
    left = {
        "room": F.col("whole") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(every), F.lit(0)),
        "open": F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(every),
    }
    wide = wide.withColumns(left)
    filled = (F.col("weight") * F.col("room")).cast("double") / (F.col("open") * share[1]).cast("double")
    return wide.select("source", F.when(F.col("stopped"), F.col("source_size").cast("double") * most).otherwise(filled).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: tuple[int, int] = (1, 1), seed: str = "") -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, key, size, source_size, target, taken."""
    rows = materialize(sizes(docs, seed), "mix-sizes")
    buckets = 1 << max(1, isqrt(rows.count()).bit_length())
    rows = rows.withColumn("bucket", (F.col("key") / F.lit((1 << 60) // buckets)).cast("int"))
    parts = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    per_source = parts.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    by_source = per_source.join(targets(per_source, weights, most, share), "source")
    in_order = Window.partitionBy("source").orderBy("bucket")
    offsets = parts.withColumn("offset", F.sum("bucket_size").over(in_order) - F.col("bucket_size")).drop("bucket_size").join(by_source, "source")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum("size").over(inside)).join(offsets, ["source", "bucket"])
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    start = F.col("offset") + F.col("end") - F.col("size")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - epochs * F.col("source_size") - start))
    return placed.select("doc_id", "key", "size", "source_size", "target", (epochs * F.col("size") + rest).cast("long").alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: tuple[int, int] = (1, 1), seed: str = "") -> DataFrame:
    """The mixed texts: doc_id, epoch (from 0), text; the text of a document's last epoch ends after the words taken there.

    doc_ids name documents here, so they must be distinct and not null.
    """
    taken = mix(docs, weights, most, share, seed).select("doc_id", "size", "taken").where("taken > 0")
    copies = docs.select("doc_id", "text").join(taken, "doc_id").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size"))
    spaced = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(spaced, F.lit(1), words.cast("int")), "")
    return copies.select("doc_id", "epoch", F.when(words == F.col("size"), F.col("text")).otherwise(cut).alias("text"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op11_mixing": op11_mixing}

ORACLES = {
    "op11_mixing": r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    substr(md5(':' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source) - 1) % 3 + 1)::INT]::HUGEINT AS weight FROM d GROUP BY source),
m AS (  -- the level at which one more source stops
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS room, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, 3 * source_size * open <= weight * room AS stopped FROM m),
t AS (
  SELECT source, source_size, CASE WHEN stopped THEN source_size::DOUBLE * 3
    ELSE (weight * (sum(source_size) OVER () - coalesce(sum(CASE WHEN stopped THEN 3 * source_size END) OVER (), 0)))::DOUBLE / (sum(CASE WHEN NOT stopped THEN weight END) OVER ())::DOUBLE END AS target
  FROM k),
p AS (
  SELECT d.doc_id, size, t.source_size, target, floor(target + 0.5)::HUGEINT AS budget,
    (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::HUGEINT AS start
  FROM d JOIN t ON t.source = d.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - start)) END)::BIGINT AS taken
FROM p
"""
}
