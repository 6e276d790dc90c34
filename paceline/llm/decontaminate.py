"""Operator 2: benchmark decontamination, DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words; a benchmark item gives windows of 13 consecutive
words, or one window of all its words if it has fewer. Documents are dealt as parts of ``PART`` words
that overlap by a window less a word, so that time is linear in a text and no row holds more than a part.
Every window of a part is looked up by its 64-bit hash in a broadcast hash set of the benchmark's windows,
right where the document is read, so no document window is shuffled. A set holds about ``BLOCK`` windows:
a larger benchmark takes more passes over the documents, each with its own set and its own written table,
so that memory never grows with the benchmark. Only what is found leaves a pass, with its words, and is
verified by an equi-join on them.

Defined cases: null or wordless text has no words, no hits, and is not contaminated; items without
words give no window; repeated rows give one result row each; a null doc_id is an ordinary key; an
empty benchmark or document table gives zero hits or no rows; other columns are ignored by ``report``
and kept by the two removal modes, whatever their names. Scratch tables are deleted when the next one stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.shared import discard, documents, materialize, unused

WINDOW = 13
#: Window hashes of a pass's broadcast set, of 8 bytes each (some 100 MB as a hash table).
BLOCK = 2_000_000
#: Words at whose starts a part of a document holds windows.
PART = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of the original text with what stands before it; for cutting spans out.
SEGMENT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def window_hash(hashes: str, i: str, k: int) -> str:
    """SQL for the hash of the k words from i on (the first is 0): that of k and an array of their hashes, without cutting one out."""
    return f"xxhash64({k}, {', '.join(f'get({hashes}, {i} + {j})' for j in range(k))})"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """One row per distinct window: its length k, its words as one string, its hash and the items it occurs in."""
    w = benchmark.select(F.col("item_id").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0").withColumn("k", F.expr(f"cast(least(size(w), {WINDOW}) as int)"))
    each = w.select("item", "k", F.explode(F.expr("transform(sequence(0, size(w) - k), i -> slice(w, i + 1, k))")).alias("win")).withColumn("hashes", F.transform("win", lambda x: F.xxhash64(x)))
    return each.groupBy("k", F.array_join("win", " ").alias("win_words")).agg(F.collect_set("item").alias("items"), F.first(F.xxhash64("k", "hashes")).alias("h"))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), n_words, start, w, hashes: each document's words in parts, the first one also of texts without words."""
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    # outer, here and below: Spark infers a filter for other generators and computes the whole array for it anew, by element
    starts = F.explode_outer(F.expr(f"sequence(0, cast(greatest(n_words - 1, 0) as int), {PART})"))
    cut = base.select("*", starts.alias("start")).withColumn("w", F.expr(f"slice(w, start + 1, {PART + WINDOW - 1})"))
    return cut.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))


def scanned(docs: DataFrame, windows: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """A table per pass: a row with pos -1 for each document row (in the first only), and one for each window (pos, k, win_words) whose hash is a benchmark window's."""
    lengths, n = windows.agg(F.sort_array(F.collect_set("k")), F.count_distinct("h")).first()  # at most WINDOW lengths
    passes = max(1, -(-n // block))
    each = [
        f"if(size(w) >= {k}, transform(sequence(0, least({PART}, size(w) - {k} + 1) - 1),"
        f" i -> named_struct('pos', i, 'k', {k}, 'h', {window_hash('hashes', 'i', k)})), array())"
        for k in lengths
    ]
    itself = "if(start = 0, array(named_struct('pos', -1, 'k', 0, 'h', 0L)), array())"
    hashes = windows.select("h").distinct()
    out = []
    for b in range(passes):
        # a projection of its own: the generator then needs no copy of the part for each window
        held = parts(docs).withColumn("xs", F.expr(f"concat({', '.join(([] if b else [itself]) + each)})"))
        rows = held.select("doc_id", "th", "n_words", "start", "w", F.explode_outer("xs").alias("x"))
        one = hashes.where(F.pmod("h", F.lit(passes)) == b).select(F.col("h").alias("known"))
        found = rows.join(F.broadcast(one), F.col("x.h") == F.col("known"), "left").where("x.pos < 0 or known is not null")
        win = F.expr("if(x.pos < 0, null, array_join(slice(w, greatest(x.pos, 0) + 1, x.k), ' '))")
        pos = F.expr("if(x.pos < 0, -1, start + x.pos)")
        out.append(materialize(found.select("doc_id", "th", "n_words", pos.alias("pos"), "x.k", win.alias("win_words")), "window-hits"))
    return out


#: Words inside any of the sorted spans (pos, k): each span adds what lies beyond the furthest end so far.
COVERED = (
    "aggregate(spans, named_struct('e', 0, 'n', 0L), (a, s) -> named_struct("
    "'e', greatest(a.e, s.pos + s.k), 'n', a.n + greatest(0, s.pos + s.k - greatest(s.pos, a.e))), a -> a.n)"
)


def report(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per document row: doc_id, th, n_words, n_hit, n_items, items (sorted strings), spans, contaminated.

    Hits belong to a doc_id and a text, not to a row, so that passes needn't meet rows in the same order.
    """
    windows = materialize(benchmark_windows(benchmark), "bench-windows")
    passes = scanned(docs, windows, block)
    seen = reduce(DataFrame.unionByName, passes)
    hit = (
        seen.where("pos >= 0").join(windows.select("k", "win_words", "items"), ["k", "win_words"])
        .groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t"))
        .agg(
            F.array_sort(F.collect_set(F.struct("pos", "k"))).alias("spans"),
            F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x.cast("string"))).alias("items"),
        )
        .withColumn("n_hit", F.expr(COVERED))
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    base = passes[0].where("pos < 0").select("doc_id", "th", "n_words")
    out = base.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").select(
        "doc_id", "th", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<pos:int,k:int>>)")).alias("spans"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
    whole = materialize(out, "contamination")
    discard(windows, *passes)
    return whole


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", block: int = BLOCK) -> DataFrame:
    """docs without its contaminated documents, or (mode "spans") with the hit words cut out of all texts.

    The documents concerned are a table of ids and text hashes; Spark sends it to all tasks or shuffles by its size.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode: documents or spans")
    judged = report(docs, benchmark, block)
    wanted = judged.where("n_hit > 0" if mode == "spans" else "contaminated")
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("spans").alias("s"))
    found = materialize(wanted.dropDuplicates(["d", "t"]), "found")
    discard(judged)
    id_of, hash_of, spans, segments = (unused(n, docs) for n in ("hit_id", "hit_hash", "hit_spans", "hit_segments"))
    found = found.select(F.col("d").alias(id_of), F.col("t").alias(hash_of), F.col("s").alias(spans))
    same = docs["doc_id"].eqNullSafe(found[id_of]) & (F.xxhash64(docs["text"]) == found[hash_of])
    if mode == "documents":
        return docs.join(found, same, "left_anti")
    joined = docs.join(found, same, "left").withColumn(segments, F.regexp_extract_all("text", F.lit(SEGMENT), F.lit(0)))
    cut = F.flatten(F.transform(F.col(spans), lambda s: F.sequence(s["pos"], s["pos"] + s["k"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(segments) - 1), cut)
    tail = F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform(left, lambda i: F.get(segments, i)), ""), tail))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Windows by position on both sides, compared as strings.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM
  (SELECT item_id, w, least(len(w), 13) AS k, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM
  (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLES = {"op2_decontaminate": ORACLE}
