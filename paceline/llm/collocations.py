"""Operator 12: mine phrases whose words occur together more often than apart.

Texts are split into pieces at marks and line ends; equal pieces of a language become one row with a
multiplicity (Spark sums partially, so a piece in a third of all texts is one row per task). Tasks turn
pieces into word ids of a chunk, count its weighted n-grams in duckdb, and deal them by a hash of language and phrase
into buckets, as compressed blocks. One task per bucket streams its blocks into a duckdb aggregation that
goes out of core beyond ``MEMORY`` (into a folder of the task's own, deleted with it; nothing else reads it) and
keeps what reaches the least count. A phrase's parts are at least as frequent as the phrase, so they are all kept.

Each candidate then asks for its parts: requests are shuffled to the parts' counts by part, with a salt for
words (a common word is part of very many phrases), and the answers come back per candidate. Scores are
exact: products in ``decimal(38, 0)``, divided as whole numbers.

A candidate goes if a longer candidate around it has ``inside`` percent of its count. A longer candidate's
own parts are at least as frequent as it is, so looking at those with one word more is enough. The best per
language are taken by rank, of which Spark keeps only the best of each task before it shuffles.

Defined cases: null text is empty, null lang ``und``; words are split at space and tab only and lower-cased
in A-Z; pieces end at ``[.,;:!?]`` and the line ends 0x0A to 0x0D; phrases never cross a piece; equal
scores go by count, then by the phrase's bytes; an empty table gives no rows; repeated rows count as often as they occur;
other columns are ignored.
"""

from __future__ import annotations

import tempfile

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from paceline.llm.shared import discard, documents, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = r"[.,;:!?\x0A-\x0D]"
GAPS = r"[\x20\x09]+"
LONGEST = 3
LEAST = 10
#: Percent of a candidate's count from which a longer candidate swallows it.
INSIDE = 50
TOP = 2000
#: Words that a task counts at once, and of one bucket.
WORDS = 400_000
#: duckdb's memory in a task; beyond it, it goes out of core.
MEMORY = "192MB"
#: A word's count is repeated so many times for the requests.
SALTS = 16

BLOCKS = "bucket int, block binary"
GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words joined by one space), m (how often), n_words; pieces without words are left out."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(low, MARKS)).alias("piece"))
    # most pieces have single spaces only, and need no pattern
    wide = F.contains("piece", F.lit("  ")) | F.contains("piece", F.lit("\t"))
    plain = each.withColumn("piece", F.btrim(F.when(wide, F.regexp_replace("piece", GAPS, " ")).otherwise(F.col("piece")))).where("piece != ''")
    counted = plain.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))
    return counted.withColumn("n_words", F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)


def _database(folder: str) -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})


def _counted(con: duckdb.DuckDBPyConnection, langs: pa.Array, texts: pa.Array, times: pa.Array, longest: int, buckets: int):
    """Blocks (bucket, bytes) of the n-grams of some pieces."""
    lists = pc.split_pattern(texts, " ")
    owner, words = pc.list_parent_indices(lists), pc.list_flatten(lists).dictionary_encode()
    names, code = words.dictionary, words.indices
    lang = langs.dictionary_encode()
    flat = pa.table({"p": owner, "l": lang.indices.take(owner), "m": times.take(owner), "w1": code})  # noqa: F841
    for n in range(1, longest + 1):
        size = max(0, len(code) - n + 1)
        if not size:
            return
        inside = pc.equal(owner.slice(0, size), owner.slice(n - 1, size))
        grams = pa.table({"l": lang.indices.take(owner.slice(0, size)), "m": times.take(owner.slice(0, size))} | {f"w{k}": code.slice(k, size) for k in range(n)}).filter(inside)  # noqa: F841
        ids = ", ".join(f"w{k}" for k in range(n))
        sums = con.sql(f"SELECT l, {ids}, sum(m)::BIGINT AS f FROM grams GROUP BY l, {ids}").to_arrow_table().combine_chunks()
        parts = [names.take(sums.column(f"w{k}").combine_chunks()) for k in range(n)]
        phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        named = pa.table([lang.dictionary.take(sums.column("l").combine_chunks()), phrase, pa.array([n] * len(phrase), pa.int32()), sums.column("f")], schema=GRAMS)  # noqa: F841
        dealt = con.sql(f"SELECT (hash(lang, phrase) % {buckets})::INT AS bucket, * FROM named ORDER BY bucket").to_arrow_table().combine_chunks()
        runs = dealt.column("bucket").combine_chunks().run_end_encode() if hasattr(pa.Array, "run_end_encode") else pc.run_end_encode(dealt.column("bucket").combine_chunks())
        lo = 0
        for bucket, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, GRAMS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(dealt.slice(lo, hi - lo).drop_columns("bucket"))
            yield bucket, sink.getvalue().to_pybytes()
            lo = hi


def frequent(found: DataFrame, buckets: int, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase, words, f of every phrase of up to ``longest`` words that occurs ``least`` times or more; found: ``pieces``."""

    def deal(batches):
        def flush(held):
            table = pa.Table.from_batches(held).combine_chunks()
            with tempfile.TemporaryDirectory() as folder, _database(folder) as con:
                blocks, size = [], 0
                for block in _counted(con, *(table.column(c).combine_chunks() for c in ("lang", "piece", "m")), longest, buckets):
                    blocks.append(block)
                    size += len(block[1])
                    if size > 1 << 22:
                        yield pa.record_batch({"bucket": pa.array([b for b, _ in blocks], pa.int32()), "block": pa.array([x for _, x in blocks], pa.binary())})
                        blocks, size = [], 0
                yield pa.record_batch({"bucket": pa.array([b for b, _ in blocks], pa.int32()), "block": pa.array([x for _, x in blocks], pa.binary())})

        held, words = [], 0
        for batch in batches:
            held.append(batch)
            words += pc.sum(batch.column("n_words")).as_py() or 0
            if words >= WORDS:
                yield from flush(held)
                held, words = [], 0
        if words:
            yield from flush(held)

    def add(batches):
        def grams():
            for batch in batches:
                for block in batch.column("block"):
                    with pa.ipc.open_stream(block.as_buffer()) as part:
                        yield from part

        with tempfile.TemporaryDirectory() as folder, _database(folder) as con:
            source = pa.RecordBatchReader.from_batches(GRAMS, grams())  # noqa: F841
            sums = con.sql(f"SELECT lang, phrase, max(words) AS words, sum(f)::BIGINT AS f FROM source GROUP BY lang, phrase HAVING sum(f) >= {least}")
            yield from sums.to_arrow_reader(20_000)

    dealt = found.select("lang", "piece", "m", "n_words").mapInArrow(deal, BLOCKS)
    return dealt.repartition(buckets, "bucket").mapInArrow(add, "lang string, phrase string, words int, f long")


def scored(kept: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every candidate, by its lowest-scoring cut; kept: ``frequent``."""
    words = F.split("phrase", " ")
    candidates = kept.where("words > 1").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    part = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    sides = F.array(F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))
    asked = cuts.select("*", F.explode(sides).alias("s")).select("lang", "phrase", "words", "a", "k", "s.side", "s.part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    counts = kept.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    answers = asked.join(counts, ["lang", "part", "salt"])
    both = answers.groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("n"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("n"))).alias("r"))
    score = F.expr("(1000000BD * cast(a as decimal(16, 0)) * cast(a as decimal(16, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "phrase", "words", "a").agg(lowest).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def unswallowed(found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """Candidates that no longer candidate swallows."""
    words = F.split("phrase", " ")
    sub = F.explode(F.array(*[F.array_join(F.slice(words, F.lit(at), F.col("words") - 1), " ") for at in (1, 2)])).alias("phrase")
    longer = found.where("words > 2").select("lang", "a", sub).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    joined = found.join(longer, ["lang", "phrase"], "left")
    return joined.where(f"around is null or 100 * around < {inside} * a").drop("around")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``top`` phrases per language (None: all)."""
    spark = docs.sparkSession
    found = materialize(pieces(docs), "pieces")
    totals = materialize(found.groupBy("lang").agg(F.sum(F.col("m") * F.col("n_words")).alias("n"), F.sum("n_words").alias("distinct")), "piece-words")
    words = totals.agg(F.sum("distinct")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // WORDS))
    kept = materialize(frequent(found, buckets, longest, least), "phrases")
    left = unswallowed(scored(kept), inside)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best))
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked
    out = materialize(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(found, totals, kept)
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(documents(spark, sf_dir))


QUERIES = {"op12_collocations": op12_collocations}

ORACLES = {
    "op12_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS m FROM d GROUP BY ALL),
g AS (
  SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase, sum(m)::BIGINT AS f
  FROM (SELECT lang, w, m, words, unnest(range(1, len(w) - words + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(words)) GROUP BY ALL HAVING sum(m) >= 10),
n AS (SELECT lang, sum(m * len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (
  SELECT *, array_to_string(s[1:k], ' ') AS left_part, array_to_string(s[k + 1:], ' ') AS right_part
  FROM (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS s, unnest(range(1, words)) AS k FROM g WHERE words > 1)),
x AS (
  SELECT c.lang, c.words, c.phrase, a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN g l ON l.lang = c.lang AND l.phrase = left_part JOIN g r ON r.lang = c.lang AND r.phrase = right_part
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
y AS (
  SELECT lang, phrase, max(f) AS around FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM g WHERE words = 3) GROUP BY ALL)
SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) AS rank, x.phrase, a, l, r, n, score
FROM x JOIN n ON n.lang = x.lang LEFT JOIN y ON y.lang = x.lang AND y.phrase = x.phrase
WHERE around IS NULL OR 100 * around < 50 * a
QUALIFY row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase) <= 2000
"""
}
