"""Operator 4: language identification by hierarchical discrimination.

A first linear model predicts the language family from hashed character n-grams; within a family,
one-versus-one linear support vector machines separate its languages and the votes' margins decide.
Features are counts of letter n-grams (1 to 4 letters with word edges, A-Z lower-cased) hashed into
2**BITS cells; a text's vector is the square roots of its shares, of length one. The models learn from a
bounded sample: at most ``PER_LANGUAGE`` labelled texts of each language, the first by a hash of doc_id
and text, drawn in one pass; every language with labelled texts is learned. Each binary model - a family
against all others, or a pair of languages of one family - is fitted by a Spark task of its own, a
family's from at most ``PER_FAMILY`` texts of each side. Only the weights come to the driver; their number
depends on the languages alone. In prediction only the pairs of a text's predicted family are scored.
Languages without an entry in ``FAMILIES`` are families of their own.

Defined cases: null texts and texts without a letter get ``und`` with score 0; without any labelled
text all do; with one language there is nothing to discriminate and every other text gets it; rows
with null lang or null doc_id are never learned from; repeated rows get a row each; an empty table gives
no rows; other columns are ignored by ``predict`` and kept by ``filter_documents``, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.shared import discard, documents, integer_ids, materialize
from paceline.llm.textnp import LEADS, chunks, mix

BITS = 16
CELLS = 1 << BITS
PER_LANGUAGE = 800
PER_FAMILY = 4000
UNKNOWN = "und"
#: Bytes of text whose n-grams are held at once; they take some 200 times as many.
GRAMS_CHUNK = 1 << 16
#: Language codes by family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
    "sino-tibetan": "my zh",
    "austronesian": "id jv ms tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] = np.arange(97, 123)
#: Bytes of words: letters and everything beyond ASCII; the rest is an edge.
INSIDE = np.zeros(256, bool)
INSIDE[65:91] = INSIDE[97:123] = True
INSIDE[128:] = True
LETTER = re.compile(r"[^\W\d_]")


def grams(c) -> tuple[np.ndarray, np.ndarray]:
    """Cell and text of every n-gram of a chunk."""
    codes = np.where(INSIDE[c.data], LOWER[c.data], np.uint64(32))
    lead = np.flatnonzero(LEADS[c.data])
    text = np.repeat(np.arange(len(c)), np.diff(c.offsets))[lead]
    # one number per code point: its bytes, packed
    packed, end = codes[lead], c.offsets[1:][text]
    for k in (1, 2, 3):
        at = np.minimum(lead + k, len(codes) - 1)
        more = (lead + k < end) & ~LEADS[c.data[at]]  # never of the next text
        packed = np.where(more, packed * np.uint64(256) + codes[at], packed)
    if not len(packed):
        return np.zeros(0, np.int64), text
    # runs of edges count once
    keep = np.ones(len(packed), bool)
    keep[1:] = ~((packed[1:] == 32) & (packed[:-1] == 32) & (text[1:] == text[:-1]))
    packed, text = packed[keep], text[keep]
    out, of = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(packed), np.uint64)
        for n in range(1, 5):
            m = len(packed) - n + 1
            if m <= 0:
                break
            h = mix(h[:m] * np.uint64(0x100000001B3) + packed[n - 1 :] + np.uint64(n))
            whole = text[:m] == text[n - 1 :]
            if n == 1:
                whole = whole & (packed != 32)
            out.append((h[whole] >> np.uint64(64 - BITS)).astype(np.int64))
            of.append(text[:m][whole])
    return np.concatenate(out), np.concatenate(of)


def vectors(c):
    """Text, cell and weight of the features; each text's weights have length one."""
    cell, text = grams(c)
    key, n = np.unique(text * CELLS + cell, return_counts=True)
    text, cell = key // CELLS, key % CELLS
    weight = np.sqrt(n)
    total = np.bincount(text, weights=n, minlength=len(c))
    return text, cell, weight / np.sqrt(np.maximum(total, 1))[text]


def sums(text, cell, weight, w: np.ndarray, n: int) -> np.ndarray:
    """Product of the texts' vectors with each row of w."""
    return np.stack([np.bincount(text, weights=weight * row[cell], minlength=n) for row in w], axis=1) if len(w) else np.zeros((n, 0))


def svm(cells: list[np.ndarray], weights: list[np.ndarray], y: np.ndarray, epochs: int = 12, c: float = 10.0) -> np.ndarray:
    """Linear support vector machine by dual coordinate descent over each text's cells and weights; y holds 1 and -1, and the vectors have length one."""
    w, alpha, rng = np.zeros(CELLS + 1), np.zeros(len(y)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, v = cells[i], weights[i]
            grad = y[i] * (w[f] @ v + w[CELLS]) - 1
            new = min(max(alpha[i] - grad / (v @ v + 1), 0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                w[CELLS] += step
                alpha[i] = new
    return w


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most per_language training rows of each language: lang, text, h. Their share comes from counts, the exact bound from their ranks."""
    train = docs.where("lang is not null and text is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 != 2").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("of"), F.least(F.lit(1.0), 1.2 * per_language / F.col("n") + 40 / F.col("n")).alias("share"))
    sizes = materialize(sizes, "languages")  # a row per language
    near = train.join(F.broadcast(sizes), F.col("lang") == F.col("of")).where(F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return ranked.where(F.col("k") <= per_language).select("lang", "text", "h")


def models_of(langs: list[str]) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """Families, the family of each language, and the pairs of languages within families."""
    families = sorted({FAMILY_OF.get(x, x) for x in langs})
    of = [families.index(FAMILY_OF.get(x, x)) for x in langs]
    return families, of, [(a, b) for a in range(len(langs)) for b in range(a + 1, len(langs)) if of[a] == of[b]]


def fit_model(texts: pa.Array, y: np.ndarray) -> np.ndarray:
    """One binary model's weights and bias. Features are narrowed chunk by chunk, to six bytes each, and never copied together."""
    cells, weights = [], []
    for c in chunks(texts, GRAMS_CHUNK):
        text, cell, weight = vectors(c)
        nexts = np.searchsorted(text, np.arange(1, len(c)))
        cells += np.split(cell.astype(np.min_scalar_type(CELLS - 1)), nexts)
        weights += np.split(weight.astype(np.float32), nexts)
    return svm(cells, weights, y).astype(np.float32)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, per_family: int = PER_FAMILY) -> dict:
    """Family models and pair models, as small arrays (float32, one row per model)."""
    spark = docs.sparkSession
    rows = materialize(sample(docs, per_language), "language-sample")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    families, of, pairs = models_of(langs)
    model = {"langs": langs, "families": families, "family_of": of, "pairs": pairs, "family_w": np.zeros((0, CELLS + 1), np.float32), "pair_w": np.zeros((0, CELLS + 1), np.float32)}
    # the sides of each model: family models first
    sides = [(m, lang, bool(of[k] == m)) for m in range(len(families)) for k, lang in enumerate(langs)] if len(families) > 1 else []
    sides += [(len(families) + m, langs[x], x == pair[0]) for m, pair in enumerate(pairs) for x in pair]
    if not sides:
        return model

    def learn(key, table):
        table = table.sort_by([("h", "ascending"), ("text", "ascending")])
        y = np.where(table.column("side").to_numpy(zero_copy_only=False), 1, -1)
        return pa.table({"model": [key[0].as_py()], "w": pa.array([fit_model(table.column("text").combine_chunks(), y)], pa.list_(pa.float32()))}, schema=pa.schema([("model", pa.int32()), ("w", pa.list_(pa.float32()))]))

    table = spark.createDataFrame(sides, "model int, of string, side boolean")
    dealt = rows.join(F.broadcast(table), F.col("lang") == F.col("of")).withColumn("k", F.row_number().over(Window.partitionBy("model", "side").orderBy("h")))
    dealt = dealt.where((F.col("model") >= len(families)) | (F.col("k") <= per_family)).select("model", "side", "h", "text")
    fitted = {r[0]: r[1] for r in dealt.groupBy("model").applyInArrow(learn, "model int, w array<float>").toArrow().to_pandas().itertuples(index=False)}
    discard(rows)
    if len(families) > 1:
        model["family_w"] = np.stack([np.asarray(fitted[k], np.float32) for k in range(len(families))])
    if pairs:
        model["pair_w"] = np.stack([np.asarray(fitted[len(families) + k], np.float32) for k in range(len(pairs))])
    return model


SHARP = 4.0  # margins of one mean 0.98


def scores(c, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Index of the predicted language and its score, per text of a chunk."""
    of = np.array(model["family_of"])
    text, cell, weight = vectors(c)
    n = len(c)
    f = sums(text, cell, weight, model["family_w"], n) + model["family_w"][:, CELLS] if len(model["family_w"]) else np.zeros((n, 1))
    p_family = np.exp(SHARP * (f - f.max(axis=1, keepdims=True)))
    p_family /= p_family.sum(axis=1, keepdims=True)
    family = f.argmax(axis=1)
    best, score = np.zeros(n, np.int64), p_family[np.arange(n), family]
    for k in np.unique(family):  # only the pairs of the predicted family
        members = np.flatnonzero(of == k)
        here = np.flatnonzero(family == k)
        best[here] = members[0]
        ours = [j for j, (a, _) in enumerate(model["pairs"]) if of[a] == k]
        if not ours:
            continue
        place = np.full(n, -1)
        place[here] = np.arange(len(here))
        rows = place[text] >= 0
        w = model["pair_w"][ours]
        m = sums(place[text[rows]], cell[rows], weight[rows], w, len(here)) + w[:, CELLS]
        strength = np.zeros((len(here), len(members)))
        for col, j in enumerate(ours):
            a, b = (int(np.searchsorted(members, x)) for x in model["pairs"][j])
            p = 1 / (1 + np.exp(-SHARP * np.clip(m[:, col], -20, 20)))
            strength[:, a] += np.log(np.maximum(p, 1e-12))
            strength[:, b] += np.log(np.maximum(1 - p, 1e-12))
        p_lang = np.exp(strength - strength.max(axis=1, keepdims=True))
        p_lang /= p_lang.sum(axis=1, keepdims=True)
        top = strength.argmax(axis=1)
        best[here] = members[top]
        score[here] *= p_lang[np.arange(len(here)), top]
    return best, score


def judged(batch, model: dict):
    """Predicted names and scores of the texts of a batch, chunk by chunk."""
    for c in chunks(batch.column("text"), GRAMS_CHUNK):
        part = batch.column("text").slice(c.first, len(c))
        lettered = np.array([bool(x and LETTER.search(x)) for x in part.to_pylist()])
        if model["langs"]:
            best, score = scores(c, model)
            names = pc.take(pa.array(model["langs"], pa.string()), pa.array(best))
        else:
            names, score, lettered = pa.array([UNKNOWN] * len(c)), np.zeros(len(c)), np.zeros(len(c), bool)
        yield c, pc.if_else(pa.array(lettered), names, UNKNOWN), np.where(lettered, score, 0.0)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a row of CELLS floats for each family and pair

    def rows(batches):
        for batch in batches:
            for c, names, score in judged(batch, shared.value):
                part = batch.slice(c.first, len(c))
                yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "held_out": part.column("held_out"), "lang_pred": names, "score": pa.array(score)})

    given = integer_ids(docs).select("doc_id", "text", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False)).alias("held_out"))
    return given.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")


#: A document of a learned language goes only if the model is this unsure.
LEAST_SCORE = 0.4


def filter_documents(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents with a recognised language, with all their columns; each is judged where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang")))

    def rows(batches):
        for batch in batches:
            for c, names, score in judged(batch, shared.value):  # small batches go back, so that no copy of a large one is held
                kept = pc.not_equal(names, UNKNOWN).to_numpy(zero_copy_only=False) & (score >= least_score)
                yield batch.slice(c.first, len(c)).filter(pa.array(kept))

    return docs.mapInArrow(rows, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs))


QUERIES = {"op4_language_id": op4_language_id}
