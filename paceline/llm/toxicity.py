"""Operator 8: toxicity by weak supervision.

Terms are words (runs of letters, A-Z lower-cased), beginnings and endings of words, and words that only
show when digits and signs are read as the letters they stand for. Over the labelled training rows (about
``LABELLED`` of them at most, drawn by hash) Spark counts how many toxic and clean texts hold each term;
those that lean strongly to toxic texts form the lexicon (its size is bounded by the labelled rows), those
that lean to clean ones a second list. ``VOTERS`` of different kinds say toxic, clean or nothing:

    0 strong words      toxic: one of the half of the toxic words that lean most
    1 other words       toxic: one of the rest
    2 beginnings        toxic: a beginning of 4 bytes that leans so
    3 longer beginnings toxic: one of 5 bytes
    4 endings           toxic: the last 4 bytes of a word
    5 disguised words   toxic: a word of the lists with digits or signs for letters
    6 several at once   toxic: three or more toxic terms; clean: none in a text of ``LONG`` words or more
    7 clean words       clean: at least ``CLEAN_WORDS`` words that lean to clean texts; nothing otherwise
    8 case and marks    toxic: shouting, or exclamation marks, where the labelled texts lean so; else nothing

Vote patterns, counted over all documents (at most 3**VOTERS, far fewer in practice), go to a generative
label model: given toxic or clean, each voter depends on one other voter, along the tree of greatest
conditional mutual information, so their accuracies and their correlations are parameters of the model.
Expectation maximisation estimates them, with labelled training rows as nearly certain; the tree is found
anew from the posteriors. A logistic regression on the terms a text holds is trained on the model's
posteriors. Its rows are the distinct sets of terms that documents hold, counted in Spark, so that copies
are one row with their number as weight; beyond ``SAMPLE`` sets a share is drawn by the hash of the set.

Defined cases: null and empty texts hold no term and get the score of a text without terms; labels
with a null doc_id or a null toxic are ignored, of several labels of one doc_id the largest counts;
without labels or without toxic ones the lexicon is empty and all texts get the smoothed base rate;
repeated rows get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.shared import discard, documents, integer_ids, materialize
from paceline.llm.textnp import chunks, keyed

SAMPLE = 30_000
#: Labels that are learned from.
LABELLED = 200_000
TRAINING = "crc32(cast(doc_id as string)) % 4 != 2"
VOTERS = 9
#: Kinds of terms: 0 a word, 4 and 5 its first bytes, -4 its last ones, 1 a word in disguise.
PREFIXES = (4, 5)
ENDING, DISGUISED = -4, 1
LONG, CLEAN_WORDS = 30, 3
#: What digits and signs stand for inside words.
STAND_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
LEAST_TOXIC = 3
LEAST_LOG_ODDS = 2.5
#: A term's toxic texts times its log odds must exceed the log of the number of terms looked at by this, so that few pass by chance.
LEAST_GAIN = 1.0
#: How far a label is trusted against the voters.
TRUST = 0.98
#: The texts without labels count together this often what the labelled ones count, at most; else they would decide alone what the classes are.
UNLABELLED = 0.2
THRESHOLD = 0.3
INSIDE = np.zeros(256, bool)
INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True
SIGNS = np.zeros(256, bool)
SIGNS[[ord(x) for x in STAND_FOR]] = True
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[ord(x) for x in STAND_FOR]] = [ord(x) for x in STAND_FOR.values()]
TERMS = "term long, kind int"


def disguised(c) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of the words that hold a digit or sign and a letter, read as letters."""
    inside = INSIDE | SIGNS
    start, end, text = c._spans(inside[c.data])
    total = np.concatenate(([0], np.cumsum(SIGNS[c.data])))
    letters = np.concatenate(([0], np.cumsum(INSIDE[c.data])))
    some = (total[end] > total[start]) & (letters[end] > letters[start])
    if not some.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    read = type(c)(c.first, PLAIN[c.data], c.offsets, c.valid)
    return read.hashes(start[some], end[some], lower=True), text[some]


def terms(c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, kind and text of each distinct term of each text."""
    start, end, text = c._spans(INSIDE[c.data])
    hashes, kinds, of = [], [], []
    for n in (0, *PREFIXES, ENDING):
        long = end - start > abs(n) if n else np.ones(len(start), bool)
        first = np.where(n < 0, end + n, start)[long]
        last = first + abs(n) if n else end[long]
        h = c.hashes(first, last, lower=True) ^ np.uint64(n * 0x5851F42D4C957F2D % 2**64)
        _, one = np.unique(keyed(h, text[long]), return_index=True)
        hashes.append(h[one])
        kinds.append(np.full(len(one), n))
        of.append(text[long][one])
    h, t = disguised(c)
    _, one = np.unique(keyed(h, t), return_index=True)
    hashes.append(h[one] ^ np.uint64(0xD15C))
    kinds.append(np.full(len(one), DISGUISED))
    of.append(t[one])
    return np.concatenate(hashes), np.concatenate(kinds), np.concatenate(of)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows: text and toxic (0 or 1). Beyond ``LABELLED`` labels a share of about so many is drawn by the hash of doc_id; they go to every task, so no text is shuffled."""
    known = labels.where(f"doc_id is not null and toxic is not null and {TRAINING}").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, LABELLED / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    train = docs.where(f"doc_id is not null and text is not null and {TRAINING}").select("doc_id", "text")
    return materialize(train.join(F.broadcast(drawn), "doc_id").select("text", "toxic"), "labelled")


def lexicon(train: DataFrame) -> dict:
    """words (sorted hashes of toxic terms), kinds, odds; clean (sorted hashes of words that lean to clean texts); n_toxic, n_clean; loud (whether shouting leans to toxic)."""
    n_toxic, n_clean = (int(x or 0) for x in train.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    none = {"words": np.zeros(0, np.uint64), "kinds": np.zeros(0, np.int64), "odds": np.zeros(0), "clean": np.zeros(0, np.uint64), "n_toxic": n_toxic, "n_clean": n_clean, "loud": False}
    if not n_toxic or not n_clean:
        return none

    def counts(batches):
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for c in chunks(batch.column("text")):
                h, kind, text = terms(c)
                shouts = np.flatnonzero(loud(c))
                h, kind, text = np.append(h, np.zeros(len(shouts), np.uint64)), np.append(kind, np.full(len(shouts), 99)), np.append(text, shouts)
                if not len(h):
                    continue
                u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
                bad = np.bincount(inverse, weights=toxic[c.first + text], minlength=len(u)).astype(np.int64)
                yield pa.record_batch({"term": pa.array(u.astype(np.int64)), "kind": pa.array(kind[first], pa.int32()), "bad": pa.array(bad), "good": pa.array(np.bincount(inverse, minlength=len(u)) - bad)})

    found = train.mapInArrow(counts, TERMS + ", bad long, good long").groupBy("term", "kind").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.col("good") + 0.5) / (n_clean + 1))
    found = materialize(found.where((F.col("bad") >= LEAST_TOXIC) | (F.col("good") >= 20)).withColumn("odds", odds), "terms")
    least = float(np.log(max(1, found.where(F.col("bad") >= LEAST_TOXIC).count()))) + LEAST_GAIN
    toxic = (F.col("bad") >= LEAST_TOXIC) & (F.col("odds") >= LEAST_LOG_ODDS) & (F.col("bad") * F.col("odds") >= least)
    # each toxic term is in LEAST_TOXIC labelled texts or more, so the labelled rows bound the lists
    best = sorted((np.uint64(t % 2**64), k, o) for t, k, o in found.where((F.col("kind") != 99) & toxic).select("term", "kind", "odds").collect())
    clean = found.where((F.col("kind") == 0) & (F.col("odds") <= -CLEAN_ODDS)).select("term").collect()
    shouting = found.where(F.col("kind") == 99).select("odds").collect()
    discard(found)
    return none | {
        "words": np.array([t for t, _, _ in best], np.uint64), "kinds": np.array([k for _, k, _ in best], np.int64), "odds": np.array([o for _, _, o in best]),
        "clean": np.array(sorted(t % 2**64 for (t,) in clean), np.uint64), "loud": bool(shouting and shouting[0][0] >= 1),
    }


#: Log odds from which a word leans to clean texts.
CLEAN_ODDS = 0.7


def loud(c) -> np.ndarray:
    """Whether most letters are capitals, or there are three exclamation marks or more for 30 words."""
    capitals, letters = c.per_text((c.data >= 65) & (c.data <= 90)), c.per_text(INSIDE[c.data] & (c.data < 128))
    words = np.bincount(c.words()[2], minlength=len(c))
    return ((letters >= 20) & (2 * capitals > letters)) | (c.per_text(c.data == 33) * 30 >= 3 * np.maximum(words, 30))


def hits(c, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and index in the lexicon of each term that a text holds, by text."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, _, text = terms(c)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    found = words[at] == h
    order = np.lexsort((at[found], text[found]))
    return text[found][order], at[found][order]


def kinds_of(model: dict) -> np.ndarray:
    """The toxic voter of each term."""
    kinds, odds = model["kinds"], model["odds"]
    middle = np.median(odds[kinds == 0]) if (kinds == 0).any() else 0.0
    return np.select([(kinds == 0) & (odds >= middle), kinds == 0, kinds == PREFIXES[0], kinds == PREFIXES[1], kinds == ENDING], [0, 1, 2, 3, 4], 5)


def votes(c, model: dict, voter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes of a chunk's texts as a number of base 3 (digits 0 nothing, 1 clean, 2 toxic), and the terms they hold."""
    text, at = hits(c, model["words"])
    n = len(c)
    said = np.zeros((n, VOTERS), np.int64)
    said[text, voter[at]] = 2
    held = np.bincount(text, minlength=n)
    start, end, of = c._spans(INSIDE[c.data])
    size = np.bincount(of, minlength=n)
    said[:, 6] = np.where(held >= 3, 2, np.where((held == 0) & (size >= LONG), 1, 0))
    if len(model["clean"]):
        h = c.hashes(start, end, lower=True)
        k = np.minimum(np.searchsorted(model["clean"], h), len(model["clean"]) - 1)
        said[:, 7] = np.where(np.bincount(of[model["clean"][k] == h], minlength=n) >= CLEAN_WORDS, 1, 0)
    if model["loud"]:
        said[:, 8] = np.where(loud(c), 2, 0)
    return said @ 3 ** np.arange(VOTERS), text, at


def patterns(texts: DataFrame, model: dict, extra: str | None = None) -> DataFrame:
    """votes, terms (the set a text holds), other (the value of extra, or 0), n: texts alike, counted by tasks and then in Spark."""
    voter = kinds_of(model)

    def rows(batches):
        for batch in batches:
            other = batch.column(extra).to_numpy() if extra else np.zeros(batch.num_rows, np.int64)
            seen: dict[tuple, int] = {}
            for c in chunks(batch.column("text")):
                v, text, at = votes(c, model, voter)
                cut = np.searchsorted(text, np.arange(len(c) + 1))
                for k in range(len(c)):
                    key = (int(v[k]), int(other[c.first + k]), tuple(at[cut[k] : cut[k + 1]].tolist()))
                    seen[key] = seen.get(key, 0) + 1
            if seen:
                yield pa.record_batch({"votes": pa.array([k[0] for k in seen], pa.int64()), "other": pa.array([k[1] for k in seen], pa.int32()), "terms": pa.array([list(k[2]) for k in seen], pa.list_(pa.int32())), "n": pa.array(list(seen.values()), pa.int64())})

    return texts.select("text", *([extra] if extra else [])).mapInArrow(rows, "votes long, other int, terms array<int>, n long").groupBy("votes", "other", "terms").agg(F.sum("n").alias("n"))


def tree(said: np.ndarray, weights: list[np.ndarray]) -> list[int]:
    """Each voter's parent (-1 for the first): the spanning tree of greatest mutual information given the class; weights: of the patterns, by class."""
    k = said.shape[1]
    gain = np.zeros((k, k))
    total = sum(w.sum() for w in weights)
    for w in weights:
        for i in range(k):
            for j in range(i):
                both = np.bincount(said[:, i] * 3 + said[:, j], weights=w, minlength=9).reshape(3, 3) + 1e-9
                p = both / both.sum()
                gain[i, j] += w.sum() / total * (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0)))).sum()
    gain += gain.T
    parent, inside, best, near = [-1] * k, {0}, gain[0].copy(), np.zeros(k, int)
    while len(inside) < k:
        best[list(inside)] = -1
        i = int(np.argmax(best))
        parent[i] = int(near[i])
        inside.add(i)
        closer = gain[i] > best
        best, near = np.where(closer, gain[i], best), np.where(closer, i, near)
    return parent


def log_likelihood(said: np.ndarray, parent: list[int], tables: list[np.ndarray]) -> np.ndarray:
    """log p(votes | one class); tables: by voter, p(vote | the parent's vote)."""
    out = np.zeros(len(said))
    for i, p in enumerate(parent):
        out += np.log(tables[i][said[:, p] if p >= 0 else 0, said[:, i]])
    return out


def tables_of(said: np.ndarray, parent: list[int], w: np.ndarray, toxic: bool) -> list[np.ndarray]:
    """p(vote | the parent's vote) of each voter from weighted patterns, smoothed towards p(vote) and that towards a weak belief in voters."""
    out = []
    for i, p in enumerate(parent):
        alone = np.bincount(said[:, i], weights=w, minlength=3) + (np.array([1.0, 0.2, 0.8]) if toxic else np.array([2.0, 0.5, 0.02]))
        alone /= alone.sum()
        if p < 0:
            out.append(alone[None, :])
            continue
        both = np.bincount(said[:, p] * 3 + said[:, i], weights=w, minlength=9).reshape(3, 3) + 5 * alone
        out.append(both / both.sum(axis=1, keepdims=True))
    return out


def label_model(every: dict[int, float], known: dict[tuple[int, int], float], rounds: int = 60) -> tuple[dict[int, float], float]:
    """Posterior of toxic by vote pattern, and the share of toxic texts. every: texts by pattern; known: labelled ones by pattern and label."""
    patterns_seen = sorted(set(every) | {v for v, _ in known})
    said = np.array([[v // 3**k % 3 for k in range(VOTERS)] for v in patterns_seen], np.int64).reshape(-1, VOTERS)
    toxic, clean = (np.array([known.get((v, y), 0) for v in patterns_seen], float) for y in (1, 0))
    free = np.maximum(np.array([every.get(v, 0) for v in patterns_seen], float) - toxic - clean, 0)
    share = (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 10)
    weight = min(1.0, UNLABELLED * (toxic.sum() + clean.sum()) / max(free.sum(), 1))
    w0, w1 = clean, toxic
    parent = tree(said, [w0 + 1e-9, w1 + 1e-9])
    for k in range(rounds):
        if k == rounds // 2:
            parent = tree(said, [w0, w1])
        odds = np.log(share / (1 - share)) + log_likelihood(said, parent, tables_of(said, parent, w1, True)) - log_likelihood(said, parent, tables_of(said, parent, w0, False))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        w1 = weight * free * p + toxic * TRUST + clean * (1 - TRUST) * p
        w0 = weight * free * (1 - p) + toxic * (1 - TRUST) * (1 - p) + clean * TRUST
        share = float(np.clip((w1.sum() + 0.1) / (w1.sum() + w0.sum() + 1), 1e-4, 0.9))
    return dict(zip(patterns_seen, p.tolist(), strict=True)), share


def train_linear(rows: list[tuple[list[int], float, float]], n: int, zero: tuple[float, float]) -> tuple[np.ndarray, float]:
    """Logistic regression on term presence; rows: terms, posterior, weight; zero: posterior and weight of texts without terms."""
    text = np.repeat(np.arange(len(rows) + 1), [*[len(r[0]) for r in rows], 0])
    at = np.array([k for r in rows for k in r[0]], np.int64)
    y, weight = (np.array([*[r[j] for r in rows], zero[j - 1]], float) for j in (1, 2))
    w, b, m, v, mb, vb = np.zeros(n), float(np.log(max(zero[0], 1e-6) / (1 - zero[0]))), np.zeros(n), np.zeros(n), 0.0, 0.0
    weight = weight / max(weight.sum(), 1)
    for step in range(1, 401):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, weights=w[at], minlength=len(y)) + b, -30, 30)))
        g = weight * (p - y)
        gw, gb = np.bincount(at, weights=g[text], minlength=n) + 1e-7 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        size = 0.1 / (1 + step / 150)
        w -= size * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
        b -= 0.2 * size * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-12)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Lexicon, weights and bias; all of bounded size."""
    train = labelled(docs, labels)
    model = lexicon(train)
    base = (model["n_toxic"] + 0.5) / (model["n_toxic"] + model["n_clean"] + 10)
    if not len(model["words"]):
        return {"words": model["words"], "w": np.zeros(0), "b": float(np.log(base / (1 - base)))}
    sets = materialize(patterns(docs, model), "term-sets")
    every = {v: float(n) for v, n in sets.groupBy("votes").agg(F.sum("n")).collect()}  # 3**VOTERS rows at most
    known = {(v, y): float(n) for v, y, n in patterns(train, model, "toxic").groupBy("votes", "other").agg(F.sum("n")).collect()}
    posterior, _ = label_model(every, known)
    held = sets.where("size(terms) > 0")
    share = min(1.0, SAMPLE / max(held.count(), 1))
    drawn = held.where(F.pmod(F.xxhash64("terms", "votes"), F.lit(1_000_003)) < share * 1_000_003).select("votes", "terms", "n").collect()  # about SAMPLE rows
    rows = [(list(t), posterior[v], n / share) for v, t, n in sorted((v, tuple(t), n) for v, t, n in drawn)]
    without = [(posterior[v], float(n)) for v, n in sets.where("size(terms) = 0").groupBy("votes").agg(F.sum("n")).collect()]
    zero = sum(n for _, n in without) + 1
    w, b = train_linear(rows, len(model["words"]), ((sum(p * n for p, n in without) + base) / zero, zero))
    discard(train, sets)
    return {"words": model["words"], "w": w, "b": b}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def rows(batches):
        for batch in batches:
            for c in chunks(batch.column("text")):
                part = batch.slice(c.first, len(c))
                text, at = hits(c, model["words"])
                z = np.bincount(text, weights=model["w"][at], minlength=len(c)) + model["b"]
                p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "held_out": part.column("held_out"), "score": pa.array(p), "predicted": pa.array((p >= THRESHOLD).astype(np.int32))})

    given = integer_ids(docs).select("doc_id", "text", F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False)).alias("held_out"))
    return given.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op8_toxicity": op8_toxicity}
