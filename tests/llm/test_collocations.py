"""Operator 12 against counting every phrase in dictionaries."""

import random
import re
from collections import Counter

import pytest

from paceline.llm import collocations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASHES = ["piece", "m", "n_words", "phrase", "words", "f", "a", "l", "r", "n", "k", "salt", "score", "rank", "bucket"]
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)
FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def rows_of(rng, n):
    common = ["of", "the", "New", "YORK", "city", "in", "é", "ÉTÉ", "don't", "a b", "x\x0by", "\xa0", "日本", "-"]
    rare = [f"w{k}" for k in range(300)]
    out = []
    for k in range(n):
        words = [rng.choice(common if rng.random() < 0.8 else rare) + rng.choice(["", "", "", ",", ".", " ", "\t", "\n", "\r\n", ";;", "?!"]) for _ in range(rng.randint(0, 60))]
        out.append((k, " ".join(words), rng.choice(["en", "en", "en", "de", None])))
    out += [(n, None, "en"), (n + 1, "", None), (n + 2, " \t ", "fr"), (n + 3, "...", "fr"), (n + 4, "long " * 9000, "en"), (None, "new york city hall", None)]
    return out + [out[0]] * 12 + [(n + 5 + k, "Terms of use apply. all rights reserved", "en") for k in range(40)]


def brute(rows, longest, least, inside, top):
    f, n = {}, Counter()
    for _, text, lang in rows:
        counts = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UP, LOW))):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                counts.update(" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if a >= least and " " in p}
        swallowed = set()
        for p, a in candidates.items():
            w = p.split(" ")
            for size in range(2, len(w)):
                swallowed |= {q for i in range(len(w) - size + 1) if 100 * a >= inside * candidates[q := " ".join(w[i : i + size])]}
        best = []
        for p, a in candidates.items():
            if p not in swallowed:
                w = p.split(" ")
                cuts = [(counts[" ".join(w[:k])], counts[" ".join(w[k:])]) for k in range(1, len(w))]
                score, _, l, r = min((1000000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
                best.append((-score, -a, p.encode(), p, l, r))
        out += [(lang, k, p, -a, l, r, n[lang], -score) for k, (score, a, _, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return out


@pytest.mark.parametrize("longest,least,inside,top,words", [(3, 10, 50, 2000, 400_000), (3, 10, 50, 7, 500), (4, 3, 70, 2000, 2000)])
def test_mine(spark, monkeypatch, longest, least, inside, top, words):
    monkeypatch.setattr(collocations, "WORDS", words)
    rows = rows_of(random.Random(longest + top), 300)
    docs = spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA).repartition(3)
    found = collocations.mine(docs, longest, least, inside, top)
    expected = brute(rows, longest, least, inside, top)
    assert len(expected) > 10 and sorted(map(tuple, found.select(FIELDS).collect())) == sorted(expected)


def test_products_beyond_64_bits(spark):
    kept = spark.createDataFrame([("en", "a", 1, 5 * 10**13), ("en", "b", 1, 7 * 10**13), ("en", "a b", 2, 3 * 10**13)], "lang string, phrase string, words int, f long")
    a, l, r = 3 * 10**13, 5 * 10**13, 7 * 10**13
    assert [tuple(x) for x in collocations.scored(kept).select("a", "l", "r", "score").collect()] == [(a, l, r, 10**6 * a * a // (l * r))]


def test_out_of_core(spark, monkeypatch):
    """Counts don't change when duckdb's memory is too small for a bucket."""
    monkeypatch.setattr(collocations, "MEMORY", "24MB")
    monkeypatch.setattr(collocations, "WORDS", 10**9)
    rng = random.Random(2)
    texts = [(k, " ".join(f"w{rng.randrange(30_000)}{'x' * 30}" for _ in range(3000)), "en") for k in range(100)]
    found = collocations.pieces(spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(1))
    kept = {r["phrase"]: r["f"] for r in collocations.frequent(found.coalesce(1), 1).collect()}
    counts = Counter(w for _, t, _ in texts for w in t.split(" "))
    assert {p: n for p, n in kept.items() if " " not in p} == {w: n for w, n in counts.items() if n >= 10}


def test_pieces_with_wide_gaps(spark):
    """Only pieces with wide gaps need a pattern, and words are counted by their spaces."""
    rows = [("a  b\tc\t\t d , X.\t \n \u00e9    B", "x"), (None, None), ("  ", None), ("one", None), ("A b  ", "x")]
    found = collocations.pieces(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(tuple(r) for r in found.collect()) == [("und", "one", 1, 1), ("x", "a b", 1, 2), ("x", "a b c d", 1, 4), ("x", "x", 1, 1), ("x", "\u00e9 b", 1, 2)]
    assert "CASE WHEN" in found._jdf.queryExecution().optimizedPlan().toString()


def test_empty(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0
