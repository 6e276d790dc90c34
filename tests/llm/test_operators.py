"""The ten operators against brute force on small tables, with the defined cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import random
import re
import time
import tracemalloc
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paceline.llm import components, decontaminate, html_text, jaccard_join, language_id, language_model, packing, quality, token_files, toxicity, url_filter
from paceline.llm.shared import new_path
from paceline.llm.textnp import chunks
from paceline.llm.tokens import Encoder, default_path

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UP, LOW)
#: Names that the operators use themselves.
CLASHES = ["spans", "h", "_id", "_h", "_th", "_url", "best", "_segments", "_d", "_t", "hit_id", "other_id", "rid", "pos", "w", "piece", "row", "cls", "d", "t"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = {"en": [a + b for a in ("the", "ing", "on", "er", "and") for b in ("", "s", "ly", "ed", ".", "th")], "fr": [a + b for a in ("éau", "le", "que", "çon", "ment") for b in ("", "x", "è", "re", ".", "tion")], "de": [a + b for a in ("über", "sch", "keit", "und", "zu") for b in ("", "en", "ß", "heit", ".", "ung")]}
    out = []
    for k in range(90):
        lang = ("en", "fr", "de")[k % 3]
        out.append((k, prose(rng, rng.randint(60, 160), vocabulary[lang]), lang))
    base = out[3][1].split()
    for k in range(90, 100):  # near copies of document 3, and copies
        w = list(base)
        if k % 2:
            w[rng.randrange(len(w))] = f"new{k}"
        out.append((k, " ".join(w).upper() if k == 92 else " ".join(w), "en"))
    out += [(100, None, "en"), (101, "", None), (102, " \n\t ", "en"), (103, "One", None), (104, "one", "en"), (105, "a\nb\na\na", "en"), (None, out[7][1], "en"), (106, out[8][1], "de"), (106, out[8][1], "de"), (107, "123 456 !!", "en"), (108, prose(rng, 6000, vocabulary["en"]), "en")]
    return [(i, t, lang, "src0", len(t or ""), *CLASHES) for i, t, lang in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def links(rows):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets, [[j for j, b in enumerate(sets) if j != i and a and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)]


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_join(docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    sets, near = links(rows)
    expected = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        expected.append((row[0], len(sets[i]), min(ids) if ids else None, len(near[i])))
    found = [tuple(r) for r in jaccard_join.join(docs).collect()]
    assert Counter(found) == Counter(expected)
    assert jaccard_join.join(empty).count() == 0


def test_one_of_each(docs, rows):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 3 in ids and not {90, 91, 94, 95} & set(ids) and ids.count(106) == 0 and {100, 101, 102} <= set(ids) and None in ids


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(0, k) for k in range(1000, 1400)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    found = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(x, x) == find(x) for x in root)


@pytest.mark.parametrize("most", [decontaminate.BLOCK, 7])
def test_decontaminate(spark, docs, rows, empty, most):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall((t or "").translate(LOWER))
    items = [(1, " ".join(rows[10][1].split()[5:40])), (2, "new91"), (3, None), (4, "..."), (10, " ".join(rows[10][1].split()[20:36])), (5, "The ings")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = cut(t)
        k = min(13, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    expected = []
    for i, t, *_ in rows:
        w, hit, got = cut(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    got |= windows[tuple(w[a : a + k])]
        expected.append((i, len(w), len(hit), len(got), bool(hit) and 20 * len(hit) >= len(w)))
    found = decontaminate.report(docs, bench, most)
    assert Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()) == Counter(expected)
    assert decontaminate.report(empty, bench, most).count() == 0
    assert decontaminate.report(docs, bench.limit(0), most).where("n_hit > 0").count() == 0
    left = decontaminate.decontaminate(docs, bench, "documents", most)
    assert left.columns == docs.columns and all(tuple(r)[5:] == tuple(CLASHES) for r in left.collect()) and left.count() == sum(not e[-1] for e in expected)
    cut_out = decontaminate.decontaminate(docs, bench, "spans", most)
    assert cut_out.columns == docs.columns and all(tuple(r)[5:] == tuple(CLASHES) for r in cut_out.collect())
    spans = {r["doc_id"]: r["text"] for r in cut_out.collect()}
    assert len(cut(spans[10])) == len(cut(rows[10][1])) - next(e[2] for e in expected if e[0] == 10) and spans[100] is None and spans[102] == " \n\t "


def test_decontaminate_long_texts(spark):
    """Windows across the borders of parts, in several passes; hits in copies of a row; a text of 400,000 words in linear time."""
    part, win = decontaminate.PART, decontaminate.WINDOW
    passage = [f"p{i}" for i in range(win)]
    bench = spark.createDataFrame([(7, " ".join(passage)), (8, "lone"), (9, " ".join(passage[3:] + ["q"]))], "item_id long, text string")
    rows, expected = [], []
    for i, at in enumerate([0, part - win - 1, part - win, part - win + 1, part - 5, part - 1, part, part + 1, 2 * part - 1]):
        words = [f"w{j}" for j in range(2 * part + win - 1)]
        words[at : at + win] = passage[: len(words) - at]
        rows += [(i, " ".join(words))] * 2
        expected += [(i, len(words), win if at + win <= len(words) else 0, int(at + win <= len(words)))] * 2
    rows.append((None, " ".join(["x"] * (part - 1) + ["lone"])))
    expected.append((None, part, 1, 1))
    for block in (decontaminate.BLOCK, 1):
        found = decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), bench, block)
        assert Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items").collect()) == Counter(expected)
    n = 400_000
    words = [f"w{j % 1000}" for j in range(n)]
    words[n - win - 1 : n - 1] = passage
    one = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    begun = time.monotonic()
    assert [tuple(r) for r in decontaminate.report(one, bench).select("n_words", "n_hit").collect()] == [(n, win)]
    assert time.monotonic() - begun < 30


@pytest.mark.parametrize(
    "inner, expected",
    [
        ("<p title=it's>{0}</p><p>It's second.</p><p>third</p>", "{0}\nIt's second.\nthird"),
        ("<p title=a\"b data-x='1>2' lang=x=\"y>{0}</p><p>\"second\" here</p>", "{0}\n\"second\" here"),
        ("<p title='what is hidden here' data-role=navigation data-class=\"ads\">{0}</p>", "{0}"),
        ("<p title=\"never closed>{0}</p><p>second</p>", "{0}\nsecond"),
        ("<p>{0} Let <math><mi>x</mi><annotation>tex</annotation></math> be</p>", "{0} Let x be"),
        ("<p>{0} Press <button>here <b>and</b> here</button> now to go.</p><p>next</p>", "{0} Press now to go.\nnext"),
        ("<p>{0} a<span hidden>b</span> c</p>", "{0} a c"),
        ("<p class='cookie-notice'>We use cookies.</p><p>{0}</p><p class='notice-of-death'>stays</p>", "{0}\nstays"),
        ("<p>{0}</p><object>shown <canvas>too</canvas></object>", "{0}\nshown too"),
    ],
)
def test_html_attributes_and_inline_elements(inner, expected):
    prose = "A long sentence of the article that says something. " * 4
    page = html_text.Page(f"<html><body><nav><a href=/>Home</a></nav><article>{inner.format(prose.strip())}</article></body></html>")
    assert page.text(page.path[page.choice()]) == expected.format(prose.strip())


def test_html_attributes_in_linear_time():
    begun = time.monotonic()
    for odd in ("<p a=\"", "<p a='x\" b=", "<p  =  = ", "=\"<a b", "<p " + " " * 9):
        html_text.Page(odd * 30_000)
    assert time.monotonic() - begun < 20


def test_url_filter(spark):
    urls = ["http://a.example.com/en/1?x=/es/", "https://www.example.com/en/", "http://net/es/2", "http://x.net/fr/#a", "http://x.net/fr", "HTTP://X.NET/ES/", "no url", None, "://", "http://com", "http://notexample.com/en/x", "http://a.example.com/en/1?x=/es/", "ftp://u@h.com:80/a"]
    found = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame([(i, u, "clash", "x", "y", "z") for i, u in enumerate(urls)], "page_id long, url string, host string, best string, _url string, of_url string"), spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA)).collect()}
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, default=(0, "allow", None))
        assert found[u] == (host, path, best[2], best[1])
    kept = url_filter.judge(spark.createDataFrame([("http://x.net/es/", "x", "y", "z")], "url string, best string, _url string, of_url string"), spark.createDataFrame(url_filter.RULES, url_filter.RULE_SCHEMA)).first()
    assert (kept["best"], kept["_url"], kept["of_url"], kept["verdict"]) == ("x", "y", "z", "block")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert url_filter.judge(spark.createDataFrame([("http://a.com/",)], "url string"), none).first()["verdict"] == "allow"


def test_quality(docs, rows, empty):
    found = {}
    for r in quality.judge(docs, quality.references(docs)).collect():
        found.setdefault(r["doc_id"], r)
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        count, repeated = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
            if count[x] > 1:
                repeated |= {k, k + 1, k + 2}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
        r = found[i]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated), failed)
        assert not (failed and r["kept"])
    assert found[0]["kept"] and not found[100]["kept"]
    assert quality.judge(empty, quality.references(empty)).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_language_id(docs, rows, empty):
    found = language_id.predict(docs, language_id.fit(docs)).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    held = [(i, lang) for i, t, lang, *_ in rows[:90] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 15 and np.mean([by_id[i]["lang_pred"] == lang for i, lang in held]) > 0.95
    assert {by_id[i]["lang_pred"] for i in (100, 101, 102, 107)} == {"und"} and all(0 <= r["score"] <= 1 for r in found)
    assert by_id[5]["held_out"] == (zlib.crc32(b"5") % 4 == 2)
    assert language_id.predict(empty, language_id.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    assert language_id.filter_documents(docs).columns == docs.columns


def test_language_model(docs, rows, empty):
    found = {}
    for r in language_model.train_and_score(docs).collect():
        found.setdefault(r["doc_id"], r)
    tokens = [words(t) + ["\0end"] for _, t, *_ in rows]
    count = Counter(w for (i, *_), t in zip(rows, tokens, strict=True) if i is not None and zlib.crc32(str(i).encode()) % 10 for w in t)
    total, kinds = sum(count.values()), len(count)
    better = 0
    for (i, *_), t in zip(rows, tokens, strict=True):
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(count[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t))
        assert r["score"] < 0
        better += r["score"] > r["base_score"]
    assert better > len(rows) / 2
    assert language_model.train_and_score(empty).count() == 0


def learned(docs):
    train = docs.where("doc_id is not null and crc32(cast(doc_id as string)) % 10 != 0")
    return language_model.learn(train, language_model.word_counts(train))


@pytest.mark.parametrize(("split", "splits", "words"), [(language_model.SPLIT, language_model.SPLITS, range(1)), (200, 1000, range(1, 1000)), (10, 100, range(1, 100))])
def test_context_probabilities_add_up_to_one(docs, monkeypatch, split, splits, words):
    """words: how many are split, fewer than splits."""
    monkeypatch.setattr(language_model, "SPLIT", split)
    monkeypatch.setattr(language_model, "SPLITS", splits)
    monkeypatch.setattr(language_model, "HELD", 500)
    model, pairs = learned(docs)
    assert pairs.where("kind = 0 and part > 0").select("w").distinct().count() in words
    p_word = {r["w"]: 10 ** r["logq"] for r in language_model.priced_words(pairs, model).collect()}
    assert sum(p_word.values()) + model.parent.unknown == pytest.approx(1, abs=1e-6) and len(p_word) == model.kinds
    by_context = {}
    for r in language_model.priced(pairs, model, 0, 1 << 62).collect():
        by_context.setdefault(r["key"] & 0xFFFF, {})[r["key"] & ~0xFFFF] = 10 ** r["logp"]
    assert len(by_context) > 50
    for ctx, found in by_context.items():
        assert sum(found.values()) + model.back[ctx] * (1 - sum(p_word[w] for w in found)) == pytest.approx(1, abs=1e-3)


def one_by_one(pairs, kinds, sweeps, burn_in, rng):
    """A plain sampler of both levels, one customer at a time: predictive probability of each pair, averaged."""
    (d, s), (dp, sp) = language_model.CONTEXT, language_model.PARENT
    tables = {k: [1] * n for k, n in pairs.items()}  # customers of each table
    above = {}
    for (_, w), t in tables.items():
        above.setdefault(w, []).extend([1] * len(t))

    def p_parent(w):
        own = above.get(w, [])
        customers, at = sum(map(sum, above.values())), sum(map(len, above.values()))
        return (sum(own) - dp * len(own) + (sp + dp * at) / (kinds + 1)) / (sp + customers)

    def leave(seats):
        k = rng.choices(range(len(seats)), seats)[0]
        seats[k] -= 1
        if not seats[k]:
            del seats[k]
            return True
        return False

    def enter(seats, discount, fresh):
        weights = [x - discount for x in seats] + [fresh]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(seats):
            seats.append(1)
            return True
        seats[k] += 1
        return False

    total = Counter()
    for r in range(sweeps):
        for (u, w), n in pairs.items():
            for _ in range(n):
                if leave(tables[(u, w)]):
                    leave(above[w])
                t = sum(len(x) for (c, _), x in tables.items() if c == u)
                if enter(tables[(u, w)], d, (s + d * t) * p_parent(w)):
                    own = above.setdefault(w, [])
                    enter(own, dp, (sp + dp * sum(map(len, above.values()))) / (kinds + 1))
        if r >= burn_in:
            for (u, w), n in pairs.items():
                c = sum(m for (x, _), m in pairs.items() if x == u)
                t = sum(len(x) for (y, _), x in tables.items() if y == u)
                total[(u, w)] += ((n - d * len(tables[(u, w)])) + (s + d * t) * p_parent(w)) / (s + c) / (sweeps - burn_in)
    return total


def test_model_agrees_with_a_plain_sampler(spark):
    rng = random.Random(3)
    texts = [prose(rng, 12, ["a", "a", "a", "b", "b", "c", "d", f"x{k}"]) for k in range(14)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model, pairs = language_model.learn(docs, language_model.word_counts(docs))
    counted = Counter()
    for t in texts:
        w = ["\0", *t.split(), "\0"]
        counted.update(zip(w, w[1:], strict=False))
    plain = one_by_one(counted, len({w for _, w in counted}), 60, 20, rng)
    found = sorted(10 ** r["logp"] for r in language_model.priced(pairs, model, 0, 1 << 62).collect())
    assert len(found) == len(plain)
    assert np.abs(np.log(found) - np.log(sorted(plain.values()))).mean() < 0.15


@pytest.mark.parametrize(("frequent", "pairs", "held"), [(200_000, 1_000_000, 2_000_000), (20, 40, 300), (10, 100_000, 2000)])
def test_scores_add_up_the_prices_of_pairs_and_words(docs, rows, monkeypatch, frequent, pairs, held):
    """Frequent words and pairs, and the others, which meet their prices by bucket; no key is joined or sorted row by row."""
    kept, learn = [], language_model.learn
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    monkeypatch.setattr(language_model, "PAIRS", pairs)
    monkeypatch.setattr(language_model, "HELD", held)
    monkeypatch.setattr(language_model, "learn", lambda train, words: kept.append(learn(train, words)) or kept[0])
    scores = language_model.train_and_score(docs)
    assert "Join" not in scores._jdf.queryExecution().executedPlan().toString()
    found = {r["doc_id"]: r for r in scores.collect()}
    model, table = kept[0]
    price = {r["key"]: r["logp"] for r in language_model.priced(table, model, 0, 1 << 62).collect()}
    word = {r["w"]: r["logq"] for r in language_model.priced_words(table, model).collect()}
    find = language_model.Lookup(model.own)
    for i, text, *_ in rows:
        h, shape, of = language_model.tokens(next(chunks(pa.array([text], pa.string()))))
        key = language_model.keys(h, shape, of, find)
        expected = 0.0
        for k, signed in zip(key, key.astype(np.int64).tolist(), strict=True):
            w = int((k & ~language_model.LOW).astype(np.int64))
            expected += price[signed] if signed in price else np.log10(model.back[int(k & language_model.LOW)]) + word.get(w, np.log10(model.parent.unknown))
        assert found[i]["score"] == pytest.approx(expected, rel=1e-5), i


@pytest.mark.parametrize(("most", "frequent", "pairs"), [(1, 200_000, 1_000_000), (12, 20, 40), (40, 10, 1_000_000)])
def test_every_word_is_a_context_of_its_own(docs, rows, monkeypatch, most, frequent, pairs):
    """Also those beyond the numbered ones: scores by their own counts, and probabilities that add up to one."""
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    monkeypatch.setattr(language_model, "PAIRS", pairs)
    train = docs.where("doc_id is not null and crc32(cast(doc_id as string)) % 10 != 0")
    counted = language_model.word_counts(train)
    model, table = language_model.learn(train, counted, most)
    price = {r["key"]: 10 ** r["logp"] for r in language_model.priced(table, model, 0, 1 << 62).collect()}
    word = {r["w"]: 10 ** r["logq"] for r in language_model.priced_words(table, model).collect()}
    assert {r["w"]: r["c"] for r in language_model.priced_words(table, model).collect()} == {int(np.int64(np.uint64(r["hash"] % 2**64) & ~language_model.LOW)): r["n"] for r in counted.collect()}
    (d, s), find, low = language_model.CONTEXT, language_model.Lookup(model.own), int(language_model.LOW)

    def pairs_of(text):
        h, shape, of = language_model.tokens(next(chunks(pa.array([text], pa.string()))))
        return list(zip([0, *h.tolist()], language_model.keys(h, shape, of, find).tolist(), strict=False))

    def shared(key):
        signed = int(np.uint64(key).astype(np.int64))
        return price[signed] if signed in price else model.back[key & low] * word.get(signed - (signed & low), model.parent.unknown)

    own, seen, kinds = Counter(), Counter(), Counter()
    for i, text, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            own.update(x for x in pairs_of(text) if x[1] & low >= language_model.OWN)
    for (before, _), n in own.items():
        seen[before] += n
        kinds[before] += 1
    assert len(seen) > 20

    def p(before, key):
        if key & low < language_model.OWN:
            return shared(key)
        return (max(own[before, key] - d, 0) + (s + d * kinds[before]) * shared(key)) / (s + seen[before])

    found = {r["doc_id"]: r for r in language_model.score(docs, counted, model, table).collect()}
    for i, text, *_ in rows:
        assert found[i]["score"] == pytest.approx(sum(np.log10(p(*x)) for x in pairs_of(text)), rel=1e-5), i
    followers = {}
    for before, key in own:
        followers.setdefault(before, key & low)
    for before, shape in list(followers.items())[:20]:
        every = sum(p(before, (w % 2**64) | shape) for w in word)
        assert every + (s + d * kinds[before]) / (s + seen[before]) * model.back[shape] * model.parent.unknown == pytest.approx(1, abs=1e-3)


def test_pairs_travel_as_blocks(docs):
    """Not as a row per pair: the rows that are dealt to buckets don't grow with a task's pairs."""
    train = docs.where("doc_id is not null and crc32(cast(doc_id as string)) % 10 != 0").coalesce(1)
    model, pairs = language_model.learn(train, language_model.word_counts(train))
    blocks = language_model.price_blocks(pairs.coalesce(1), model, 1 << 62, 0, 4)
    assert blocks.count() <= 2 * 4 < pairs.where("kind = 0").count()


def test_toxicity(spark, rows, empty):
    rng = random.Random(2)
    many = [(k, prose(rng, 30, ["alpha", "beta", "gamma", "delta", "epsilon"]) + (" " + rng.choice(["vilest", "vilesto,", "Scumbag"]) if k % 6 == 0 else "")) for k in range(600)] + [(700, None), (701, "")]
    d = spark.createDataFrame(many, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(600)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(d, toxicity.fit(d, labels)).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(found[k]["held_out"] for k in held) and all(found[k]["predicted"] == int(k % 6 == 0) for k in held)
    assert all(0 <= r["score"] <= 1 for r in found.values()) and found[700]["predicted"] == 0
    assert {r["predicted"] for r in toxicity.score(d, toxicity.fit(d, labels.limit(0))).collect()} == {0}
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def encoded(rows, end):
    plain = Encoder(default_path()).tokenizer
    return [np.array(plain.encode(t or "", add_special_tokens=False).ids + [end], "<u4") for _, t, *_ in rows]


def test_token_files(spark, docs, rows, empty):
    manifest = token_files.write(docs, new_path(spark, "tokens"), default_path(), length=64, files=3)
    found = sorted((tuple(r) for r in token_files.read(manifest).collect()), key=lambda r: r[1])
    ids = encoded(rows, 1)
    assert [r[0] for r in found] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    at = 0
    for doc_id, start, n, crc in found:
        assert start == at and (n, crc) in {(len(x), zlib.crc32(x)) for (i, *_), x in zip(rows, ids, strict=True) if i == doc_id}
        at += n
    file = token_files.TokenFile(manifest.orderBy("shard").first()["file"])
    whole = np.concatenate(list(file.batches()))
    for k in (0, 5, len(whole) // 64 - 1):
        seq, mask = file.sequence(k)
        assert (seq == whole[k * 64 : k * 64 + 64]).all() and (k == len(whole) // 64 - 1 or mask.all())
    assert token_files.read(token_files.write(empty, new_path(spark, "tokens"), default_path())).count() == 0


def test_encoder_matches_library():
    e = Encoder(default_path())
    odd = ["", "áb. É́", "don't. I'll! x<|endoftext|>y", "ΑΣ. ΑΣ ΑΣ.Β", "  two   spaces\t\x1ctab", "İ. ß!! ﬁ. 漢字, 123. a1. !!!", "\r\n x", "e.́", "ÀÉß. ªº µ. ÿ"]
    for text in odd * 2:
        assert e.ids(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, rows, empty):
    ids = encoded(rows, 2)
    found = packing.pack(docs, default_path(), capacity=256).collect()
    crcs = Counter()
    for (i, *_), x in zip(rows, ids, strict=True):
        for s in range(0, len(x), 256):
            crcs[(i, s, len(x[s : s + 256]), zlib.crc32(x[s : s + 256]), len(x))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found) == crcs
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty, default_path()).count() == 0
    filled = packing.sequences(docs, default_path(), capacity=256).collect()
    assert sum(r["n_tokens"] for r in filled) == sum(map(len, ids)) and all(len(r["ids"]) <= 256 for r in filled)


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(rng.integers(1, 65, 5000), return_counts=True)
    plan = packing.solve(sizes, counts, 64)
    assert (sum(p * t for p, t in plan) == counts).all() and all(p @ sizes <= 64 for p, _ in plan)
    assert sum(t for _, t in plan) <= np.ceil(sizes @ counts / 64) * 1.01 + 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page-12"><header class="site"><h1>Site</h1></header><nav><a href=x>Home</a></nav><form><div id="main">
<div class="cookie-notice">We use cookies, please accept all of them now.</div><main><article class="post post-77"><header><h1>Title &amp; more</h1><span>By me</span></header><section><p>First   para&nbsp;x.<p>Second <a href=1>link</a> para
with text<ul><li>One<li>Two</ul></section><section><p>Third para is here.</p></section><div class="comments"><p>A reader says a lot of things here, more than the whole article together, so that it would win by length alone.</p></div></article>
<aside>side</aside></main></div></form><footer>foot</footer><script>var a="<p>no</p>";</script></body></html>"""


def test_html_text(spark):
    pages = [(1, "http://a.com/1", PAGE), (2, "http://a.com/2", PAGE.replace("post-77", "post-78")), (3, None, None), (4, "x", ""), (5, "http://b.com/", "just text &lt;b&gt;"), (6, "http://b.com/", "<div><p>cut off <b>he"), (1, "http://a.com/1", PAGE)]
    found = html_text.extract(spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")).collect()
    assert len(found) == 7
    by_id = {r["page_id"]: r for r in found}
    assert by_id[1]["text"] == by_id[2]["text"] == "Title & more\nFirst para x.\nSecond link para with text\nOne\nTwo\nThird para is here."
    assert (by_id[3]["text"], by_id[4]["text"], by_id[5]["text"], by_id[6]["text"]) == ("", "", "just text <b>", "cut off he")
    assert by_id[1]["n_chars"] == len(by_id[1]["text"])
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


L = "A long sentence goes on and on here, with commas. " * 8


@pytest.mark.parametrize(("html", "text"), [
    (f'<body><nav>menu</nav><article><h2 class="notice-title">Note</h2><p class="related-work">Related work.</p><p>{L}</p></article><footer>x</footer></body>', f"Note\nRelated work.\n{L.strip()}"),
    (f'<main><h1>Head line</h1><p>Lead.</p><div class="body"><p>{L}</p><p>{L}</p></div></main>', f"Head line\nLead.\n{L.strip()}\n{L.strip()}"),
    (f'<body><article><h1>T</h1><p>{L}</p></article><ol class="commentlist">{f"<li><b>Bob</b><p>{L}</p></li>" * 6}</ol></body>', f"T\n{L.strip()}"),
    (f'<body><article><h1>T</h1><p>{L}</p><section id="responses">{f"<div><b>Bob</b><p>{L}</p></div>" * 2}</section></article></body>', f"T\n{L.strip()}"),
    (f'<body><article><h1>T</h1><p>{L}</p></article><div>{f"<div class=x><b>Bob</b><p>{L}</p><a>Reply</a></div>" * 3}</div></body>', f"T\n{L.strip()}"),
    (f'<body><div id="wrap"><h1>T</h1><p>{L}</p><label>Name</label><div class="cookie-notice"><p>We use cookies</p></div></div></body>', f"T\n{L.strip()}"),
    (f"<article><header><h1>Top</h1><p>By me</p></header><section><p>{L}</p></section><section><p>{L}</p></section></article>", f"Top\n{L.strip()}\n{L.strip()}"),
    ('<body><div class="ad">Buy now, a rather long advertisement text.</div><article><h1>Tiny</h1><p>Text.</p></article></body>', "Tiny\nText."),
    (f'<body><div class="widget-content"><p>{L}</p><p>{L}</p></div><nav>menu</nav></body>', f"{L.strip()}\n{L.strip()}"),
])
def test_html_cases(html, text):
    page = html_text.Page(html)
    assert page.text(page.path[page.choice()]) == text


def test_html_random_trees():
    """Articles of nested plain elements between menus and footers, against what was put in."""
    rng = random.Random(8)
    for _ in range(200):
        blocks = []

        def tree(depth, blocks=blocks):
            if depth == 0 or rng.random() < 0.4:
                tag, words = rng.choice(["p", "h2", "blockquote", "p", "p"]), prose(rng, rng.randint(8, 40), ["alpha", "beta,", "gamma.", "related", "comment"])
                blocks.append(words)
                return f"<{tag}>{words}</{tag}>"
            tag = rng.choice(["div", "section", "div class='inner-x'"])
            return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag.split()[0]}>"

        inside = "".join(tree(3) for _ in range(rng.randint(2, 5)))
        page = html_text.Page(f"<body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>The title</h1>{inside}</article><aside><p>{prose(rng, 20, ['side'])}</p></aside><footer>foot</footer></body>")
        assert page.text(page.path[page.choice()]) == "\n".join(["The title", *blocks])


def test_deep_and_repeated_pages(spark):
    for html in ('<div class="a">' * 100_000 + "text here", "<b>" * 20_000 + "</i>" * 20_000 + "<p>x</p>", "<p>a" * 50_000, "<ul>" + "<li>x" * 50_000):
        page = html_text.Page(html)
        assert page.text(page.path[page.choice()])
    long = f"<body><article><h1>T</h1>{f'<p>{L}</p>' * 5000}</article></body>"
    found = html_text.extract(spark.createDataFrame([(1, "http://a.com/", long), (2, "http://a.com/", '<div class="a">' * 20_000 + "text")], "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["n_chars"] for r in found} == {1: 1 + 5000 * len(L.strip()) + 5000, 2: 4}


def test_label_model_finds_accuracies_and_correlations():
    """Voters of known accuracy, two of them copies of one another, few labels: posteriors near those of the true model."""
    rng = np.random.default_rng(5)
    n = 40_000
    y = rng.random(n) < 0.2
    said = np.zeros((n, toxicity.VOTERS), np.int64)
    for k, (hit, wrong) in enumerate([(0.7, 0.02), (0.5, 0.05), (0.6, 0.1), (0.4, 0.01)]):
        said[:, k] = np.where(rng.random(n) < np.where(y, hit, wrong), 2, 0)
    said[:, 4] = said[:, 2]
    said[:, 7] = np.where(rng.random(n) < np.where(y, 0.1, 0.6), 1, 0)
    key = said @ 3 ** np.arange(toxicity.VOTERS)
    every = {int(k): float(c) for k, c in zip(*np.unique(key, return_counts=True), strict=True)}
    known = Counter((int(k), int(t)) for k, t in zip(key[:1500], y[:1500], strict=True))
    posterior, share = toxicity.label_model(every, {k: float(c) for k, c in known.items()})
    assert share == pytest.approx(0.2, abs=0.03)
    truth = {k: np.mean(y[key == k]) for k in every if every[k] > 300}
    assert max(abs(posterior[k] - p) for k, p in truth.items()) < 0.12
    parent = toxicity.tree(said, [(~y).astype(float), y.astype(float)])
    assert parent[4] == 2 or parent[2] == 4


def test_voters_vote_both_ways():
    from paceline.llm.textnp import chunks
    import pyarrow as pa

    texts = ["clean words " * 20, "vilest stuff", "v1lest stuff", "", None, "VILEST VILEST VILEST THINGS!"]
    (c,) = chunks(pa.array(texts, pa.string()))
    h, kind, _ = toxicity.terms(next(iter(chunks(pa.array(["vilest"])))))
    order = np.argsort(h)
    h, kind, text = h[order], kind[order], None
    hidden, _ = toxicity.disguised(next(iter(chunks(pa.array(["v1lest"])))))
    words = np.append(h, hidden ^ np.uint64(0xD15C))
    kinds = np.append(kind, toxicity.DISGUISED)
    order = np.argsort(words)
    clean_start, clean_end, _ = c._spans(toxicity.INSIDE[c.data])
    model = {"words": words[order], "kinds": kinds[order], "odds": np.ones(len(words)), "clean": np.unique(c.hashes(clean_start, clean_end, lower=True)[:2]), "loud": True}
    v, *_ = toxicity.votes(c, model, toxicity.kinds_of(model))
    digits = [[int(x) // 3**k % 3 for k in range(toxicity.VOTERS)] for x in v]
    assert digits[0][6] == 1 and digits[0][7] == 1 and digits[1][0] == 2 and digits[1][6] == 2
    assert digits[2][5] == 2 and digits[2][0] == 0 and digits[3] == digits[4] == [0] * toxicity.VOTERS and digits[5][8] == 2


def slow_distance(p, q):
    """Jensen-Shannon divergence in bits of two histograms as dicts."""
    total = 0.0
    for k in set(p) | set(q):
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + b) / 2
        total += (a * np.log2(a / m) if a else 0.0) / 2 + (b * np.log2(b / m) if b else 0.0) / 2
    return total


def test_quality_verdicts_against_brute_force(spark):
    rng = random.Random(6)
    common = {lang: [lang + a + b for a in "bcd" for b in "aeiou"] for lang in ("qa", "wu")}
    given = [(k, prose(rng, rng.randint(40, 400), common[lang]), lang) for k, lang in enumerate(["qa", "wu"] * 60)]
    given += [(200 + k, " ".join("".join(rng.choice("xyz0#%") for _ in range(5)) for _ in range(rng.randint(60, 300))), "qa") for k in range(6)] + [(300, common["qa"][0] + " b" * 100, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string")
    refs = {}
    for lang in ("qa", "wu", None):
        w = [x for _, t, of in given if of == lang for x in words(t)]
        if len(w) < quality.LEAST_WORDS:
            continue
        count = Counter(w)
        share = {x: n / len(w) for x, n in count.items() if n >= quality.COMMON * len(w)}
        share[None] = 1 - sum(share.values())
        chars = Counter(int(quality.CLASS[b]) for _, t, of in given if of == lang for b in t.encode() if b & 0xC0 != 0x80)
        refs[lang or ""] = ({k: v / chars.total() for k, v in chars.items()}, share)
    found = {r["doc_id"]: r for r in quality.judge(docs, quality.references(docs)).collect()}
    over = lambda q, n: sum(min(1, n * x) for x in q.values()) / (8 * np.log(2) * n) * quality.CHANCE
    for i, t, lang in given:
        w, chars = words(t), Counter(int(quality.CLASS[b]) for b in t.encode() if b & 0xC0 != 0x80)
        best = None
        for name in sorted(refs):
            q_chars, q_words = refs[name]
            hist = Counter(x if x in q_words else None for x in w)
            dw = max(slow_distance({k: v / len(w) for k, v in hist.items()}, q_words) - over(q_words, len(w)), 0) ** 0.5
            dc = max(slow_distance({k: v / chars.total() for k, v in chars.items()}, q_chars) - over(q_chars, chars.total()), 0) ** 0.5
            if best is None or dw + dc < best[0] - 1e-9:
                best = (dw + dc, dw, dc, name)
        r = found[i]
        assert (r["word_distance"], r["char_distance"]) == (pytest.approx(best[1], abs=1e-6), pytest.approx(best[2], abs=1e-6)) and r["reference"] == best[3]
        far = len(w) >= quality.MIN_WORDS and best[1] > quality.MAX_WORD_DISTANCE or chars.total() >= quality.MIN_CHARS and best[2] > quality.MAX_CHAR_DISTANCE
        assert r["kept"] == (not r["base_failed"] and not (far and (lang or "") in refs))
    assert not all(r["kept"] for r in found.values())


def test_lines_of_two_letters_do_not_collide(spark):
    """A pair of lines that every polynomial modulo a power of two confuses."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    r = quality.judge(spark.createDataFrame([(1, f"{a}\n{b}", "en")], "doc_id long, text string, lang string"), {}).first()
    assert r["n_dup_lines"] == 0


@pytest.mark.parametrize("n", [1, 9, 17, 33, 100])
def test_short_pieces_leave_little_padding(spark, n):
    pieces = spark.range(3000).select(F.col("id").alias("piece"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(n).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    found = packing.assign(pieces).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 4096 for r in found)
    full = 4096 // n * n
    assert 3000 * n >= 0.98 * full * (len(found) - 1)


def test_ids_of_other_types(spark):
    named = spark.createDataFrame([("a", "one two", "en"), ("b", "one two three", "en")], "doc_id string, text string, lang string")
    for f in (jaccard_join.join, language_model.train_and_score, lambda d: quality.judge(d, {})):
        with pytest.raises(TypeError):
            f(named)
    assert {r["doc_id"] for r in packing.pack(named, default_path()).collect()} == {"a", "b"}


def test_chain_of_blocks(spark, monkeypatch):
    """Classes chained by common shingles alone: one large component, whose classes meet few blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    rng = random.Random(2)
    fresh = iter(range(10**6))
    word = lambda: f"w{next(fresh)}"
    texts, last = [], [word() for _ in range(12)]
    for _ in range(300):
        after = [word() for _ in range(12)]
        texts.append(" ".join(last + after))
        last = after
    texts += [" ".join([*t.split()[:-1], "changed"]) for t in texts[:10]]
    given = [(k, t) for k, t in enumerate(texts)]
    found = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.join(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert rng and all(found[k] == (k, int(k < 10)) for k in range(300)) and all(found[300 + k] == (k, 1) for k in range(10))


def test_hot_shingles(spark, monkeypatch):
    """A passage in the prefixes of all texts: salted hubs, blocks by length, pairs of blocks in parts, and no link lost."""
    for name, value in (("BLOCK", 8), ("FEW", 2), ("OFTEN", 10)):
        monkeypatch.setattr(jaccard_join, name, value)
    passage = [f"common{k}" for k in range(40)]
    texts = [" ".join(passage + [f"own{k}-{j}" for j in range(k % 20)] + [f"last{k}"]) for k in range(160)]
    texts += [" ".join(passage[:30] + [f"far{k}-{j}" for j in range(100)]) for k in range(20)]
    _, near = links([(k, t) for k, t in enumerate(texts)])
    heads, met = [], set()
    partners = jaccard_join.partners

    def watched(h):
        heads.extend(h.collect())
        met.update((r["cls"], r["other"]) for r in partners(h).collect())
        return partners(h)

    monkeypatch.setattr(jaccard_join, "partners", watched)
    found = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {k: n for k, (_, n) in found.items()} == {k: len(x) for k, x in enumerate(near)} and any(near) and not all(near)
    first = min(k for k, x in enumerate(near) if x)
    assert all(found[k][0] == (first if x else k) for k, x in enumerate(near))
    held = {(r["hash"], r["cls"]): r for r in heads}
    assert len({r["block"] for r in held.values()}) > 4
    by_hash = {}
    for (h, _), r in held.items():
        by_hash.setdefault(h, []).append(r)
    pairs = {(a["cls"], b["block"]) for rows in by_hash.values() for a in rows for b in rows if 80 * max(a["n"], b["n"]) <= 100 * min(a["n"], b["n"])}
    assert pairs <= met


def test_close_languages(spark):
    """Languages of one family with many words in common: held-out texts are told apart by the pair's own model."""
    words_of = {
        "da": "og i at det er en til på som af med for ikke den har jeg et de var han kun meget efter også blev nogle uden igen hvad sige mig noget lidt vej siger hjælp",
        "no": "og i at det er en til på som av med for ikke den har jeg et de var han bare veldig etter også ble noen uten igjen hva si meg noe litt vei sier hjelp",
        "es": "el la de que y en los se del las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también",
        "pt": "o a de que e em os se do as por um para com não uma seu ao lo como mais mas seus lhe já ou este sim porque esta entre quando muito sem sobre também",
    }
    rng = random.Random(11)
    given = [(k * 4 + j, " ".join(rng.choices(w.split(), k=30)), lang) for k in range(90) for j, (lang, w) in enumerate(words_of.items())]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string")
    assert language_id.FAMILY_OF["da"] == language_id.FAMILY_OF["no"] != language_id.FAMILY_OF["es"] == language_id.FAMILY_OF["pt"]
    truth = {i: lang for i, _, lang in given if zlib.crc32(str(i).encode()) % 4 == 2}
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    for lang in words_of:
        own = [found[i] == lang for i, x in truth.items() if x == lang]
        assert len(own) > 10 and sum(own) >= 0.95 * len(own)


def test_language_features_stay_with_their_text():
    """A text's features are the same alone and before other texts."""
    texts = ["a", "Ésa", "naïve b", "ça", "", "日本", "я"]
    (c,) = chunks(pa.array(texts), 1 << 16)
    text, cell, weight = language_id.vectors(c)
    for i, t in enumerate(texts):
        (own,) = chunks(pa.array([t]), 1 << 16)
        _, alone, w = language_id.vectors(own)
        assert np.array_equal(cell[text == i], alone) and np.array_equal(weight[text == i], w)


def test_language_models_are_fitted_in_little_memory():
    """A model's features lie side by side in few bytes each, so that two tasks of an executor fit many texts."""
    rng = random.Random(5)
    texts = [prose(rng, 600, ["".join(rng.choices(LOW, k=5)) for _ in range(300)]) for _ in range(1000)]
    y = np.where(np.arange(len(texts)) % 2, 1, -1)
    given = pa.array(texts)
    tracemalloc.start()
    try:
        w = language_id.fit_model(given, y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 15 * sum(map(len, texts)) + 25e6 and w.shape == (language_id.CELLS + 1,)


def test_pipeline_hands_documents_over_in_small_batches(spark, docs, sf_dir):
    """Whole documents go to Python at most BATCH at once; a smaller bound that is set already stays."""
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for given, expected in (("10000", corpus_pipeline.BATCH), ("0", corpus_pipeline.BATCH), ("7", 7)):
        spark.conf.set(name, given)
        try:
            corpus_pipeline.small_batches(spark)
            largest = spark.range(0, 3000, 1, 1).mapInArrow(lambda batches: (pa.record_batch({"n": [len(b)]}) for b in batches), "n long").agg(F.max("n")).first()[0]
            assert largest == expected
            if given == "10000":
                spark.conf.set(name, given)
                corpus_pipeline.quality_rules(spark, docs, sf_dir)
                assert spark.conf.get(name) == str(expected)
        finally:
            spark.conf.unset(name)


def test_pipeline_stages(spark, docs, rows, sf_dir):
    """Every stage keeps what its rule keeps, of its own input, with all columns."""
    import corpus_pipeline

    def key(r):
        return (r["doc_id"], r["text"])

    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, sf_dir)
        seen[name] = (before, out)
        if name != "packing":
            assert out.columns == docs.columns and all(tuple(r)[5:] == tuple(CLASHES) for r in out.collect())
    before, out = seen["quality rules"]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(before.withColumn("doc_id", F.xxhash64("doc_id", "lang", "text")), quality.references(before)).collect()}
    assert Counter(map(key, out.collect())) == Counter(key(r) for r in before.withColumn("x", F.xxhash64("doc_id", "lang", "text")).collect() if kept[r["x"]])
    before, out = seen["language ID"]
    kept = {r["doc_id"]: r["lang_pred"] != "und" and r["score"] >= language_id.LEAST_SCORE for r in language_id.predict(before.withColumn("doc_id", F.xxhash64("doc_id", "text")), language_id.fit(before)).collect()}
    assert Counter(map(key, out.collect())) == Counter(key(r) for r in before.withColumn("x", F.xxhash64("doc_id", "text")).collect() if kept[r["x"]])
    before, out = (x.collect() for x in seen["near copies"])
    _, near = links([(r["doc_id"], r["text"]) for r in before])
    alone = [key(r) for i, r in enumerate(before) if not near[i] or r["doc_id"] is None]
    assert not Counter(alone) - Counter(map(key, out)) and len({r["doc_id"] for r in out} & {3, *range(90, 100)}) == 1
    before, out = (x.collect() for x in seen["decontamination"])
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").translate(LOWER))
    items = [cut(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[a : a + 13]) for w in items if w for a in range(max(1, len(w) - 12))}
    dirty = lambda w: (n := len({a + j for k in {len(x) for x in windows} for a in range(len(w) - k + 1) if tuple(w[a : a + k]) in windows for j in range(k)})) and 20 * n >= len(w)
    assert Counter(map(key, out)) == Counter(key(r) for r in before if not dirty(cut(r["text"])))
    before, out = seen["packing"]
    assert {"doc_id", "start", "length", "sequence_id"} <= set(out.columns)
    ids = encoded([(r["doc_id"], r["text"]) for r in before.collect()], 2)
    assert out.agg(F.sum("length")).first()[0] == sum(map(len, ids))


def ways(n, d):
    """log of the generalised Stirling numbers of n customers, by their recurrence."""
    out, t = np.append(0.0, np.full(n + 1, -np.inf)), np.arange(1, n + 2)
    for m in range(n):
        out[1:] = np.logaddexp(out[:-1], np.where(t <= m, out[1:] + np.log(np.maximum(m - d * t, 1e-300)), -np.inf))
        out[0] = -np.inf
    return out[1 : n + 1]


@pytest.mark.parametrize("n", [2, 60, 700, 6000])
def test_seats_converge(n):
    """From one table, the chain finds the mean of the exact distribution, whatever the count."""
    t = np.arange(1, n + 1)
    for d, s, base in ((0.7, 2.0, 1 / 640), (0.7, 10.0, 0.3), (0.5, 5.0, 0.9)):
        log_p = ways(n, d) + t * np.log(base) + np.concatenate(([0.0], np.cumsum(np.log(s + d * t[:-1]))))
        p = np.exp(log_p - log_p.max())
        exact = (p * t).sum() / p.sum()
        means = []
        for k in range(8):
            rng, now = np.random.default_rng(k), np.array([1])
            for sweep in range(400):
                now, mean = language_model.seat(np.array([n]), np.array([d * rng.gamma(s / d + now[0]) * base]), d, rng)
                assert 1 <= now[0] <= n
                if sweep >= 30:
                    means.append(mean[0])
        assert np.mean(means) == pytest.approx(exact, rel=0.04)


def test_one_of_each_keeps_nulls_and_shared_ids(spark):
    rng = random.Random(9)
    a, b, c, d = (prose(rng, 60, [x + y for x in "bcdfghklmn" for y in "aeiou"]) for _ in range(4))
    given = [(1, a), (1, a), (None, b), (None, b), (None, None), (None, c), (2, ""), (2, ""), (3, b), (3, c), (4, d), (5, d + " end"), (5, a + " end"), (6, a)]
    found = jaccard_join.one_of_each(spark.createDataFrame(given, "doc_id long, text string"))
    assert Counter(tuple(r) for r in found.collect()) == Counter([(1, a), (None, b), (None, b), (None, None), (None, c), (2, ""), (2, ""), (3, b), (3, c), (4, d)])


def test_quality_keeps_rare_languages(spark):
    """Languages of under 1 % of the rows, with a reference and too small for one."""
    rng = random.Random(4)
    common = {lang: [lang + a + b for a in "bcdfgh" for b in "aeiou"] for lang in ("qa", "wu", "zy", "ki", "mo")}

    def text(lang, n):
        return " ".join(rng.choice(common[lang]) if rng.random() < 0.5 else lang + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))

    given = [(k, text("qa", 60), "qa") for k in range(700)] + [(1000 + 10 * j + k, text(lang, 1500), lang) for j, lang in enumerate(("wu", "zy", "ki")) for k in range(5)] + [(2000, text("mo", 800), "mo")]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string")
    refs = quality.references(docs)
    assert sorted(refs) == ["ki", "qa", "wu", "zy"]
    found = {r["doc_id"]: r for r in quality.judge(docs, refs).collect()}
    assert all(found[i]["kept"] for i, _, lang in given if lang != "qa") and all(found[i]["reference"] == lang for i, _, lang in given if lang in ("wu", "zy", "ki"))
