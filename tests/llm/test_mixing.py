"""Operator 11 against a sequential mix of the same keys."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from paceline.llm import mixing

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["bucket", "offset", "end", "size", "target", "taken", "weight", "cap", "key", "start", "source_size"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES)


def refill(sizes, weights, most, share):
    """Targets by the rule in words: share by weight, stop at most times the size, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target = dict.fromkeys(names, Fraction(0))
    excess, open_ = sum(sizes.values()) * Fraction(*share), set(names)
    while excess and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / total
        excess = Fraction(0)
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                excess += target[s] - most * sizes[s]
                target[s] = Fraction(most * sizes[s])
                open_.remove(s)
    return target


def brute(rows, weights=(5, 2, 1), most=3, share=(1, 1)):
    groups = defaultdict(list)
    for doc, text, source in rows:
        key = hashlib.md5(f":{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()[:15]
        groups[source].append((key, doc is not None, doc or 0, len(WORDS.findall(text or ""))))
    sizes = {s: sum(g[3] for g in group) for s, group in groups.items()}
    out = []
    for source, target in refill(sizes, weights, most, share).items():
        size, start = sizes[source], 0
        epochs, rest = divmod(int(target + Fraction(1, 2)), size) if size else (0, 0)
        for _, known, doc, n in sorted(groups[source]):
            out.append((doc if known else None, n, size, round(float(target), 6), epochs * n + max(0, min(n, rest - start))))
            start += n
    return Counter(out)


def rows_of(rng, n, sources):
    out = [(k, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 7, 40, 400]))), sources[min(int(rng.expovariate(0.8)), len(sources) - 1)]) for k in range(n)]
    out += [(None, "a b", "s1"), (None, "a b", "s1"), (None, None, None), (n, "", "void"), (n, None, "void"), (n + 1, "x \t\n y\x0b z z", "\U0001f600"), (n + 2, "l " * 20000, "￮")]
    return out + [out[0], out[0]]


@pytest.mark.parametrize("sources,weights,most,share", [(["s1"], (5, 2, 1), 3, (1, 1)), (["s1", "S2", "é", None, "z"], (5, 2, 1), 3, (1, 1)), (["a", "b", "c", "d"], (1, 9), 2, (3, 2)), (["a", "b", "c"], (1,), 4, (1, 3))])
def test_mix_equals_a_sequential_one(spark, sources, weights, most, share):
    rows = rows_of(random.Random(len(sources)), 400, sources)
    docs = spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in mixing.mix(docs, weights, most, share).drop("key").collect()]
    expected = brute(rows, weights, most, share)
    assert Counter((d, n, s, round(t, 6), x) for d, n, s, t, x in found) == expected
    assert all(x <= most * n for _, n, _, _, x in found)
    assert abs(sum(x for *_, x in found) - min(most, Fraction(*share)) * sum(len(WORDS.findall(r[1] or "")) for r in rows)) <= len({r[2] for r in rows})


def test_mixture_has_the_words_taken(spark):
    rows = [r for r in rows_of(random.Random(3), 60, ["a", "b", "c"])[:60] if r[0] is not None]
    docs = spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA)
    texts = {r[0]: r[1] for r in rows}
    words = defaultdict(int)
    for doc, epoch, text in mixing.mixture(docs, most=2).collect():
        assert texts[doc].startswith(text) and epoch < 2
        words[doc] += len(WORDS.findall(text))
    assert words == {r[0]: r[5] for r in mixing.mix(docs, most=2).collect() if r[5]}


def test_empty_and_reruns(spark, sf_dir):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixture(spark.createDataFrame([], SCHEMA)).count() == 0
    found = [sorted(map(tuple, mixing.op11_mixing(spark, sf_dir).repartition(k).collect())) for k in (1, 3)]
    assert found[0] == found[1]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = con.sql(mixing.ORACLES["op11_mixing"])
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(sql.project(", ".join(names)).fetchall()) == found[0]
