"""Operator 13 against whole-text encodings and a plain walk over every byte."""

import hashlib
import random
from collections import Counter

import pytest

from paceline.llm import alignment

A, B = alignment.default_paths()
CLASHES = ["key", "start", "side", "copies", "n", "ids", "chunk", "at", "a", "b", "links", "most", "n_a", "copy"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)


def texts():
    rng = random.Random(13)
    odd = ["the", "Übergrößenträger", "naïve", "don't", "they'll", "été", "日本語", "\U0001f600\U0001f468‍\U0001f469", "x1y22", "--", "...", "<|endoftext|>", "<0x41>", "</s>", "a\x00b", "é", " ", "\x1c", "\xa0", "ﬁ", "ａ", "fi\r\nve", "\t\ttabs", "http://a.b/c?d=e"]
    out = [" ".join(rng.choice(odd) + rng.choice(["", "", " ", "\n", "\n\n ", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    out += [None, "", " ", "  ", "\n", " a", "a ", "a  ", "  a  b", "\n b", "b \n", "a \n b", "▁", "a ▁b", "a▁", "y" * 3000, " " * 700, "word " * 4000, "日" * 2000]
    return [(k, t) for k, t in enumerate(out)] + [(None, "a b"), (None, "a b"), (None, None), (3, out[3]), (3, out[3]), (5, out[3])]


def reference(rows):
    """Per row: n_a, n_b, groups, links, by whole texts and overlaps of byte ranges."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in visible]
    letter = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(hidden)}
    out = []
    for _, text in rows:
        spans = []
        if text:
            whole = (" " + text).encode()
            sides = [[(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]]
            sides.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)])
            if all(b"".join(x for _, x in side) == whole for side in sides):
                for side in sides:
                    at, spans_of = 0, []
                    for i, x in side:
                        spans_of.append((at, at + len(x), i))
                        at += len(x)
                    spans.append(spans_of)
        if not spans:
            out.append(((), (), [], []))
            continue
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for hi in cuts:
            groups.append([[i for s, e, i in side if lo <= s and e <= hi] for side in spans] if len(text) < 2500 else None)
            lo = hi
        if len(text) >= 2500:  # the same, without the square
            edge, groups = {c: k for k, c in enumerate(cuts)}, [[[], []] for _ in cuts]
            for n, side in enumerate(spans):
                g = 0
                for _, e, i in side:
                    groups[g][n].append(i)
                    g = edge[e] + 1 if e in edge else g
        owner = [[i for i, (s, e, _) in enumerate(side) for _ in range(s, e)] for side in spans]
        links = [(spans[0][x][2], spans[1][y][2]) for x, y in dict.fromkeys(zip(*owner, strict=True))]
        out.append((spans[0], spans[1], groups, links))
    return out


def expected(rows):
    found = reference(rows)
    count = Counter(link for *_, links in found for link in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (doc, _), (a, b, groups, links) in zip(rows, found, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), sha))
    return out


@pytest.mark.parametrize("block,links", [(1 << 15, 1_000_000), (7, 50)])
def test_alignment(spark, monkeypatch, block, links):
    monkeypatch.setattr(alignment, "BLOCK", block)
    monkeypatch.setattr(alignment, "LINKS", links)
    rows = texts()
    docs = spark.createDataFrame([(*r, *CLASHES) for r in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in alignment.align(docs, A, B).collect()]
    assert Counter(found) == Counter(expected(rows))


def test_ranks_give_the_tokenizer_s_ids():
    pair, rng = alignment.pair_of(A, B), random.Random(4)
    letters = [chr(c) for c in [*range(0, 0x250)] if chr(c) != "\u2581"]
    words = [w for _, t in texts() for w in (t or "")[:300].split(" ") if max(w, default="") < alignment.PLAIN]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(20)) + " ".join(rng.choice(words) for _ in range(5)) + "".join(rng.choice("aehinrst'., \n\t10") for _ in range(60))
        assert pair.quick.encode_ordinary(text) == pair.a.encode(text, add_special_tokens=False).ids


def test_groups(spark):
    rows = [r for r in texts() if r[0] is not None and r[0] not in (3, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = {}
    for r in sorted(alignment.groups(docs, A, B).collect(), key=lambda r: (r["doc_id"], r["position"])):
        assert r["copies"] == 1 and r["position"] == len(found.setdefault(r["doc_id"], []))
        found[r["doc_id"]].append([r["a"], r["b"]])
    assert all(found.get(doc, []) == groups for (doc, _), (_, _, groups, _) in zip(rows, reference(rows), strict=True))


def test_empty_and_wrong_ids(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    assert alignment.groups(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    with pytest.raises(TypeError):
        alignment.align(spark.createDataFrame([("x", "y")], "doc_id string, text string"), A, B)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = alignment.op13_alignment(spark, sf_dir).collect()
    assert Counter(map(tuple, found)) == Counter(expected(rows))
