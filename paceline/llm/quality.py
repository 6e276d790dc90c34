"""Operator 9: quality rules, with divergence from language references.

Counting rules reject short texts and texts of repeated three-word windows. For the rest, each text's
histogram of character classes and its histogram of common words are compared with references of every
language by the Jensen-Shannon distance (base 2, the square root of the divergence); the language whose
two distances sum to least is the text's. A distance counts only from a least length on, and its limit
is widened by what chance adds to the divergence of a text of that length. References come from the
whole table, by its ``lang`` (null is a language of its own; one of fewer than ``LEAST_WORDS`` words has no
reference, and for its documents only the counting rules count): words that make up at least ``COMMON`` of
a language's words, hence at most 1 / COMMON of them. All words are counted in one pass, by tasks first
and then in Spark; only these common ones come to the driver.

Defined cases: null, empty and wordless texts have zero counts, fail the base rules and are not kept;
repeated rows get a row each; null doc_ids stay null; an empty table gives no rows; other columns are
ignored here and kept by ``filter_documents``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.shared import discard, documents, integer_ids, materialize
from paceline.llm.textnp import LEADS, WHITE, chunks, keyed, windows

COMMON = 0.002
#: Least words and characters from which a distance counts, and the distances allowed.
MIN_WORDS, MIN_CHARS = 80, 400
MAX_WORD_DISTANCE, MAX_CHAR_DISTANCE = 0.32, 0.26
#: Times the expected divergence of a sample from its own source that is allowed besides.
CHANCE = 2.0
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Character classes by byte: control, space, newline, digit, upper, lower, sentence mark, other mark, symbol, Latin letter with accent, other lead byte; continuation bytes don't count.
N_CLASSES = 11
CLASS = np.full(256, 7)
CLASS[:32], CLASS[127], CLASS[32], CLASS[10] = 0, 0, 1, 2
CLASS[48:58], CLASS[65:91], CLASS[97:123] = 3, 4, 5
CLASS[list(b".,;:!?'\"-()")] = 6
CLASS[list(b"#*$%&|<>@^~=+_\\{}[]/`")] = 8
CLASS[0x80:], CLASS[[0xC3, 0xC4, 0xC5]] = 10, 9
#: Words that a task holds before they leave it.
HELD = 500_000
#: Words of a language from which it has a reference: a common word is there ten times.
LEAST_WORDS = int(10 / COMMON)


def char_classes(c) -> np.ndarray:
    """Characters of each class, per text of a chunk."""
    lead = LEADS[c.data]
    text = np.repeat(np.arange(len(c)), np.diff(c.offsets))[lead]
    return np.bincount(text * N_CLASSES + CLASS[c.data[lead]], minlength=len(c) * N_CLASSES).reshape(len(c), N_CLASSES)


def base_counts(c) -> tuple[dict[str, np.ndarray], tuple]:
    """The counting rules' figures per text of a chunk, and its words."""
    start, end, text = c.words()
    h = c.hashes(start, end, lower=False)
    n = len(c)
    line_start, line_end, line_text = c.lines()
    filled = np.concatenate(([0], np.cumsum(~WHITE[c.data])))
    with_word = filled[line_end] > filled[line_start]
    line_start, line_end, line_text = line_start[with_word], line_end[with_word], line_text[with_word]
    lines = keyed(c.hashes(line_start, line_end, lower=False), line_text)
    _, first = np.unique(lines, return_index=True)
    win, at = windows(h, text, 3)
    _, inverse, count = np.unique(keyed(win, text[at]), return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    repeated = np.zeros(len(h), bool)
    for j in range(3):
        repeated[twice + j] = True
    return {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": c.per_text(LEADS[c.data] & ~WHITE[c.data]),
        "n_symbols": c.per_text(SYMBOLS[c.data]),
        "n_dup_lines": np.bincount(line_text, minlength=n) - np.bincount(line_text[first], minlength=n),
        "n_repeat_words": np.bincount(text[repeated], minlength=n),
    }, (start, end, text)


def tally(docs: DataFrame, place: dict[str, int]) -> DataFrame:
    """lang (its place), kind, key, n over all documents: 0 characters by class, 1 words in all, 2 words by hash."""

    def rows(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        chars, size = np.zeros((len(place), N_CLASSES), np.int64), 0

        def words_out():
            of, h = (np.concatenate(x) for x in zip(*held, strict=True))
            for k in np.unique(of):
                words, n = np.unique(h[of == k], return_counts=True)
                yield pa.record_batch({"lang": pa.array(np.full(len(n) + 1, k), pa.int32()), "kind": pa.array(np.append(np.full(len(n), 2), 1), pa.int32()), "key": pa.array(np.append(words.astype(np.int64), 0)), "n": pa.array(np.append(n, n.sum()), pa.int64())})

        for batch in batches:
            langs = np.array([place[x or ""] for x in batch.column("lang").to_pylist()], np.int64)
            for c in chunks(batch.column("text")):
                here = langs[c.first : c.first + len(c)]
                start, end, text = c.words()
                held.append((here[text].astype(np.int32), c.hashes(start, end, lower=True)))
                size += len(text)
                np.add.at(chars, here, char_classes(c))
                if size >= HELD:
                    yield from words_out()
                    held, size = [], 0
        if size:
            yield from words_out()
        lang, cls = np.nonzero(chars)
        yield pa.record_batch({"lang": pa.array(lang, pa.int32()), "kind": pa.array(np.zeros(len(lang)), pa.int32()), "key": pa.array(cls, pa.int64()), "n": pa.array(chars[lang, cls])})

    return docs.select("lang", "text").mapInArrow(rows, "lang int, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language: shares of character classes, hashes of common words (sorted), and their shares with that of all others last."""
    own = sorted(r[0] for r in docs.select(F.coalesce("lang", F.lit("")).alias("lang")).distinct().collect())  # the languages
    counted = materialize(tally(docs, {x: k for k, x in enumerate(own)}), "word-tally")
    sizes = counted.where("kind = 1").select(F.col("lang").alias("of"), F.col("n").alias("size"))  # one row per language
    common = counted.where("kind = 2").join(F.broadcast(sizes), F.col("lang") == F.col("of")).where(F.col("n") >= COMMON * F.col("size")).select("lang", "kind", "key", "n")
    out: dict[int, list[dict[int, int]]] = {k: [{}, {}, {}] for k in range(len(own))}
    for k, kind, key, n in counted.where("kind < 2").unionByName(common).collect():  # per language N_CLASSES + 1 + 1 / COMMON rows at most
        out[k][kind][key] = n
    discard(counted)
    refs = {}
    for k, (chars, size, words) in out.items():
        size = size.get(0, 0)
        if size < LEAST_WORDS:
            continue
        kept = {np.uint64(np.int64(w).astype(np.uint64)): n for w, n in words.items()}
        hashes = np.array(sorted(kept), np.uint64)
        shares = np.array([kept[w] for w in hashes] + [size - sum(kept.values())], float) / size
        chars = np.array([chars.get(j, 0) for j in range(N_CLASSES)], float)
        refs[own[k]] = (chars / chars.sum(), hashes, shares)
    return refs


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p from q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.maximum(part.sum(axis=1) / 2, 0)


def chance(q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What chance adds to the divergence of n draws from q; of cells seen less than once in n, only their share."""
    cells = np.minimum(1, n[:, None] * q[None, :]).sum(axis=1)
    return cells / (8 * np.log(2) * np.maximum(n, 1))


def verdicts(c, has_reference: np.ndarray, refs: dict) -> dict[str, np.ndarray]:
    """The base figures, base_failed, reference (its place, or the number of references), word_distance, char_distance (less chance) and kept of the texts of a chunk."""
    base, (start, end, text) = base_counts(c)
    n, chars = base["n_words"], char_classes(c)
    h = c.hashes(start, end, lower=True)
    best = np.full(len(c), np.inf)
    word_d, char_d, which = np.zeros(len(c)), np.zeros(len(c)), np.full(len(c), len(refs))
    n_chars = chars.sum(axis=1)
    for r, (q_chars, common, q_words) in enumerate(refs[name] for name in sorted(refs)):
        at = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
        at = np.where(common[at] == h, at, len(common)) if len(common) else np.zeros(len(h), np.int64)
        k = len(common) + 1
        hist = np.bincount(text * k + at, minlength=len(c) * k).reshape(-1, k)
        dw = np.sqrt(np.maximum(divergence(hist / np.maximum(n, 1)[:, None], q_words) - CHANCE * chance(q_words, n), 0))
        dc = np.sqrt(np.maximum(divergence(chars / np.maximum(n_chars, 1)[:, None], q_chars) - CHANCE * chance(q_chars, n_chars), 0))
        nearer = dw + dc < best
        best = np.where(nearer, dw + dc, best)
        word_d, char_d, which = np.where(nearer, dw, word_d), np.where(nearer, dc, char_d), np.where(nearer, r, which)
    failed = (n < 50) | (100 * base["n_repeat_words"] > 50 * n)
    far = ((n >= MIN_WORDS) & (word_d > MAX_WORD_DISTANCE)) | ((n_chars >= MIN_CHARS) & (char_d > MAX_CHAR_DISTANCE))
    return base | {"base_failed": failed, "reference": which, "word_distance": word_d, "char_distance": char_d, "kept": ~failed & ~(far & has_reference)}


def _referenced(batch, refs: dict) -> np.ndarray:
    return np.array([(x or "") in refs for x in batch.column("lang").to_pylist()], bool)


def judge(docs: DataFrame, refs: dict) -> DataFrame:
    """doc_id and the figures of ``verdicts``, reference by name; one row per document."""
    names = pa.array([*sorted(refs), None], pa.string())
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def rows(batches):
        for batch in batches:
            known = _referenced(batch, refs)
            for c in chunks(batch.column("text")):
                v = verdicts(c, known[c.first : c.first + len(c)], refs)
                columns = {"doc_id": batch.column("doc_id").slice(c.first, len(c)).cast(pa.int64())} | {k: pa.array(v[k], pa.int64()) for k in counts}
                columns |= {"base_failed": pa.array(v["base_failed"]), "reference": pc.take(names, pa.array(v["reference"]))} | {k: pa.array(v[k]) for k in ("word_distance", "char_distance", "kept")}
                yield pa.record_batch(columns)

    return integer_ids(docs).select("doc_id", "lang", "text").mapInArrow(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, reference string, word_distance double, char_distance double, kept boolean")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; each is judged where it is read."""
    refs = references(docs)

    def rows(batches):
        for batch in batches:
            known = _referenced(batch, refs)
            for c in chunks(batch.column("text")):  # small batches go back, so that no copy of a large one is held
                kept = verdicts(c, known[c.first : c.first + len(c)], refs)["kept"]
                yield batch.slice(c.first, len(c)).filter(pa.array(kept))

    return docs.mapInArrow(rows, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, references(docs))


QUERIES = {"op9_quality": op9_quality}
