"""Operator 7: hierarchical Pitman-Yor language model of words.

A token is a word (A-Z lower-cased) or the end of a text. Its context is the word before it, whatever the
number of words. One restaurant per context serves the words that follow it; each of its tables is a
customer of the parent restaurant that all contexts share, whose base is uniform over the known words and
one more for all unknown ones. Every dish is a word, in all levels, so what is counted grows with the
corpus.

The ``OWN`` most frequent training tokens have a number and join the parent at once; all other contexts are called
rare and have a restaurant between, shared by words of one shape (length and last byte); words that training hasn't seen begin there.
A rare context's word has one table, as in interpolated Kneser-Ney, so it needs no sweeps: its pairs are counted by bucket of
contexts (``followers``), and each of them is one customer of its shape's restaurant.

Pairs travel as blocks, one row for all pairs of a task's two million tokens whose words' hashes lie in one
range (a bucket; their number follows the training tokens, so that a bucket holds no more as the corpus grows).
Pair counts are kept in rows of some thousand words (``ROW``), one entry per word: the contexts it follows, and how
often (words of more than ``SPLIT`` tokens in several entries, fewer than ``SPLITS`` of them). So a word's dishes and its parent
dish lie together, and a sweep needs no shuffle: each task draws the tables of its words' dishes, all customers anew, from their conditional
distribution (``seat``) given the contexts' gamma variables and the parent's predictive probabilities; then
the tables of the parent's dishes. Only the number of tables of each context (a fixed number of contexts)
and of the split words come back to the driver between sweeps. For n customers and t tables the
distribution is that of generalised Stirling numbers times z**t; these are exact up to ``EXACT`` customers,
beyond it a series or a saddle point, and a normal distribution where ``MANY`` tables or more are expected.
Predictive probabilities use table counts averaged over the sweeps after the burn-in: for the parent
their means, for contexts their expectation given the averaged variables. Each context's probabilities
add up to one.

For scoring, the ``FREQUENT`` most frequent words and the about ``PAIRS`` most frequent pairs go to all
tasks (fixed numbers); a text's other pairs are dealt by bucket, where they meet the pairs' and words' prices,
a task holding the prices of one bucket at a time, and the sums go back to the block of texts they came from. A pair's key holds 48 bits of the word's hash and 16 of the context, so two words in
2**48 are one to the model (and, if rare, to their count). A pair of a rare context takes the price of its shape's pair along
to the bucket of its context (57 bits of hash and the shape), where its own count and its context's are.

Defined cases: null and empty texts are one end token; documents with a null doc_id are scored but not
learned from; repeated rows are learned from each time and get a row each; without training tokens N and
V are 0 and every token has the probability one, as the only unknown word; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.shared import discard, documents, integer_ids, materialize
from paceline.llm.textnp import chunks, mix

SHAPES = 128
OWN = 65_408
CONTEXTS = OWN + SHAPES
FREQUENT, PAIRS = 200_000, 1_000_000
END = np.uint64(0xE7D0E7D0E7D0E7D0)
LOW = np.uint64(0xFFFF)
#: Bits of a rare context that hold its shape.
SHAPE = np.uint64(SHAPES - 1)
#: Discounts and strengths: of context restaurants and of their parent.
CONTEXT, PARENT = (0.7, 2.0), (0.5, 5.0)
ROUNDS, BURN_IN = 6, 3
#: Customers of a dish up to which Stirling numbers are tabled, tables from which their number is drawn as normal, terms of the series, and numbers a step may hold.
EXACT, MANY, TERMS, CELLS = 512, 400, 80, 1 << 20
SEED = 20_240_901
#: Tokens that are counted together before they leave a task.
HELD = 2_000_000
#: Tokens of a word in one row of the pair table, or, if more, one ``SPLITS``-th of all training tokens, so that
#: fewer than ``SPLITS`` words are split, whatever the input. A row holds CONTEXTS numbers at most, however many tokens.
SPLIT, SPLITS = 1_000_000, 1000
#: Numbers of pairs told apart when the most frequent are chosen.
MOST = 4096
#: Buckets at least, and training tokens in each if there are more of them.
BUCKETS, IN_BUCKET = 512, 1_000_000
#: Blocks on their way to a bucket, and sums on their way back to a block of texts.
BLOCKS, SUMS = "bucket int, kind int, block long, x binary, y binary, z binary", "block long, kind int, x binary, y binary, z binary"
#: Tasks that add up what all tasks tell, and bytes of sums that leave a task together.
SUMMED, SENT = 16, 1 << 24
#: Texts of a block at most; the bit above their numbers marks words that aren't frequent.
TEXTS = 1 << 15
#: Pairs of a row of the state, an entry counting as ENTRY more, and rows of a file of it, which a task reads at once.
ROW, ENTRY, FILE = 1 << 15, 6, 32
#: Rows of a file of pairs that wait for their contexts' counts.
WAIT_FILE = 512
#: What such a row holds: of each entry of a word (``size`` and ``ones``: its pairs of several customers and of one; ``tokens``: what it
#: counts in training), of each pair of several customers, and the contexts of the pairs of one, which always have one table.
ENTRIES = {"w": np.int64, "part": np.int32, "size": np.int32, "ones": np.int32, "tokens": np.int64, "customers": np.int64, "tables": np.int64, "mean_customers": np.float64, "mean_tables": np.float64, "mean_p": np.float64, "ctx": np.uint16, "n": np.int64, "once": np.uint16}
#: Which of them go by pairs, and the number of pairs that each entry has there.
OF_PAIRS = {"ctx": "size", "n": "size", "once": "ones"}
STATE = "kind int, " + ", ".join(f"{x} binary" for x in ENTRIES) + ", total binary"
#: A word at its bucket: log10 of the parent's probability, its tokens, and how many contexts it follows with one customer.
WORD = np.dtype([("w", np.uint64), ("logq", np.float64), ("tokens", np.int64), ("ones", np.int32)])
#: A text (its block and number) that waits for a pair of a rare context, and log10 of the shape's price.
WAITING = np.dtype([("text", np.int64), ("logp", np.float32)])
#: Pairs' rows at the buckets of rare contexts; sums on their way through these buckets have their kind and PASSING.
COUNTED, WAITS, PASSING = 0, 4, 10
DOC = np.dtype([("doc_id", np.int64), ("null", np.bool_), ("held_out", np.bool_), ("n_tokens", np.int64), ("n_known", np.int64), ("base", np.float64), ("score", np.float64)])


def tokens(c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape class and text of each token of a chunk; each text ends with END."""
    start, end, text = c.words()
    h = c.hashes(start, end, lower=True)
    last = c.data[end - 1].astype(np.int64) if len(end) else np.zeros(0, np.int64)
    last = np.where((last >= 65) & (last <= 90), last + 32, last)
    shape = OWN + np.minimum(end - start, 15) // 2 * 16 + last % 16
    at = np.cumsum(np.bincount(text, minlength=len(c)))
    texts = np.arange(len(c))
    return np.insert(h, at, END), np.insert(shape, at, OWN), np.insert(text, at, texts)


def word_counts(train: DataFrame) -> DataFrame:
    """hash, shape, n of all training tokens."""

    def rows(batches):
        held, size = [], 0

        def out():
            h, s = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            return pa.record_batch({"hash": pa.array(u.astype(np.int64)), "shape": pa.array(s[first], pa.int32()), "n": pa.array(n)})

        for batch in batches:
            for c in chunks(batch.column("text")):
                h, s, _ = tokens(c)
                held.append((h, s))
                size += len(h)
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return materialize(train.select("text").mapInArrow(rows, "hash long, shape int, n long").groupBy("hash").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")), "word-counts")


class Lookup:
    """Finds tokens in an array of hashes, by cells of their first bits that hold less than one on average."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        bits = max(1, (2 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        cells = np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.concatenate(([0], np.cumsum(cells)[:-1]))
        self.ended = np.append(self.hashes, np.uint64(2**64 - 1))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Index of each in the array that was given, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = self.first[h >> self.shift]
        on = np.flatnonzero(self.ended[at] < h)
        while len(on):
            at[on] += 1
            on = on[self.ended[at[on]] < h[on]]
        at = np.minimum(at, len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)


@cache
def stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers of n customers at t tables, up to EXACT of each."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, EXACT + 1)
    for n in range(EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= n, out[n, 1:] + np.log(np.maximum(n - d * t, 1e-300)), -np.inf)
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], stay)
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series at x + 8."""
    x = np.asarray(x, float)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - sum(np.log(x + k) for k in range(8))


def saddle(ratio, low) -> np.ndarray:
    """w in (0, 1) where the decreasing function ``ratio`` is ``low``, by bisection of log w."""
    a, b = np.full(np.shape(low), -80.0), np.zeros(np.shape(low))
    for _ in range(50):
        c = (a + b) / 2
        over = ratio(np.exp(c)) > low
        a, b = np.where(over, c, a), np.where(over, b, c)
    return np.exp((a + b) / 2)


@cache
def choices() -> np.ndarray:
    """Binomial coefficients of up to 2 * MANY tables over 1 .. TERMS."""
    j = np.arange(1, TERMS + 1)
    return np.cumprod(np.maximum(np.arange(2 * MANY + 1)[:, None] - j + 1, 0) / j, axis=1)


def log_ways(n: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the generalised Stirling numbers of n[k] and each t[k], less what depends on n alone; n > EXACT, t <= 2 * MANY.

    They are coefficients of y**n in (1 - (1 - y)**d)**t / (t! d**t): by its binomial series where few tables
    have many customers, else at the saddle point.
    """
    j = np.arange(1, TERMS + 1)
    a, m = d * j, np.asarray(n, float)[:, None]
    # gamma(1 + a) gamma(n - a) / gamma(n + 1), without the difference of large numbers
    fall = log_gamma(1 + a) + (m - a - 0.5) * np.log1p(-(a + 1) / (m + 1)) - (a + 1) * np.log(m + 1) + a + 1 + (1 / (m - a) - 1 / (m + 1)) / 12
    total = np.einsum("kwj,kj->kw", choices()[t], np.exp(fall) * np.sin(np.pi * a) * np.where(j % 2, 1, -1)) / np.pi
    out = np.log(np.maximum(total, 1e-300))
    n, t = np.broadcast_arrays(m, np.asarray(t, float))
    near = (t * d) ** (1 / (1 - d)) * n ** (-d / (1 - d)) <= 6
    far = ~near & (t < n)
    if far.any():
        m, k = n[far], t[far]
        mean = lambda w: d * w ** (d - 1) * (1 - w) / -np.expm1(d * np.log(w))
        w = np.minimum(saddle(mean, m / k), 1 - 1e-12)
        at = mean(w)
        spread = k * at * (1 + (1 - d) * (1 - w) / w - at)
        out[far] = k * np.log(-np.expm1(d * np.log(w))) - m * np.log1p(-w) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-300))
    out[t == n] = t[t == n] * np.log(d)
    return out - log_gamma(t + 1) - t * np.log(d)


def seat(n: np.ndarray, z: np.ndarray, d: float, rng: np.random.Generator, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tables of dishes of n customers, t with a weight of z**t times the Stirling number: a sample (added over ``copies`` dishes alike) and the mean of one."""
    copies = np.ones(len(n), np.int64) if copies is None else copies
    drawn, mean = copies.astype(np.int64), np.ones(len(n))

    def draw(of, t, log_p):
        p = np.exp(log_p - log_p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        drawn[of] = (rng.multinomial(copies[of], p) * t).sum(axis=1)
        mean[of] = (p * t).sum(axis=1)

    log_z = np.log(z)
    two = np.flatnonzero(n == 2)
    p = z[two] / (1 - d + z[two])
    drawn[two], mean[two] = copies[two] + rng.binomial(copies[two], p), 1 + p
    least = 2
    while least < EXACT:  # dishes of about one count share a matrix
        most = 2 * least
        few = np.flatnonzero((n > least) & (n <= most))
        t = np.arange(1, most + 1)
        for part in np.array_split(few, -(-len(few) * most // CELLS) or 1):
            if len(part):
                draw(part, t, stirling(d)[n[part], 1 : most + 1] + log_z[part, None] * t)
        least = most
    large = np.flatnonzero(n > EXACT)
    if not len(large):
        return drawn, mean
    m, y = n[large].astype(float), z[large]
    w = saddle(lambda w: w ** (d - 1) * (1 - w), m / y)
    expected = y / d * -np.expm1(d * np.log(w))
    at = m / expected
    spread = expected / (1 + at / np.maximum(1 + (1 - d) * (1 - w) / w - at, 1e-9))
    normal = expected >= MANY
    of, k = large[normal], copies[large[normal]]
    drawn[of] = np.clip(np.round(rng.normal(k * expected[normal], np.sqrt(k * spread[normal]))), k, k * n[of]).astype(np.int64)
    mean[of] = np.clip(expected[normal], 1, n[of])
    rest = np.flatnonzero(~normal)
    rest = rest[np.argsort(expected[rest])]
    while len(rest):
        width = int(16 * np.sqrt(expected[rest[min(len(rest), 256) - 1]]) + 40)
        part, rest = rest[: max(1, min(256, CELLS // (width * TERMS)))], rest[max(1, min(256, CELLS // (width * TERMS))) :]
        low = np.maximum(1, np.floor(expected[part] - width / 2))
        t = np.minimum(low[:, None] + np.arange(width), m[part, None]).astype(np.int64)
        log_p = log_ways(m[part], t, d) + log_z[large[part], None] * t
        log_p[:, 1:][t[:, 1:] == t[:, :-1]] = -np.inf
        draw(large[part], t, log_p)
    return drawn, mean


def context_of(h: np.ndarray, shape: np.ndarray, own: Lookup) -> np.ndarray:
    """Context of the token after each token."""
    at = own(h)
    return np.where(at >= 0, at, shape)


def keys(h: np.ndarray, shape: np.ndarray, text: np.ndarray, own: Lookup) -> np.ndarray:
    """Key of each token with the one before it; a text's first follows END, context 0."""
    ctx = context_of(h, shape, own)
    before = np.concatenate((np.zeros(1, np.int64), ctx[:-1]))
    before[np.concatenate(([True], text[1:] != text[:-1]))[: len(before)]] = 0
    return (h & ~LOW) | before.astype(np.uint64)


def rare_contexts(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that follow a rare word, and that word: its hash, its shape in the last bits. key: of ``keys``."""
    at = np.flatnonzero((key & LOW) >= OWN)
    return at, (h[at - 1] & ~SHAPE) | ((key[at] & LOW) - np.uint64(OWN))


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The range of hashes that each word or pair lies in, ascending with it."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def stretches(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of values from each of starts on."""
    values = np.ascontiguousarray(values)
    ends = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def dealt(kind: int, block: int, buckets: int, key: np.ndarray, *more: np.ndarray):
    """Rows of ``BLOCKS``: sorted keys and up to two arrays that go with them, by bucket."""
    for i in range(0, len(key), HELD):
        here = slice(i, i + HELD)
        b = bucket_of(key[here], buckets)
        starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        columns = [stretches(v[here], starts) for v in (key, *more)]
        columns += [pa.nulls(len(starts), pa.binary())] * (3 - len(columns))
        yield pa.record_batch([pa.array(b[starts]), pa.array(np.full(len(starts), kind, np.int32)), pa.array(np.full(len(starts), block, np.int64)), *columns], names=["bucket", "kind", "block", "x", "y", "z"])


def array_of(value: pa.Scalar, dtype) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype)


def summed(held: list[tuple[np.ndarray, ...]], keys: int = 1) -> tuple[np.ndarray, ...]:
    """Distinct keys (of so many arrays), sorted, and the sums of each one's numbers."""
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    order = np.argsort(columns[0]) if keys == 1 else np.lexsort(columns[:keys][::-1])
    columns = [x[order] for x in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in columns[:keys]:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return (*(x[first] for x in columns[:keys]), *(np.add.reduceat(x.astype(np.int64), first) for x in columns[keys:]))


def state_row(arrays: dict[str, np.ndarray], kind: int = 0) -> pa.RecordBatch:
    return pa.record_batch({
        "kind": pa.array([kind], pa.int32()), **{x: pa.array([np.asarray(arrays[x], dtype).tobytes()], pa.binary()) for x, dtype in ENTRIES.items()},
        "total": pa.nulls(1, pa.binary()),
    })


class Totals:
    """What a task tells the driver: tables and customers of each context, customers and tables of the parent, and customers of each split word."""

    def __init__(self, split: np.ndarray):
        self.split = split
        self.values = np.zeros(2 * CONTEXTS + 2 + len(split), np.int64)

    def add(self, ctx: np.ndarray, tables: np.ndarray | None, n: np.ndarray | None, once: np.ndarray, w: np.ndarray, customers: np.ndarray, words_tables: np.ndarray) -> None:
        """tables and n: of each pair of several customers, one and not counted if None; once: contexts of the others."""
        ones = np.bincount(once, minlength=CONTEXTS)
        self.values[:CONTEXTS] += np.bincount(ctx, weights=tables, minlength=CONTEXTS).astype(np.int64) + ones
        if n is not None:
            self.values[CONTEXTS : 2 * CONTEXTS] += np.bincount(ctx, weights=n, minlength=CONTEXTS).astype(np.int64) + ones
        several = np.isin(w, self.split)
        self.values[2 * CONTEXTS] += customers[~several].sum()
        self.values[2 * CONTEXTS + 1] += words_tables[~several].sum()
        np.add.at(self.values, 2 * CONTEXTS + 2 + np.searchsorted(self.split, w[several]), customers[several])

    def row(self, kind: int = 1) -> pa.RecordBatch:
        return pa.record_batch({"kind": pa.array([kind], pa.int32()), **{x: pa.nulls(1, pa.binary()) for x in ENTRIES}, "total": pa.array([self.values.tobytes()], pa.binary())})


def followers(train: DataFrame, own: np.ndarray, buckets: int) -> DataFrame:
    """Rows of ``BLOCKS``, by bucket of contexts: rare contexts, keys of the words that follow them (with the shape), and how often."""

    def rows(batches):
        find, held, size = Lookup(own), [], 0

        def out():
            context, key = (np.concatenate(v) for v in zip(*held, strict=True))
            order = np.argsort(context)
            return dealt(COUNTED, 0, buckets, context[order], key[order])

        for batch in batches:
            for c in chunks(batch.column("text")):
                h, shape, text = tokens(c)
                key = keys(h, shape, text, find)
                at, context = rare_contexts(h, key)
                held.append((context, key[at]))
                size += len(at)
                if size >= HELD:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def merged(batches):
        now, held, size, most = None, [], 0, 2 * HELD

        def out():
            context, key, n = summed(held, 2)
            for i in range(0, len(key), ROW):
                here = slice(i, i + ROW)
                yield pa.record_batch([pa.array([now], pa.int32()), pa.array([COUNTED], pa.int32()), pa.array([0], pa.int64()), *[pa.array([v[here].tobytes()], pa.binary()) for v in (context, key, n)]], names=["bucket", "kind", "block", "x", "y", "z"])

        for batch in batches:
            for b, x, y in zip(batch.column("bucket").to_numpy(), *(batch.column(v) for v in "xy"), strict=True):
                if b != now:
                    if held:
                        yield from out()
                    now, held, size, most = b, [], 0, 2 * HELD
                context = array_of(x, np.uint64)
                held.append((context, array_of(y, np.uint64), np.ones(len(context), np.int64)))
                size += len(held[-1][0])
                if size >= most:
                    held = [summed(held, 2)]
                    size = len(held[0][0])
                    most = max(2 * HELD, 2 * size)
        if held:
            yield from out()

    blocks = train.select("text").mapInArrow(rows, BLOCKS).select("bucket", "x", "y")
    return materialize(blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merged, BLOCKS), "followers", FILE, small=True)


def of_shapes(rare: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``BLOCKS``, by bucket of words: keys of a shape and a word, contexts of that shape that the word follows (one table each), and tokens."""

    def rows(batches):
        held, size = [], 0

        def out():
            key, n, seen = summed(held)
            return dealt(0, 0, buckets, key, n.astype(np.uint32), seen)

        for batch in batches:
            for y, z in zip(batch.column("y"), batch.column("z"), strict=True):
                key = array_of(y, np.uint64)
                held.append((key, np.ones(len(key), np.uint32), array_of(z, np.int64)))
                size += len(key)
                if size >= HELD:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    return rare.select("y", "z").mapInArrow(rows, BLOCKS)


def pair_counts(train: DataFrame, own: np.ndarray, parts: dict[int, int], buckets: int, rare: DataFrame | None = None) -> DataFrame:
    """Rows of ``STATE``: words, contexts and counts, with one table for each pair to begin with; kind 2: words of one customer in all, kind 3: their ``Totals``. rare: of ``followers``, if there are rare contexts."""
    hot = np.array(sorted(parts), np.int64)
    hot_parts = np.array([parts[int(w)] for w in hot], np.int64)

    def rows(batches):
        find, held, size = Lookup(own), [], 0

        def out():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return dealt(0, 0, buckets, key, n.astype(np.uint32))

        for batch in batches:
            for c in chunks(batch.column("text")):
                key = keys(*tokens(c), find)
                held.append(key[(key & LOW) < OWN])
                size += len(held[-1])
                if size >= HELD:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def entries(held):
        key, n, seen = summed(held)
        w, ctx = (key & ~LOW).astype(np.int64), (key & LOW).astype(np.int64)
        part = np.zeros(len(w), np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, w), len(hot) - 1)
            part = np.where(hot[at] == w, ctx % hot_parts[at], 0)
            order = np.lexsort((part, key & ~LOW))
            w, ctx, part, n, seen = w[order], ctx[order], part[order], n[order], seen[order]
        first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (part[1:] != part[:-1]))))
        size, none, one = np.diff(np.append(first, len(w))), np.zeros(len(first)), n == 1
        ones = np.add.reduceat(one.astype(np.int64), first)
        return {"w": w[first], "part": part[first], "size": size - ones, "ones": ones, "tokens": np.add.reduceat(seen, first), "customers": size, "tables": np.ones(len(first), np.int64), "mean_customers": none, "mean_tables": none, "mean_p": none, "ctx": ctx[~one], "n": n[~one], "once": ctx[one]}

    def merged(batches):
        now, held, size, most, told, alone_told = None, [], 0, 2 * HELD, Totals(hot), Totals(hot)

        def out():
            e = entries(held)
            # words of one customer in all never move
            alone = (e["customers"] == 1) & (e["ones"] == 1) & ~np.isin(e["w"], hot)
            once = np.repeat(alone, e["ones"])
            still = {x: v[once] if x == "once" else v[:0] if x in OF_PAIRS else v[alone] for x, v in e.items()}
            still["mean_customers"] = still["mean_tables"] = np.ones(len(still["w"]))
            for i in range(0, len(still["w"]), ROW // ENTRY):
                yield state_row({x: v[i : i + ROW // ENTRY] for x, v in still.items()}, 2)
            alone_told.add(still["ctx"], None, still["n"], still["once"], still["w"], still["customers"], still["tables"])
            e = {x: v[~once] if x == "once" else v if x in OF_PAIRS else v[~alone] for x, v in e.items()}
            if not len(e["w"]):
                return
            told.add(e["ctx"], None, e["n"], e["once"], e["w"], e["customers"], e["tables"])
            ends = {x: np.append(0, np.cumsum(e[of])) for x, of in OF_PAIRS.items()}
            row = (ends["ctx"][:-1] + ends["once"][:-1] + ENTRY * np.arange(len(e["w"]))) // ROW
            cut = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                yield state_row({x: v[ends[x][i] : ends[x][j]] if x in ends else v[i:j] for x, v in e.items()})

        for batch in batches:
            for b, x, y, z in zip(batch.column("bucket").to_numpy(), *(batch.column(v) for v in "xyz"), strict=True):
                if b != now:
                    if held:
                        yield from out()
                    now, held, size, most = b, [], 0, 2 * HELD
                n = array_of(y, np.uint32)
                held.append((array_of(x, np.uint64), n, array_of(z, np.int64) if z.is_valid else n))
                size += len(n)
                if size >= most:  # only what a bucket has of distinct pairs is held
                    held = [summed(held)]
                    size = len(held[0][0])
                    most = max(2 * HELD, 2 * size)
        if held:
            yield from out()
        yield told.row()
        yield alone_told.row(3)

    blocks = train.select("text").mapInArrow(rows, BLOCKS)
    if rare is not None:
        blocks = blocks.unionByName(of_shapes(rare, buckets))
    blocks = blocks.select("bucket", "x", "y", "z")
    return materialize(blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merged, STATE), "pairs", FILE)


def flat(batch) -> tuple[np.ndarray, ...]:
    """Contexts, counts, tables and row of each pair of a batch of word rows: those of several customers, then the others."""
    ctx, n, t, once = (batch.column(x) for x in ("ctx", "n", "t", "once"))
    row = [np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())) for x in (ctx, once)]
    ones = len(row[1])
    parts = (ctx.flatten(), once.flatten()), (n.flatten(), np.ones(ones, np.int64)), (t.flatten(), np.ones(ones, np.float32)), row
    return tuple(np.concatenate(x) for x in parts)


def opened(batches):
    """The arrays of each row of the state."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {x: array_of(batch.column(x)[i], dtype) for x, dtype in ENTRIES.items()}


class Parent:
    """The parent restaurant's totals, and the probabilities of the words that lie in several rows."""

    def __init__(self, customers: float, tables: float, kinds: int, split: dict[int, tuple[float, float]]):
        self.customers, self.tables, self.base, self.split = customers, tables, 1 / (kinds + 1), split

    def p(self, w: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of each word."""
        d, s = PARENT
        customers, tables = customers.astype(float), tables.astype(float)
        if self.split:
            for k in np.flatnonzero(np.isin(w, list(self.split))):
                customers[k], tables[k] = self.split[int(w[k])]
        return (customers - d * tables + (s + d * self.tables) * self.base) / (s + self.customers)

    @property
    def unknown(self) -> float:
        d, s = PARENT
        return (s + d * self.tables) * self.base / (s + self.customers)


def totals(state: DataFrame, split: int, kind: int = 1) -> np.ndarray:
    """The sum of the tasks' ``Totals``. split: how many words are split; kind: of the rows that hold them."""
    size = 2 * CONTEXTS + 2 + split

    def rows(batches):
        out = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("total"):
                out += array_of(x, np.int64)
        yield pa.record_batch({"total": pa.array([out.tobytes()], pa.binary())})

    found = state.where(F.col("kind") == kind).select("total").coalesce(SUMMED).mapInArrow(rows, "total binary").toArrow()  # SUMMED rows at most
    return sum((array_of(x, np.int64) for x in found.column("total")), np.zeros(size))


def sums_of(state: DataFrame, parts: dict[int, int], kinds: int, columns: tuple[str, str]) -> Parent:
    """The parent from the customers and tables of all words; columns: their names."""
    customers, tables = columns
    own = state.where("kind = 0")
    split: dict[int, tuple[float, float]] = {}
    if parts:  # fewer than SPLITS words
        found = own.where(F.col("w").isin(list(parts))).groupBy("w").agg(F.sum(customers), F.max(tables)).collect()
        split = {w: (c, t) for w, c, t in found}
        own = own.where(~F.col("w").isin(list(parts)))
    c, t = own.agg(F.coalesce(F.sum(customers), F.lit(0)), F.coalesce(F.sum(tables), F.lit(0))).first()
    c, t = c + sum(x[0] for x in split.values()), t + sum(x[1] for x in split.values())
    return Parent(float(c), float(t), kinds, split)


def sweep(state: DataFrame, gamma: np.ndarray, parent: Parent, gamma_parent: float, split_tables: dict[int, tuple[int, float]], r: int) -> DataFrame:
    """One sweep over all dishes: the state after it, and per task its ``Totals``."""
    d, _ = CONTEXT
    dp, _ = PARENT
    held = state.sparkSession.sparkContext.broadcast(gamma)  # CONTEXTS numbers
    more = 1 / (ROUNDS - BURN_IN) if r >= BURN_IN else 0.0
    split = np.array(sorted(split_tables), np.int64)

    def rows(batches):
        told = Totals(split)
        for e in opened(batches):
            rng = np.random.default_rng((SEED, r, int(e["w"].view(np.uint64)[0]), int(e["part"][0])))
            w, row = e["w"], np.repeat(np.arange(len(e["w"])), e["size"])
            p = parent.p(w, e["customers"], e["tables"])
            t, mean = seat(e["n"], d * held.value[e["ctx"]] * p[row], d, rng)
            customers, mean_customers = (np.bincount(row, weights=x, minlength=len(w)) + e["ones"] for x in (t, mean))
            customers = customers.astype(np.int64)
            tables, mean_tables = seat(customers, np.full(len(w), dp * gamma_parent * parent.base), dp, rng)
            for k in np.flatnonzero(np.isin(w, split)):
                tables[k], mean_tables[k] = split_tables[int(w[k])]
            told.add(e["ctx"], t, None, e["once"], w, customers, tables)
            averaged = {x: e[x] + more * v for x, v in (("mean_customers", mean_customers), ("mean_tables", mean_tables), ("mean_p", p))}
            yield state_row(e | averaged | {"customers": customers, "tables": tables})
        yield told.row()

    return materialize(state.where("kind = 0").mapInArrow(rows, STATE), "seats", FILE)


def sampled(start: DataFrame, kinds: int, parts: dict[int, int]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The state after all sweeps (without words of one customer, which stay in start), the contexts' averaged gamma variables, and their customers."""
    d, s = CONTEXT
    dp, sp = PARENT
    rng = np.random.default_rng(SEED)
    words = sorted(parts)
    state, alone = start, totals(start, len(words), 3)
    told = totals(start, len(words)) + alone
    counts, t = told[CONTEXTS : 2 * CONTEXTS], np.ones(len(words), np.int64)
    mean = np.zeros(CONTEXTS)
    for r in range(ROUNDS):
        n = told[2 * CONTEXTS + 2 :]
        split = {w: (float(n[k]), float(t[k])) for k, w in enumerate(words)}
        parent = Parent(told[2 * CONTEXTS] + n.sum(), told[2 * CONTEXTS + 1] + t.sum(), kinds, split)
        gamma, gamma_parent = rng.gamma(s / d + told[:CONTEXTS]), rng.gamma(sp / dp + parent.tables)
        if r >= BURN_IN:
            mean += gamma / (ROUNDS - BURN_IN)
        t, m = seat(n.astype(np.int64), np.full(len(n), dp * gamma_parent * parent.base), dp, rng)
        after = sweep(state, gamma, parent, gamma_parent, {w: (int(t[k]), float(m[k])) for k, w in enumerate(words)}, r)
        if state is not start:
            discard(state)
        state, told = after, totals(after, len(words)) + alone
    return state, mean, counts


def settled(state: DataFrame, gamma: np.ndarray, start: DataFrame) -> DataFrame:
    """w, part, ctx, n, t (expected tables of each pair of several customers), once (contexts of the pairs of one), mean_customers, mean_tables, total (tokens of the row; shapes' pairs count contexts in n), kind; kind 1: the tables of each context, by task, in t."""
    d, _ = CONTEXT
    held = state.sparkSession.sparkContext.broadcast(gamma)

    def rows(batches):
        rng, per_context, size = np.random.default_rng(SEED), np.zeros(CONTEXTS), np.zeros(MOST + 1, np.int64)
        for e in opened(batches):
            ctx, n, m = e["ctx"], e["n"], len(e["w"])
            row = np.repeat(np.arange(m), e["size"])
            _, t = seat(n, d * held.value[ctx] * e["mean_p"][row], d, rng)
            t = np.clip(t, 1, n).astype(np.float32)
            per_context += np.bincount(ctx, weights=t, minlength=CONTEXTS) + np.bincount(e["once"], minlength=CONTEXTS)
            size += np.bincount(np.minimum(n, MOST), minlength=MOST + 1)
            size[1] += len(e["once"])
            ends = {of: pa.array(np.concatenate(([0], np.cumsum(e[of]))), pa.int32()) for of in ("size", "ones")}
            lists = {x: pa.ListArray.from_arrays(ends[of], pa.array(v)) for x, of, v in (("ctx", "size", ctx.astype(np.int32)), ("n", "size", n), ("t", "size", t), ("once", "ones", e["once"].astype(np.int32)))}
            yield pa.record_batch({"kind": pa.array(np.zeros(m, np.int32)), **{x: pa.array(e[x]) for x in ("w", "part")}, "ctx": lists["ctx"], "n": lists["n"], **{x: pa.array(e[x]) for x in ("mean_customers", "mean_tables")}, "t": lists["t"], "once": lists["once"], "total": pa.array(e["tokens"])})
        for kind, of, values in ((1, np.flatnonzero(per_context), per_context), (2, np.flatnonzero(size), size)):
            yield pa.record_batch({
                "kind": pa.array([kind], pa.int32()), "w": pa.array([None], pa.int64()), "part": pa.array([None], pa.int32()), "ctx": pa.array([of], pa.list_(pa.int32())), "n": pa.array([values[of].astype(np.int64)], pa.list_(pa.int64())),
                "mean_customers": pa.array([None], pa.float64()), "mean_tables": pa.array([None], pa.float64()), "t": pa.array([values[of].astype(np.float32)], pa.list_(pa.float32())), "once": pa.array([None], pa.list_(pa.int32())), "total": pa.array([None], pa.int64()),
            })

    return materialize(state.where("kind = 0").unionByName(start.where("kind = 2")).mapInArrow(rows, "kind int, w long, part int, ctx array<int>, n array<long>, mean_customers double, mean_tables double, t array<float>, once array<int>, total long"), "settled", small=True)


class Model:
    """Everything about the model that has a fixed size, and the table of rare contexts (of ``followers``; none if there are no such words)."""

    def __init__(self, own: np.ndarray, counts: np.ndarray, tables: np.ndarray, parent: Parent, tokens_in_all: int, kinds: int, rare: DataFrame | None = None):
        d, s = CONTEXT
        self.rare = rare
        self.own, self.counts, self.parent, self.size, self.kinds = own, counts, parent, tokens_in_all, kinds
        #: what the parent's probability is multiplied by, by context
        self.back = (s + d * tables) / (s + counts)

    def base_of(self, c):
        return np.log10((c + 0.1) / (self.size + 0.1 * (self.kinds + 1)))


def buckets_for(size: int) -> int:
    return max(BUCKETS, -(-int(size) // IN_BUCKET))


def learn(train: DataFrame, words: DataFrame, most: int = OWN) -> tuple[Model, DataFrame]:
    """The model, and its pairs as of ``settled``. words: hash, shape, n of all training tokens; most: how many contexts aren't rare, at most OWN."""
    size, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = F.col("hash") == END.astype(np.int64).item()
    own = np.concatenate(([END], words.where(~end).orderBy(F.desc("n"), "hash").limit(most - 1).select("hash").toArrow().column("hash").to_numpy().astype(np.uint64)))
    held = max(SPLIT, -(-int(size) // SPLITS))
    often = words.where(F.col("n") > held).select("hash", "n").collect()  # fewer than SPLITS rows
    parts: dict[int, int] = {}
    for h, n in often:
        w = int(np.int64(np.uint64(h % 2**64) & ~LOW))
        parts[w] = parts.get(w, 0) + n // held + 1
    rare = followers(train, own, buckets_for(size)) if kinds > most else None
    start = pair_counts(train, own, parts, buckets_for(size), rare)
    state, gamma, counts = sampled(start, kinds, parts)
    pairs = settled(state, gamma, start)
    discard(state, start)
    tables = np.zeros(CONTEXTS)
    found = pairs.where("kind = 1").select(F.explode(F.arrays_zip("ctx", "t")).alias("x")).groupBy("x.ctx").agg(F.sum(F.col("x.t").cast("double")).alias("t")).toArrow()  # CONTEXTS rows
    tables[found.column("ctx").to_numpy()] = found.column("t").to_numpy()
    return Model(own, counts, tables, sums_of(pairs, parts, kinds, ("mean_customers", "mean_tables")), int(size), int(kinds), rare), pairs


def prices(batch, back: np.ndarray, counts: np.ndarray, parent: Parent, low: int, high: int, rare: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, logp (log10) and row of the pairs with low <= n < high; and, unless rare is -1, of all pairs of shapes and of words of at most ``rare`` tokens, but none of one customer."""
    d, s = CONTEXT
    ctx, n, t, row = flat(batch)
    w = batch.column("w").to_numpy()
    p = parent.p(w, batch.column("mean_customers").to_numpy(), batch.column("mean_tables").to_numpy())
    keep = (n >= low) & (n < high)
    if rare >= 0:
        keep |= (batch.column("total").to_numpy() <= rare)[row] | (ctx >= OWN)
        keep &= n > 1
    ctx, n, row, t = ctx[keep], n[keep], row[keep], t[keep]
    logp = np.log10((n - d * t) / (s + counts[ctx]) + back[ctx] * p[row])
    return w[row] | ctx, logp.astype(np.float32), row


def priced(pairs: DataFrame, model: Model, low: int, high: int) -> DataFrame:
    """key, logp (log10), c (tokens of the row's word): pairs with low <= n < high."""
    held = pairs.sparkSession.sparkContext.broadcast((model.back, model.counts, model.parent))

    def rows(batches):
        for batch in batches:
            key, logp, row = prices(batch, *held.value, low, high)
            yield pa.record_batch({"key": pa.array(key), "logp": pa.array(logp), "c": pa.array(batch.column("total").to_numpy()[row])})

    return pairs.where("kind = 0").mapInArrow(rows, "key long, logp float, c long")


def priced_words(pairs: DataFrame, model: Model) -> DataFrame:
    """w, logq (log10 of the parent's probability), c: one row per word, part 0 standing for split ones."""
    held = pairs.sparkSession.sparkContext.broadcast(model.parent)

    def rows(batches):
        for batch in batches:
            w = batch.column("w").to_numpy()
            p = held.value.p(w, batch.column("mean_customers").to_numpy(), batch.column("mean_tables").to_numpy())
            yield pa.record_batch({"w": batch.column("w"), "logq": pa.array(np.log10(p)), "c": batch.column("total")})

    return pairs.where("kind = 0").select("w", "mean_customers", "mean_tables", "total").mapInArrow(rows, "w long, logq double, c long").groupBy("w").agg(F.max("logq").alias("logq"), F.sum("c").alias("c"))


def price_blocks(pairs: DataFrame, model: Model, high: int, rare: int, buckets: int) -> DataFrame:
    """Rows of ``BLOCKS``. Kind 0: key and logp of pairs of several customers, those below ``high``, of shapes and of words of at most ``rare`` tokens; kind 1: ``WORD`` of each row's word, and its contexts of one customer."""
    held = pairs.sparkSession.sparkContext.broadcast((model.back, model.counts, model.parent))

    def rows(batches):
        of_pairs, of_words, size = [], [], 0

        def out():
            key, logp = (np.concatenate(v) for v in zip(*of_pairs, strict=True))
            order = np.argsort(key)
            yield from dealt(0, 0, buckets, key[order], logp[order])
            words, once = (np.concatenate(v) for v in zip(*of_words, strict=True))
            order = np.argsort(words["w"])
            begins = np.append(0, np.cumsum(words["ones"]))[order]
            words = words[order]
            ends = np.append(0, np.cumsum(words["ones"]))
            once = once[np.repeat(begins - ends[:-1], words["ones"]) + np.arange(len(once))]
            b = bucket_of(words["w"], buckets)
            starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            yield pa.record_batch([
                pa.array(b[starts]), pa.array(np.ones(len(starts), np.int32)), pa.array(np.zeros(len(starts), np.int64)), stretches(words, starts), stretches(once, ends[starts]), pa.nulls(len(starts), pa.binary()),
            ], names=["bucket", "kind", "block", "x", "y", "z"])

        for batch in batches:
            key, logp, _ = prices(batch, *held.value, 0, high, rare)
            w = batch.column("w").to_numpy()
            p = held.value[2].p(w, batch.column("mean_customers").to_numpy(), batch.column("mean_tables").to_numpy())
            of_pairs.append((key.astype(np.uint64), logp))
            once, words = batch.column("once"), np.zeros(len(w), WORD)
            words["w"], words["logq"], words["tokens"], words["ones"] = w.astype(np.uint64), np.log10(p), batch.column("total").to_numpy(), np.diff(once.offsets.to_numpy())
            of_words.append((words, once.flatten().to_numpy().astype(np.uint16)))
            size += len(key) + len(w) + len(of_words[-1][1])
            if size >= HELD:
                yield from out()
                of_pairs, of_words, size = [], [], 0
        if of_words:
            yield from out()

    return pairs.where("kind = 0").mapInArrow(rows, BLOCKS)


def found_in(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


class Prices:
    """The prices of one bucket's pairs and words."""

    def __init__(self, pairs: list, words: list, back: np.ndarray, counts: np.ndarray):
        key, logp = (np.concatenate([np.zeros(0, t), *v]) for t, v in zip((np.uint64, np.float32), zip(*pairs, strict=True) if pairs else ((), ()), strict=True))
        words, once = (np.concatenate([np.zeros(0, t), *v]) for t, v in zip((WORD, np.uint16), zip(*words, strict=True) if words else ((), ()), strict=True))
        d, s = CONTEXT
        key = np.concatenate((key, np.repeat(words["w"], words["ones"]) | once))
        logp = np.concatenate((logp, np.log10((1 - d) / (s + counts[once]) + back[once] * np.repeat(10.0 ** words["logq"], words["ones"])).astype(np.float32)))
        order = np.argsort(key)
        self.key, self.logp = key[order], logp[order]
        self.w, first, which = np.unique(words["w"], return_index=True, return_inverse=True)
        self.logq, self.c = words["logq"][first], np.bincount(which, weights=words["tokens"], minlength=len(first))


class Counts:
    """The counts of one bucket's rare contexts."""

    def __init__(self, blocks: list):
        context, key, n = (np.concatenate([np.zeros(0, t), *v]) for t, v in zip((np.uint64, np.uint64, np.int64), zip(*blocks, strict=True) if blocks else ((), (), ()), strict=True))
        pair = mix(context ^ mix(key))
        order = np.argsort(pair)
        self.pair, self.n = pair[order], n[order]
        self.context, which = np.unique(context, return_inverse=True)
        self.tokens, self.kinds = (np.bincount(which, weights=v, minlength=len(self.context)) for v in (n, None))

    def logp(self, context: np.ndarray, key: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """log10 of each pair's probability; logp: of its shape's."""
        d, s = CONTEXT
        at, there = found_in(self.context, context)
        tokens, kinds = np.zeros(len(key)), np.zeros(len(key))
        tokens[there], kinds[there] = self.tokens[at[there]], self.kinds[at[there]]
        at, there = found_in(self.pair, mix(context ^ mix(key)))
        own = np.zeros(len(key))
        own[there] = self.n[at[there]] - d
        return np.log10((own + (s + d * kinds) * 10.0 ** logp.astype(float)) / (s + tokens))


def in_blocks(text: np.ndarray, logp: np.ndarray):
    """Sums of each text's logp as rows of ``SUMS``; text: block and number."""
    text, which = np.unique(text, return_inverse=True)
    total = np.bincount(which, weights=logp).astype(np.float32)
    block = text // TEXTS
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    for i, j in zip(starts, np.append(starts[1:], len(text)), strict=True):
        yield int(block[i]), 1, (text[i:j] % TEXTS).astype(np.uint16).tobytes(), total[i:j].tobytes(), None


def sums_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["block", "kind", "x", "y", "z"])


def score(docs: DataFrame, words: DataFrame, model: Model, pairs: DataFrame) -> DataFrame:
    """What ``train_and_score`` returns, from a model, its pairs and the words it was learned from; with rare contexts the pairs aren't read any more after it."""
    spark, buckets = docs.sparkSession, buckets_for(model.size)
    first = words.orderBy(F.desc("n"), "hash").limit(FREQUENT).toArrow()
    top, top_n = first.column("hash").to_numpy().astype(np.uint64), first.column("n").to_numpy()
    rare_n = int(top_n.min()) if len(top) == FREQUENT else 0  # tokens that a word outside has at most
    sizes = np.zeros(MOST + 1, np.int64)
    for n, k in pairs.where("kind = 2").select(F.explode(F.arrays_zip("ctx", "n")).alias("x")).groupBy("x.ctx").agg(F.sum("x.n")).collect():  # MOST rows
        sizes[n] = k
    many = np.cumsum(sizes[::-1])[::-1] <= PAIRS
    least = int(np.argmax(many)) if many.any() else MOST + 1
    least = max(least, 1)
    common = priced(pairs, model, least, 1 << 62).select("key", "logp").toArrow()  # about PAIRS rows
    key = mix(common.column("key").to_numpy().astype(np.uint64))
    order = np.argsort(key)
    held = spark.sparkContext.broadcast((top, key[order], common.column("logp").to_numpy()[order], model.own, model.base_of(top_n)))
    contexts = spark.sparkContext.broadcast((model.back, model.counts))
    is_rare, held_waits, first_sum = model.rare is not None, HELD // 2, PASSING
    size, kinds, log_back, log_unknown = model.size, model.kinds, np.log10(model.back), float(np.log10(model.parent.unknown))

    def asked(batches):
        from pyspark import TaskContext

        top, pair_keys, pair_logp, own, base = held.value
        find, find_own, find_pair, task = Lookup(top), Lookup(own), Lookup(pair_keys), TaskContext.get().partitionId()
        held_docs, asks, far, n_docs, n_asks, serial = [], [], [], 0, 0, 0

        def out():
            block, about = task << 24 | serial, np.concatenate(held_docs)
            # the texts themselves pass through any bucket
            yield pa.record_batch([pa.array([(task + serial) % buckets], pa.int32()), pa.array([3], pa.int32()), pa.array([block], pa.int64()), pa.array([about.tobytes()], pa.binary()), *[pa.nulls(1, pa.binary())] * 2], names=["bucket", "kind", "block", "x", "y", "z"])
            key, text = (np.concatenate(x) for x in zip(*asks, strict=True))
            order = np.argsort(key)
            yield from dealt(2, block, buckets, key[order], text[order])
            key, text, context = (np.concatenate(x) for x in zip(*far, strict=True))
            order = np.argsort(key)
            yield from dealt(2, block, buckets, key[order], text[order], context[order])

        for batch in batches:
            doc_id = batch.column("doc_id").cast(pa.int64())
            ids = pa.record_batch({"doc_id": doc_id.fill_null(0), "null": doc_id.is_null(), "held_out": batch.column("held_out")})
            for c in chunks(batch.column("text")):
                h, shape, text = tokens(c)
                at, key = find(h), keys(h, shape, text, find_own)
                often = at >= 0
                place = find_pair(mix(key))
                direct = (place >= 0) & often  # rare words' counts are with their bucket
                after, context = rare_contexts(h, key) if is_rare else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                direct[after] = False
                near = ~direct
                near[after] = False
                about = np.zeros(len(c), DOC)
                for x in ("doc_id", "null", "held_out"):
                    about[x] = ids.column(x).slice(c.first, len(c)).to_numpy(zero_copy_only=False)
                about["n_tokens"], about["n_known"] = np.bincount(text, minlength=len(c)), np.bincount(text[often], minlength=len(c))
                about["base"] = np.bincount(text[often], weights=base[at[often]], minlength=len(c))
                about["score"] = np.bincount(text[direct], weights=pair_logp[place[direct]], minlength=len(c))
                asked_of = (key[near], text[near], ~often[near]), (key[after], text[after], ~often[after])
                for i in range(0, len(c), TEXTS):
                    here = about[i : i + TEXTS]
                    if held_docs and (n_docs + len(here) > TEXTS or n_asks >= HELD):
                        yield from out()
                        held_docs, asks, far, n_docs, n_asks, serial = [], [], [], 0, 0, serial + 1
                    for to, (key, text, rare), more in zip((asks, far), asked_of, ((), (context,)), strict=True):
                        j = slice(*np.searchsorted(text, (i, i + TEXTS)))
                        to.append((key[j], (text[j] - i + n_docs + rare[j] * TEXTS).astype(np.uint16), *(v[j] for v in more)))
                        n_asks += len(to[-1][0])
                    held_docs.append(here)
                    n_docs += len(here)
        if held_docs:
            yield from out()

    def met(batches):
        now, of_pairs, of_words, prices, found, sent, waits, waiting = None, [], [], None, [], 0, [], 0

        def out():
            if not is_rare:
                return sums_batch(found)
            block, kind, *more = zip(*found, strict=True)  # through any bucket
            return pa.record_batch([pa.array([(now + i) % buckets for i in range(len(block))], pa.int32()), pa.array([k + first_sum for k in kind], pa.int32()), pa.array(block, pa.int64()), *[pa.array(v, pa.binary()) for v in more]], names=["bucket", "kind", "block", "x", "y", "z"])

        def off():
            context, key, text = (np.concatenate(v) for v in zip(*waits, strict=True))
            order = np.argsort(context)
            return dealt(WAITS, 0, buckets, context[order], key[order], text[order])

        for batch in batches:
            for bucket, kind, block, x, y, z in zip(*(batch.column(v).to_numpy() for v in ("bucket", "kind", "block")), *(batch.column(v) for v in ("x", "y", "z")), strict=True):
                if bucket != now:
                    now, of_pairs, of_words, prices = bucket, [], [], None
                if kind == 0:
                    of_pairs.append((array_of(x, np.uint64), array_of(y, np.float32)))
                elif kind == 1:
                    of_words.append((array_of(x, WORD), array_of(y, np.uint16)))
                elif kind == 2:
                    if prices is None:
                        prices, of_pairs, of_words = Prices(of_pairs, of_words, *contexts.value), [], []
                    key, text = array_of(x, np.uint64), array_of(y, np.uint16)
                    rare, text = text >= TEXTS, text % TEXTS
                    at, direct = found_in(prices.key, key)
                    logp = np.full(len(key), log_unknown)
                    logp[direct] = prices.logp[at[direct]]
                    look = np.flatnonzero(rare | ~direct)
                    at, there = found_in(prices.w, key[look] & ~LOW)
                    lost = there & ~direct[look]
                    logp[look[lost]] = prices.logq[at[lost]]
                    logp[~direct] += log_back[(key[~direct] & LOW).astype(np.int64)]
                    if z.is_valid:
                        wait = np.zeros(len(key), WAITING)
                        wait["text"], wait["logp"] = int(block) * TEXTS + text.astype(np.int64), logp
                        waits.append((array_of(z, np.uint64), key, wait))
                        waiting += len(key)
                    else:
                        sums = np.bincount(text, weights=logp)
                        some = np.unique(text)
                        found.append((block, 1, some.tobytes(), sums[some].astype(np.float32).tobytes(), None))
                    if rare.any():
                        of = text[rare]
                        n = np.zeros(len(key))
                        n[look[there]] = prices.c[at[there]]
                        n, some = n[rare], np.unique(of)
                        known, base = np.bincount(of, weights=n > 0), np.bincount(of, weights=np.log10((n + 0.1) / (size + 0.1 * (kinds + 1))))
                        found.append((block, 2, some.tobytes(), known[some].astype(np.int64).tobytes(), base[some].tobytes()))
                    sent += 24 * len(text)  # at most
                else:
                    found.append((block, 0, x.as_py(), None, None))
                    sent += len(found[-1][2])
                if sent >= SENT and found:
                    yield out()
                    found, sent = [], 0
                if waiting >= held_waits:
                    yield from off()
                    waits, waiting = [], 0
        if found:
            yield out()
        if waits:
            yield from off()

    def counted(batches):
        now, blocks, counts, found, sent, sums, n = None, [], None, [], 0, [], 0

        def add_up():
            before = len(found)
            found.extend(in_blocks(*(np.concatenate(v) for v in zip(*sums, strict=True))))
            return sum(len(v) for r in found[before:] for v in r[2:4])

        for batch in batches:
            for bucket, kind, block, x, y, z in zip(*(batch.column(v).to_numpy() for v in ("bucket", "kind", "block")), *(batch.column(v) for v in "xyz"), strict=True):
                if bucket != now:
                    now, blocks, counts = bucket, [], None
                if kind == COUNTED:
                    blocks.append((array_of(x, np.uint64), array_of(y, np.uint64), array_of(z, np.int64)))
                elif kind == WAITS:
                    if counts is None:
                        counts, blocks = Counts(blocks), []
                    wait = array_of(z, WAITING)
                    sums.append((wait["text"], counts.logp(array_of(x, np.uint64), array_of(y, np.uint64), wait["logp"])))
                    n += len(wait)
                    if n >= held_waits:
                        sent += add_up()
                        sums, n = [], 0
                else:
                    found.append((block, kind - first_sum, *(v.as_py() for v in (x, y, z))))
                    sent += sum(len(v) for v in found[-1][2:] if v is not None)
                if sent >= SENT:
                    yield sums_batch(found)
                    found, sent = [], 0
        if sums:
            add_up()
        if found:
            yield sums_batch(found)

    def added(batches):
        now, docs = None, None

        def out():
            return pa.record_batch({
                "doc_id": pa.array(docs["doc_id"], mask=docs["null"]), "held_out": pa.array(docs["held_out"]), "n_tokens": pa.array(docs["n_tokens"]), "n_known": pa.array(docs["n_known"]),
                "train_tokens": pa.array(np.full(len(docs), size)), "base_score": pa.array(docs["base"]), "score": pa.array(docs["score"]),
            })

        for batch in batches:
            for block, kind, x, y, z in zip(*(batch.column(v).to_numpy() for v in ("block", "kind")), *(batch.column(v) for v in ("x", "y", "z")), strict=True):
                if block != now:
                    if docs is not None:
                        yield out()
                    now, docs = block, array_of(x, DOC).copy()  # kind 0 comes first
                elif kind == 1:
                    docs["score"][array_of(x, np.uint16)] += array_of(y, np.float32)
                else:
                    docs["n_known"][array_of(x, np.uint16)] += array_of(y, np.int64)
                    docs["base"][array_of(x, np.uint16)] += array_of(z, np.float64)
        if docs is not None:
            yield out()

    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 10 = 0"), F.lit(False))
    asks = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(asked, BLOCKS)
    priced_asks = asks.unionByName(price_blocks(pairs, model, least, rare_n, buckets)).repartition("bucket").sortWithinPartitions("bucket", "kind")
    sums = priced_asks.mapInArrow(met, BLOCKS if is_rare else SUMS)
    if is_rare:  # stored, so that what was shuffled for it goes
        sums = materialize(sums, "waiting", WAIT_FILE, small=True)
        sums = sums.unionByName(model.rare).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(counted, SUMS)
    return sums.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(added, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    train = integer_ids(docs).where("doc_id is not null and crc32(cast(doc_id as string)) % 10 != 0")
    words = word_counts(train)
    model, pairs = learn(train, words)
    scores = score(docs, words, model, pairs)
    if model.rare is not None:
        discard(pairs, words)
    return scores


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and training documents, under the model and the base."""
    of = lambda x: F.pow(F.lit(10.0), -F.sum(x) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(documents(spark, sf_dir))


QUERIES = {"op7_language_model": op7_language_model}
