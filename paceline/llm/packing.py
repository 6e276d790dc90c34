"""Operator 5: packing by cutting-stock column generation.

Documents are cut into pieces of at most ``CAPACITY`` ids: whole capacities, then the rest. Pieces of less
than ``SHORT`` ids are first bundled, one after the other, until a bundle has ``SHORT`` of them or more; a
bundle is then packed like a piece. Lengths are rounded up to ``UNIT`` ids, which leaves at most CAPACITY /
UNIT classes, so the histogram of classes has a proven bound whatever the input; it alone goes to the
driver. There a linear program over patterns (how many pieces of each class share a sequence) is solved by
column generation: the basis's prices go into an unbounded knapsack, solved by dynamic programming over the
capacity, whose best pattern enters the basis until none is worth more than a sequence. Rounded-down
pattern counts and a first-fit decreasing rest cover the histogram exactly. On the executors the pieces of
a class are ranked (in salted groups with summed offsets, so one common length is no single task; the
salt is of a piece's number, so that equal rows are dealt as well), and each rank falls into one interval
of its class's slots, which names the sequence. Offsets are sums within a sequence.

Defined cases: null or empty text is its end id alone; repeated rows are pieces of their own; a null
doc_id is an ordinary key; an empty table gives no rows; other columns are ignored; doc_ids of any type stay as they are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.shared import documents, materialize
from paceline.llm.tokens import default_path, encoder

CAPACITY = 4096
UNIT = 8
#: Pieces below this length are bundled to this length or a little more, so that rounding costs little.
SHORT = 256
END_ID = 2
#: The linear program ends when no pattern is worth this much more than a sequence.
GAP = 2e-4
#: Rooms that the knapsack fills at once, which bounds its memory.
ROOMS = 512
#: Rows that one task ranks.
RANKED = 10_000


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: piece (a number of its own), doc_id, start, length, ids_crc32, doc_tokens (and ids)."""

    def pieces(batches):
        texts = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                doc, start, length, crc, total, ids_of = [], [], [], [], [], []
                for row, text in enumerate(part.column("text")):
                    ids = np.append(texts.ids(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), capacity):
                        piece = ids[s : s + capacity]
                        doc.append(row)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids))
                        if with_ids:
                            ids_of.append(piece.astype(np.int32))
                columns = {"piece": pa.array(np.arange(number, number + len(doc)))} | {"doc_id": part.column("doc_id").take(pa.array(doc, pa.int64()))} | {n: pa.array(v, pa.int64()) for n, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", total))}
                number += len(doc)
                yield pa.record_batch(columns | ({"ids": pa.array(ids_of, pa.list_(pa.int32()))} if with_ids else {}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"piece long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes (ascending) that fits.

    The best single size per room comes first; each level then doubles the number of pieces, splitting every
    room between two solutions of the level before.
    """
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    worth = np.concatenate([[0.0], prices])
    top = np.maximum.accumulate(np.where(worth >= np.maximum.accumulate(worth), np.arange(len(worth)), 0))
    single = top[fits]  # one more than the size's place; 0 for none
    value, splits = worth[single], []
    for _ in range(int(capacity // sizes[0]).bit_length() if capacity >= sizes[0] else 0):
        padded = np.concatenate([np.full(capacity, -np.inf), value])
        rest = np.lib.stride_tricks.as_strided(padded[capacity:], (capacity + 1, capacity + 1), (padded.strides[0], -padded.strides[0]), writeable=False)
        split = np.concatenate([np.argmax(value + rest[r : r + ROOMS], axis=1) for r in range(0, capacity + 1, ROOMS)])
        rooms = np.arange(capacity + 1)
        value = value[split] + value[rooms - split]
        splits.append(split)
    pieces = np.array([capacity])
    for split in reversed(splits):
        pieces = np.concatenate([split[pieces], pieces - split[pieces]])
    return float(value[capacity]), np.bincount(single[pieces], minlength=len(sizes) + 1)[1:].astype(float)


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is used; together they hold counts pieces of each size, exactly."""
    n = len(sizes)
    if not n:
        return []
    most = (capacity // sizes).astype(float)
    basis, inverse, x = np.diag(most), np.diag(1 / most), counts / most
    for _ in range(20 * n + 200):
        if x.sum() <= (1 + gap) * (sizes @ counts) / capacity:  # no plan needs fewer sequences than ids fill
            break
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, sizes, capacity)
        if value <= 1 + gap:
            break
        held = np.flatnonzero(pattern)
        d = (inverse[:, held] * pattern[held]).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d > 1e-9, x / d, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        row = inverse[out] / d[out]
        inverse -= d[:, None] * row
        inverse[out] = row
        # small errors of many steps are harmless: the counts are rounded down and the rest is placed exactly
        x = np.maximum((inverse * counts).sum(axis=1), 0)
    used: dict[tuple[int, ...], int] = {}
    left = counts.astype(np.int64).copy()
    for k in np.argsort(-x):
        pattern = basis[:, k].astype(np.int64)
        held = pattern > 0
        times = min(int(x[k] + 1e-9), int((left[held] // pattern[held]).min()))
        if times > 0:
            used[tuple(pattern)] = used.get(tuple(pattern), 0) + times
            left -= pattern * times
    while left.any():  # first fit, decreasing
        pattern, room = np.zeros(n, np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            pattern[k] = take = min(int(left[k]), room // int(sizes[k]))
            room -= take * int(sizes[k])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        used[tuple(pattern)] = used.get(tuple(pattern), 0) + times
        left -= pattern * times
    return [(np.array(p), t) for p, t in used.items()]


def bundled(pieces: DataFrame, salts: int, short: int = SHORT) -> DataFrame:
    """pieces with salt, item (the piece itself, or the first piece of its bundle), inner (ids before it there) and item_length."""
    dealt = pieces.withColumns({"salt": F.pmod(F.xxhash64("piece"), F.lit(salts)), "small": F.col("length") < short})
    before = F.sum("length").over(Window.partitionBy("salt").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    few = dealt.where("small").withColumn("before", before).withColumn("bundle", F.floor(F.col("before") / short))
    w = Window.partitionBy("salt", "bundle")
    few = few.withColumns({"item": F.min("piece").over(w), "inner": F.col("before") - F.min("before").over(w), "item_length": F.sum("length").over(w)}).drop("before", "bundle", "small")
    own = dealt.where("not small").drop("small").withColumns({"item": F.col("piece"), "inner": F.lit(0).cast("long"), "item_length": F.col("length")})
    return own.unionByName(few)


def assign(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """pieces (piece, doc_id, start, length, ...) with sequence_id, offset and sequence_tokens added, and without piece."""
    spark = pieces.sparkSession
    items = materialize(bundled(pieces.select("piece", "length"), max(1, -(-pieces.count() // RANKED)), min(SHORT, capacity // 16)), "items")
    first = items.where("inner = 0").select("item", "item_length", F.ceil(F.col("item_length") / unit).cast("int").alias("c"))
    histogram = sorted((r[0], r[1]) for r in first.groupBy("c").count().collect())  # capacity / unit rows
    sizes, counts = np.array([c for c, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    patterns = solve(sizes, counts, capacity // unit)
    slots, base, filled = [], 0, np.zeros(len(sizes), np.int64)
    for pattern, times in patterns:
        for k in np.flatnonzero(pattern):
            slots.append((int(sizes[k]), int(filled[k]), int(filled[k] + pattern[k] * times), int(pattern[k]), base))
            filled[k] += pattern[k] * times
        base += times
    table = spark.createDataFrame(slots, "c int, lo long, hi long, per long, base long")  # patterns x classes at most
    salts = max(1, -(-int(counts.max(initial=0)) // RANKED))
    dealt = first.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    before = dealt.groupBy("c", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("c").orderBy("salt")) - F.col("count")).drop("count")
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("c", "salt").orderBy("item"))).join(before, ["c", "salt"])
    placed = ranked.withColumn("rank", F.col("before") + F.col("k") - 1).alias("p").join(F.broadcast(table).alias("t"), F.expr("p.c = t.c and p.rank >= t.lo and p.rank < t.hi"))
    placed = placed.select("p.item", "p.item_length", "p.c", "p.rank", F.expr("base + (rank - lo) div per").alias("sequence_id"))
    inside = Window.partitionBy("sequence_id")
    order = inside.orderBy(F.desc("c"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.select("item", "sequence_id", (F.sum("item_length").over(order) - F.col("item_length")).alias("at"), F.sum("item_length").over(inside).alias("sequence_tokens"))
    own = items.join(placed, "item").select("piece", "sequence_id", (F.col("at") + F.col("inner")).alias("offset"), "sequence_tokens")
    return pieces.join(own, "piece").drop("piece")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return assign(materialize(cut(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids padded to capacity, n_tokens."""
    whole = materialize(cut(docs, tokenizer, capacity, end_id, with_ids=True), "piece-ids")
    places = assign(whole, capacity)
    rows = places.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"), F.sum("length").alias("n_tokens"))
    size = F.when(F.log2("n_tokens") == F.floor(F.log2("n_tokens")), F.col("n_tokens")).otherwise(capacity)
    return rows.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), (size - F.col("n_tokens")).cast("int"))).alias("ids"), "n_tokens")


def op5_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer or default_path())


QUERIES = {"op5_packing": op5_packing}
