"""Operator 3: n-gram Jaccard self-join by prefix filtering.

A document's set holds its distinct shingles of ``SHINGLE`` words (fewer words: all of them as one) as
64-bit hashes. Equal sets, told by a 128-bit digest, form a class; only classes are compared.

1. A sketch of 2**SKETCH_BITS counters over all shingles of all documents gives the global order:
   rare first, then by hash. Any total order keeps the join exact; this one keeps hot shingles out of
   prefixes.
2. Of each set the first n - ceil(0.8 n) + 1 shingles are its prefix; linked sets share one of these,
   and about 0.2 n of them and as many spare ones. Shingles of only one class are dropped by a shuffle on
   the shingle (those whose counter is far above the mean are salted and simply kept), and then classes
   that share too few for any link; what chance passages have in common goes here.
3. Sets that share a prefix shingle and are of compatible length hang together through a hub per shingle
   and length band - a number of edges linear in the prefixes; a shingle with salts has a hub per salt too.
   Small components of these edges share a task. The classes of a larger one are dealt to blocks by length.
   Blocks with a common prefix shingle and compatible lengths of its holders meet, and each class goes to
   the tasks of those pairs of its block where it has such a shingle itself, and to no others. Blocks are
   joined by shingle with salts on both sides, classes by shingle and block, so a key has ``FEW`` blocks or
   a block's classes on one side at most, and on the other the shingle's blocks, a ``BLOCK``-th of its classes.
4. In a task, each set meets the later sets of its prefix shingles' lists once; length, positional and
   suffix filters drop most, and the rest are verified by their exact intersection. Out come each set's
   number of links and the edges of a spanning forest, never all pairs.
5. The spanning edges' components, with the smallest doc_id of each, go back to the documents; the at most
   ``HOT`` classes that hold 1 / ``HOT`` of the rows each are broadcast for that, and rows without words
   need no join.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; repeated
rows are copies and linked; a null doc_id keeps its row, and counts for no component_id (null if nothing
else is reachable); an empty table gives no rows; other columns are ignored here and kept by
``one_of_each``, whatever their names; doc_ids that aren't whole numbers are an error at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.components import components
from paceline.llm.shared import discard, documents, integer_ids, materialize, unused
from paceline.llm.textnp import chunks, mix, windows

SHINGLE = 5
#: The similarity, as a fraction of whole numbers.
NUM, DEN = 80, 100
SKETCH_BITS = 18
#: Classes with this share of all rows at least are joined to them by broadcast; there are as many at most.
HOT = 1000
#: Most classes and shingles of one side of a task.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Classes of small components that share a task.
TOGETHER = 400
#: Blocks of one shingle that meet all others of it in one part of a join.
FEW = 64
#: Shingles whose counter is this much above eight times the mean are salted.
OFTEN = 20_000
SUFFIX_CELLS = 32


def sets(c, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct shingle of each text, sorted by both."""
    start, end, text = c.words()
    h = c.hashes(start, end, lower=True)
    n = np.bincount(text, minlength=len(c))
    parts = [windows(h, text, k)]
    for short in range(1, k):
        of = n[text] == short
        if of.any():
            g, at = windows(h[of], text[of], short)
            parts.append((g, np.flatnonzero(of)[at]))
    g, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    t = text[at] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((g, t))
    g, t = g[order], t[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    return t[keep], g[keep]


def digests(t: np.ndarray, g: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent digests of each text's set; 0 for empty ones."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (2 * seed + 1, 2 * seed + 2):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g + np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)))
            at = np.searchsorted(t, np.arange(n + 1))
            out.append(np.where(at[1:] > at[:-1], mix(sums[at[1:]] - sums[at[:-1]]), np.uint64(0)).astype(np.int64))
    return out[0], out[1]


def needed(a, b):
    """Least intersection of linked sets of sizes a and b."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix(n):
    return n - -(-NUM * n // DEN) + 1


def members(docs: DataFrame, seed: int = 0) -> DataFrame:
    """id (doc_id, or a stand-in for null), doc_id, th, cls, d2, n: one row per document."""

    def rows(batches):
        for batch in batches:
            for c in chunks(batch.column("text")):
                t, g = sets(c)
                d1, d2 = digests(t, g, len(c), seed)
                part = batch.slice(c.first, len(c))
                yield pa.record_batch({"id": part.column("id"), "doc_id": part.column("doc_id"), "th": part.column("th"), "cls": pa.array(d1), "d2": pa.array(d2), "n": pa.array(np.bincount(t, minlength=len(c)), pa.int32())})

    return docs.select("id", "doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(rows, "id long, doc_id long, th long, cls long, d2 long, n int")


def sketch(docs: DataFrame) -> np.ndarray:
    """How often shingles of each of 2**SKETCH_BITS cells occur, over all documents."""

    def rows(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for c in chunks(batch.column("text")):
                _, g = sets(c)
                counts += np.bincount((g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        cells = np.flatnonzero(counts)
        for at in range(0, len(cells), 65536):
            some = cells[at : at + 65536]
            yield pa.record_batch({"cell": pa.array(some, pa.int32()), "n": pa.array(counts[some])})

    found = docs.select("text").mapInArrow(rows, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2**SKETCH_BITS rows
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def ordered(t: np.ndarray, g: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """t and g in the global order within each text, and the position of each."""
    order = np.lexsort((g, counts[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], t))
    t, g = t[order], g[order]
    first = np.searchsorted(t, t)
    return t, g, np.arange(len(t)) - first


def spare(n):
    """Shingles beyond the prefix that are looked at as well."""
    return np.maximum(1, n * (DEN - NUM) // DEN)


def shared_only(rows: DataFrame) -> DataFrame:
    """Rows (hash, salt, cls, ..) of hashes of several classes, one per hash and class; salted ones stay as they are."""
    least, most, last = (f"{f} over (partition by hash, salt{o})" for f, o in (("min(cls)", ""), ("max(cls)", ""), ("lag(cls)", " order by cls")))
    marked = rows.select("*", F.expr(last).alias("_last"), F.expr(least).alias("_least"), F.expr(most).alias("_most"))
    return marked.where("(_last is null or _last != cls) and (salt >= 0 or _least != _most)").select(*rows.columns)


def prefixes(docs: DataFrame, counts, hot: int, seed: int) -> DataFrame:
    """hash, salt, cls, n, head: shingles of the prefix (head) and ``spare`` more that several classes have there."""

    def rows(batches):
        freq = counts.value
        for batch in batches:
            for c in chunks(batch.column("text")):
                t, g = sets(c)
                cls, _ = digests(t, g, len(c), seed)
                n = np.bincount(t, minlength=len(c))
                _, one = np.unique(cls, return_index=True)  # copies in a chunk count once
                first = np.zeros(len(c), bool)
                first[one] = True
                t, g, pos = ordered(t, g, freq)
                head = prefix(n[t])
                keep = first[t] & (pos < head - 1 + spare(n[t]))
                t, g, head = t[keep], g[keep], (pos < head)[keep]
                often = freq[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                salt = np.where(often > hot, cls[t] % (often // hot + 1), -1)  # parts of about ``hot`` rows
                yield pa.record_batch({"hash": pa.array(g.astype(np.int64)), "salt": pa.array(salt, pa.int64()), "cls": pa.array(cls[t]), "n": pa.array(n[t], pa.int32()), "head": pa.array(head)})

    return shared_only(docs.select("text").mapInArrow(rows, "hash long, salt long, cls long, n int, head boolean"))


def peeled(shared: DataFrame, rounds: int = 2) -> DataFrame:
    """shared without the classes that have too few shared shingles for any link, and so again.

    Linked sets of sizes n <= m have their first ``spare(n)`` common shingles in both prefixes with their
    spares, and n >= 0.8 m; so a class of size m needs spare(ceil(0.8 m)) shared ones.
    """
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * NUM / DEN) * (DEN - NUM) / DEN))
    columns = shared.columns
    for _ in range(rounds):
        counted = shared.select(*columns, F.count("*").over(Window.partitionBy("cls")).alias("_shared"))  # a set's own shingles at most
        shared = materialize(shared_only(counted.where(F.col("_shared") >= least).select(*columns)), "shared")
    return shared


def candidate_edges(shared: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that hold every compatible pair of one shingle together.

    shared: hash, salt, cls, n. A hub of each salt keeps a hot shingle's rows apart; hubs of salts hang on one of all.
    """
    # sets of one link lie in one band or in neighbouring ones: n grows by less than DEN / NUM within a link
    banded = shared.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(DEN / NUM * 1.0001))).cast("int"))
    near = banded.groupBy("hash", "salt", "band").agg(F.min("cls").alias("hub"), F.count("*").alias("size"))
    hubs = near.groupBy("hash", "band").agg(F.min("hub").alias("top"))
    next_hubs = hubs.select("hash", (F.col("band") - 1).alias("band"), F.col("top").alias("b"))
    across = hubs.join(next_hubs, ["hash", "band"]).select(F.col("top").alias("a"), "b")
    within = banded.join(near.where("size > 1"), ["hash", "salt", "band"]).select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    salted = near.where("salt >= 0").join(hubs, ["hash", "band"]).select(F.col("hub").alias("a"), F.col("top").alias("b"))
    return within.union(salted).union(across).where("a != b").distinct()


def in_blocks(sized: DataFrame) -> DataFrame:
    """sized (cls, component, n, ..) with block and blocks, of its component: about BLOCK classes and BLOCK_SHINGLES shingles at most each.

    Blocks follow the length, so that far lengths lie in blocks that never meet; equal ones are dealt by hash.
    """
    room = F.greatest(F.col("n"), F.lit(BLOCK_SHINGLES // BLOCK)).cast("long")
    lengths = sized.groupBy("component", "n").agg(F.count("*").alias("same")).withColumn("filled", F.col("same") * room)
    before = F.sum("filled").over(Window.partitionBy("component").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("filled")
    blocks = F.ceil(F.sum("filled").over(Window.partitionBy("component")) / BLOCK_SHINGLES).cast("int")
    starts = lengths.select("component", "n", "same", before.alias("before"), blocks.alias("blocks"))  # a row per length
    at = F.col("before") + F.pmod(F.xxhash64("cls"), F.col("same")) * room
    return sized.join(starts, ["component", "n"]).withColumn("block", F.floor(at / BLOCK_SHINGLES).cast("int")).drop("same", "before")


def partners(heads: DataFrame) -> DataFrame:
    """cls, component, block, other: the blocks in which a class may have links, by common shingle and length, at least once each.

    heads: hash, cls, n, component, block."""
    held = heads.groupBy("hash", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    held = held.withColumn("salts", F.ceil(F.count("*").over(Window.partitionBy("hash")) / FEW).cast("int"))
    left = held.withColumn("salt", F.pmod("block", "salts"))
    right = held.select("hash", F.col("block").alias("other"), F.col("least").alias("from_n"), F.col("most").alias("to_n"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    close = lambda lo, hi: (F.col(lo) * NUM <= F.col("to_n") * DEN) & (F.col("from_n") * NUM <= F.col(hi) * DEN)
    met = left.join(right, ["hash", "salt"]).where(close("least", "most")).select("hash", "block", "other", "from_n", "to_n")
    return heads.join(met, ["hash", "block"]).where(close("n", "n")).select("cls", "component", "block", "other")


def linked(size, weight, side, flat, begin, cut: bool):
    """Numbers of links and spanning edges among sets (flat[begin[k]:begin[k + 1]], in the global order).

    cut: only pairs of different sides count."""
    m = len(size)
    _, ids = np.unique(flat, return_inverse=True)
    of = np.repeat(np.arange(m), size)
    pos = np.arange(len(flat)) - np.repeat(begin[:-1], size)
    cells = np.bincount(of * SUFFIX_CELLS + (flat >> np.uint64(20)).astype(np.int64) % SUFFIX_CELLS, minlength=m * SUFFIX_CELLS).reshape(m, SUFFIX_CELLS)
    in_prefix = np.flatnonzero(pos < prefix(size[of]))
    by_id = in_prefix[np.lexsort((of[in_prefix], ids[in_prefix]))]
    list_of, list_doc, list_pos = ids[by_id], of[by_id], pos[by_id]
    where = np.zeros(len(flat) and int(ids.max()) + 2, np.int64)
    np.add.at(where, list_of + 1, 1)
    where = np.cumsum(where)
    mark = np.zeros(len(where), bool)
    links, root, edges = np.zeros(m, np.int64), list(range(m)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(m):
        own = ids[begin[a] : begin[a + 1]]
        head = own[: prefix(int(size[a]))]
        lo, hi = where[head], where[head + 1]
        n = hi - lo
        if n.sum() <= len(head):
            continue
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        pos_a, b, pos_b = np.repeat(np.arange(len(head)), n), list_doc[at], list_pos[at]
        keep = b > a
        if cut:
            keep &= side[b] != side[a]
        pos_a, b, pos_b = pos_a[keep], b[keep], pos_b[keep]
        if not len(b):
            continue
        b, first = np.unique(b, return_index=True)  # the first common shingle of each pair
        pos_a, pos_b = pos_a[first], pos_b[first]
        least = needed(size[a], size[b])
        keep = (np.minimum(size[a], size[b]) * DEN >= np.maximum(size[a], size[b]) * NUM) & (1 + np.minimum(size[a] - pos_a - 1, size[b] - pos_b - 1) >= least)
        b, least = b[keep], least[keep]
        keep = np.minimum(cells[a], cells[b]).sum(axis=1) >= least  # the suffix filter
        b, least = b[keep], least[keep]
        if not len(b):
            continue
        mark[own] = True
        sizes = size[b]
        ends = np.cumsum(sizes)
        flat_at = np.repeat(begin[b] - (ends - sizes), sizes) + np.arange(ends[-1])
        common = np.add.reduceat(mark[ids[flat_at]], ends - sizes, dtype=np.int64)
        mark[own] = False
        b = b[common >= least]
        links[a] += weight[b].sum()
        links[b] += weight[a]
        for x in b:
            p, q = find(a), find(int(x))
            if p != q:
                root[q] = p
                edges.append((a, int(x)))
    return links, edges


def compare(key: tuple, table: pa.Table) -> pa.Table:
    """One task's links: rows (cls, null, links) and spanning edges (cls, other, 0); key: group and its two blocks."""
    first = np.unique(table.column("cls").to_numpy(), return_index=True)[1]
    table = table.take(pa.array(np.sort(first)))
    cls, weight, side = (table.column(n).to_numpy() for n in ("cls", "weight", "side"))
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
    size = np.array([len(x) for x in parts], np.int64)
    links, edges = linked(size, weight, side, np.concatenate(parts), np.concatenate(([0], np.cumsum(size))), key[1].as_py() != key[2].as_py())
    some = np.flatnonzero(links)
    a, b = (np.array([e[j] for e in edges], np.int64) for j in (0, 1))
    return pa.table({
        "cls": pa.array(np.concatenate((cls[some], cls[a]))), "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cls[b], pa.int64())]),
        "links": pa.array(np.concatenate((links[some], np.zeros(len(a), np.int64)))),
    })


def placed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component (a class of it; null without shingles), component_id, n_links: one row per document."""
    spark = integer_ids(docs).sparkSession
    # a stand-in for null doc_ids, from the text; equal texts may share it
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 62))).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    for seed in range(8):  # another digest if two sets ever share the first half of theirs
        all_rows = materialize(members(docs, seed), "members")
        classes = all_rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.min("doc_id").alias("least_doc"), F.count("*").alias("weight"), F.first("n").alias("n"), F.min("d2").alias("d_min"), F.max("d2").alias("d_max"))
        classes = materialize(classes, "classes")
        if classes.where("d_min != d_max").isEmpty():
            break
    counts = sketch(docs)
    freq = spark.sparkContext.broadcast(counts)  # 2**SKETCH_BITS numbers
    shared = materialize(prefixes(docs, freq, int(8 * counts.mean()) + OFTEN, seed), "prefixes")
    heads = materialize(shared_only(peeled(shared).where("head")).select("hash", "salt", "cls", "n"), "heads")
    groups = components(candidate_edges(heads))
    sized = materialize(groups.join(classes, F.col("node") == F.col("cls")).select("cls", "component", "rep", "weight", "n"), "groups")
    tasks = max(1, -(-sized.count() // TOGETHER))
    placed = materialize(in_blocks(sized), "placed")
    one = lambda g, i, j, side: F.struct(g.alias("g"), F.lit(i).alias("i") if isinstance(i, int) else i.alias("i"), F.lit(j).alias("j") if isinstance(j, int) else j.alias("j"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    together = placed.where("blocks = 1").select("cls", "rep", "weight", F.array(one(F.pmod(F.xxhash64("component"), F.lit(tasks)), -1, -1, 0)).alias("sides"))
    # the blocks that hold a class's prefix shingles, its own included, in rows of some blocks each
    apart = placed.where("blocks > 1").select(F.col("cls").alias("c"), "component", "block")
    met = partners(heads.join(apart, F.col("cls") == F.col("c")).select("hash", "cls", "n", "component", "block"))
    pair = one(F.col("component"), F.least("block", "other"), F.greatest("block", "other"), F.col("block"))
    wide = met.groupBy(F.col("cls").alias("c"), F.floor(F.col("other") / FEW)).agg(F.collect_set(pair).alias("sides")).select("c", "sides")
    spread = placed.where("blocks > 1").join(wide, F.col("cls") == F.col("c")).select("cls", "rep", "weight", "sides")
    placed = materialize(together.unionByName(spread), "sides")
    sides = "array<struct<g: long, i: int, j: int, side: int>>"

    def to_sets(batches):
        freq_here = freq.value
        for batch in batches:
            for c in chunks(batch.column("text")):
                part = batch.slice(c.first, len(c))
                t, g = sets(c)
                same = digests(t, g, len(c), seed)[0] == part.column("cls").to_numpy()  # rows that share the id but not the text go
                t, g, _ = ordered(t, g, freq_here)
                at = np.searchsorted(t, np.arange(len(c) + 1))
                kept = np.flatnonzero(same)
                rows = part.select(["cls", "weight", "sides"]).take(pa.array(kept))
                yield pa.record_batch([*rows.columns, pa.array([g[at[k] : at[k + 1]].tobytes() for k in kept], pa.binary())], names=[*rows.schema.names, "shingles"])

    # texts meet their classes in the same kind of join at every size
    with_text = docs.join(placed.hint("merge"), F.col("id") == F.col("rep")).select("cls", "weight", "sides", "text")
    ready = with_text.mapInArrow(to_sets, f"cls long, weight long, sides {sides}, shingles binary")
    dealt = ready.select("cls", "weight", "shingles", F.explode("sides").alias("s")).select("cls", "weight", "s.side", "shingles", "s.g", "s.i", "s.j")
    found = materialize(dealt.groupBy("g", "i", "j").applyInArrow(compare, "cls long, other long, links long"), "links")
    links = found.where("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
    of_class = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = of_class.join(classes.select("cls", "least_doc"), F.col("node") == F.col("cls"))
    least = named.groupBy("component").agg(F.min("least_doc").alias("component_id"))
    by_class = classes.select("cls", "least_doc", "weight").join(named.select("cls", "component").join(least, "component").select("cls", "component", "component_id"), "cls", "left").join(links, "cls", "left")
    by_class = materialize(by_class.select("cls", "weight", F.coalesce("component", "cls").alias("component"), F.coalesce("component_id", "least_doc").alias("component_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")), "by-class")
    discard(shared, heads, sized, found)
    hot = by_class.where(F.col("weight") >= max(2, all_rows.count() // HOT)).drop("weight")  # HOT rows at most
    worded = all_rows.where("n > 0")
    some = worded.join(F.broadcast(hot), "cls").unionByName(worded.join(F.broadcast(hot.select("cls")), "cls", "left_anti").join(by_class.drop("weight"), "cls"))
    columns = ("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component", "component_id", "n_links")
    none = all_rows.where("n = 0").select("doc_id", "th", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.select(*columns).unionByName(none)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links: one row per document."""
    return placed_rows(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component (that with the smallest doc_id, then text hash); rows with null doc_id or without words stay.

    The rows that go are a table of ids and text hashes; Spark sends it to all tasks or shuffles by its size.
    """
    rows = placed_rows(docs).where("doc_id is not null and n_shingles > 0").groupBy("component", "doc_id", "th").agg(F.count("*").alias("n"))
    rows = materialize(rows, "texts")
    first = rows.groupBy(F.col("component").alias("c")).agg(F.min(F.struct("doc_id", "th")).alias("x"))
    own = first.select("c", F.col("x.doc_id").alias("i"), F.col("x.th").alias("t"))
    repeated = materialize(rows.join(own, F.expr("component = c and doc_id = i and th = t"), "left").select("doc_id", "th", "n", F.col("i").isNotNull().alias("head")).where("not head or n > 1"), "not-single")
    id_of, hash_of = unused("other_id", docs), unused("other_hash", docs)
    gone = repeated.select(F.col("doc_id").alias(id_of), F.col("th").alias(hash_of))
    same = (docs["doc_id"] == gone[id_of]) & (F.xxhash64(docs["text"]) == gone[hash_of])
    kept = docs.join(gone, same, "left_anti")
    twice = repeated.where("head").select(F.col("doc_id").alias(id_of), F.col("th").alias(hash_of))
    if not twice.isEmpty():  # of equal rows, one
        again = docs.join(twice, (docs["doc_id"] == twice[id_of]) & (F.xxhash64(docs["text"]) == twice[hash_of])).dropDuplicates([id_of, hash_of])
        kept = kept.unionByName(again.select(*[docs[c] for c in docs.columns]))
    return kept


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


#: Pairs from an inverted list of all shingles, counted exactly; components by the smallest id that paths reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id) AS component_id,
  CAST((SELECT count(*) FROM link WHERE link.a = w.doc_id) AS BIGINT) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""

QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLES = {"op3_jaccard_join": ORACLE}
