"""Operator 13: align the tokens of two tokenizers over the same bytes.

``Pair`` encodes a text with a byte-level tokenizer (A, of space and text) and a sentencepiece model (B,
which adds that space), as events: the byte offsets where tokens end. Events travel in blocks of ids (an
id gives its token's bytes), A's and B's in one table, are repartitioned by document and sorted by offset,
and ``Sweep`` reads them like two merged lists. Offsets where both end close a group. Between two
neighbouring offsets of the union lies exactly one token of either side, and each overlapping pair of tokens
shares exactly one such stretch, so links are the stretches. The state is the open group and the blocks that reach beyond it, whatever
the text's length.

Corpus counts: a chunk is about ``LINKS`` links of whole or partial documents; its distinct id pairs become rows
with counts, which Spark sums. Every chunk asks for its pairs again (a join on the pair), the answers are
repartitioned by chunk to its documents' pairs, and each document sums them. No pair or document is
larger than a chunk there, so no key is hot.

Texts of Latin letters get A's ids from tiktoken, with ranks made from A's own merges, which is four times as
fast; a test compares both.

Defined cases: null and empty texts, and texts whose joined token bytes aren't space and text (U+2581, which B
writes for a space, is the usual cause), have no tokens, zeros and an empty digest; rows that are equal in
doc_id and text are aligned once per task and counted as often as they occur; a null doc_id is an ordinary value;
an empty table gives no rows; other columns are ignored; doc_ids are whole numbers.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.shared import discard, documents, integer_ids, materialize
from paceline.llm.tokens import BYTE_LETTERS

#: Tokens of one event block.
BLOCK = 1 << 15
#: Links of a chunk; a chunk's links, distinct pairs and answers are in a task's memory at once.
LINKS = 1_000_000
#: How byte-level tokenizers part a text before its bytes are merged (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this character, libraries can't differ in what a letter, number or space is; other texts take the tokenizer's own way.
PLAIN = "\u0250"
ROWS = 20_000

EVENTS = "key binary, doc_id long, start long, side int, copies long, n int, ids binary"
SWEPT = "chunk long, key binary, doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, entries binary, n int, at int, a int, b int, pair_count long"


class Pair:
    """Both tokenizers: ids of a text on either side, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {letter: b for b, letter in enumerate(BYTE_LETTERS)}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [self._letters(names.get(i), byte_of) for i in range(max(names) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.quick = self._ranked(spec)

    def _ranked(self, spec: dict):
        """The same byte pairs by rank in tiktoken, which is faster, if ids ascend with the merges; else None."""
        import tiktoken

        pre, vocab = spec.get("pre_tokenizer") or {}, spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ascending = all(vocab[x + y] == 256 + k for k, (x, y) in enumerate(merges)) and all(vocab.get(c, 256) < 256 for c in BYTE_LETTERS)
        if not ascending or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _letters(token: str | None, byte_of: dict[str, int]) -> bytes:
        return bytes(byte_of[c] for c in token) if token and all(c in byte_of for c in token) else (token or "").encode()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """A's and B's ids, both empty if either doesn't give the text's bytes."""
        if not text:
            return [], []
        spaced = " " + text
        if self.quick is not None and max(text) < PLAIN:
            a = self.quick.encode_ordinary(spaced)
        else:
            a = self.a.encode(spaced, add_special_tokens=False).ids
        b, whole = self.b.encode(text), spaced.encode()
        joined = all(b"".join([of[i] for i in ids]) == whole for of, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        return (a, b) if joined else ([], [])


@lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    """One per worker process and pair of files."""
    return Pair(path_a, path_b)


def _digits(n: int) -> np.ndarray:
    """Ids below n as decimal digits, one row each, with zero bytes after them and a last column for the separator."""
    return np.array([str(i).encode() for i in range(n)], "S7").view(np.uint8).reshape(n, 7)


class Tables:
    """Token lengths and digits by id; one byte string per group list."""

    def __init__(self, pair: Pair):
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in (pair.bytes_a, pair.bytes_b)]
        self.digits = [_digits(len(side)) for side in (pair.bytes_a, pair.bytes_b)]
        self.size_b = len(pair.bytes_b)

    def text(self, ids: list[np.ndarray], group: list[np.ndarray]) -> bytes:
        """``a1,a2|b1;...`` of whole groups; group numbers ascend on both sides."""
        rows = []
        for side, (last, token, g) in enumerate(zip(b"|;", ids, group, strict=True)):
            row = self.digits[side][token]
            row[:, 6] = np.where(np.append(g[1:] != g[:-1], True), last, ord(","))
            rows.append(row)
        order = np.argsort(np.concatenate([group[0] * 2, group[1] * 2 + 1]), kind="stable")
        flat = np.concatenate(rows)[order].ravel()
        return flat[flat != 0].tobytes()[:-1]


@lru_cache(maxsize=1)
def tables_of(path_a: str, path_b: str) -> Tables:
    return Tables(pair_of(path_a, path_b))


class Sweep:
    """Reads one document's event blocks in the order of their offsets; ``step`` gives what is closed so far."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.ids = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.ends = [np.empty(0, np.int64), np.empty(0, np.int64)]

    def add(self, side: int, start: int, ids: np.ndarray) -> None:
        ids = ids.astype(np.int64)
        ends = start + np.cumsum(self.tables.lengths[side][ids])
        self.ids[side], self.ends[side] = (np.concatenate([x[side], y]) if len(x[side]) else y for x, y in ((self.ids, ids), (self.ends, ends)))

    def step(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray] | None:
        """Ids and group numbers of both sides up to the last offset where both end, and the linked ids; None if no group is whole."""
        common = np.intersect1d(self.ends[0], self.ends[1], assume_unique=True)
        if not len(common):
            return None
        ids, ends = [], []
        for side in (0, 1):
            k = int(np.searchsorted(self.ends[side], common[-1])) + 1
            ids.append(self.ids[side][:k])
            ends.append(self.ends[side][:k])
            self.ids[side], self.ends[side] = self.ids[side][k:], self.ends[side][k:]
        offsets = np.union1d(*ends)
        return ids, [np.searchsorted(common, e) for e in ends], ids[0][np.searchsorted(ends[0], offsets)], ids[1][np.searchsorted(ends[1], offsets)]


def _packed(ids: np.ndarray, wide: bool) -> bytes:
    return pa.compress(ids.astype("<u4" if wide else "<u2").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of token ends of both sides, and one row per document (side -1) before them."""

    def encode(batches):
        pair = pair_of(path_a, path_b)
        wide = [len(pair.bytes_a) > 65536, len(pair.bytes_b) > 65536]
        lengths = tables_of(path_a, path_b).lengths
        for batch in batches:
            rows: dict[bytes, list] = {}
            for i, key in enumerate(batch.column("key").to_pylist()):
                rows.setdefault(key, [i, 0])[1] += 1
            doc_ids, texts, out, size = batch.column("doc_id").to_pylist(), batch.column("text"), [], 0
            for key, (i, copies) in rows.items():
                out.append((key, doc_ids[i], -1, -1, copies, 0, b""))
                for side, ids in enumerate(map(np.array, pair.ids(texts[i].as_py()))):
                    start = 0
                    for k in range(0, len(ids), BLOCK):
                        block = ids[k : k + BLOCK]
                        out.append((key, doc_ids[i], start, side, 0, len(block), _packed(block, wide[side])))
                        start += int(lengths[side][block].sum())
                        size += len(out[-1][-1])
                if size > 1 << 20:
                    yield _batch(out, EVENTS)
                    out, size = [], 0
            yield _batch(out, EVENTS)

    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))).cast("binary")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key")).mapInArrow(encode, EVENTS)


ARROW = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


class _Chunk:
    """Links of some documents, to be written as distinct pairs and, per document, numbers of pairs."""

    def __init__(self, number: int, size_b: int):
        self.number, self.size_b, self.codes, self.docs, self.total = number, size_b, [], [], 0

    def add(self, codes: list[np.ndarray], row: tuple) -> None:
        """row: key, doc_id, copies, n_a, n_b, n_groups, n_links, groups_sha256."""
        self.codes.append(np.concatenate(codes) if codes else np.empty(0, np.int64))
        self.docs.append(row)
        self.total += len(self.codes[-1])

    def batches(self):
        sizes = np.array([len(c) for c in self.codes], np.int64)
        pairs, inverse = np.unique(np.concatenate(self.codes), return_inverse=True)
        copies = np.repeat(np.array([d[2] for d in self.docs], np.int64), sizes)
        weights = np.zeros(len(pairs), np.int64)
        np.add.at(weights, inverse, copies) if copies.max(initial=1) > 1 else np.copyto(weights, np.bincount(inverse, minlength=len(pairs)))
        none = lambda n, kind: pa.nulls(n, kind)
        for k in range(0, len(pairs), ROWS):
            p = pairs[k : k + ROWS]
            n = len(p)
            yield pa.record_batch(
                [pa.array(np.full(n, self.number)), none(n, pa.binary()), *[none(n, pa.int64())] * 6, none(n, pa.string()), none(n, pa.binary()), none(n, pa.int32()), pa.array(np.arange(k, k + n, dtype=np.int32)), pa.array((p // self.size_b).astype(np.int32)), pa.array((p % self.size_b).astype(np.int32)), pa.array(weights[k : k + n])],
                names=[x.split()[0] for x in SWEPT.split(", ")],
            )
        found, times = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(pairs)) + inverse, return_counts=True)
        doc, at = found // max(1, len(pairs)), found % max(1, len(pairs))
        bounds = np.searchsorted(doc, np.arange(len(sizes) + 1))
        out, size = [], 0
        for i, row in enumerate(self.docs):
            part = slice(bounds[i], bounds[i + 1])
            entries = np.concatenate([np.diff(at[part], prepend=0), times[part]]).astype("<u4")
            out.append((self.number, *row, pa.compress(entries.tobytes(), codec="zstd", asbytes=True), len(entries), None, None, None, None))
            size += len(out[-1][9])
            if size > 1 << 20:
                yield _batch(out, SWEPT)
                out, size = [], 0
        yield _batch(out, SWEPT)


def _documents(batches, path_a: str, path_b: str):
    """The sweep over sorted event blocks: (key, doc_id, copies, step or None), None after a document's last step."""
    tables, key, sweep, last, doc_id, copies = tables_of(path_a, path_b), None, None, None, None, 0
    kinds = ["<u4" if len(d) > 65536 else "<u2" for d in tables.digits]
    for batch in batches:
        names = batch.schema.names
        cols = [batch.column(names.index(n)).to_pylist() for n in ("key", "doc_id", "start", "side", "copies", "n", "ids")]
        for k, d, start, side, more, n, ids in zip(*cols, strict=True):
            if k != key:
                if key is not None:
                    yield key, doc_id, copies, None
                key, doc_id, copies, sweep, last = k, d, 0, Sweep(tables), None
            if side < 0:
                copies += more
            elif (start, side) != last:  # a copy's block is the same block again
                last = start, side
                sweep.add(side, start, _unpacked(ids, n, kinds[side]))
                if (closed := sweep.step()) is not None:
                    yield key, doc_id, copies, closed
    if key is not None:
        yield key, doc_id, copies, None


def sweep(dealt: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents (with entries) and of a chunk's pairs (with a and b); dealt: ``sorted_events``."""

    def run(batches):
        tables, task = tables_of(path_a, path_b), TaskContext.get().partitionId() << 32
        number, chunk = 0, _Chunk(task, tables.size_b)
        sha, codes, held, n_a, n_b, n_groups, n_links = hashlib.sha256(), [], 0, 0, 0, 0, 0
        for key, doc_id, copies, closed in _documents(batches, path_a, path_b):
            if closed is not None:
                ids, group, a, b = closed
                sha.update((b";" if n_groups else b"") + tables.text(ids, group))
                codes.append(a * tables.size_b + b)
                held += len(a)
                n_a, n_b, n_groups, n_links = n_a + len(ids[0]), n_b + len(ids[1]), n_groups + int(group[0][-1]) + 1, n_links + len(a)
            else:
                chunk.add(codes, (key, doc_id, copies, n_a, n_b, n_groups, n_links, sha.hexdigest() if n_a else ""))
                sha, codes, held, n_a, n_b, n_groups, n_links = hashlib.sha256(), [], 0, 0, 0, 0, 0
            if chunk.total + held >= LINKS:
                if codes:  # a part of a document, whose counts and digest come with its last part
                    chunk.add(codes, (key, doc_id, copies, 0, 0, 0, 0, ""))
                    codes, held = [], 0
                yield from chunk.batches()
                number += 1
                chunk = _Chunk(task + number, tables.size_b)
        if chunk.docs:
            yield from chunk.batches()

    return dealt.mapInArrow(run, SWEPT)


def sorted_events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Events by document, in the order of their offsets."""
    return events(docs, path_a, path_b).repartition("key").sortWithinPartitions("key", "start", "side")


def pair_counts(swept: DataFrame) -> DataFrame:
    """Every linked id pair of the corpus: a, b, links, and most, the highest number of links of any pair with this b."""
    counts = swept.where("a is not null").groupBy("a", "b").agg(F.sum("pair_count").alias("links"))
    return counts.join(counts.groupBy("b").agg(F.max("links").alias("most")), "b")


def _summed(dealt: DataFrame) -> DataFrame:
    """Per document of a chunk (answers first, then documents): its counts, n_best and count_sum."""
    schema = "key binary, doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"

    def run(batches):
        chunk, counts, best = None, [], []
        for batch in batches:
            names = batch.schema.names
            col = lambda n: batch.column(names.index(n))  # noqa: B023, E731
            ids, is_doc = col("chunk").to_numpy(), col("key").is_valid().to_numpy(zero_copy_only=False)
            links, most = (col(n).fill_null(0).to_numpy() for n in ("links", "most"))
            edges = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (is_doc[1:] != is_doc[:-1]))) if len(ids) else []
            out = []
            for lo, hi in zip(edges, [*edges[1:], len(ids)], strict=True):
                if ids[lo] != chunk:
                    chunk, counts, best = ids[lo], [], []
                if not is_doc[lo]:
                    counts.append(links[lo:hi])
                    best.append(links[lo:hi] == most[lo:hi])
                    continue
                counts, best = [np.concatenate(counts)] if counts else [], [np.concatenate(best)] if best else []
                part = batch.slice(lo, hi - lo)
                rows = zip(*(part.column(names.index(n)).to_pylist() for n in ("key", "doc_id", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "entries", "n")), strict=True)
                for *row, entries, n in rows:
                    step, times = _unpacked(entries, n, "<u4").astype(np.int64).reshape(2, -1)
                    at = np.cumsum(step)
                    out.append((*row, int(times[best[0][at]].sum()) if n else 0, int((times * counts[0][at]).sum()) if n else 0))
            yield _batch(out, schema)

    return dealt.mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    swept = materialize(sweep(sorted_events(integer_ids(docs), path_a, path_b), path_a, path_b), "alignment")
    asked = swept.where("a is not null").select("chunk", "at", "a", "b").join(pair_counts(swept), ["a", "b"])
    answers = asked.select("chunk", "at", "links", "most")
    own = swept.where("key is not null").drop("at", "a", "b", "pair_count")
    dealt = answers.unionByName(own, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("key").isNotNull(), "at")
    parts = _summed(dealt)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    whole = parts.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.max("copies").alias("copies"), *[F.sum(c).alias(c) for c in numbers], F.max("groups_sha256").alias("groups_sha256"))
    out = materialize(whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *numbers, "groups_sha256"), "aligned")
    discard(swept)
    return out


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups themselves: doc_id, copies (equal rows), position (from 0), a and b (arrays of ids)."""
    schema = "doc_id long, copies long, position long, a array<int>, b array<int>"

    def run(batches):
        before = 0
        for _, doc_id, copies, closed in _documents(batches, path_a, path_b):
            if closed is None:
                before = 0
                continue
            ids, group, *_ = closed
            n = int(group[0][-1]) + 1
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(g, np.arange(n + 1)).astype(np.int32)), pa.array(i.astype(np.int32))) for i, g in zip(ids, group, strict=True)]
            rows = pa.array([doc_id] * n, pa.int64()), pa.array([copies] * n, pa.int64()), pa.array(np.arange(before, before + n))
            yield pa.record_batch([*rows, *lists], names=["doc_id", "copies", "position", "a", "b"])
            before += n

    return sorted_events(integer_ids(docs), path_a, path_b).mapInArrow(run, schema)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir), *default_paths())


QUERIES = {"op13_alignment": op13_alignment}
