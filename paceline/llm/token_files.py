"""Operator 10: token ids as Arrow IPC files of fixed-size lists.

Documents are range-partitioned by doc_id; each task encodes its documents in order, ends each with
``end_id``, and writes the ids as one file of equal-length sequences: record batches of
``FixedSizeList<uint16 or uint32>[length]`` and a ``FixedSizeList<bool>[length]`` mask, true for ids and
false for the padding of the file's last sequence. Batches are uncompressed and all but the last have
the same number of rows, so sequence i is found by arithmetic and read as a view of the mapped file
(``TokenFile``). A second file holds the documents' places. Files are written under an attempt's own
name and then moved, so a task that is run again replaces its file with equal bytes; the manifest, one
row per file, says which files count.

Defined cases: null text is empty and gives the end id alone; repeated rows and equal doc_ids are
written one after the other (by the hash of the text); a null doc_id sorts first; an empty table gives
no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.shared import documents, materialize, new_path
from paceline.llm.tokens import default_path, encoder

LENGTH = 1024
ROWS_PER_BATCH = 64
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, file string, n_docs long, n_ids long"


def schema_of(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Cuts a stream of ids into batches of whole sequences."""

    def __init__(self, sink, length: int, wide: bool):
        self.schema, self.length, self.type = schema_of(length, wide), length, np.uint32 if wide else np.uint16
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0

    def _put(self, ids: np.ndarray) -> None:
        short = -len(ids) % self.length
        values, mask = pa.array(np.pad(ids, (0, short))), pa.array(np.arange(len(ids) + short) < len(ids))
        self.out.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(v, type=t) for v, t in zip((values, mask), self.schema.types, strict=True)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.type))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= (size := self.length * ROWS_PER_BATCH):
            flat = np.concatenate(self.parts)
            whole = len(flat) // size * size
            for i in range(0, whole, size):
                self._put(flat[i : i + size])
            self.parts, self.held = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.parts))
        self.out.close()


class TokenFile:
    """Random access to the sequences of one file, and its documents' places."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        local = isinstance(store, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))
        with store.open_input_file(path + ".index") as f:
            self.index = pa.ipc.open_file(f).read_all()
        self.length = self.reader.schema.field("ids").type.list_size

    def batches(self) -> Iterator[np.ndarray]:
        """Views of all ids, batch by batch, padding included."""
        for i in range(self.reader.num_record_batches):
            yield self.reader.get_batch(i).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of sequence i."""
        batch = self.reader.get_batch(i // ROWS_PER_BATCH)
        row = slice((i % ROWS_PER_BATCH) * self.length, (i % ROWS_PER_BATCH + 1) * self.length)
        return tuple(batch.column(n).flatten()[row].to_numpy(zero_copy_only=n == "ids") for n in ("ids", "mask"))


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, length: int = LENGTH, files: int | None = None) -> DataFrame:
    """Write docs' ids to folder (a URI that all executors reach); returns the manifest."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def put(batches):
        texts = encoder(tokenizer)
        wide = texts.tokenizer.get_vocab_size() > 65536
        writer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                task = TaskContext.get()
                name = f"part-{task.partitionId():06d}.arrow"
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                drafts = [f"{root}/.{name}{kind}.{task.taskAttemptId()}" for kind in ("", ".index")]
                sinks = [store.open_output_stream(x) for x in drafts]
                writer, index, n_docs = _Writer(sinks[0], length, wide), pa.ipc.new_file(sinks[1], INDEX), 0
            starts, counts = [], []
            for text in batch.column("text"):
                ids = np.append(texts.ids(text.as_py() or ""), np.uint32(end_id))
                starts.append(writer.total)
                counts.append(len(ids))
                writer.add(ids)
            n_docs += batch.num_rows
            index.write_batch(pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=INDEX))
        if writer is not None:
            writer.close()
            index.close()
            for sink in sinks:
                sink.close()
            for draft, kind in zip(drafts, ("", ".index"), strict=True):
                store.move(draft, f"{root}/{name}{kind}")
            yield pa.record_batch({"shard": pa.array([task.partitionId()], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([writer.total], pa.int64())})

    tie = F.xxhash64("text")
    ranged = docs.select("doc_id", "text").repartitionByRange(files, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return materialize(ranged.mapInArrow(put, MANIFEST), "token-files")


def read(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start among all ids, n_tokens, ids_crc32 of the ids read back."""
    spark = manifest.sparkSession
    rows = sorted(manifest.select("shard", "file", "n_ids").collect())  # one per file
    bases, total = [], 0
    for _, file, n in rows:
        bases.append((file, total))
        total += n

    def get(batches):
        for batch in batches:
            for file, base in zip(*(batch.column(n).to_pylist() for n in ("file", "base")), strict=True):
                tokens = TokenFile(file)
                ends = np.cumsum(tokens.index.column("n_tokens").to_numpy())
                crcs, crc, doc, at = np.zeros(len(ends), np.int64), 0, 0, 0
                for ids in tokens.batches():
                    data, i = ids.astype("<u4"), 0
                    while i < len(data) and doc < len(ends):
                        j = min(len(data), int(ends[doc]) - at)
                        crc = zlib.crc32(data[i:j], crc)
                        if at + j == ends[doc]:
                            crcs[doc], crc, doc = crc, 0, doc + 1
                        i = j
                    at += len(data)
                yield pa.record_batch({
                    "doc_id": tokens.index.column("doc_id").combine_chunks(), "start": pa.array(tokens.index.column("start").to_numpy() + base),
                    "n_tokens": tokens.index.column("n_tokens").combine_chunks(), "ids_crc32": pa.array(crcs),
                })

    places = spark.createDataFrame(bases, "file string, base long").repartition(max(1, len(bases)))
    return places.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    folder = new_path(spark, "tokens")
    return read(write(documents(spark, sf_dir), folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")), tokenizer or default_path()))


QUERIES = {"op10_token_files": op10_token_files}
