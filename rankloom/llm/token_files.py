"""Operator 6: token ids in binary files with Elias-Fano document boundaries.

Documents are range-partitioned by id; each task encodes its run and writes
files that hold one concatenated id array. Where each document ends is an
Elias-Fano list: the low bits of the ends are packed side by side, the high
bits are a unary bit string, and every 256th one of it is noted so that
``BoundaryList.select`` needs a short scan. That takes about 2 + log2(ids per
document) bits a document instead of 64.

Nulls and empty texts: an empty text has the end id alone; null ids sort last, rows
of one id by a hash of their texts. Repeated rows stay rows of their own. An empty table writes no file and gives
no rows. A text of any length is one document in one file.
"""

from __future__ import annotations

import re


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import id_text, out_id, pieces, scratch_dir, small_batches, text_bytes
from rankloom.llm.tokens import encoder, vocabulary

MAGIC = b"RLTOKEN1"
#: Noted ones of the unary bit string: each of so many.
NOTED = 256
#: A file is closed once it holds so many ids; text bytes a task is given.
FILE_IDS, TASK_BYTES = 8 << 20, 16 << 20
END_ID = 1


class BoundaryList:
    """An Elias-Fano list of ascending ends; ``select(i)`` is the i-th of them."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, noted: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.noted = n, low_bits, low, high, noted

    @classmethod
    def of(cls, ends: np.ndarray) -> BoundaryList:
        n = len(ends)
        ends = ends.astype(np.uint64)
        most = int(ends[-1]) if n else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        bits = ((ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, low_bits, np.packbits(bits.ravel()), np.packbits(unary), ones[::NOTED].astype(np.uint32))

    def _low(self, i: int, k: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(k, np.int64)
        first = i * self.low_bits
        own = np.unpackbits(self.low[first // 8:-(-(first + k * self.low_bits) // 8)])[first % 8:][:k * self.low_bits]
        return own.reshape(k, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """End of document i: from the nearest noted one, a scan of the unary bits."""
        at, need = int(self.noted[i // NOTED]), i % NOTED
        byte, skip = at // 8, at % 8
        step = 64
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte:byte + step])[skip:])
            if len(ones) > need:
                return int(((at + int(ones[need]) - i) << self.low_bits) | int(self._low(i, 1)[0]))
            step *= 4

    def between(self, i: int, j: int) -> np.ndarray:
        """Ends of documents i to j - 1: the unary bits from the noted one before
        the first to the noted one after the last, and their low bits."""
        at, past = int(self.noted[i // NOTED]), (j - 1) // NOTED + 1
        stop = int(self.noted[past]) if past < len(self.noted) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at // 8:-(-stop // 8)])[at % 8:]
        ones = np.flatnonzero(bits)[i % NOTED:i % NOTED + j - i] + at
        return ((ones - np.arange(i, j)) << self.low_bits) | self._low(i, j - i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))[:self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._low(0, self.n)

    @property
    def n_bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.noted.nbytes


def to_bytes(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: header, document ids, boundaries, token ids (2 bytes each where
    all of them fit, else 4)."""
    b = BoundaryList.of(ends)
    wide = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = np.array([b.n, len(ids), b.low_bits, len(b.low), len(b.high), len(b.noted), wide], "<i8")
    return b"".join([MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), b.low.tobytes(), b.high.tobytes(),
                     b.noted.astype("<u4").tobytes(), ids.astype(f"<u{wide}").tobytes()])


def from_bytes(data: bytes) -> tuple[np.ndarray, BoundaryList, np.ndarray]:
    """(document ids, boundaries, token ids); a file that is cut short raises."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    n, n_ids, low_bits, low, high, noted, wide = (int(x) for x in np.frombuffer(data, "<i8", 7, 8))
    at = 64
    if len(data) != at + 8 * n + low + high + 4 * noted + wide * n_ids:
        raise ValueError("token file has a wrong length")
    doc_ids = np.frombuffer(data, "<i8", n, at)
    at += 8 * n
    b = BoundaryList(n, low_bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low),
                     np.frombuffer(data, "<u4", noted, at + low + high))
    return doc_ids, b, np.frombuffer(data, f"<u{wide}", n_ids, at + low + high + 4 * noted)


def put(folder: str, name: str, data: bytes, attempt: int) -> None:
    """Write a file whole or not at all, into any store that Arrow reaches."""
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/_{name}.{attempt}") as out:
        out.write(data)
    store.move(f"{path}/_{name}.{attempt}", f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID,
                      task_bytes: int = TASK_BYTES, file_ids: int = FILE_IDS) -> list[tuple]:
    """Encode ``docs`` and write its files into ``folder`` (shared by all
    executors) in ascending doc_id order; returns (part, file, documents, ids) of
    each, one row for each file."""
    path = tokenizer or vocabulary()
    docs = id_text(docs)
    n = pieces(text_bytes(docs), task_bytes)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        from pyspark import TaskContext
        at = TaskContext.get()
        part, attempt = at.partitionId(), at.taskAttemptId()
        rows = []

        def close(doc_ids, lengths, parts):
            ids = np.frombuffer(b"".join(parts), "<u4")
            name = f"part-{part:06d}-{len(rows):04d}.tok"
            put(folder, name, to_bytes(np.array(doc_ids, np.int64), np.cumsum(lengths), ids), attempt)
            rows.append((part, len(rows), len(doc_ids), len(ids)))

        doc_ids, lengths, parts, size = [], [], [], 0
        enc = encoder(path)
        for b in small_batches(batches, "text"):
            for d, ids in zip(b.column("id").to_pylist(), enc.ids(b.column("text").to_pylist())):
                doc_ids.append(d)
                parts += [ids, end]
                lengths.append(len(ids) // 4 + 1)
                size += lengths[-1]
                if size >= file_ids:
                    close(doc_ids, lengths, parts)
                    doc_ids, lengths, parts, size = [], [], [], 0
        if doc_ids:
            close(doc_ids, lengths, parts)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                             names=["part", "file", "n_docs", "n_ids"])

    # a task that is run again has the same rows in the same order, and rows without an id are spread
    order = docs.withColumn("own", F.xxhash64("text")).repartitionByRange(n, "id", "own").sortWithinPartitions("id", "own").drop("own")
    done = order.mapInArrow(write, "part long, file long, n_docs long, n_ids long")
    return sorted(tuple(r) for r in done.collect())


def read_token_files(spark: SparkSession, folder: str, files: list[tuple]) -> DataFrame:
    """(id, start, ids binary) of every document, from the files alone: ids as
    little-endian 32-bit integers, start counted over all files in order."""
    schema = "id long, start long, ids binary"
    if not files:
        return spark.createDataFrame([], schema)
    key = np.array([f[0] * 10000 + f[1] for f in files], np.int64)
    before = np.concatenate(([0], np.cumsum([f[3] for f in files])))[:-1].astype(np.int64)

    def read(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                part, file = map(int, re.search(r"part-(\d+)-(\d+)\.tok$", path).groups())
                base = int(before[np.searchsorted(key, part * 10000 + file)])
                doc_ids, ends, ids = from_bytes(content.as_buffer().to_pybytes())
                step = 8 * NOTED
                for i in range(0, len(doc_ids), step):
                    j = min(len(doc_ids), i + step)
                    first = ends.select(i - 1) if i else 0
                    edge = np.concatenate(([first], ends.between(i, j)))
                    own = np.ascontiguousarray(ids[first:edge[-1]].astype("<u4"))
                    off = edge - first
                    blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i,
                                                            [None, pa.py_buffer(np.ascontiguousarray(off * 4)),
                                                             pa.py_buffer(own)])
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i:j]), pa.array(edge[:-1] + base),
                                                      blob.cast(pa.binary())], names=["id", "start", "ids"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(folder)
    return found.select("path", "content").mapInArrow(read, schema)


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what ``read_token_files`` gives."""
    return tokens.select(out_id(), "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                         F.crc32("ids").alias("ids_crc32"))


def round_trip(spark: SparkSession, docs: DataFrame, folder: str | None = None, **how) -> DataFrame:
    folder = folder or scratch_dir(spark, "tokens")
    return read_token_files(spark, folder, write_token_files(docs, folder, **how))


__all__ = ["BoundaryList", "digest", "from_bytes", "read_token_files", "round_trip", "to_bytes",
           "write_token_files"]
