"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import configure, scratch_dir  # noqa: F401  (re-exported)

#: A null doc_id counts as larger than every other id.
NO_ID = (1 << 63) - 1
#: The word rule of all operators: runs of anything but these ASCII blanks.
BLANKS = "[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(id, text) of a documents table, whatever else it carries: null ids
    become NO_ID, null texts become empty."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def out_id(col: str = "id") -> Column:
    """The doc_id to hand out: NO_ID is null again."""
    return F.when(F.col(col) != NO_ID, F.col(col)).alias("doc_id")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of the text column, one small aggregate."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pieces(total: int, each: int) -> int:
    return max(1, math.ceil(total / each))


def kept_between_tasks(name: str, make):
    """An object that a Python worker makes once and keeps for its later tasks."""
    store = sys.__dict__.setdefault("_rankloom_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def forget(prefix: str) -> None:
    """Let go of what this worker kept under names that begin so."""
    store = sys.__dict__.get("_rankloom_kept", {})
    for name in [n for n in store if n.startswith(prefix)]:
        del store[name]


def give_back() -> None:
    """Hand memory that is free in this worker back to the system: what a group
    took at its height would stay with an idle worker otherwise."""
    import ctypes
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def lean(fn):
    """``fn`` of a cogroup (key, left, right), giving memory back after each."""
    def run(key, left, right):
        try:
            return fn(key, left, right)
        finally:
            give_back()
    return run


def lean_group(fn):
    """The same for ``fn`` of a group's table."""
    def run(t):
        try:
            return fn(t)
        finally:
            give_back()
    return run


def lean_batches(fn):
    """The same for ``fn`` of a partition's batches, after the last of them."""
    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()
    return run


def small_batches(batches, column: str, limit: int = 2 << 20):
    """Cut Arrow batches so that ``column`` has at most ``limit`` bytes in each
    part (a longer text is a part of its own)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        done = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < len(size):
            base = done[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(done, base + limit, "right")))
            yield b.slice(start, end - start)
            start = end


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 bytes of a string array, and len + 1 offsets."""
    texts = texts.cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def ascii_lower(texts: pa.Array) -> pa.Array:
    """A-Z to a-z; every other code point stays (UTF-8 tails are >= 0x80)."""
    data, off = raw(texts)
    up = (data >= 65) & (data <= 90)
    low = data + up.astype(np.uint8) * np.uint8(32)
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off, np.int64)),
                                            pa.py_buffer(low))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts given as bytes and offsets: start, end, and text index."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~blank
    first = inside.copy()
    last = inside.copy()
    if len(data):
        first[1:] &= blank[:-1]
        last[:-1] &= blank[1:]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as one Arrow string array (one gather over the bytes)."""
    n = end - start
    to = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=to[1:])
    take = np.repeat(start - to[:-1], n) + np.arange(to[-1])
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(data[take])))


def word_codes(data, start, end) -> tuple[np.ndarray, pa.Array]:
    """Words as codes into their distinct values."""
    d = word_array(data, start, end).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted or grouped array."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def joined_ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... n[0] values, then those of start[1], ..."""
    to = np.cumsum(n)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(start - (to - n), n)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to a fresh table in the cluster's shared folder."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
