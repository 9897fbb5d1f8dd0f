"""Which hashed keys occur in two documents or more, and in how many.

Documents are dealt over shards by id and text. A shard hands in its distinct keys,
sorted, each with its number of documents, cut by binary search into runs by
key range; a bucket merges the runs of all shards and returns to each shard
those of its keys that the whole corpus has twice or more. A key costs about
four bytes, and a key of any number of documents comes once from each shard.

No shard cuts its keys into more than ``FAN`` runs. Where there are more shards,
their runs are merged FAN shards at a time and cut into FAN finer runs each, level
by level, and what is shared comes back the same way: FAN rows a shard and level,
so rows grow with the corpus and not with its square.

Keys are the top 44 bits of a 64-bit hash. Two keys that share them are counted
as one, which makes counts too high and never too low.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import forget, lean, lean_group, pieces, run_starts, stored

BITS = 44
#: UTF-8 bytes of text in a shard.
SHARD_BYTES = 8 << 20
#: Runs that a shard's keys are cut into, and shards that are merged at a level.
FAN = 256
ROWS = "shard long, kind int, id long, keys binary, counts binary"
_ROWS = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
_HANDED = "bucket long, shard long, keys binary, counts binary"


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - BITS)


def packed(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: the first, then gaps (of 4 bytes where all fit)."""
    gaps = np.diff(keys)
    wide = 8 if len(gaps) and int(gaps.max()) >> 32 else 4
    return bytes([wide]) + keys[:1].tobytes() + gaps.astype(f"<u{wide}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.zeros(0, np.uint64)
    gaps = np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(data, "<u8", 1, 1), gaps)), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Which of that many equal ranges each key is in: key * buckets >> BITS, in
    two halves so that no product is over 64 bits."""
    half, b = np.uint64(BITS // 2), np.uint64(buckets)
    low = (keys & np.uint64((1 << BITS // 2) - 1)) * b >> half
    return ((keys >> half) * b + low >> half).astype(np.int64)


def handed_in(shard: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """A shard's sorted distinct keys, one row for each bucket that has any."""
    own = bucket_of(keys, buckets)
    first = run_starts(own)
    runs = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)])]
    return pa.table([pa.array(own[first]), pa.array([shard] * len(first), pa.int64()),
                     pa.array([packed(keys[r]) for r in runs], pa.binary()),
                     pa.array([counts[r].astype("<u4").tobytes() for r in runs], pa.binary())],
                    names=["bucket", "shard", "keys", "counts"])


def _summed(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The runs of a bucket, their distinct keys, and the documents of each."""
    runs = [unpacked(x) for x in t.column("keys").to_pylist()]
    keys = np.concatenate(runs)
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    first = run_starts(keys[order])
    return runs, keys[order][first], np.add.reduceat(counts[order], first)


def _given_back(shards: list[int], runs: list[np.ndarray], keys: np.ndarray, total: np.ndarray) -> pa.Table:
    """For each run those of its keys that are among ``keys``, with their counts."""
    out = []
    for shard, run in zip(shards, runs):
        if not len(keys):
            break
        at = np.minimum(np.searchsorted(keys, run), len(keys) - 1)
        hit = keys[at] == run
        if hit.any():
            out.append((shard, packed(run[hit]), _counts(total[at[hit]])))
    return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([1] * len(out), pa.int32()),
                     pa.nulls(len(out), pa.int64()), pa.array([r[1] for r in out], pa.binary()),
                     pa.array([r[2] for r in out], pa.binary())], names=["shard", "kind", "id", "keys", "counts"])


def _counts(total: np.ndarray) -> bytes:
    return np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()


def _merge(t: pa.Table) -> pa.Table:
    runs, keys, total = _summed(t)
    many = total >= 2
    return _given_back(t.column("shard").to_pylist(), runs, keys[many], total[many])


def _finer(buckets: int):
    """Merges the runs of a source and cuts them anew, for that many buckets in all."""
    def run(t: pa.Table) -> pa.Table:
        _, keys, total = _summed(t)
        return handed_in(t.column("source")[0].as_py(), keys, np.minimum(total, (1 << 32) - 1), buckets)
    return run


def _back(left: pa.Table, right: pa.Table) -> pa.Table:
    runs = [unpacked(x) for x in left.column("keys").to_pylist()]
    return _given_back(left.column("shard").to_pylist(), runs, *returned(right))


def first_cut(shards: int) -> int:
    """Buckets that each of so many shards cuts its keys into."""
    return min(shards, FAN)


def shared(handed: DataFrame, shards: int) -> DataFrame:
    """What each of so many shards gets back: rows of kind 1 with its shared keys
    and counts."""
    return _shared(handed, shards, shards, first_cut(shards))


def _shared(handed: DataFrame, each: int, shards: int, buckets: int) -> DataFrame:
    """``each``: shards that have runs in a bucket, ``shards``: all of them."""
    if each <= FAN:
        return handed.groupBy("bucket").applyInArrow(lean_group(_merge), ROWS)
    # runs of FAN shards next to each other in a bucket are one shard of the next level
    several = pieces(shards, FAN)
    handed = handed.withColumn("source", F.col("bucket") * several + F.floor(F.col("shard") / FAN))
    above = handed.groupBy("source").applyInArrow(lean_group(_finer(buckets * FAN)), _HANDED)
    back = _shared(above, pieces(each, FAN), buckets * several, buckets * FAN).withColumnRenamed("shard", "source")
    return handed.groupBy("source").cogroup(back.groupBy("source")).applyInArrow(lean(lambda key, a, b: _back(a, b)), ROWS)


def _shard(key: str, shards: int):
    return F.pmod(F.xxhash64(key, "digest"), F.lit(shards)).alias("shard")


def digest_of(text) -> Column:
    """What texts are told apart by: 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def by_shard(docs: DataFrame, shards: int) -> DataFrame:
    """Rows of (id, text) and what else there is, with the text's digest and the
    shard that they belong to. Rows of one id are dealt by their texts."""
    named = docs.select(*docs.columns, digest_of(F.col("text")).alias("digest"))
    return named.select(_shard("id", shards), *named.columns)


def members(classes: DataFrame, shards: int, name: str = "rep") -> DataFrame:
    """Rows of kind 0: ``name`` and digest of each text, where its smallest id is."""
    return classes.select(_shard("rep", shards), F.lit(0).alias("kind"), F.col(name).alias("id"),
                          F.col("digest").alias("keys"), F.lit(None).cast("binary").alias("counts"))


def returned(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's shared keys, sorted, and their counts."""
    own = right.filter(pa.compute.equal(right.column("kind"), 1))
    parts = sorted(((unpacked(k), np.frombuffer(c, "<u4")) for k, c in zip(own.column("keys").to_pylist(), own.column("counts").to_pylist())),
                   key=lambda p: int(p[0][0]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def standing(left: pa.Table, right: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """One row of each text that stands in this shard, in order of the id that its
    member row gives; and those ids."""
    forget("words:")  # a shard needs the memory
    own = right.filter(pa.compute.equal(right.column("kind"), 0))
    at = pa.compute.index_in(left.column("digest"), own.column("keys").combine_chunks())
    at = pa.compute.fill_null(at, -1).to_numpy().astype(np.int64)
    member, row = np.unique(at, return_index=True)
    row, ids = row[member >= 0], own.column("id").to_numpy()[member[member >= 0]]
    order = np.argsort(ids, kind="stable")
    return left.take(pa.array(row[order])), ids[order]


def first_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of all rows, and (digest, rep, node): the smallest id of each
    text, and a number of its own, which holds once it is written. The rows are
    written, so that joins with them don't read whole texts again."""
    named = stored(docs.select("id", digest_of(F.col("text")).alias("digest")), "named")
    return named, named.groupBy("digest").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id())
