"""Byte-bounded, order-preserving sharding of records into JSON-array files.

Records are (group..., pos, rec_bytes) with rec_bytes = compact JSON bytes + 1
(the separator); a shard's file is ``[`` + records joined by ``,`` + ``]``.

* :func:`greedy_shards` (SHARD2) reproduces the reference's sequential
  packing exactly: a shard starts at 2 bytes, a record is added while it fits,
  the shard is flushed when a record would overflow it, and an oversize
  record gets a shard of its own. The fold is sequential by nature; it is run
  in three parallel passes over range partitions (see below), so no group is
  ever collected into one task.
* :func:`bounded_shards` (SHARD1) is the cheaper prefix-sum variant: shard =
  floor(start offset / W) within segments that large records end, numbered in
  order; W = budget - largest small record. Every shard stays within budget
  (or is one large record); shards are not greedy-optimal.

Greedy in parallel. For a run of records of one group, let ``G(i)`` be the
outcome (bytes of the last open shard, shards started) of packing from a
fresh shard at record i. ``next(i)`` (where the shard started at i ends) is
monotone, so it comes from one ``searchsorted`` over prefix sums, and all
``G(i)`` follow by pointer doubling (vectorised numpy, O(L log L)). A
partition entered with an open shard of ``c`` bytes first flushes at the
first record that overflows ``c`` and then behaves like ``G`` from there, so
its effect is a step function of ``c`` with one step per distinct outcome.
The step functions stay on the executors, as rows. They are composed in groups
of four neighbours, level by level, up to the root; then each node hands its
entry state down to its children. Both ways take log4(partitions) rounds
whatever the data. A composed function has no more steps than its parts have
records within one budget. The driver sees the first and last key and the
entry state of each partition, nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.sequence import (
    key_changes, key_fields, materialize, partitions_for, running_totals)

# Fixed value: default shard budget (90 MiB, under a 100 MB file cap).
DEFAULT_MAX_BYTES = 90 * 1024 * 1024
_EMPTY = 2  # "[" + "]"
_FAN = 4            # step functions composed by one task
_ANY = 1 << 62      # above every open-shard size
_STEP_SCHEMA = "node long, lo long, hi long, moves long, bytes long, shards long, anew long"
_STEP = ["lo", "hi", "moves", "bytes", "shards", "anew"]


# ------------------------------------------------------------- greedy core
def _next_start(prefix: np.ndarray, max_bytes: int) -> np.ndarray:
    """next(i): first record of the shard after the one started fresh at i
    (L when the shard runs to the end). prefix has L+1 entries."""
    L = len(prefix) - 1
    k = np.searchsorted(prefix, prefix[:L] + (max_bytes - _EMPTY), side="right")
    return np.minimum(np.maximum(np.arange(L) + 1, k - 1), L)


def _fresh_outcomes(prefix: np.ndarray, max_bytes: int):
    """For every i: (last shard start reached, shards started) packing fresh
    from i to the end; pointer doubling over next()."""
    L = len(prefix) - 1
    nxt = np.append(_next_start(prefix, max_bytes), L)        # index L absorbs
    last = np.append(np.arange(L), L)
    cnt = np.append(np.ones(L, dtype=np.int64), 0)
    jump = nxt.copy()
    while True:
        live = jump[:L] < L
        if not live.any():
            break
        idx = np.flatnonzero(live)
        j = jump[idx]
        last[idx] = last[j]
        cnt[idx] += cnt[j]
        jump[idx] = jump[j]
    end_bytes = _EMPTY + prefix[L] - prefix[last[:L]]
    return end_bytes, cnt[:L]


def _first_flush(prefix: np.ndarray, c: int, max_bytes: int) -> int:
    """Index of the first record that overflows an open shard of c bytes
    (L if every record fits)."""
    L = len(prefix) - 1
    # record i overflows iff c + prefix[i+1] > max_bytes
    k = int(np.searchsorted(prefix[1:], max_bytes - c, side="right"))
    return min(k, L)


def _steps_of(prefix: np.ndarray, max_bytes: int, end_bytes: np.ndarray, cnt: np.ndarray) -> np.ndarray:
    """Outcome of a run entered with an open shard of c bytes, as a step
    function of c: rows (lo, hi, moves, bytes, shards, anew) for c in (lo, hi].
    The new open size is ``bytes`` (``moves``: c + bytes), ``shards`` more are
    started, and ``anew`` says that the count restarts with them (a new group).

    The first flush is before record i iff c in (max - prefix[i+1],
    max - prefix[i]]; from there the run packs like a fresh start at i. If c
    leaves room for the whole run, nothing is flushed. c <= 2 is a fresh start."""
    edge = np.maximum(max_bytes - prefix, _EMPTY)
    hi = np.concatenate([[_ANY], edge[1:-1]])
    z = np.zeros(len(hi), dtype=np.int64)
    rows = np.column_stack([edge[1:], hi, z, end_bytes, cnt, z])
    stay = [[_EMPTY, edge[-1], 1, prefix[-1], 0, 0], [0, _EMPTY, 0, end_bytes[0], cnt[0], 0]]
    return _merged(np.vstack([rows, np.array(stay, dtype=np.int64)]))


def _merged(f: np.ndarray) -> np.ndarray:
    """Steps by rising c, without empty ones, neighbours of equal outcome joined."""
    f = f[f[:, 0] < f[:, 1]]
    f = f[np.argsort(f[:, 0], kind="stable")]
    first = np.ones(len(f), dtype=bool)
    first[1:] = (f[1:, 2:] != f[:-1, 2:]).any(axis=1)
    at = np.flatnonzero(first)
    out = f[at]
    out[:, 1] = f[np.append(at[1:], len(f)) - 1, 1]
    return out


def _after(f: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(open bytes, shards started) after a run entered with (c, n)."""
    h = f[np.searchsorted(f[:, 0], c, side="left") - 1]
    return np.where(h[:, 2] == 1, c, 0) + h[:, 3], np.where(h[:, 5] == 1, 0, n) + h[:, 4]


def _then(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The step function of a run f followed by a run g."""
    fixed, moving = f[f[:, 2] == 0].copy(), f[f[:, 2] == 1]
    h = g[np.searchsorted(g[:, 0], fixed[:, 3], side="left") - 1]
    fixed[:, 3], fixed[:, 4] = _after(g, fixed[:, 3], fixed[:, 4])
    fixed[:, 5] |= h[:, 5]
    parts = [fixed]
    for lo, hi, _, add, shards, anew in moving:      # c + add stays open: g's steps, moved down by add
        m = g.copy()
        m[:, 0] = np.maximum(g[:, 0] - add, lo)
        m[:, 1] = np.minimum(g[:, 1] - add, hi)
        m[:, 3] += np.where(g[:, 2] == 1, add, 0)
        m[:, 4] += np.where(g[:, 5] == 1, 0, shards)
        m[:, 5] |= anew
        parts.append(m)
    return _merged(np.vstack(parts))


def _assign(prefix: np.ndarray, c: int, max_bytes: int) -> np.ndarray:
    """Shard-start flags for a run entered with an open shard of c bytes
    (c == 2: fresh). Walks the chain of starts: O(#shards) steps."""
    L = len(prefix) - 1
    starts = np.zeros(L, dtype=bool)
    if not L:
        return starts
    nxt = _next_start(prefix, max_bytes)
    i = 0 if c <= _EMPTY else _first_flush(prefix, c, max_bytes)
    while i < L:
        starts[i] = True
        i = int(nxt[i])
    return starts


def _runs(t: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """Split a sorted partition into (start, end) runs of one group."""
    at = np.flatnonzero(key_changes([t.column(k).combine_chunks() for k in keys], t.num_rows))
    return list(zip(at.tolist(), [*at[1:].tolist(), t.num_rows]))


def _children(steps: pd.DataFrame):
    """(node, step function) of each child, in order."""
    for node, part in steps.groupby("node", sort=True):
        yield node, part[_STEP].to_numpy(dtype=np.int64)[np.argsort(part["lo"].to_numpy(), kind="stable")]


def _entries(level0: DataFrame, nodes: int) -> dict[int, tuple[int, int]]:
    """(open bytes, shards started) at the entry of every node of level 0."""
    def up(key, steps):
        fs = [f for _, f in _children(steps)]
        whole = fs[0]
        for f in fs[1:]:
            whole = _then(whole, f)
        out = pd.DataFrame(whole, columns=_STEP)
        out.insert(0, "node", key[0])
        return out

    def down(key, entry, steps):
        c, n = (entry[x].to_numpy(dtype=np.int64) for x in ("c", "n"))
        rows = []
        for node, f in _children(steps):
            rows.append((node, int(c[0]), int(n[0])))
            c, n = _after(f, c, n)
        return pd.DataFrame(rows, columns=["node", "c", "n"])

    parent = F.floor(F.col("node") / _FAN)
    levels = [level0]
    while nodes > _FAN:
        levels.append(materialize(levels[-1].groupBy(parent.alias("node")).applyInPandas(up, _STEP_SCHEMA), "steps"))
        nodes = -(-nodes // _FAN)
    entry = level0.sparkSession.createDataFrame([(0, _EMPTY, 0)], "node long, c long, n long")
    for steps in reversed(levels):
        entry = entry.groupBy("node").cogroup(steps.groupBy(parent)).applyInPandas(down, "node long, c long, n long")
    return {r["node"]: (r["c"], r["n"]) for r in entry.collect()}


# ------------------------------------------------------------- operators
def greedy_shards(df: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES,
                  group_by: Sequence[str] = (), order_by: str = "pos",
                  size_col: str = "rec_bytes", num_partitions: int | None = None,
                  bytes_per_partition: int = 32 << 20) -> DataFrame:
    """SHARD2: exact greedy shard ids (0-based, per group) for every record.

    Only (group, order, size) columns are shuffled; join the result back by
    (group, order) to attach payloads. Partitions are range partitions of
    about ``bytes_per_partition`` of narrow rows (optimizer estimate). Null
    group keys form a group of their own. Output: group columns, ``order_by``,
    ``size_col``, ``shard_id``."""
    keys = list(group_by)
    narrow = df.select(*keys, order_by, F.col(size_col).cast("long").alias(size_col))
    n = num_partitions or partitions_for(narrow, bytes_per_partition)
    srt = materialize(narrow.repartitionByRange(n, *keys, order_by)
                      .sortWithinPartitions(*keys, order_by), "greedy")
    first, last = key_fields(srt.schema, keys, "first"), key_fields(srt.schema, keys, "last")
    edge_schema = T.StructType([T.StructField("pid", T.IntegerType()), *first, *last])

    def edges(batches):
        from pyspark import TaskContext
        held = [b for b in batches if b.num_rows]
        if held:
            ends = [held[0].column(k).slice(0, 1) for k in keys] + [
                held[-1].column(k).slice(held[-1].num_rows - 1, 1) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *ends],
                                             names=edge_schema.fieldNames())

    # one row per partition: its number in order, and whether it opens a group
    rows = sorted(srt.select(*(keys or [order_by])).mapInArrow(edges, edge_schema).collect(), key=lambda r: r["pid"])
    order: dict[int, tuple[int, bool]] = {}
    prev = None
    for j, r in enumerate(rows):
        order[r["pid"]] = (j, prev != tuple(r[f.name] for f in first))
        prev = tuple(r[f.name] for f in last)

    def steps(batches):
        from pyspark import TaskContext
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        node, opens = order[TaskContext.get().partitionId()]
        runs = _runs(t, keys)
        s, e = runs[-1]
        pre = np.concatenate([[0], np.cumsum(t.column(size_col).to_numpy()[s:e])])
        end, cnt = _fresh_outcomes(pre, max_bytes)
        if opens or len(runs) > 1:                   # whatever comes in, the last group starts here
            f = np.array([[0, _ANY, 0, end[0], cnt[0], 1]], dtype=np.int64)
        else:
            f = _steps_of(pre, max_bytes, end, cnt)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), node), pa.int64()),
                                          *[pa.array(f[:, j], pa.int64()) for j in range(len(_STEP))]],
                                         names=["node", *_STEP])

    entry = _entries(materialize(srt.mapInArrow(steps, _STEP_SCHEMA), "steps"), len(rows)) if rows else {}
    state = {pid: (_EMPTY, 0) if opens else entry[j] for pid, (j, opens) in order.items()}
    out_schema = T.StructType([*srt.schema.fields, T.StructField("shard_id", T.LongType())])

    def apply(batches):
        from pyspark import TaskContext
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        c, base = state[TaskContext.get().partitionId()]
        sizes = t.column(size_col).to_numpy()
        ids = np.zeros(t.num_rows, dtype=np.int64)
        for s, e in _runs(t, keys):
            pre = np.concatenate([[0], np.cumsum(sizes[s:e])])
            ids[s:e] = base - 1 + np.cumsum(_assign(pre, c, max_bytes))
            c, base = _EMPTY, 0
        yield from t.append_column("shard_id", pa.array(ids)).to_batches()

    return srt.mapInArrow(apply, out_schema)


def bounded_shards(df: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES,
                   group_by: Sequence[str] = (), order_by: str = "pos",
                   size_col: str = "rec_bytes") -> DataFrame:
    """SHARD1: shards by byte offset, in input order. A record of more than half
    the budget (max_bytes - 2) is large: it has a shard of its own, and offsets
    begin anew after it, so it ends a segment. Within a segment the shard is
    floor(start / W), where start is the record's offset in the segment and
    W = budget - the group's largest small record. A shard then holds at most
    W + that record = budget bytes, and W is at least half the budget, however
    large the large records are.

    Offsets are segmented running sums over range partitions; shards are numbered
    by a running index over one row a shard, so no group is in one task.
    Output: group columns, ``order_by``, ``size_col``, ``start``, ``shard_id``."""
    keys = list(group_by)
    budget = max_bytes - _EMPTY
    narrow = df.select(*keys, order_by, F.col(size_col).cast("long").alias(size_col))
    large = 2 * F.col(size_col) > budget
    small = F.when(~large, F.col(size_col)).otherwise(0).cast("long")
    n = partitions_for(narrow)
    run = running_totals(narrow, keys, [order_by], {"_b": small, "_large": large.cast("long")},
                         num_partitions=n, restart=large, restarting=["_b"])
    # small records after k large ones are in segment 2k, the k-th large one is 2k - 1
    run = run.select(*keys, order_by, size_col, (F.col("run__b") - F.when(~large, F.col(size_col)).otherwise(0)).alias("start"),
                     (2 * F.col("run__large") - large.cast("long")).alias("_segment"))
    width = narrow.filter(~large).groupBy(*keys).agg((F.lit(budget) - F.max(size_col)).alias("_w"))
    if keys:
        run = run.alias("r").join(width.alias("w"), [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in keys], "left").select("r.*", "_w")
    else:
        run = run.withColumn("_w", F.lit((width.first() or [None])[0]).cast("long"))  # one scalar
    shard = [*keys, "_segment", "_bucket"]
    placed = materialize(run.withColumn("_bucket", F.when(~large, F.floor(F.col("start") / F.col("_w"))).otherwise(0))
                         .drop("_w"), "placed")
    # a checkpoint keeps the estimate of the join before it, so the count is given
    numbered = running_totals(placed.select(*shard).distinct(), keys, ["_segment", "_bucket"], index_name="shard_id", num_partitions=n)
    same = placed.alias("p").join(numbered.alias("n"), [F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}")) for c in shard])
    return same.select(*[f"p.{c}" for c in keys], f"p.{order_by}", f"p.{size_col}", "p.start", "n.shard_id")


def shard_report(assigned: DataFrame, group_by: Sequence[str] = (),
                 size_col: str = "rec_bytes") -> DataFrame:
    """AGG9: shards and bytes per group. A shard file is ``[`` + records
    joined by ``,`` + ``]``: 1 + sum(rec_bytes) bytes."""
    per_shard = assigned.groupBy(*group_by, "shard_id").agg(
        (F.sum(size_col) + 1).alias("file_bytes"), F.count(F.lit(1)).alias("n"))
    return per_shard.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("n_shards"), F.sum("n").alias("n_records"),
        F.sum("file_bytes").alias("total_bytes"), F.max("file_bytes").alias("max_shard_bytes"))
