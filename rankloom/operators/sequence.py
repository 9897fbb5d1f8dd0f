"""Order-dependent scans without single-task groups.

``running_totals`` numbers rows and accumulates values in a total order
within groups (``row_number`` / running ``sum`` semantics). A window
``partitionBy(group)`` would put a whole group into one task; here a hot
group is spread over many range partitions instead:

1. range-partition and sort by (group, order) -- one shuffle, balanced by
   sampling, so one key can span many tasks;
2. cut lineage (reliable checkpoint in the cluster's checkpoint folder) so
   both passes below see the same partitions;
3. pass 1: each partition reports the count and sums of its first and last
   group (at most one small row per partition -- a proven size bound);
4. the driver folds those rows into a carry per partition (O(#partitions));
5. pass 2: each partition computes local running totals batch by batch
   (vectorised numpy over Arrow batches) and adds its carry to the rows of
   its first group.

Both passes see typed Arrow columns: a nullable integer key stays an integer,
integer sums stay integers, and payload columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.session import scratch_dir


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder
    (``spark.checkpoint.dir``); the partitioning and row order are kept."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(scratch_dir(spark, "ckpt"))
    return df.checkpoint(eager=True)


def partitions_for(df: DataFrame, bytes_per_partition: int = 256 << 20) -> int:
    """Range-partition count for an ordered pass: max(shuffle partitions,
    size / bytes_per_partition), costing no job. The size is the optimizer's
    estimate, but no more than what the plan's sources hold, since the estimate
    of a join is the product of its sides. Sources of unknown size do not count."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = min(sum(x for x in sizes if x < 1 << 60), int(str(plan.stats().sizeInBytes())))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_per_partition))


def key_changes(cols: Sequence[pa.Array], n: int) -> np.ndarray:
    """Row i starts a new group: its key differs from row i-1 (nulls are equal
    to each other). Row 0 always starts one."""
    change = np.zeros(n, dtype=bool)
    for c in cols:
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        change[1:] |= ~same.to_numpy(zero_copy_only=False)
    change[:1] = True
    return change


def key_at(cols: Sequence[pa.Array], i: int) -> tuple:
    """The group key of row i as Python values (typed; null is None)."""
    return tuple(c[i].as_py() for c in cols)


def key_fields(schema: T.StructType, keys: Sequence[str], prefix: str) -> list[T.StructField]:
    """Summary fields that carry a group key in its own types."""
    return [T.StructField(f"{prefix}{j}", schema[k].dataType) for j, k in enumerate(keys)]


def _local_running(batch: pa.RecordBatch, keys: list[str], vals: list[str], state: dict,
                   restart: str | None = None, restarting: frozenset[str] = frozenset()):
    """Running index and sums within one sorted partition, continuing
    ``state`` across Arrow batches (vectorised; O(batch)). The sums in
    ``restarting`` also begin anew at rows where ``restart`` holds.

    Returns (index, {val: inclusive running sum}, {val or None: rows that what
    came before the partition still counts for}); None stands for the index."""
    n = batch.num_rows
    cols = [batch.column(k) for k in keys]
    first_batch = "key" not in state
    change = key_changes(cols, n)
    change[0] = first_batch or key_at(cols, 0) != state["key"]
    pos = np.arange(n)
    seg = np.cumsum(change)
    last_start = np.maximum.accumulate(np.where(change, pos, -1))
    cont = last_start < 0                       # continues the previous batch's group
    safe_start = np.maximum(last_start, 0)
    index = np.where(cont, state.get("idx", 0) + pos, pos - last_start)
    in_first = (seg == (1 if first_batch else 0)) & state.get("first_open", True)
    carried = dict.fromkeys([None, *vals], in_first)
    starts = dict.fromkeys(vals, (cont, safe_start))
    if restarting:
        again = pc.fill_null(batch.column(restart), False).to_numpy(zero_copy_only=False)
        last_again = np.maximum.accumulate(np.where(change | again, pos, -1))
        unbroken = in_first & (np.cumsum(again) == 0) & state.get("unbroken", True)
        state["unbroken"] = bool(unbroken[-1])
        for v in restarting:
            carried[v], starts[v] = unbroken, (last_again < 0, np.maximum(last_again, 0))
    sums = {}
    for v in vals:
        x = pc.fill_null(batch.column(v), 0).to_numpy(zero_copy_only=False)
        cs = np.cumsum(x)
        excl = cs - x
        goes_on, start = starts[v]
        sums[v] = np.where(goes_on, state.get(v, 0) + cs, cs - excl[start])
    state["first_open"] = bool(in_first[-1])
    state["key"] = key_at(cols, n - 1)
    state["idx"] = int(index[-1]) + 1
    for v in vals:
        state[v] = sums[v][-1].item()
    return index, sums, carried


def running_totals(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str],
                   values: Mapping[str, Column] | None = None, index_name: str = "_idx",
                   start: int = 0, num_partitions: int | None = None,
                   bytes_per_partition: int = 256 << 20, restart: Column | None = None,
                   restarting: Sequence[str] = ()) -> DataFrame:
    """Add ``index_name`` (position within group in ``order_by`` order, from
    ``start``) and, for each ``values`` entry, the inclusive running sum of
    that expression within the group (``run_<name>``: long for integer
    expressions, double for the others; null counts as 0). ``order_by`` should
    make the order total (end it with a unique key). Null keys form a group of
    their own. The values named in ``restarting`` are sums within segments: they
    begin anew at each row where ``restart`` holds (with that row's own value).
    Partial sums of segments compose like those of groups, so a segment may span
    many partitions, too. Without ``num_partitions`` the range partition count comes from
    :func:`partitions_for`."""
    values = dict(values or {})
    keys = list(group_by)
    vals = list(values)
    prepared = df.withColumns(values) if values else df
    again = frozenset(restarting)
    if again:
        prepared = prepared.withColumn("_restart", restart)
    extra = ["_restart"] if again else []
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kind = {v: T.LongType() if isinstance(prepared.schema[v].dataType, whole) else T.DoubleType() for v in vals}
    if vals:
        prepared = prepared.withColumns({v: F.col(v).cast(kind[v]) for v in vals})
    n = num_partitions or partitions_for(prepared, bytes_per_partition)
    srt = prepared.repartitionByRange(n, *keys, *order_by).sortWithinPartitions(*keys, *order_by)
    srt = materialize(srt, "running")

    # ---- pass 1: first/last group summary per partition -------------------
    first, last = key_fields(srt.schema, keys, "first"), key_fields(srt.schema, keys, "last")
    summary_schema = T.StructType([
        T.StructField("pid", T.IntegerType()), *first, *last,
        T.StructField("single", T.BooleanType()), T.StructField("unbroken", T.BooleanType()),
        T.StructField("n_last", T.LongType()),
        *[T.StructField(f"s_{v}", kind[v]) for v in vals]])

    def summarize(batches):
        from pyspark import TaskContext
        state: dict = {}
        heads: list[pa.Array] = []
        tails: list[pa.Array] = []
        for b in batches:
            if not b.num_rows:
                continue
            if not state:
                heads = [b.column(k).slice(0, 1) for k in keys]
            tails = [b.column(k).slice(b.num_rows - 1, 1) for k in keys]
            _local_running(b, keys, vals, state, "_restart", again)
        if not state:
            return
        rest = [pa.array([state["first_open"]]), pa.array([state.get("unbroken", True)]), pa.array([state["idx"]], pa.int64()),
                *[pa.array([state[v]], pa.float64() if isinstance(kind[v], T.DoubleType) else pa.int64())
                  for v in vals]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), *heads, *tails, *rest],
            names=summary_schema.fieldNames())

    cols = list(dict.fromkeys([*keys, *vals, *extra, order_by[0]]))  # never zero columns
    summaries = srt.select(*cols).mapInArrow(summarize, summary_schema).collect()
    summaries.sort(key=lambda r: r["pid"])

    # ---- driver: carry into each partition's first group -------------------
    none = (0, {v: 0 for v in vals})
    carry: dict[int, tuple[int, dict]] = {}
    prev_key, prev = None, none
    for r in summaries:
        c_idx, c_sums = prev if prev_key == tuple(r[f.name] for f in first) else none
        carry[r["pid"]] = (c_idx, c_sums)
        own = (r["n_last"], {v: r[f"s_{v}"] for v in vals})
        prev = (c_idx + own[0], {v: own[1][v] + (c_sums[v] if r["unbroken"] or v not in again else 0) for v in vals}) \
            if r["single"] else own
        prev_key = tuple(r[f.name] for f in last)

    # ---- pass 2: local running totals + carry -------------------------------
    kept = [f for f in srt.schema.fields if f.name not in extra]
    out_schema = T.StructType([*kept, T.StructField(index_name, T.LongType()),
                               *[T.StructField(f"run_{v}", kind[v]) for v in vals]])

    def apply(batches):
        from pyspark import TaskContext
        c_idx, c_sums = carry.get(TaskContext.get().partitionId(), none)
        state: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            index, sums, carried = _local_running(b, keys, vals, state, "_restart", again)
            added = [pa.array(index + np.where(carried[None], c_idx, 0) + start, pa.int64())]
            added += [pa.array(sums[v] + np.where(carried[v], c_sums[v], 0)) for v in vals]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *added], names=out_schema.fieldNames())

    return srt.mapInArrow(apply, out_schema)


def row_index(df: DataFrame, order_by: Sequence[str], group_by: Sequence[str] = (),
              name: str = "idx", start: int = 0) -> DataFrame:
    """``row_number() over (partition by group order by order_by) - 1 + start``
    without putting a group into one task."""
    return running_totals(df, group_by, order_by, index_name=name, start=start)
