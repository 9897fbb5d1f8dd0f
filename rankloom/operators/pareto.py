"""CMP2: the rows that no other row beats on every metric (Pareto front).

A row is dominated if another is at least as good in every metric and better in
one; equal rows don't dominate each other. Every task first keeps the front of its
own rows; then the fronts of four tasks at a time are merged, level by level. What
is dominated within a part is dominated in the whole, so nothing is lost, and no
pair of rows is ever emitted: a sorted sweep compares a row with the front so far.
The last merge holds the fronts of four parts; the front itself has to fit a task.

Rows with a null or NaN metric can't be compared and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.sequence import materialize

_FAN = 4
#: Rows of the front that a block of rows is compared with at a time.
_BLOCK = 1024


def _front(costs: np.ndarray) -> np.ndarray:
    """Rows (of costs, smaller is better) that none dominates: after sorting by all
    metrics a row can be dominated by earlier rows only."""
    order = np.lexsort(costs.T[::-1])
    front = np.zeros((0, costs.shape[1]))
    kept = []
    for at in range(0, len(order), _BLOCK):
        own = order[at:at + _BLOCK]
        block, alive = costs[own], np.ones(len(own), bool)
        for f in range(0, len(front), _BLOCK):
            known = front[f:f + _BLOCK]
            no_worse = (known[:, None] <= block[None][:, alive]).all(2) & (known[:, None] < block[None][:, alive]).any(2)
            alive[np.flatnonzero(alive)[no_worse.any(0)]] = False
        own, block = own[alive], block[alive]
        beaten = ((block[:, None] <= block[None]).all(2) & (block[:, None] < block[None]).any(2)).any(0)
        kept.append(own[~beaten])
        front = np.concatenate((front, block[~beaten]))
    return np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)


def pareto_front(df: DataFrame, maximize: Sequence[str] = (), minimize: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` (all columns) that are not dominated in the metrics."""
    metrics = [*maximize, *minimize]
    known = df.filter(" and ".join(f"{m} is not null and not isnan(cast({m} as double))" for m in metrics))
    node = known.withColumn("_node", F.spark_partition_id().cast("long"))

    def local(t: pa.Table) -> pa.Table:
        costs = np.stack([t.column(m).cast(pa.float64()).to_numpy() * (-1 if m in maximize else 1) for m in metrics], 1)
        return t.take(pa.array(_front(costs)))

    def first(batches):
        held: pa.Table | None = None
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                held = local(t if held is None else pa.concat_tables([held, t]))
        if held is not None:
            yield from held.to_batches()

    level = materialize(node.mapInArrow(first, node.schema), "front")
    nodes = (level.agg(F.max("_node")).first()[0] or 0) + 1
    while True:
        level = level.withColumn("_node", F.floor(F.col("_node") / _FAN)).groupBy("_node").applyInArrow(local, node.schema)
        nodes = -(-nodes // _FAN)
        if nodes == 1:
            return level.drop("_node")
