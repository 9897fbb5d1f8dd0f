"""Structured Streaming versions of progress, scoring and curation (STR1-3).

* :func:`stream_progress` (STR1): trainer-log files -> per-run
  ``max(step)`` / last loss in a streaming aggregation (state store keyed by
  run), ``update`` output.
* :func:`stream_leaderboard` (STR2): prediction files -> stateless scoring ->
  per-run metric partials (counts and sums) in the state store.
* :func:`stream_dedup` (STR3): raw example files -> row-wise validity -> the first
  valid row of each qid, by a state keyed by qid. No batch reads what earlier ones
  wrote. With an event time the state is bounded by a watermark: rows that come
  later than it are dropped and counted.

Sinks are ``foreachBatch`` writes of one Parquet folder per batch in the
shared checkpoint folder, so a replayed batch replaces itself. An ``update`` log is
compacted every ``COMPACT_EVERY`` batches into a table with one row a key, so what a
reader reads is bounded by the keys and that many batches, however long the stream
runs. Checkpoints live under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators import curation, runs, scoring
from rankloom.operators.sequence import materialize
from rankloom.session import scratch_dir
from rankloom.sources.datasets import _Files

#: Batches between two compactions of an update log.
COMPACT_EVERY = 10


def _batch_sink(out_dir: str, keys: list[str] | None = None, schema: T.StructType | None = None,
                every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """One folder per batch, overwritten when a batch is replayed. With ``keys``,
    every ``every`` batches the log becomes ``<out>.base/upto=<batch>``; the folders
    that it replaces go only after it is complete, and a replayed batch that is
    already in it is left out."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = _Files(spark, out_dir)
        if keys and batch_id <= _base(files, out_dir):
            return
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")
        if keys and len(_log(files, out_dir)) >= every:
            old = _base(files, out_dir)
            latest_per_key(spark, out_dir, keys, schema).write.mode("overwrite").parquet(f"{out_dir}.base/upto={batch_id}")
            for n in _log(files, out_dir, upto=batch_id):
                files.remove(f"{out_dir}/batch={n}")
            files.remove(f"{out_dir}.base/upto={old}")
    return sink


def _base(files: _Files, out_dir: str) -> int:
    """The last batch of the newest complete base table, or -1."""
    done = [int(n.split("=")[1]) for n in files.names(f"{out_dir}.base") if n.startswith("upto=")]
    return max((n for n in done if files.exists(f"{out_dir}.base/upto={n}/_SUCCESS")), default=-1)


def _log(files: _Files, out_dir: str, upto: int | None = None) -> list[int]:
    """Batches in the log that the base doesn't hold (or all up to ``upto``)."""
    found = sorted(int(n.split("=")[1]) for n in files.names(out_dir) if n.startswith("batch="))
    return [n for n in found if (n > _base(files, out_dir) if upto is None else n <= upto)]


def latest_per_key(spark: SparkSession, out_dir: str, keys: list[str],
                   schema: T.StructType) -> DataFrame:
    """Final state of an ``update``-mode log: the row of the last batch per key."""
    files = _Files(spark, out_dir)
    base, log = _base(files, out_dir), _log(files, out_dir)
    rows = spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
    if base >= 0:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{out_dir}.base/upto={base}").withColumn("batch", F.lit(base).cast("long")))
    if log:
        whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        rows = rows.unionByName(spark.read.schema(whole).option("basePath", out_dir).parquet(*[f"{out_dir}/batch={n}" for n in log]))
    vals = [c for c in schema.fieldNames() if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*vals), "batch").alias("_s"))
    return last.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in vals])


def _run(query_writer, available_now: bool = True):
    w = query_writer.trigger(availableNow=True) if available_now else query_writer
    q = w.start()
    q.awaitTermination()
    return q


def stream_progress(spark: SparkSession, log_dir: str, runs_dim: DataFrame,
                    log_schema: str = "run_id bigint, step int, loss double, ts timestamp",
                    max_steps: int = 0, max_files_per_trigger: int | None = None,
                    work_dir: str | None = None) -> DataFrame:
    """STR1: progress of every run from trainer-log files as they arrive."""
    work = work_dir or scratch_dir(spark, "stream-progress")
    reader = spark.readStream.schema(log_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(log_dir)
    agg = runs.log_state(src)
    _run(agg.writeStream.outputMode("update").foreachBatch(_batch_sink(f"{work}/out", ["run_id"], agg.schema))
         .option("checkpointLocation", f"{work}/ckpt"))
    state = latest_per_key(spark, f"{work}/out", ["run_id"], agg.schema)
    return runs.progress(runs_dim, state, max_steps=max_steps)


def stream_leaderboard(spark: SparkSession, pred_dir: str,
                       pred_schema: str = "run string, ex_id bigint, predict string, label string",
                       max_files_per_trigger: int | None = None,
                       work_dir: str | None = None) -> DataFrame:
    """STR2: per-run metrics over prediction files as they arrive."""
    work = work_dir or scratch_dir(spark, "stream-leaderboard")
    reader = spark.readStream.schema(pred_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(pred_dir)
    partials = scoring.metric_partials(scoring.score(src, keep=["run"]), by=["run"])
    _run(partials.writeStream.outputMode("update").foreachBatch(_batch_sink(f"{work}/out", ["run"], partials.schema))
         .option("checkpointLocation", f"{work}/ckpt"))
    state = latest_per_key(spark, f"{work}/out", ["run"], partials.schema)
    return scoring.finalize_metrics(state, by=["run"])


def _first_of_key(order_by: str, event_time: str | None, columns: list[str], keep_ms: int):
    """The first row of a key, ever (or within the watermark): in one batch the one
    with the smallest ``order_by``. State: whether the key was there."""
    def first(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen, late, best, newest = state.exists, 0, None, None
        for rows in batches:
            if event_time:
                # the watermark is 0 before the first batch with rows has passed
                on_time = rows[event_time].isna() | (rows[event_time] >= pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms"))
                late += int((~on_time).sum())
                rows = rows[on_time]
                if len(rows):
                    newest = max(x for x in (newest, rows[event_time].max()) if x is not None)
            if not seen and len(rows):
                row = rows.loc[[rows[order_by].idxmin()]]
                if best is None or row[order_by].iloc[0] < best[order_by].iloc[0]:
                    best = row
        if best is not None:
            state.update((True,))
            yield best[columns].assign(n_late=0)
        if event_time and state.exists and newest is not None and not pd.isna(newest):
            state.setTimeoutTimestamp(max(int(newest.timestamp() * 1000), state.getCurrentWatermarkMs()) + keep_ms + 1)
        if late:
            yield pd.DataFrame([dict.fromkeys(columns) | {"qid": key[0], "n_late": late}])
    return first


def _read_batches(spark: SparkSession, out: str, schema: T.StructType, late: bool) -> DataFrame:
    files = _Files(spark, out)
    if not files.names(out):
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("is_late", T.BooleanType())])
    return spark.read.schema(whole).parquet(out).filter(F.col("is_late") == late).drop("batch", "is_late")


def late_rows(spark: SparkSession, work_dir: str) -> DataFrame:
    """(qid, n_late) of the rows that ``stream_dedup`` dropped as too late."""
    schema = T.StructType([T.StructField("qid", T.StringType()), T.StructField("n_late", T.LongType())])
    return _read_batches(spark, f"{work_dir}/canonical", schema, True).groupBy("qid").agg(F.sum("n_late").alias("n_late"))


def stream_dedup(spark: SparkSession, raw_dir: str, meta: DataFrame | None,
                 raw_schema: str = ("pos bigint, qid string, dataset string, prompt string, "
                                    "thinking string, answer string"),
                 max_files_per_trigger: int | None = 1, work_dir: str | None = None,
                 event_time: str | None = None, keep_hours: int = 168) -> DataFrame:
    """STR3: canonical examples from raw files arriving over time; the first
    valid row of a qid in arrival order (by ``pos`` within a batch) wins.

    A state keyed by qid remembers which qids came, in the state store; batches write
    only their winners, and a batch without any writes none. Without ``event_time``
    (a timestamp column of the raw rows) the state keeps every qid. With it, a qid is
    forgotten ``keep_hours`` after its last row's time, and rows that come later than
    the watermark are dropped and counted (:func:`late_rows`)."""
    work = work_dir or scratch_dir(spark, "stream-dedup")
    out = f"{work}/canonical"
    reader = spark.readStream.schema(raw_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(raw_dir)
    if event_time:
        src = src.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, f"{keep_hours} hours")
    latest = materialize(curation.metadata_latest(meta), "metadata") if meta is not None else None
    valid = curation.valid_rows(src, latest)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in valid.schema.fields], T.StructField("n_late", T.LongType())])
    first = _first_of_key("pos", event_time, valid.columns, keep_hours * 3_600_000)
    winners = valid.groupBy("qid").applyInPandasWithState(first, schema, "there boolean", "append", "EventTimeTimeout" if event_time else "NoTimeout")

    def sink(batch: DataFrame, batch_id: int) -> None:
        row = F.struct(*[F.col(c) for c in src.columns])
        won = curation.cleaned(batch.filter("n_late = 0").select(row.alias("w"), "_text"), set(src.columns))
        late = batch.filter("n_late > 0").select("qid", "n_late", F.lit(True).alias("is_late"))
        both = won.withColumn("is_late", F.lit(False)).unionByName(late, allowMissingColumns=True)
        both.write.mode("overwrite").partitionBy("is_late").parquet(f"{out}/batch={batch_id}")

    _run(winners.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{work}/ckpt"))
    columns = curation.cleaned(spark.createDataFrame([], T.StructType([T.StructField("w", T.StructType(src.schema.fields)),
                                                                       T.StructField("_text", T.StringType())])), set(src.columns)).schema
    return _read_batches(spark, out, columns, False)
