"""Streaming dedup and update logs: empty batches, replay, late rows, compaction."""

import datetime as dt
import json
import os

import pytest

from rankloom.streaming import live

COLUMNS = "pos bigint, qid string, dataset string, prompt string, thinking string, answer string"
GOOD = json.dumps({"ranked_tables": [1, 2]})


def _batches(spark, folder, batches, schema=COLUMNS):
    """One file a batch; file times tell the order of arrival."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/.w{i}")
        name = next(f for f in os.listdir(f"{folder}/.w{i}") if f.startswith("part-"))
        os.rename(f"{folder}/.w{i}/{name}", f"{folder}/{i}.parquet")
        os.utime(f"{folder}/{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    return folder


def _row(pos, qid, thinking="t", answer=GOOD, prompt="p"):
    return (pos, qid, None, f"{prompt}{pos}", thinking, answer)


def test_dedup_survives_batches_without_valid_rows_and_restarts(spark, tmpdir_path):
    meta = spark.createDataFrame([("b", "train", "found", None)], "qid string, split string, reasoning_text string, total_thinking string")
    first = [[_row(9, "a", answer="none"), _row(8, None)], [], [_row(7, "a"), _row(6, "a"), _row(5, "b", thinking=" ")]]
    raw = _batches(spark, f"{tmpdir_path}/raw", first)
    for _ in range(2):          # a second run has nothing new to do
        out = live.stream_dedup(spark, raw, meta, work_dir=f"{tmpdir_path}/work")
        assert sorted((r.pos, r.qid, r.prompt, r.thinking) for r in out.collect()) == [(5, "b", "p5", "found"), (6, "a", "p6", "t")]
    later = [[_row(1, "a"), _row(2, "b"), _row(4, "c"), _row(3, "c")], [_row(0, "c", answer="x")]]
    for i, rows in enumerate(later):
        _batches(spark, f"{tmpdir_path}/more{i}", [rows])
        os.rename(f"{tmpdir_path}/more{i}/0.parquet", f"{raw}/{i + 10}.parquet")
        os.utime(f"{raw}/{i + 10}.parquet", (2_000_000 + i, 2_000_000 + i))
    out = live.stream_dedup(spark, raw, meta, work_dir=f"{tmpdir_path}/work")
    assert sorted((r.pos, r.qid) for r in out.collect()) == [(3, "c"), (5, "b"), (6, "a")]
    assert live.late_rows(spark, f"{tmpdir_path}/work").count() == 0


def test_dedup_of_nothing(spark, tmpdir_path):
    out = live.stream_dedup(spark, _batches(spark, f"{tmpdir_path}/raw", [[_row(1, "a", answer="none")]]), None, work_dir=f"{tmpdir_path}/w1")
    assert out.count() == 0 and "ranked_table_ids" in out.columns
    os.makedirs(f"{tmpdir_path}/none")
    assert live.stream_dedup(spark, f"{tmpdir_path}/none", None, work_dir=f"{tmpdir_path}/w2").count() == 0


def test_late_rows_are_counted_and_the_state_is_bounded(spark, tmpdir_path):
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    batches = [[(*_row(1, "a"), day(0)), (*_row(2, "b"), day(0))],
               [(*_row(3, "a"), day(0.5)), (*_row(4, "c"), day(10))],
               [(*_row(5, "d"), day(1)), (*_row(6, "d"), day(2)), (*_row(7, "e"), day(9.5)), (*_row(8, "c"), day(10.5))],   # d: before the watermark (day 9)
               [(*_row(9, "a"), day(11))]]                                                                              # a is forgotten by now
    raw = _batches(spark, f"{tmpdir_path}/raw", batches, COLUMNS + ", at timestamp")
    out = live.stream_dedup(spark, raw, None, raw_schema=COLUMNS + ", at timestamp", work_dir=f"{tmpdir_path}/work", event_time="at", keep_hours=24)
    assert sorted((r.pos, r.qid) for r in out.collect()) == [(1, "a"), (2, "b"), (4, "c"), (7, "e"), (9, "a")]
    assert {r.qid: r.n_late for r in live.late_rows(spark, f"{tmpdir_path}/work").collect()} == {"d": 2}


def test_update_log_is_compacted_and_replays(spark, tmpdir_path):
    out, every = f"{tmpdir_path}/log", 3
    schema = spark.createDataFrame([], "run string, v int").schema
    sink, want = live._batch_sink(out, ["run"], schema, every), {}
    for i in range(11):
        rows = [(f"r{i % 4}", i), (f"r{i % 3}x", -i)]
        want.update(rows)
        sink(spark.createDataFrame(rows, schema), i)
        if i % 4 == 0:      # a batch that is run again after its compaction, or before
            sink(spark.createDataFrame(rows, schema), i)
        names = [n for n in os.listdir(out) if n.startswith("batch=")]
        assert len(names) < every
        assert dict(map(tuple, live.latest_per_key(spark, out, ["run"], schema).collect())) == want
    assert len(os.listdir(f"{out}.base")) == 1
    os.makedirs(f"{out}.base/upto=99")      # a compaction that did not end is not read
    assert dict(map(tuple, live.latest_per_key(spark, out, ["run"], schema).collect())) == want
    with open(f"{out}/batch=10/part-bad.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        live.latest_per_key(spark, out, ["run"], schema).collect()


def test_arrivals_and_orders_are_dealt_by_size(spark, monkeypatch):
    from rankloom.plans import catalog, fixtures
    monkeypatch.setattr(catalog, "partitions_for", lambda df, size: 37)
    rows, each = catalog._arrivals(spark.range(4000), 4)
    assert each == 10 and rows.rdd.getNumPartitions() == 40
    monkeypatch.setattr(fixtures, "partitions_for", lambda df, size: 37)
    assert fixtures.by_order(spark.range(4000).withColumnRenamed("id", "l_orderkey")).rdd.getNumPartitions() == 37
