"""File sources/sinks round trips, run dimension, progress, path rebase."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rankloom.operators import manifest, runs, scoring, setups
from rankloom.operators.sharding import greedy_shards
from rankloom.sources import readers, writers


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_raw_array_and_wrapper(spark, tmpdir_path):
    ex = [{"qid": "a", "prompt": "p", "thinking": "t", "answer": "x"},
          {"qid": "b", "prompt": "p2", "thinking": "t2", "answer": "y", "ranked_table_ids": [1]}]
    _write(f"{tmpdir_path}/arr.json", json.dumps(ex))
    _write(f"{tmpdir_path}/wrap.json", json.dumps({"examples": ex}))
    for name in ("arr.json", "wrap.json"):
        rows = readers.read_raw_examples(spark, f"{tmpdir_path}/{name}").orderBy("pos").collect()
        assert [r.qid for r in rows] == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        readers.read_raw_examples(spark, f"{tmpdir_path}/missing.json")


def test_metadata_scan_skips_absent_splits(spark, tmpdir_path):
    _write(f"{tmpdir_path}/deepseek_listwise_metadata_train.json",
           json.dumps({"q1": {"reasoning_text": "a", "total_thinking": "b"}, "q2": {"reasoning_text": ""}}))
    _write(f"{tmpdir_path}/deepseek_listwise_metadata_test.json", json.dumps({"q1": {"reasoning_text": ""}}))
    m = readers.read_metadata(spark, tmpdir_path)
    assert m.count() == 3
    from rankloom.operators.curation import metadata_latest
    latest = {r.qid: r for r in metadata_latest(m).collect()}
    assert latest["q1"].split == "test" and latest["q1"].recovered is None


def test_prediction_jsonl_key_aliases(spark, tmpdir_path):
    lines = [json.dumps({"prediction": '{"ranked_tables": [1, 2]}', "gold": '{"ranked_tables": [1, 2]}'}),
             "   ",
             json.dumps({"predict": None, "output": '{"ranked_tables": [1]}', "label": '{"ranked_tables": [1]}'}),
             json.dumps({"output": [2, 1], "labels": [1, 2]}),
             json.dumps({"output": [], "reference": []})]
    _write(f"{tmpdir_path}/pred.jsonl", "\n".join(lines) + "\n")
    p = readers.read_predictions(spark, f"{tmpdir_path}/pred.jsonl")
    s = {r.idx: r for r in scoring.score(p, keep=["idx"]).collect()}
    assert sorted(s) == [0, 1, 2, 3]
    assert s[0].em == 1
    assert s[1].invalid            # present null "predict" wins over "output"
    assert s[2].relaxed_em == 1 and s[2].tau == -1.0
    assert s[3].em == 1            # empty native lists are valid
    d = scoring.per_example(s and scoring.score(p, keep=["idx"]), keep=["idx"]).orderBy("idx").collect()
    assert d[0].pred == "[1, 2]" and d[1].pred is None


def test_malformed_line_fails(spark, tmpdir_path):
    _write(f"{tmpdir_path}/bad.jsonl", '{"predict": "x", "label": "y"}\n{not json\n')
    with pytest.raises(Exception):
        readers.read_predictions(spark, f"{tmpdir_path}/bad.jsonl").collect()


def test_trainer_states_and_progress(spark, tmpdir_path):
    _write(f"{tmpdir_path}/r1/trainer_state.json", json.dumps(
        {"global_step": 10, "max_steps": 10, "epoch": 3.0,
         "log_history": [{"step": 5, "loss": 1.5}, {"step": 10, "eval_loss": 2.0}]}))
    _write(f"{tmpdir_path}/r2/trainer_state.json", json.dumps(
        {"global_step": 4, "max_steps": 10, "epoch": 1.2, "log_history": []}))
    st = {r.run: r for r in readers.read_trainer_states(spark, tmpdir_path).collect()}
    assert st["r1"].last_loss == 1.5 and st["r2"].last_loss is None
    runs_dim = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run string")
    state = readers.read_trainer_states(spark, tmpdir_path)
    p = {r.run_id: r for r in runs.progress(runs_dim.withColumnRenamed("run", "run_id"),
                                         state.withColumnRenamed("run", "run_id"),
                                         max_steps=10).collect()}
    assert p["r1"].status == "DONE" and p["r2"].status == "running" and p["r3"].status == "not started"


def test_run_dimension(spark):
    r = runs.run_dimension(runs.setup_dimension(spark)).collect()
    assert len(r) == 8
    by = {x.run_name: x for x in r}
    assert by["qwen3_8b_answer_only"].max_new_tokens == 128
    assert by["qwen3_8b_hint_answer_only"].max_new_tokens == 128
    assert by["qwen3_4b_hint_full_loss"].max_new_tokens == 4096
    assert by["qwen3_4b_full_loss"].val_dataset == "setup1_full_loss_val"
    assert by["qwen3_8b_answer_only"].mask_history
    paths = spark.createDataFrame([("Qwen/Qwen3-8B", "/m/8b")], "repo_id string, path string")
    with pytest.raises(Exception):
        runs.run_dimension(runs.setup_dimension(spark), model_paths=paths).collect()


def test_path_rebase_idempotent(spark):
    df = spark.createDataFrame([('{"file_name": "/a/b/training_data/x/lora_runs/y.json"} /c/Qwen__Qwen3-8B',)],
                               "p string")
    once = df.select(manifest.rebase_paths(F.col("p"), "/new$r", "/cache").alias("p"))
    twice = once.select(manifest.rebase_paths(F.col("p"), "/new$r", "/cache").alias("p"))
    a, b = once.collect()[0].p, twice.collect()[0].p
    assert a == '{"file_name": "/new$r/lora_runs/y.json"} /cache/Qwen__Qwen3-8B' and a == b


def test_manifest_upsert(spark):
    old = manifest.manifest_entries(spark.createDataFrame([("a", "/old/a"), ("b", "/old/b")],
                                                          "name string, file_name string"))
    new = manifest.manifest_entries(spark.createDataFrame([("b", "/new/b"), ("c", "/new/c")],
                                                          "name string, file_name string"))
    m = {r.name: r for r in manifest.manifest_upsert(old, new).collect()}
    assert m["a"].file_name == "/old/a" and m["b"].file_name == "/new/b" and len(m) == 3
    assert m["c"].tags["assistant_tag"] == "gpt"


def test_sharded_json_output(spark, tmpdir_path):
    canon = spark.createDataFrame([(i, f"q{i}", "p" * (i % 7 + 1), "t", '{"ranked_tables": [1]}')
                                   for i in range(60)],
                                  "pos long, qid string, prompt string, thinking string, answer string")
    recs = setups.with_record(setups.fan_out(canon.withColumn("split", F.lit("train"))))
    sharded = writers.shard_records(recs.select("setup", "split", "pos", "record"), max_bytes=2000)
    writers.write_json_shards(sharded, f"{tmpdir_path}/out")
    d = f"{tmpdir_path}/out/setup=setup1_full_loss/split=train"
    total = []
    for shard in sorted(os.listdir(d), key=lambda s: int(s.split("=")[1])):
        for f in os.listdir(f"{d}/{shard}"):
            if f.startswith("part-"):
                text = open(f"{d}/{shard}/{f}", encoding="utf-8").read().rstrip("\n")
                assert len(text.encode()) <= 2000
                total += json.loads(text)
    assert len(total) == 60 and total[0]["conversations"][0]["value"] == "p"


def test_reshard_and_replace(spark, tmpdir_path):
    recs = [{"system": "s", "conversations": [{"from": "human", "value": "x" * (i % 50)}], "qid": None if i % 2 else i,
             **({"extra": {"b": 1, "a": [1.5, "é"]}} if i % 3 == 0 else {})} for i in range(40)]
    src = f"{tmpdir_path}/big.json"
    _write(src, json.dumps(recs))
    rep = writers.reshard(spark, src, f"{tmpdir_path}/shards", max_bytes=600, replace=True).collect()[0]
    assert rep.n_records == 40 and rep.max_shard_bytes <= 600 and not os.path.exists(src)
    got = []
    names = sorted(f for f in os.listdir(f"{tmpdir_path}/shards") if not f.startswith("."))
    assert names == [f"part-{k:05d}.json" for k in range(rep.n_shards)]
    for f in names:
        got += json.loads(open(f"{tmpdir_path}/shards/{f}").read())
    assert got == recs


def test_load_or_build_and_metric_sinks(spark, tmpdir_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(0, "q")], "pos long, qid string")
    path = f"{tmpdir_path}/canonical"
    assert writers.load_or_build(spark, path, build).count() == 1
    assert writers.load_or_build(spark, path, build).count() == 1 and len(calls) == 1
    writers.load_or_build(spark, path, build, force=True)
    assert len(calls) == 2
    df = spark.createDataFrame([("r", '{"ranked_tables": [1]}', '{"ranked_tables": [1]}')],
                               "run string, predict string, label string")
    writers.write_metrics(scoring.leaderboard(df), f"{tmpdir_path}/m", pred_file="/x/pred.jsonl")
    m = spark.read.json(f"{tmpdir_path}/m").collect()[0]
    assert m.EM == 1.0 and m.pred_file == "/x/pred.jsonl"
    writers.write_per_example(scoring.per_example(scoring.score(df, keep=["run"]), keep=["run"]),
                              f"{tmpdir_path}/d")
    line = open([f"{tmpdir_path}/d/{f}" for f in os.listdir(f"{tmpdir_path}/d")
                 if f.startswith("part-") and os.path.getsize(f"{tmpdir_path}/d/{f}")][0]).read()
    assert json.loads(line)["pred"] == [1] and json.loads(line)["f1"] == 1.0
    mline = open([f"{tmpdir_path}/m/{f}" for f in os.listdir(f"{tmpdir_path}/m")
                  if f.startswith("part-")][0]).read()
    assert "KendallTau" in json.loads(mline) and json.loads(mline)["KendallTau"] is None


def test_raw_jsonl_compare_runs_and_status(spark, tmpdir_path):
    _write(f"{tmpdir_path}/raw.jsonl", "\n".join(json.dumps({"qid": f"q{i}", "prompt": "p", "thinking": "t",
                                                               "answer": "a"}) for i in range(5)) + "\n")
    raw = readers.read_raw_jsonl(spark, f"{tmpdir_path}/raw.jsonl").orderBy("pos").collect()
    assert [r.qid for r in raw] == [f"q{i}" for i in range(5)] and [r.pos for r in raw] == list(range(5))
    dim = runs.run_dimension(runs.setup_dimension(spark))
    metrics = spark.createDataFrame([("qwen3_8b_full_loss", 0.5)], "run_name string, EM double")
    c = runs.compare_runs(metrics, dim).collect()[0]
    assert c.setup == "setup1_full_loss" and c.max_new_tokens == 4096
    p = runs.progress(spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, name string"),
                      spark.createDataFrame([(1, 5, 0.25)], "run_id long, global_step long, last_loss double"),
                      max_steps=10)
    by_name = {r.name: (r.step, r.max_steps, r.pct, r.status) for r in p.collect()}
    assert by_name["a"] == (5, 10, 50.0, "running") and by_name["b"][3] == "not started"
    m = manifest.manifest_entries(spark.createDataFrame([("x_train", "/d/x_train")], "name string, file_name string"))
    writers.write_manifest(m, f"{tmpdir_path}/manifest")
    back = spark.read.json(f"{tmpdir_path}/manifest").collect()[0]
    assert back.name == "x_train" and back.columns.messages == "conversations"


def test_reshard_rejects_non_array_and_data_wrapper(spark, tmpdir_path):
    _write(f"{tmpdir_path}/obj.json", json.dumps({"system": "s", "conversations": []}))
    with pytest.raises(Exception):
        readers.read_json_array(spark, f"{tmpdir_path}/obj.json").collect()
    with pytest.raises(ValueError):
        writers.reshard(spark, f"{tmpdir_path}/obj.json", f"{tmpdir_path}/obj.json")
    ex = [{"qid": "d1", "prompt": "p", "thinking": "t", "answer": "a"}]
    _write(f"{tmpdir_path}/data.json", json.dumps({"data": ex, "examples": [{"qid": "e1"}]}))
    assert [r.qid for r in readers.read_raw_examples(spark, f"{tmpdir_path}/data.json").collect()] == ["d1"]


def test_reshard_keeps_a_truncated_source(spark, tmpdir_path):
    src = f"{tmpdir_path}/cut.json"
    _write(src, json.dumps([{"a": i} for i in range(9)])[:-4])
    with pytest.raises(Exception):
        writers.reshard(spark, src, f"{tmpdir_path}/cut", replace=True).collect()
    assert os.path.exists(src)


def test_shards_of_an_earlier_run_go(spark, tmpdir_path):
    for n in (40, 10):
        recs = spark.createDataFrame([("s", "t", i, json.dumps({"i": i})) for i in range(n)],
                                     "setup string, split string, pos long, record string")
        writers.write_json_shards(writers.shard_records(recs, 50), f"{tmpdir_path}/out")
        back = spark.read.text(f"{tmpdir_path}/out", wholetext=True).collect()
        assert sorted(r["i"] for f in back for r in json.loads(f.value)) == list(range(n))


def test_malformed_sources_fail(spark, tmpdir_path):
    _write(f"{tmpdir_path}/raw.json", '[{"qid": "a"}, {"qid": ')
    with pytest.raises(Exception):
        readers.read_raw_examples(spark, f"{tmpdir_path}/raw.json").collect()
    _write(f"{tmpdir_path}/raw.jsonl", '{"qid": "a"}\n{"qid": \n')
    with pytest.raises(Exception):
        readers.read_raw_jsonl(spark, f"{tmpdir_path}/raw.jsonl").collect()
    _write(f"{tmpdir_path}/deepseek_listwise_metadata_dev.json", '{"q1": {"reasoning_text": "x"')
    with pytest.raises(Exception):
        readers.read_metadata(spark, tmpdir_path).collect()


def test_replayed_batch_replaces_itself(spark, tmpdir_path):
    from rankloom.streaming import live
    sink = live._batch_sink(f"{tmpdir_path}/log")
    for batch_id, v in ((0, 1), (1, 2), (1, 3)):
        sink(spark.createDataFrame([("r", v)], "run string, v int"), batch_id)
    schema = spark.createDataFrame([], "run string, v int").schema
    assert [tuple(r) for r in live.latest_per_key(spark, f"{tmpdir_path}/log", ["run"], schema).collect()] == [("r", 3)]
    assert live.latest_per_key(spark, f"{tmpdir_path}/none", ["run"], schema).count() == 0
    _write(f"{tmpdir_path}/log/batch=2/part-0.parquet", "no parquet")
    with pytest.raises(Exception):
        live.latest_per_key(spark, f"{tmpdir_path}/log", ["run"], schema).collect()


def test_line_index_over_many_blocks(spark, tmpdir_path):
    for name, n in (("a", 700), ("b", 5), ("c", 300)):
        _write(f"{tmpdir_path}/in/{name}.jsonl", "".join(json.dumps({"predict": f"{name}{i}", "label": "x" * (i % 60)}) + "\n" + "  \n" * (i % 3) for i in range(n)))
        _write(f"{tmpdir_path}/raw/{name}.jsonl", "".join(json.dumps({"qid": f"{name}{i}"}) + "\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        p = readers.read_predictions(spark, f"{tmpdir_path}/in")
        assert p.rdd.getNumPartitions() > 10
        got = sorted((r.idx, r.v) for r in p.select("idx", F.try_variant_get("predict", "$", "string").alias("v")).collect())
        assert got == sorted((i, f"{name}{i}") for name, n in (("a", 700), ("b", 5), ("c", 300)) for i in range(n))
        raw = [r.qid for r in readers.read_raw_jsonl(spark, f"{tmpdir_path}/raw").orderBy("pos").select("pos", "qid").collect()]
        assert raw == [f"{name}{i}" for name, n in (("a", 700), ("b", 5), ("c", 300)) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
