"""One JSON document read by many tasks: equal to json.loads, or an error."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rankloom.sources import readers, writers
from rankloom.sources.json_split import json_elements


@pytest.fixture(params=[None, 150])
def blocks(spark, request):
    """Whole files, and small blocks."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    spark.conf.unset("spark.sql.files.minPartitionNum")


def _file(folder, text, name="x.json"):
    path = f"{folder}/{name}"
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return path


def _nasty(rng, i):
    text = "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "é", "日", "a", " ", "\n", "\\\\"]) for _ in range(rng.randint(0, 25)))
    return {"qid": f"q{i}", "prompt": text, "extra": [{"k": [text, {}]}, None, 1.5, []], "thinking": None, "answer": text[::-1]}


@pytest.mark.parametrize("indent", [None, 1])
def test_elements_of_arrays_objects_and_wrappers(spark, tmpdir_path, blocks, indent):
    rng = random.Random(3)
    recs = [_nasty(rng, i) for i in range(6)]
    text = json.dumps(recs, indent=indent, ensure_ascii=False)
    got = json_elements(spark, _file(tmpdir_path, text + "\n ")).collect()
    assert [json.loads(r.text) for r in sorted(got)] == recs and sorted(r.pos for r in got) == list(range(6))
    back = sorted(readers.read_json_array(spark, _file(tmpdir_path, text)).collect())
    assert [json.loads(r.record) for r in back] == recs
    by_key = {r["qid"]: r for r in recs}
    got = json_elements(spark, _file(tmpdir_path, " \n" + json.dumps(by_key, indent=indent)), top="{").collect()
    assert [json.loads("{" + r.text + "}") for r in sorted(got)] == [{k: v} for k, v in by_key.items()]
    for wrapper in ({"meta": {"a": [1, {"data": [3]}], "n": [[]]}, "data": recs, "z": "}],{"}, {"examples": recs, "v": 1}, {"a": [], "examples": [1], "data": recs}):
        raw = readers.read_raw_examples(spark, _file(tmpdir_path, json.dumps(wrapper, indent=indent))).orderBy("pos").collect()
        assert [(r.pos, r.qid, r.prompt, r.answer) for r in raw] == [(i, r["qid"], r["prompt"], r["answer"]) for i, r in enumerate(recs)]
    for empty in ("[]", " [ \n] ", "{}", '{"other": [{"qid": "a"}]}', '{"data": []}'):
        assert readers.read_raw_examples(spark, _file(tmpdir_path, empty)).count() == 0


BAD = ['[{"a":1}]\n[{"lost":2}]', '[{"a":1}] x', '[{"a":1}', '[{"a":1}]]', '[{"a":1},]', '[,{"a":1}]', '[{"a":1} {"b":2}]', '[{"a":1]', '[{"a":"x]', "[{'a':1}]",
       '[{"a":1}]{', '[{"a":01}]', '[{"a":1}, 2]', '[{"a":1}, null]', '"[]"', "5", "", " ", '[{"a":1}],', '}[{"a":1}]', '"x" [{"a":1}]', b'[{"a":"\xff"}]', '﻿[{"a":1}]',
       '[{"a":1}, [1]]', '[{"a":1}}', '[}']


def test_malformed_arrays_fail(spark, tmpdir_path):
    for size in ("134217728", "9"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        for text in BAD:
            with pytest.raises(Exception):
                print(text, readers.read_json_array(spark, _file(tmpdir_path, text)).collect())
            with pytest.raises(Exception):
                print(text, readers.read_raw_examples(spark, _file(tmpdir_path, text)).collect())
        for text in ('{"data": 3}', '{"data": null}', '{"data": {"a": 1}}', '{"data": [{"qid": "a"}] x}', '{"data" [{"qid": "a"}]}', '{"data": [{"qid": "a"}], "b"}',
                     '{"data": [{"qid": "a"}}}', '{"data": [{"qid": "a"}]} {}', '{"data": [{"qid": "a"}], "b": }', '{"data": [{"qid": "a"}]'):
            with pytest.raises(Exception):
                print(text, readers.read_raw_examples(spark, _file(tmpdir_path, text)).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")
    with pytest.raises(FileNotFoundError):
        readers.read_json_array(spark, f"{tmpdir_path}/none.json")


def test_metadata_is_strict(spark, tmpdir_path):
    name = "deepseek_listwise_metadata_train.json"
    _file(tmpdir_path, '{"a": {"reasoning_text": "r"}, "b": {"total_thinking": "t", "x": {"y": 1}}, "a": {}, "c": null}', name)
    rows = readers.read_metadata(spark, tmpdir_path).orderBy("pos").collect()
    assert [(r.qid, r.split, r.reasoning_text, r.total_thinking) for r in rows] == [
        ("a", "train", "r", None), ("b", "train", None, "t"), ("a", "train", None, None), ("c", "train", None, None)]
    for text in ('{"a": {"reasoning_text": "r"}} trailing', '{"a": {}} {"b": {}}', '[{"a": 1}]', '{"a": {"reasoning_text": "r"}', '{"a" {}}', '{"a": {},}'):
        _file(tmpdir_path, text, name)
        with pytest.raises(Exception):
            print(text, readers.read_metadata(spark, tmpdir_path).collect())


def test_one_file_is_read_by_many_tasks(spark, tmpdir_path):
    path = _file(tmpdir_path, json.dumps([{"i": i, "v": "x" * 100} for i in range(2000)]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    x = readers.read_json_array(spark, path)
    n = x.filter("pos is not null").select(F.spark_partition_id().alias("p")).distinct().count()
    assert n > 8 and x.agg(F.sum("pos")).first()[0] == sum(range(2000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
