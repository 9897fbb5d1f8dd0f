"""Worked vectors and property tests for parse + metrics."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pymodel
from rankloom.functions.rankings import parse_ranking, with_rankings
from rankloom.operators import scoring

# text, gold, exact, same set, same first (tau: 1, -1/3, none, none, 1, -1)
SCORED = [
    ('Final: {"ranked_tables": [12, 4, 9, 30]}', '{"ranked_tables": [12, 4, 9, 30]}', 1, 1, 1),
    ('{"ranked_tables": [9, 30, 4]} it is', '{"ranked_tables": [4, 9, 30]}', 0, 1, 0),
    ("I cannot rank these.", '{"ranked_tables": [8]}', 0, 0, 0),
    ('{"ranked_tables": [1, 2]}', '{"ranked_tables": [3, 4]}', 0, 0, 0),
    ('{"ranked_tables": [6, 7, 8]}', '{"ranked_tables": [6, 7]}', 0, 0, 1),
    ('{"note": 3} {"ranked_tables": [21, 20]}', '{"ranked_tables": [20, 21]}', 0, 1, 0),
]

PARSE_CASES = [
    ('{"ranked_tables": [1]} x {"ranked_tables": [2,3]}', (["2", "3"], True)),
    ('{"ranked_tables": []}', None),
    ('{"ranked_tables": [1,2], "meta": {"a": 1}}', (["1", "2"], True)),
    ('"ranked_tables": [1] then "ranked_tables": [2]', (["1"], True)),
    ('{"ranked_tables": [3.9, "2", true]}', (["3", "2", "1"], True)),
    ('{"ranked_tables": [1, "t9"]}', (["1", "t9"], False)),
    ('{"ranked_tables": [1, null]}', (["1", "None"], False)),
    ("{'ranked_tables': [1]}", None),
    ('x { y {"ranked_tables": [4,5]}', (["4", "5"], True)),
    ('"ranked_tables": [1.0, 2]', (["1.0", "2"], False)),
    ('{"ranked_tables": [1.0, 2]}', (["1", "2"], True)),
    ('{"ranked_tables": [" 7 ", "1_0", "+3", "007"]}', (["7", "10", "3", "7"], True)),
    ('{"ranked_tables": [-0.5, -3.7]}', (["0", "-3"], True)),
    ('"ranked_tables" :\n [ "a" , \'b\' ,, ]', (["a", "b"], False)),
    ('{"ranked_tables": [1], "ranked_tables": [2]}', (["2"], True)),
    (None, None),
]


def _collect_parse(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    staged = with_rankings(df, {"r": "t"}, ["i"]).orderBy("i").collect()
    single = df.select("i", parse_ranking(F.col("t")).alias("r")).orderBy("i").collect()
    out = []
    for a, b in zip(staged, single):
        ra = None if a["r"] is None else (list(a["r"]["ids"]), a["r"]["numeric"])
        rb = None if b["r"] is None else (list(b["r"]["ids"]), b["r"]["numeric"])
        assert ra == rb, "staged and single-expression parsers disagree"
        out.append(ra)
    return out


def test_parse_edge_cases(spark):
    got = _collect_parse(spark, [c[0] for c in PARSE_CASES])
    for (text, want), g in zip(PARSE_CASES, got):
        assert g == want, text


def test_scored_texts(spark):
    df = spark.createDataFrame([(i, p, g) for i, (p, g, *_) in enumerate(SCORED)],
                               "i int, predict string, label string")
    s = scoring.score(df, keep=["i"]).orderBy("i").collect()
    for row, (_, _, em, rel, t1) in zip(s, SCORED):
        assert (row.em, row.relaxed_em, row.top1) == (em, rel, t1)
    agg = scoring.aggregate_metrics(scoring.score(df, keep=["i"])).collect()[0]
    assert agg.n_invalid == 1 and agg.n_total == 6
    assert (agg.EM, agg.RelaxedEM, agg.Top1, agg.invalid_rate) == (0.1667, 0.5, 0.3333, 0.1667)
    assert (agg.F1, agg.KendallTau) == (0.6333, 0.1667)


def test_lists_of_100000_ids(spark):
    from rankloom.operators import curation
    ids = ", ".join(map(str, range(100_000)))
    df = spark.createDataFrame([(0, f'{{"ranked_tables": [{ids}]}}')], "i int, t string")
    r = df.select(parse_ranking(F.col("t")).alias("r")).collect()[0].r
    assert len(r.ids) == 100_000 and r.numeric and r.ids[-1] == "99999"
    assert df.select(F.length(curation.canonical_answer(F.col("t")))).collect()[0][0] > 500_000


NATIVE = [
    ([1, 1, 2], [1, 2], 0, 1, 1.0, 1, 1.0),
    ([2, 1], [1, 2, 1], 0, 1, 1.0, 0, 1.0),
    ([], [1, 2], 0, 0, 0.0, 0, None),
    ([], [], 1, 1, 1.0, 0, None),
    ([2, 1], [1, 2], 0, 1, 1.0, 0, -1.0),
]


def test_native_list_metrics(spark):
    df = spark.createDataFrame([(i, p, g) for i, (p, g, *_) in enumerate(NATIVE)],
                               "i int, predict array<bigint>, label array<bigint>")
    rows = scoring.score(df, keep=["i"]).orderBy("i").collect()
    for r, (_, _, em, rel, f1, t1, tau) in zip(rows, NATIVE):
        assert (r.em, r.relaxed_em, r.f1, r.top1, r.tau) == (em, rel, f1, t1, tau)


def test_mixed_kinds_never_match(spark):
    df = spark.createDataFrame([(0, '{"ranked_tables": [1, "t9"]}', '{"ranked_tables": [1, 9]}')],
                               "i int, predict string, label string")
    r = scoring.score(df, keep=["i"]).collect()[0]
    assert (r.em, r.relaxed_em, r.f1, r.top1, r.tau) == (0, 0, 0.0, 0, None)


def test_empty_group_note(spark):
    df = spark.createDataFrame([("a", '{"ranked_tables": [1]}', "unlabelled")],
                               "run string, predict string, label string")
    r = scoring.leaderboard(df).collect()[0]
    assert r.n_total == 0 and r.note.startswith("no scorable rows") and r.EM is None


ids = st.lists(st.integers(min_value=0, max_value=6), max_size=7)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(ids, ids, st.booleans()), min_size=1, max_size=12))
def test_metrics_match_python_model(spark, cases):
    rows = []
    for i, (p, g, as_text) in enumerate(cases):
        if as_text:
            rows.append((i, json.dumps({"ranked_tables": p}), json.dumps({"ranked_tables": g})))
        else:
            rows.append((i, "[" + ", ".join(map(str, p)) + "]", "[" + ", ".join(map(str, g)) + "]"))
    df = spark.createDataFrame(rows, "i int, predict string, label string")
    got = {r.i: r for r in scoring.score(df, keep=["i"]).collect()}
    for i, pt, gt in rows:
        want = pymodel.measures(pymodel.parse(pt), pymodel.parse(gt))
        r = got[i]
        if want is None:
            assert r.skip
            continue
        assert (r.em, r.relaxed_em, r.top1) == (want["em"], want["relaxed"], want["top1"])
        assert r.f1 == pytest.approx(want["f1"])
        assert (r.tau is None and want["tau"] is None) or r.tau == pytest.approx(want["tau"])
        assert 0.0 <= r.f1 <= 1.0
        if r.em:
            assert r.relaxed_em == 1 and r.f1 == 1.0


def test_tau_of_lists_equals_its_definition():
    import random
    import time

    import pyarrow as pa

    from rankloom.functions.metrics import tau_of_lists

    def plain(pred, gold):
        if pred is None or gold is None:
            return None
        shared = [x for x in gold if x in pred]
        last = lambda a, x: len(a) - 1 - a[::-1].index(x)
        ranks = [(last(gold, x), last(pred, x)) for x in shared]
        sign = lambda v: (v > 0) - (v < 0)
        products = [sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(ranks) for b in ranks[:i]]
        c, d = products.count(1), products.count(-1)
        return (c - d) / (c + d) if c + d else None

    rng = random.Random(6)
    rows = [tuple([str(rng.randint(0, k)) for _ in range(rng.randint(0, k))] for _ in range(2)) for k in (1, 3, 8, 30) for _ in range(150)]
    rows += [(None, ["1"]), (["1"], None), ([], []), (["a", None, "b"], ["b", "a", None]), (["x"], ["y"])]
    got = tau_of_lists(pa.array([p for p, _ in rows], pa.list_(pa.string())), pa.array([g for _, g in rows], pa.list_(pa.string())))
    assert got.to_pylist() == [plain(p, g) for p, g in rows]
    assert tau_of_lists(pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.string()))).to_pylist() == []
    ids = [str(i) for i in range(10_000)]
    shuffled = rng.sample(ids, len(ids))
    began = time.perf_counter()
    tau = tau_of_lists(pa.array([ids, ids[::-1], shuffled]), pa.array([ids, ids, ids])).to_pylist()
    assert time.perf_counter() - began < 1 and tau[:2] == [1.0, -1.0] and abs(tau[2]) < .05


def test_scoring_cases(spark):
    from rankloom.operators import scoring
    gold = '{"ranked_tables": [40, 41, 42, 43]}'
    cases = [("First thoughts. " + gold, 1, 1, 1), ('{"ranked_tables": [40, 41, 43, 42]}', 0, 1, 1), ('{"ranked_tables": [41, 40]}', 0, 0, 0),
             ('{"ranked_tables": [40]} no, {"ranked_tables": [43, 42, 41, 40]}', 0, 1, 0), ("I could not decide.", 0, 0, 0),
             ('"ranked_tables": [40, 41, 42, 43] without braces', 1, 1, 1)]
    df = spark.createDataFrame([(i, c[0], gold) for i, c in enumerate(cases)], "i int, predict string, label string")
    rows = {r.i: r for r in scoring.score(df, keep=["i"]).collect()}
    assert [(rows[i].em, rows[i].relaxed_em, rows[i].top1) for i in range(6)] == [c[1:] for c in cases]
    m = scoring.leaderboard(df.withColumn("run", F.lit("r"))).first()
    assert (m.n_total, m.n_invalid, m.n_wrong_em, m.n_wrong_set) == (6, 1, 4, 2)


