"""Text primitives against Python itself; results invariant under repartitioning."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.functions.text import PY_WS, int_text, py_strip
from rankloom.operators import scoring

CHARS = st.sampled_from(list("0123456789_+- \t\nabx") + list(PY_WS[:12]) + ["　", " ", "é"])


def _py_int_text(s):  # Python int() itself is the model
    if any(ch.isdigit() and not ("0" <= ch <= "9") for ch in s):
        return "unicode-digit"
    try:
        return str(int(s))
    except ValueError:
        return None


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(CHARS, max_size=8), min_size=1, max_size=40))
def test_strip_and_int_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.s, r.n) for r in df.select("i", py_strip(F.col("t")).alias("s"),
                                               int_text(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == t.strip()
        want = _py_int_text(t)
        if want != "unicode-digit":
            assert got[i][1] == want, repr(t)


def test_leaderboard_invariant_under_repartitioning(spark):
    from rankloom.plans import fixtures as fx
    f1 = fx.predictions(spark, "/root/testdata/sf0.001")
    a = sorted(map(tuple, scoring.leaderboard(f1).collect()))
    b = sorted(map(tuple, scoring.leaderboard(f1.repartition(13, "ex_id")).collect()))
    c = sorted(map(tuple, scoring.leaderboard(f1.coalesce(1)).collect()))
    assert a == b == c


FRAGMENTS = ['{', '}', '"ranked_tables"', ':', ' : ', '[', ']', ',', ', ', ' ', '\n', '1', '-2', '3.5',
             '"a"', '"7"', ' "8 " ', 'true', 'null', 'x', '"', '1e2', '01', '{"x":1}', "'", '"1_0"',
             '{"ranked_tables": [4, 5]}', '"ranked_tables": [', '0', '-0', '12345678901234567890']


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(FRAGMENTS), min_size=1, max_size=14).map("".join),
                min_size=1, max_size=60))
def test_parse_matches_python_model(spark, texts):
    import pymodel
    from rankloom.functions.rankings import with_rankings
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (None if r.r is None else (list(r.r.ids), r.r.numeric))
           for r in with_rankings(df, {"r": "t"}, ["i"]).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pymodel.parse(t), repr(t)
