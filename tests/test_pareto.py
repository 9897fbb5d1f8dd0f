"""Pareto fronts against the definition."""

import random

import numpy as np

from rankloom.operators.pareto import _front, pareto_front


def plain(rows):
    beats = lambda a, b: all(x <= y for x, y in zip(a, b)) and a != b
    return [i for i, b in enumerate(rows) if not any(beats(a, b) for a in rows)]


def test_front(spark):
    rng = random.Random(3)
    for d, n, k in ((1, 50, 9), (2, 3000, 40), (3, 2500, 10 ** 6), (3, 0, 1), (4, 300, 3)):
        rows = [tuple(rng.randint(0, k) for _ in range(d)) for _ in range(n)]
        assert _front(np.array(rows, float).reshape(n, d)).tolist() == plain(rows)
    rows = [(i, float(rng.randint(0, 30)), rng.randint(0, 30), float(rng.randint(0, 30)), "x") for i in range(600)]
    odd = [(1000, None, 1, 1.0, "x"), (1001, float("nan"), 1, 1.0, "x"), (1002, 99.0, None, 0.0, "x")]
    df = spark.createDataFrame(rows + odd, "id long, acc double, ms int, mb double, note string").repartition(23)
    got = sorted(r.id for r in pareto_front(df, ["acc"], ["ms", "mb"]).collect())
    assert got == plain([(-r[1], r[2], r[3]) for r in rows])
    assert pareto_front(df.limit(0), ["acc"], ["ms"]).count() == 0
