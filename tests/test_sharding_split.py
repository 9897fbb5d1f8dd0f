"""Greedy sharding against the Python model, bounded shards, split rules."""

import random

from pyspark.sql import functions as F

import pymodel
from rankloom.operators import setups, sharding, split


def test_greedy_fixture_vector(spark):
    df = spark.createDataFrame(list(enumerate([5, 5, 5, 30, 5, 18])), "pos long, rec_bytes long")
    got = sorted((r.pos, r.shard_id) for r in sharding.greedy_shards(df, 20, num_partitions=3).collect())
    assert [s for _, s in got] == [0, 0, 0, 1, 2, 3]


def test_greedy_matches_model_across_partitions(spark):
    rnd = random.Random(7)
    for trial in range(4):
        rows = []
        for g in "abc"[: 1 + trial % 3]:
            for i in range(rnd.randint(1, 300)):
                rows.append((g, i, rnd.choice([rnd.randint(2, 40), rnd.randint(2, 400), 21])))
        m = rnd.choice([23, 64, 250, 1000])
        df = spark.createDataFrame(rows, "g string, pos long, rec_bytes long")
        got = {(r.g, r.pos): r.shard_id
               for r in sharding.greedy_shards(df, m, ["g"], num_partitions=6).collect()}
        for g in {r[0] for r in rows}:
            recs = [r for r in rows if r[0] == g]
            pymodel.check_greedy([r[2] for r in recs], [got[(g, r[1])] for r in recs], m)


def test_bounded_shards_respect_budget(spark):
    rnd = random.Random(3)
    rows = [("a", i, rnd.randint(2, 200)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, pos long, rec_bytes long")
    b = sharding.bounded_shards(df, 1000, ["g"])
    rep = sharding.shard_report(b, ["g"]).collect()[0]
    assert rep.max_shard_bytes <= 1000 and rep.n_records == 2000
    ids = [r.shard_id for r in b.orderBy("pos").collect()]
    assert ids == sorted(ids) and ids[0] == 0 and set(ids) == set(range(max(ids) + 1))


def test_split_sizes_and_consistency(spark):
    canon = spark.createDataFrame([(i, f"q{i}", "p", "t", '{"ranked_tables": [1]}') for i in range(503)],
                                  "pos long, qid string, prompt string, thinking string, answer string")
    s = split.assign_split(canon)
    assert s.filter(F.col("split") == "val").count() == 25
    fanned = setups.fan_out(s)
    per = fanned.groupBy("setup").agg(F.sort_array(F.collect_list(
        F.when(F.col("split") == "val", F.col("qid")))).alias("v")).collect()
    assert len({tuple(r.v) for r in per}) == 1
    assert split.n_val_for(20) == 0 and split.n_val_for(21) == 1 and split.n_val_for(21, 0.0) == 1


def test_split_takes_the_smallest_keys(spark):
    canon = spark.createDataFrame([(i, f"q{i}") for i in range(400)], "pos long, qid string")
    s = split.assign_split(canon).filter(F.col("split") == "val").select("qid").collect()
    keyed = sorted((__import__("hashlib").md5(f"42:q{i}".encode()).hexdigest(), f"q{i}") for i in range(400))
    assert sorted(r.qid for r in s) == sorted(q for _, q in keyed[:20])


def test_loss_mask(spark):
    canon = spark.createDataFrame([(0, "q", "P", "T", "A")], "pos long, qid string, prompt string, "
                                                             "thinking string, answer string")
    t = setups.loss_turns(setups.fan_out(canon)).collect()
    s2 = sorted((r.turn, r.role, r.in_loss) for r in t if r.setup == "setup2_answer_only")
    assert s2 == [(0, "human", False), (1, "gpt", False), (2, "human", False), (3, "gpt", True)]
    s1 = [r for r in t if r.setup == "setup1_full_loss" and r.role == "gpt"]
    assert s1[0].in_loss and s1[0].value == "T\n\nA"
    h = [r for r in t if r.setup == "setup3_1_hint_answer_only" and r.role == "human"][0]
    assert h.value == "P\n\n" + setups.HINT_INSTRUCTION + "T"


def test_running_totals_hot_key_matches_model(spark):
    from rankloom.operators.sequence import running_totals
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}"
        rows.append((g, rnd.randint(0, 10**6), i, rnd.randint(1, 9)))
    df = spark.createDataFrame(rows, "g string, t long, id long, v long")
    out = running_totals(df, ["g"], ["t", "id"], {"v2": F.col("v") * 2}, index_name="step", start=1,
                         num_partitions=9).collect()
    got = {r.id: (r.step, r.run_v2) for r in out}
    expect = {}
    for g in {r[0] for r in rows}:
        acc = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))):
            acc += 2 * r[3]
            expect[r[2]] = (n + 1, acc)
    assert got == expect


def test_greedy_of_paths_that_never_merge(spark):
    # equal-size records: a step function with one step per record
    rows = [("a", i, 7) for i in range(500)] + [("b", i, 5 + i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, pos long, rec_bytes long")
    got = {(r.g, r.pos): r.shard_id for r in sharding.greedy_shards(
        df, 52, ["g"], num_partitions=23).collect()}
    for g in ("a", "b"):
        recs = [r for r in rows if r[0] == g]
        pymodel.check_greedy([r[2] for r in recs], [got[(g, r[1])] for r in recs], 52)


def test_bounded_shards_without_groups(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.randint(2, 120)) for i in range(700)]
    df = spark.createDataFrame(rows, "pos long, rec_bytes long")
    b = sharding.bounded_shards(df, 500)
    rep = sharding.shard_report(b).collect()[0]
    assert rep.n_records == 700 and rep.max_shard_bytes <= 500
    ids = [r.shard_id for r in b.orderBy("pos").collect()]
    assert ids == sorted(ids) and set(ids) == set(range(max(ids) + 1))
    g = sharding.greedy_shards(df, 500, num_partitions=5)
    pymodel.check_greedy([r[1] for r in rows], [r.shard_id for r in g.orderBy("pos").collect()], 500)


def test_greedy_of_tiny_records_spans_partitions(spark):
    # one shard holds several partitions: entries pass through whole runs
    sizes = [1 + i % 3 for i in range(900)]
    df = spark.createDataFrame(list(enumerate(sizes)), "pos long, rec_bytes long")
    for budget in (5, 300, 701, 10**6):
        g = sharding.greedy_shards(df, budget, num_partitions=21).orderBy("pos").collect()
        pymodel.check_greedy(sizes, [r.shard_id for r in g], budget)


def test_greedy_with_many_steps(spark):
    # more than 4,096 steps in a partition, with a null group key
    rows = [(None if i < 9000 else 1, i, 40) for i in range(18_000)]
    df = spark.createDataFrame(rows, "g bigint, pos long, rec_bytes long")
    got = sharding.greedy_shards(df, 40 * 6000 + 17, ["g"], num_partitions=3).orderBy("pos").collect()
    for part in (got[:9000], got[9000:]):
        pymodel.check_greedy([40] * 9000, [r.shard_id for r in part], 40 * 6000 + 17)
    assert [r.g for r in got] == [r[0] for r in rows]


def test_ordered_passes_keep_types_and_null_keys(spark):
    big = 2**53 + 1
    rows = [(None if i % 2 else 1, i, None if i % 7 == 0 else big + i, 2**53 if i < 2 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "g bigint, pos long, payload bigint, v bigint")
    from rankloom.operators.sequence import running_totals
    out = running_totals(df, ["g"], ["pos"], {"w": F.col("v")}, num_partitions=9).orderBy("pos").collect()
    for i, r in enumerate(out):
        assert (r.g, r.payload, r._idx, r.run_w) == (rows[i][0], rows[i][2], i // 2, 2**53 + i // 2)


def plain_bounded(sizes, budget):
    """Shard of each record, from the rule: large ones alone, else by offset."""
    width = budget - max([x for x in sizes if 2 * x <= budget], default=0)
    out, shard, offset, last = [], -1, 0, None
    for x in sizes:
        if 2 * x > budget:
            here, offset = object(), 0
        else:
            here, offset = offset // width, offset + x
        shard += last is None or here != last
        last = here if 2 * x <= budget else object()
        out.append(shard)
    return out


def test_bounded_shards_break_at_large_records(spark):
    import random
    rng = random.Random(7)
    many = [50] * 1001
    many[500] = 990
    cases = {"one large": many, "mixed": [rng.choice([1, 30, 200, 480, 499, 500, 700, 5000]) for _ in range(900)],
             "only large": [900, 800, 5000], "all small": [rng.randint(1, 90) for _ in range(700)]}
    rows = [(name, i, x) for name, sizes in cases.items() for i, x in enumerate(sizes)] + [(None, i, x) for i, x in enumerate(cases["mixed"])]
    df = spark.createDataFrame(rows, "g string, pos long, rec_bytes long").repartition(5)
    got = {(r.g, r.pos): r for r in sharding.bounded_shards(df, 1000, ["g"]).collect()}
    assert len(got) == len(rows)
    for name, sizes in [*cases.items(), (None, cases["mixed"])]:
        ids = [got[name, i].shard_id for i in range(len(sizes))]
        assert ids == plain_bounded(sizes, 998), name
        for k in set(ids):
            own = [x for x, j in zip(sizes, ids) if j == k]
            assert sum(own) <= 998 or len(own) == 1
    greedy = sharding.greedy_shards(df.filter("g = 'one large'"), 1000, ["g"]).agg({"shard_id": "max"}).first()[0] + 1
    assert max(got["one large", i].shard_id for i in range(1001)) + 1 <= 2 * greedy
    alone = sharding.bounded_shards(df.filter("g = 'mixed'").select("pos", "rec_bytes"), 1000)
    assert {r.pos: r.shard_id for r in alone.collect()} == {i: got["mixed", i].shard_id for i in range(900)}


def test_segmented_totals_over_many_partitions(spark):
    import random
    from pyspark.sql import functions as F
    from rankloom.operators.sequence import running_totals
    rng = random.Random(9)
    rows = [(g, i, rng.randint(1, 9), rng.random() < p) for g, p in (("a", .02), ("b", 0.0), (None, .5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, v long, again boolean")
    got = {(r.g, r.i): (r.run_x, r.run_y) for r in running_totals(
        df, ["g"], ["i"], {"x": F.col("v"), "y": F.col("v")}, num_partitions=23, restart=F.col("again"), restarting=["y"]).collect()}
    whole, part = {}, {}
    for g, i, v, again in rows:
        whole[g] = whole.get(g, 0) + v
        part[g] = v + (0 if again else part.get(g, 0))
        assert got[g, i] == (whole[g], part[g])
