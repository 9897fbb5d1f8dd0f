"""Inputs of the reference's workloads, derived from the given tables.

The reference ships no data; FIXTURES.md defines five derivations over the
TPC-H-ish test tables. Each builder reads only the columns it needs, so the
parquet scans prune and push down.

* F1 ``predictions``  (lineitem, orders)  run, ex_id, predict, label
* F2 ``raw_examples`` (conversations)     pos, qid, dataset, prompt, thinking, answer
* F3 ``reasoning_metadata`` (conversations) qid, split, reasoning_text, total_thinking
* F4 ``shard_input``  (documents)         pos, rec_bytes, lang
* F5 ``trainer_log``  (events)            run_id, step, loss, ts
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.sequence import partitions_for
from rankloom.session import cached_column


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sorted_ids(pairs: Column) -> Column:
    """', '-joined part keys of an array<struct<k1, k2, partkey>> sorted by
    (k1, k2)."""
    return F.array_join(F.transform(F.sort_array(pairs), lambda s: s["partkey"].cast("string")), ", ")


def by_order(li: DataFrame) -> DataFrame:
    """The lines dealt by order key: to as many partitions as their size asks for, so
    that a task's groups, sorts and lists do not grow with the table."""
    n = partitions_for(li, 4 << 20)
    more = n > int(li.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return li.repartition(n, "l_orderkey") if more else li.repartition("l_orderkey")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one prediction per order. Gold = part keys by price desc; the
    prediction = part keys with quantity >= 10 by quantity desc; the order key
    picks one of several text shapes (JSON, bare list, nested, no JSON)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
    # One hash exchange on the order key serves both aggregations and the
    # join with orders (hash(orderkey) satisfies clustering on
    # (orderkey, partkey)); map-side combining would gain nothing here
    # because (orderkey, partkey) is nearly unique.
    p = (by_order(li)
         .groupBy("l_orderkey", "l_partkey")
         .agg(F.max("l_extendedprice").alias("px"), F.max("l_quantity").alias("q")))
    # Per-order lists are bounded by the lines of one order.
    g = p.groupBy("l_orderkey").agg(
        _sorted_ids(F.collect_list(F.struct((-F.col("px")).alias("k1"), F.col("l_partkey").alias("k2"),
                                            F.col("l_partkey").alias("partkey")))).alias("gold"),
        _sorted_ids(F.collect_list(F.when(F.col("q") >= 10, F.struct(
            (-F.col("q")).alias("k1"), F.col("l_partkey").alias("k2"),
            F.col("l_partkey").alias("partkey"))))).alias("pred"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    j = g.join(orders, g.l_orderkey == orders.o_orderkey)
    return j.select(*_f1_text_exprs())


@cached_column
def _f1_text_exprs() -> list[Column]:
    """The F1 text shapes, keyed on the order key (built once per context)."""
    k = F.col("l_orderkey") % 10
    gold, pred = F.col("gold"), F.col("pred")
    predict = (F.when(k == 3, F.lit("no json here"))
               .when(k == 4, F.concat(F.lit('so "ranked_tables": ['), gold, F.lit("] is final")))
               .when(k == 5, F.concat(F.lit('{"ranked_tables": ['), gold, F.lit(', "x1"]}')))
               .when(k == 6, F.concat(F.lit('{"ranked_tables": [0]} then {"x":1} then {"ranked_tables": ['),
                                      gold, F.lit("]}")))
               .when(k == 7, F.concat(F.lit('{"ranked_tables": ['), pred, F.lit('], "meta": {"a": 1}}')))
               .otherwise(F.concat(F.lit('think... {"ranked_tables": ['), pred, F.lit("]}"))))
    label = (F.when(F.col("l_orderkey") % 50 == 1, F.lit("unlabelled"))
             .otherwise(F.concat(F.lit('{"ranked_tables": ['), gold, F.lit("]}"))))
    return [F.col("o_orderpriority").alias("run"), F.col("l_orderkey").alias("ex_id"),
            predict.alias("predict"), label.alias("label")]


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, k, prompt, th): a user turn followed by an assistant turn.

    User and assistant rows are disjoint, so the equi-join on
    (conv_id, turn + 1) = (conv_id, turn) shuffles each row once, and a long
    conversation spreads over partitions by turn (no per-conversation task)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    u = c.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt"), (F.col("turn") + 1).alias("_next"))
    a = c.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("text").alias("th"))
    pairs = u.join(a, (u.conv_id == a._c) & (u._next == a._t))
    return pairs.select("conv_id", "turn", (F.col("conv_id") * 16 + F.col("turn")).alias("k"),
                        "prompt", "th")


def raw_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw SFT examples with blank/null thinking, duplicate qids and
    malformed answers mixed in."""
    return _turn_pairs(spark, sf_dir).select(*_f2_exprs())


@cached_column
def _f2_exprs() -> list[Column]:
    turn, conv, k = F.col("turn"), F.col("conv_id"), F.col("k")
    lst = F.concat_ws(", ", *[(((1 + turn % 6) * i + conv) % 7 + 1).cast("string") for i in range(7)])
    nl = F.lit("\n")
    qid_turn = F.when((turn >= 3) & (k % 3 == 0), turn - 2).otherwise(turn)
    answer = (F.when(k % 11 == 0, F.lit("no json"))
              .when(k % 13 == 2, F.lit('{"ranked_tables": []}'))
              .when(k % 19 == 4, F.lit('{"ranked_tables": [1,2]} and {"x": 2}'))
              .when(k % 23 == 5, F.lit('{"answer": [1]}'))
              .when(k % 7 == 6, F.concat(nl, F.lit('{"ranked_tables": ['), lst, F.lit('], "note": "ok"}')))
              .otherwise(F.concat(nl, nl, F.lit('{"ranked_tables": ['), lst, F.lit("]}"))))
    return [
        k.alias("pos"),
        F.concat(F.lit("c"), conv.cast("string"), F.lit("-"), qid_turn.cast("string")).alias("qid"),
        F.when(k % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("ds"), (k % 3).cast("string"))).alias("dataset"),
        F.concat(F.lit("  "), F.col("prompt"), nl).alias("prompt"),
        F.when(k % 17 == 3, F.lit(None).cast("string")).when(k % 4 == 1, F.concat(F.lit(" "), nl))
        .otherwise(F.col("th")).alias("thinking"),
        answer.alias("answer")]


def reasoning_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per-split reasoning records keyed by qid; some qids have a later
    (test) record that is blank, which overrides the earlier text."""
    b = _turn_pairs(spark, sf_dir).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"),
                 F.col("turn").cast("string")).alias("qid"), "k", "th")
    k = F.col("k")
    # One pass: each pair yields its split record and, for some qids, a later
    # blank test record (explode of up to two structs instead of a union that
    # would scan and join the conversations twice).
    first = F.when(k % 6 != 5, F.struct(
        F.when(k % 3 == 0, "train").when(k % 3 == 1, "dev").otherwise("test").alias("split"),
        F.when(k % 2 == 0, F.concat(F.lit(" "), "th")).otherwise(F.lit(""))
        .alias("reasoning_text"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(F.concat("th", F.lit(" (total)")))
        .alias("total_thinking")))
    blank = F.when((k % 5 == 0) & (k % 3 != 2), F.struct(
        F.lit("test").alias("split"), F.lit("").alias("reasoning_text"),
        F.lit("").cast("string").alias("total_thinking")))
    recs = F.filter(F.array(first, blank), lambda r: r.isNotNull())
    return b.select("qid", F.explode(recs).alias("r")).select(
        "qid", "r.split", "r.reasoning_text", "r.total_thinking")


def shard_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one record per document; rec_bytes = UTF-8 bytes + 1."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return d.select(F.col("doc_id").alias("pos"),
                    (F.octet_length("text") + 1).cast("int").alias("rec_bytes"), "lang")


TRAINER_LOG_SCHEMA = "run_id bigint, step int, loss double, ts timestamp_ntz"


def trainer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a training log per run (user): step = event order within the run,
    loss = value, with no loss logged on error events."""
    from rankloom.operators.sequence import row_index
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    e = e.select(F.col("user_id").alias("run_id"), "ts", "event_id",
                 F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
                 .otherwise(F.col("value")).alias("loss"))
    stepped = row_index(e, order_by=["ts", "event_id"], group_by=["run_id"], name="step", start=1)
    return stepped.select("run_id", F.col("step").cast("int").alias("step"), "loss", "ts")
