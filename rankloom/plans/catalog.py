"""Registered queries (Spark) and their DuckDB oracles, keyed by name.

Every query reads the given parquet tables through the fixture builders, so
its work grows with the data; none runs on made-up input alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.rankings import with_rankings
from rankloom.operators import curation, manifest, pareto, runs, scoring, setups, sharding, split
from rankloom.operators.sequence import materialize, partitions_for
from rankloom.plans import fixtures as fx
from rankloom.plans import oracles as o
from rankloom.session import configure, scratch_dir
from rankloom.sources import datasets, readers
from rankloom.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run
    return deco


# ------------------------------------------------------------------ scoring
@register("rank_parse", o.with_(o.F1, f"""parsed as (select run, ex_id,
  {o.ranking('predict')} p, {o.ranking('label')} g from f1)""")
          + f"select run, ex_id, {o.ids_json('p')} pred, {o.ids_json('g')} gold from parsed")
def rank_parse(spark, sf_dir):
    """RNK1-4, RNK6: rankings parsed from prediction and label text."""
    f1 = fx.predictions(spark, sf_dir)
    r = with_rankings(f1, {"pred": "predict", "gold": "label"}, keep=["run", "ex_id"])
    return r.select("run", "ex_id", scoring.ids_json(F.col("pred")).alias("pred"),
                    scoring.ids_json(F.col("gold")).alias("gold"))


@register("example_scores", o.with_(o.F1, o.SCORED)
          + "select run, ex_id, skip, invalid, em, relaxed_em, f1, top1, tau from scored")
def example_scores(spark, sf_dir):
    """MET1-7: every prediction scored against its label."""
    s = scoring.score(fx.predictions(spark, sf_dir), keep=["run", "ex_id"])
    return s.select("run", "ex_id", "skip", "invalid", "em", "relaxed_em", "f1", "top1", "tau")


@register("leaderboard", o.with_(o.F1, o.SCORED) + o.metrics_select("run,") + " group by run")
def leaderboard(spark, sf_dir):
    """AGG5-8: macro metrics per run."""
    return scoring.leaderboard(fx.predictions(spark, sf_dir))


@register("metrics_file", o.with_(o.F1, o.SCORED) + f"select *, 'runs/predictions.jsonl' pred_file from ({o.metrics_select('run,')} group by run)")
def metrics_file(spark, sf_dir):
    """SNK4: the metrics as a JSON file with the scored file's path, nulls included,
    read back."""
    from rankloom.sources import writers
    path = f"{scratch_dir(spark, 'q-metrics')}/metrics"
    board = scoring.leaderboard(fx.predictions(spark, sf_dir))
    writers.write_metrics(board, path, pred_file="runs/predictions.jsonl")
    return spark.read.schema(board.schema.add("pred_file", "string")).option("mode", "FAILFAST").json(path)


@register("metrics_by_label_state", o.with_(o.F1, o.SCORED)
          + o.metrics_select("case when skip then 'unlabelled' else 'labelled' end label_state,")
          + " group by label_state")
def metrics_by_label_state(spark, sf_dir):
    """AGG7: the unlabelled group has no scorable row -> n_total 0 plus note."""
    s = scoring.score(fx.predictions(spark, sf_dir), keep=["run"])
    s = s.withColumn("label_state", F.when(F.col("skip"), "unlabelled").otherwise("labelled"))
    return scoring.aggregate_metrics(s, by=["label_state"])


@register("per_example_dump", o.with_(o.F1, o.SCORED) + f"""
select run, ex_id idx, em, relaxed_em, {o.round4('f1')} f1, top1, invalid,
  {o.ids_json('p')} pred, {o.ids_json('g')} gold from scored where not skip""")
def per_example_dump(spark, sf_dir):
    """SNK5: per-example rows (skipped rows omitted; idx = example key)."""
    s = scoring.score(fx.predictions(spark, sf_dir), keep=["run", "ex_id"])
    return scoring.per_example(s.withColumnRenamed("ex_id", "idx"), keep=["run", "idx"])


@register("first_key_pick", o.with_(o.F1, o.LINES) + f"""
select run, ex_id, {o.pick_sql(('predict', 'prediction', 'output'))} predict,
  {o.pick_sql(('label', 'labels', 'reference', 'gold'))} label from picked""")
def first_key_pick(spark, sf_dir):
    """SRC3-4: predictions rendered as JSON lines under varying alias keys
    (some with a present null ``predict``), parsed back; the first present
    alias wins, even when its value is null."""
    lines = _prediction_lines(fx.predictions(spark, sf_dir))
    v = F.try_parse_json("value")
    picked = lines.select("run", "ex_id",
                          readers.pick_first_key(v, F.col("value"), readers.PRED_KEYS).alias("p"),
                          readers.pick_first_key(v, F.col("value"), readers.GOLD_KEYS).alias("g"))
    return picked.select("run", "ex_id", F.try_variant_get("p", "$", "string").alias("predict"),
                         F.try_variant_get("g", "$", "string").alias("label"))


def _prediction_lines(f1: DataFrame) -> DataFrame:
    """F1 rows as JSON lines with alias keys; ``predict`` is a present null
    on some rows whose prediction sits under a later alias."""
    k3, k4, k7 = F.col("ex_id") % 3, F.col("ex_id") % 4, F.col("ex_id") % 7

    def quoted(c):
        return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
    pkey = F.when(k3 == 0, "predict").when(k3 == 1, "prediction").otherwise("output")
    gkey = (F.when(k4 == 0, "label").when(k4 == 1, "labels").when(k4 == 2, "reference")
            .otherwise("gold"))
    line = F.concat(F.lit("{"), F.when((k7 == 0) & (k3 != 0), F.lit('"predict": null, ')).otherwise(F.lit("")),
                    F.lit('"'), pkey, F.lit('": '), quoted(F.col("predict")), F.lit(', "'), gkey,
                    F.lit('": '), quoted(F.col("label")), F.lit("}"))
    return f1.select("run", "ex_id", line.alias("value"))


@register("jsonl_leaderboard", o.with_(o.F1, o.LINES, f"""parsed as (select run, ex_id,
  {o.ranking(o.pick_sql(('predict', 'prediction', 'output')))} p,
  {o.ranking(o.pick_sql(('label', 'labels', 'reference', 'gold')))} g from picked)""", o.SCORED_BODY)
          + o.metrics_select("run,") + " group by run")
def jsonl_leaderboard(spark, sf_dir):
    """SRC3 + SRC4 + AGG8 through files: predictions written as JSON
    Lines (one folder per run, blank lines between records), read back with
    the prediction reader (blank-line skip, malformed-line check, alias pick)
    and scored per run."""
    work = scratch_dir(spark, "q-jsonl")
    lines = _prediction_lines(fx.predictions(spark, sf_dir))
    blank = F.when(F.col("ex_id") % 9 == 0, F.lit("\n   ")).otherwise(F.lit(""))
    (lines.select("run", F.concat(F.col("value"), blank).alias("value"))
     .write.mode("overwrite").partitionBy("run").text(f"{work}/pred"))
    preds = readers.read_predictions(spark, f"{work}/pred", with_index=False, keep=["run"])
    return scoring.leaderboard(preds)


@register("jsonl_line_index", o.with_(o.F1, o.LINES, f"""parsed as (select run, ex_id, {o.pick_sql(('predict', 'prediction', 'output'))} predict,
  row_number() over (partition by run order by ex_id) - 1 idx from picked)""") + "select run, idx, md5(predict) predict_md5 from parsed")
def jsonl_line_index(spark, sf_dir):
    """SRC3 + WIN1: one prediction file a run, in order of the examples, with blank
    lines; each record's index among its file's records."""
    work = scratch_dir(spark, "q-line-index")
    lines = _prediction_lines(fx.predictions(spark, sf_dir))
    blank = F.when(F.col("ex_id") % 9 == 0, F.lit("\n   ")).otherwise(F.lit(""))
    (lines.repartition("run").sortWithinPartitions("run", "ex_id").select("run", F.concat(F.col("value"), blank).alias("value"))
     .write.mode("overwrite").partitionBy("run").text(f"{work}/pred"))
    p = readers.read_predictions(spark, f"{work}/pred", keep=["run"])
    return p.select("run", "idx", F.md5(F.try_variant_get("predict", "$", "string").cast("binary")).alias("predict_md5"))


@register("array_rankings", o.with_(o.NATIVE, "parsed as (select * from nparsed)", o.SCORED_BODY)
          + "select run, ex_id, em, relaxed_em, f1, top1, tau from scored")
def array_rankings(spark, sf_dir):
    """RNK5 + MET1-7 on native id arrays (no text parsing; an empty
    predicted list is a valid ranking): part keys by price vs. part keys with
    quantity >= 45 by quantity, per order."""
    li = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
    p = (fx.by_order(li).groupBy("l_orderkey", "l_partkey")
         .agg(F.max("l_extendedprice").alias("px"), F.max("l_quantity").alias("q")))
    arr = p.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("px")).alias("k1"), F.col("l_partkey").alias("k")))).alias("g"),
        F.sort_array(F.collect_list(F.when(F.col("q") >= 45, F.struct(
            (-F.col("q")).alias("k1"), F.col("l_partkey").alias("k"))))).alias("pr"))
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    x = arr.join(orders, arr.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderpriority").alias("run"), F.col("l_orderkey").alias("ex_id"),
        F.transform("pr", lambda s: s["k"]).alias("predict"), F.transform("g", lambda s: s["k"]).alias("label"))
    s = scoring.score(x, keep=["run", "ex_id"])
    return s.select("run", "ex_id", "em", "relaxed_em", "f1", "top1", "tau")


# ------------------------------------------------------------------ curation
_CUR = (o.F2, o.F3, o.LATEST)


def _raw_meta(spark, sf_dir):
    return fx.raw_examples(spark, sf_dir), fx.reasoning_metadata(spark, sf_dir)


@register("metadata_latest", o.with_(*_CUR)
          + "select qid, split, reasoning_text, total_thinking, recovered from latest")
def metadata_latest(spark, sf_dir):
    """AGG4 + PRJ4: last-wins metadata record per qid and its recovery text."""
    return curation.metadata_latest(fx.reasoning_metadata(spark, sf_dir))


@register("backfill", o.with_(*_CUR, o.ROWS)
          + "select pos, qid, needs_recovery, recovered, thinking_final from rows")
def backfill(spark, sf_dir):
    """FLT3 + JOIN1: per raw row, whether its blank thinking was recovered."""
    raw, meta = _raw_meta(spark, sf_dir)
    b = curation.backfill(raw, curation.metadata_latest(meta))
    return b.select("pos", "qid", "needs_recovery", "recovered", "thinking_final")


@register("curation_outcomes", o.with_(*_CUR, o.ROWS)
          + "select pos, qid, recovered, outcome from outcomes")
def curation_outcomes(spark, sf_dir):
    """FLT1-2 + FLT5 per row: kept / duplicate / invalid."""
    raw, meta = _raw_meta(spark, sf_dir)
    return curation.row_outcomes(raw, meta)


@register("curation_audit", o.with_(*_CUR, o.ROWS) + """
select count(*) n_raw, count(*) filter (where recovered) n_recovered,
  count(*) filter (where outcome = 'kept') n_kept, count(*) filter (where outcome <> 'kept') n_dropped,
  count(*) filter (where outcome = 'invalid') n_invalid,
  count(*) filter (where outcome = 'duplicate') n_duplicate,
  (select count(*) from latest) n_metadata
from outcomes""")
def curation_audit(spark, sf_dir):
    """AGG2 + FLT5: curation counters in one row."""
    raw, meta = _raw_meta(spark, sf_dir)
    return curation.curation_audit(raw, meta)


@register("curation_counters", ORACLES["curation_audit"])
def curation_counters(spark, sf_dir):
    """AGG2 as a by-product: the counters observed while the canonical table is
    written, without a pass of their own."""
    raw, meta = _raw_meta(spark, sf_dir)
    canonical, audit = curation.canonical_with_audit(raw, meta)
    canonical.write.parquet(f"{scratch_dir(spark, 'q-counters')}/canonical")
    return spark.createDataFrame([audit()], "n_raw long, n_recovered long, n_kept long, n_dropped long, n_invalid long, n_duplicate long, n_metadata long")


@register("canonical_examples", o.with_(*_CUR, o.ROWS) + f"""
select pos, qid, coalesce(dataset, 'unknown') dataset, {o.strip('prompt')} prompt,
  {o.strip('thinking_final')} thinking, {o.CANON_ANSWER} answer
from outcomes where outcome = 'kept'""")
def canonical_examples(spark, sf_dir):
    """AGG1 + PRJ1-3: first valid example per qid, cleaned."""
    raw, meta = _raw_meta(spark, sf_dir)
    c = curation.canonical_examples(raw, meta)
    return c.select("pos", "qid", "dataset", "prompt", "thinking", "answer")


@register("canonical_from_jsonl", o.with_(*_CUR, o.ROWS) + f"""
select qid, coalesce(dataset, 'unknown') dataset, {o.strip('prompt')} prompt,
  {o.strip('thinking_final')} thinking, {o.CANON_ANSWER} answer
from outcomes where outcome = 'kept'""")
def canonical_from_jsonl(spark, sf_dir):
    """SRC1 + SRC5 + SNK1 through files: the raw examples written as JSON
    Lines in input order (range-partitioned part files), read back with a
    global line order, curated, and persisted via load-or-build Parquet."""
    from rankloom.sources import writers
    work = scratch_dir(spark, "q-raw-jsonl")
    raw = fx.raw_examples(spark, sf_dir)
    (raw.repartitionByRange("pos").sortWithinPartitions("pos").drop("pos")
     .write.mode("overwrite").json(f"{work}/raw"))
    back = readers.read_raw_jsonl(spark, f"{work}/raw")
    canon = writers.load_or_build(
        spark, f"{work}/canonical",
        lambda: curation.canonical_examples(back, fx.reasoning_metadata(spark, sf_dir)))
    return canon.select("qid", "dataset", "prompt", "thinking", "answer")


# ------------------------------------------------------------ whole JSON files
_RAW_FILE = o.with_(o.F2) + """
select row_number() over (order by pos) - 1 pos, qid, dataset, prompt, thinking, answer from f2"""


def _json_text(*cols: str):
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def _raw_file(spark, sf_dir, path, opening="[", closing="]"):
    raw = fx.raw_examples(spark, sf_dir)
    datasets.write_json_file(raw.select("pos", _json_text("qid", "dataset", "prompt", "thinking", "answer").alias("record")), path, opening, closing)
    return path


def _metadata_files(spark, sf_dir, folder):
    meta = fx.reasoning_metadata(spark, sf_dir)
    member = F.concat(F.regexp_extract(F.to_json(F.array("qid")), r"^\[(.*)\]$", 1), F.lit(": "), _json_text("reasoning_text", "total_thinking"))
    for name in curation.SPLIT_ORDER:
        rows = meta.filter(F.col("split") == name).select(F.col("qid").alias("pos"), member.alias("record"))
        datasets.write_json_file(rows, f"{folder}/{readers.META_FILE.format(split=name)}", "{", "}")
    return folder


@register("raw_array_file", _RAW_FILE)
def raw_array_file(spark, sf_dir):
    """SRC1: the raw examples as one JSON array file, read back by many tasks."""
    path = _raw_file(spark, sf_dir, f"{scratch_dir(spark, 'q-raw-array')}/raw.json")
    return readers.read_raw_examples(spark, path).select("pos", "qid", "dataset", "prompt", "thinking", "answer")


@register("raw_wrapper_file", _RAW_FILE)
def raw_wrapper_file(spark, sf_dir):
    """SRC1: the same under ``data`` of an object, between other members."""
    path = _raw_file(spark, sf_dir, f"{scratch_dir(spark, 'q-raw-wrapper')}/raw.json",
                     '{"about": {"data": [{"qid": "no"}]}, "data": [', '], "examples": [{"qid": "no"}]}')
    return readers.read_raw_examples(spark, path).select("pos", "qid", "dataset", "prompt", "thinking", "answer")


@register("metadata_files", ORACLES["metadata_latest"])
def metadata_files(spark, sf_dir):
    """SRC2 + AGG4: the reasoning metadata as one JSON object a split, read back
    by many tasks, last record per qid."""
    folder = _metadata_files(spark, sf_dir, scratch_dir(spark, "q-metadata"))
    return curation.metadata_latest(readers.read_metadata(spark, folder))


@register("reshard_documents", f"""
with recursive docs as (select doc_id pos, text, lang, 1 one, octet_length(encode(to_json({{'doc_id': doc_id, 'lang': lang, 'text': text}}))) + 1 rec_bytes from documents),
{o.greedy_cte('docs', 'one', 65536)}
select pos doc_id, lang, cast(shard as integer) shard, md5(text) text_md5 from fold join docs using (pos)""")
def reshard_documents(spark, sf_dir):
    """SRC7 + SNK2 + SNK7: all documents as one JSON array file, resharded into
    part-%05d.json files of 64 KiB at most, the source replaced after its checksum
    was found in the shards, and the shards read back."""
    from rankloom.sources import writers
    work = scratch_dir(spark, "q-reshard")
    docs = fx.table(spark, sf_dir, "documents")
    datasets.write_json_file(docs.select(F.col("doc_id").alias("pos"), _json_text("doc_id", "lang", "text").alias("record")), f"{work}/documents.json")
    writers.reshard(spark, f"{work}/documents.json", f"{work}/documents", 65536, replace=True)
    back = datasets.read_dataset(spark, f"{work}/documents")
    r = F.from_json("record", "doc_id long, lang string, text string", {"mode": "FAILFAST"})
    return back.select("shard", r.alias("r")).select("r.doc_id", "r.lang", "shard", F.md5(F.col("r.text").cast("binary")).alias("text_md5"))


@register("corpus_build", o.with_(*_CUR, o.ROWS, o.CANON, o.SPLIT, o.SETUP_ROWS, f"""
texts as (select pos, setup, mask_history, split.split, cast(to_json({{'system': '{o.SYSTEM.replace("'", "''")}', 'conversations': conversations}}) as varchar) record
  from setups join split using (pos)),
train as (select setup, pos, octet_length(encode(record)) + 1 rec_bytes from texts where split = 'train')""",
          o.greedy_cte("train", "setup", 65536)).replace("with ", "with recursive ", 1) + f"""
select t.setup || '_' || t.split "name", mask_history, case t.split when 'train' then cast(shard as integer) else 0 end shard, md5(record) record_md5
from texts t left join fold on t.split = 'train' and fold.key = t.setup and fold.pos = t.pos""")
def corpus_build(spark, sf_dir):
    """From a raw JSON file and metadata files to registered datasets (SRC1, SRC2,
    SRC5, curation, SPL1, PRJ5-13, SNK2, SNK3, SNK6); then every record of every
    file that the manifest names."""
    work = scratch_dir(spark, "q-corpus")
    raw = _raw_file(spark, sf_dir, f"{work}/raw.json")
    written = datasets.build_corpus(spark, raw, _metadata_files(spark, sf_dir, f"{work}/metadata"), f"{work}/canonical", f"{work}/sets",
                                    f"{work}/manifest", max_bytes=65536)
    masks = {r["name"]: r["mask_history"] for r in written.collect()}          # one row a dataset
    out = None
    for entry in spark.read.schema(datasets.MANIFEST_SCHEMA).json(f"{work}/manifest").orderBy("name").collect():
        rows = datasets.read_dataset(spark, entry["file_name"]).select(
            F.lit(entry["name"]).alias("name"), F.lit(masks[entry["name"]]).alias("mask_history"), "shard", F.md5(F.col("record").cast("binary")).alias("record_md5"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ------------------------------------------------------------ setups, split
def _canonical(spark, sf_dir):
    raw, meta = _raw_meta(spark, sf_dir)
    return curation.canonical_examples(raw, meta)


@register("setup_rows", o.with_(*_CUR, o.ROWS, o.CANON, o.SETUP_ROWS) + """
select qid, setup, mask_history, 'You are a careful retrieval assistant that ranks candidate tables by their relevance to a user''s question.' system,
  cast(len(conversations) as integer) n_turns, conversations[1].value human, conversations[-1].value response,
  octet_length(encode(to_json({'system': 'You are a careful retrieval assistant that ranks candidate tables by their relevance to a user''s question.', 'conversations': conversations}))) + 1 rec_bytes
from setups""")
def setup_rows(spark, sf_dir):
    """PRJ5-11 + PRJ13: every canonical example in the four layouts."""
    f = setups.with_record(setups.fan_out(_canonical(spark, sf_dir)))
    return f.select("qid", "setup", "mask_history", "system",
                    F.size("conversations").alias("n_turns"),
                    F.col("conversations")[0]["value"].alias("human"),
                    F.element_at("conversations", -1)["value"].alias("response"), "rec_bytes")


@register("loss_turns", o.with_(*_CUR, o.ROWS, o.CANON, o.SETUP_ROWS) + """
select qid, setup, turn, role, value,
  role = 'gpt' and (not mask_history or turn = last_gpt) in_loss
from (select qid, setup, mask_history, cast(generate_subscripts(conversations, 1) - 1 as integer) turn,
        unnest(conversations).from role, unnest(conversations).value value,
        list_last(list_filter(range(len(conversations)), lambda i: conversations[i + 1].from = 'gpt')) last_gpt
      from setups)""")
def loss_turns(spark, sf_dir):
    """PRJ12: one row per turn with its loss-mask flag."""
    t = setups.loss_turns(setups.fan_out(_canonical(spark, sf_dir)), keep=["qid"])
    return t.select("qid", "setup", "turn", "role", "value", "in_loss")


@register("registered_setup", o.with_(*_CUR, o.ROWS, o.CANON) + """
select qid, 'answer_first' setup, cast(i - 1 as integer) turn, case when i % 2 = 1 then 'human' else 'gpt' end role,
  case i when 1 then prompt when 2 then answer when 3 then 'Why?' else thinking end "value", i = 4 in_loss
from canon, unnest([1, 2, 3, 4]) t(i)""")
def registered_setup(spark, sf_dir):
    """UDF1 + PRJ12: a layout of the user's own, registered as Column expressions:
    the answer first, then the reasoning, which alone is a loss target."""
    setups.register_setup("answer_first", lambda: [("human", F.col("prompt")), ("gpt", F.col("answer")), ("human", F.lit("Why?")), ("gpt", F.col("thinking"))],
                          mask_history=True)
    try:
        fanned = setups.fan_out(_canonical(spark, sf_dir), only=["answer_first"])
    finally:
        setups.unregister_setup("answer_first")
    return setups.loss_turns(fanned, keep=["qid"]).select("qid", "setup", "turn", "role", "value", "in_loss")


@register("split_assign", o.with_(*_CUR, o.ROWS, o.CANON, o.SPLIT) + "select qid, split from split")
def split_assign(spark, sf_dir):
    """SPL1: exact-size seeded val split, identical for every setup."""
    canon = materialize(_canonical(spark, sf_dir).select("pos", "qid"), "canonical")
    return split.assign_split(canon).select("qid", "split")


@register("split_counts", o.with_(*_CUR, o.ROWS, o.CANON, o.SPLIT, o.SETUP_ROWS) + """
select setups.setup, split.split, count(*) n_rows, bool_or(mask_history) mask_history
from setups join split on split.qid = setups.qid group by setups.setup, split.split""")
def split_counts(spark, sf_dir):
    """AGG3: rows per (setup, split) and the setup's mask flag. Every setup has every
    example, so the narrow split is counted once and given to each setup."""
    canon = materialize(_canonical(spark, sf_dir).select("pos", "qid"), "canonical")
    counts = split.assign_split(canon).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    each = F.explode(F.array(*[F.struct(F.lit(s.name).alias("setup"), F.lit(s.mask_history).alias("mask_history")) for s in setups.setups()]))
    return counts.select(each.alias("s"), "split", "n_rows").select("s.setup", "split", "n_rows", "s.mask_history")


# ------------------------------------------------------------------ shards
SHARD_TEST_BYTES = 65536


@register("shard_greedy", o.greedy_sql(SHARD_TEST_BYTES) + "select lang, pos, rec_bytes, shard_id from g")
def shard_greedy(spark, sf_dir):
    """SHARD2: exact greedy packing per lang in pos order (64 KiB budget)."""
    return sharding.greedy_shards(fx.shard_input(spark, sf_dir), SHARD_TEST_BYTES, ["lang"]) \
        .select("lang", "pos", "rec_bytes", "shard_id")


@register("shard_report", o.greedy_sql(SHARD_TEST_BYTES) + """
, s as (select lang, shard_id, sum(rec_bytes) + 1 file_bytes, count(*) n from g group by lang, shard_id)
select lang, count(*) n_shards, cast(sum(n) as bigint) n_records, cast(sum(file_bytes) as bigint) total_bytes,
  cast(max(file_bytes) as bigint) max_shard_bytes
from s group by lang""")
def shard_report(spark, sf_dir):
    """AGG9: shard count and bytes per lang."""
    g = sharding.greedy_shards(fx.shard_input(spark, sf_dir), SHARD_TEST_BYTES, ["lang"])
    return sharding.shard_report(g, ["lang"])


@register("shard_assign", o.with_(o.F4) + f"""
, marked as (select *, 2 * rec_bytes > {SHARD_TEST_BYTES} - 2 large from f4),
cut as (select *, 2 * count(*) filter (where large) over (partition by lang order by pos) - large::int seg from marked),
r as (select lang, pos, rec_bytes, seg, case when large then 0 else
    sum(rec_bytes) over (partition by lang, seg order by pos rows between unbounded preceding and current row) - rec_bytes end start,
    {SHARD_TEST_BYTES} - 2 - max(rec_bytes) filter (where not large) over (partition by lang) w from cut)
select lang, pos, cast(rec_bytes as bigint) rec_bytes, cast(start as bigint) start,
  dense_rank() over (partition by lang order by seg, case when seg % 2 = 0 then floor(start / w) end) - 1 shard_id from r""")
def shard_assign(spark, sf_dir):
    """SHARD1: prefix-sum bounded shards per lang (64 KiB budget; longer half-budget
    records end segments)."""
    return sharding.bounded_shards(fx.shard_input(spark, sf_dir), SHARD_TEST_BYTES, ["lang"])


# ------------------------------------------------------------ runs, progress
@register("trainer_log_steps", o.with_(o.F5) + "select run_id, step, loss from f5")
def trainer_log_steps(spark, sf_dir):
    """WIN1-style ordered numbering: step = position of the event in its run
    (skew-safe running index, no per-run window)."""
    return fx.trainer_log(spark, sf_dir).select("run_id", "step", "loss")


@register("run_progress", o.with_(o.F5) + f"""
, st as (select run_id, max(step) global_step,
    arg_max(loss, step) filter (where loss is not null) last_loss from f5 group by run_id)
select c_custkey run_id, c_name name,
  case when st.run_id is null then 'not started' when global_step >= {o.MAX_STEPS} then 'DONE'
       else 'running' end status,
  global_step step, case when st.run_id is not null then {o.MAX_STEPS} end max_steps,
  case when st.run_id is not null then 100.0 * global_step / {o.MAX_STEPS} end pct,
  case when st.run_id is not null then 3.0 * global_step / {o.MAX_STEPS} end epoch, last_loss
from customer left join st on st.run_id = c_custkey""")
def run_progress(spark, sf_dir):
    """PROG1 + JOIN3 + WIN3: status of every run (customer) from its log."""
    runs_dim = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_name").alias("name"))
    state = runs.log_state(fx.trainer_log(spark, sf_dir))
    return runs.progress(runs_dim, state, max_steps=o.MAX_STEPS)


@register("run_states", o.with_(o.F5) + f"""
, st as (select run_id, max(step) step, arg_max(loss, step) filter (where loss is not null) last_loss from f5 group by run_id),
own as (select *, case when run_id % 7 = 0 then 0 else 32 + run_id % 64 end max_steps from st)
select cast(c_custkey as varchar) run, c_name "name", case when own.run_id is null then 'not started' when step >= max_steps and max_steps > 0 then 'DONE' else 'running' end status,
  cast(step as bigint) step, cast(max_steps as bigint) max_steps, case when own.run_id is not null then case when max_steps > 0 then 100.0 * step / max_steps else 0 end end pct,
  cast(step as double) / 8 epoch, last_loss
from customer left join own on own.run_id = c_custkey""")
def run_states(spark, sf_dir):
    """SRC6 + PROG1 + SORT2 through files: a state file for each run that has logged,
    with its own max_steps (some have none) and epoch, read back and joined to the
    list of runs."""
    work = scratch_dir(spark, "q-states")
    log = fx.trainer_log(spark, sf_dir).groupBy(F.col("run_id").alias("run")).agg(
        F.max("step").alias("global_step"), F.sort_array(F.collect_list(F.struct("step", "loss"))).alias("log_history"))
    states = log.select("run", "global_step", F.when(F.col("run") % 7 != 0, 32 + F.col("run") % 64).alias("max_steps"),
                        (F.col("global_step") / 8).alias("epoch"), "log_history")
    states.repartition("run").write.partitionBy("run").json(f"{work}/runs")
    listed = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("run"), F.col("c_name").alias("name"))
    return runs.state_progress(listed, readers.read_trainer_states(spark, f"{work}/runs", "part-*.json"))


@register("run_comparison", o.with_(o.F1, o.SCORED) + f""", board as ({o.metrics_select("run,")} group by run),
sides as (select *, row_number() over (order by run) - 1 k from board),
dim as (select model_tag, setup, {o.LABELS} label, path, row_number() over (order by model_tag, setup) - 1 k
  from {o.MODELS_VALUES}, (values ('setup1_full_loss'), ('setup2_answer_only'), ('setup3_1_hint_answer_only'), ('setup3_2_hint_full_loss')) s(setup),
  (values ('Qwen/Qwen3-8B', '/models/8b'), ('Qwen/Qwen3-4B', '/models/4b')) l(repo, path) where repo = repo_id)
select run, model_tag || '_' || label run_name, setup, path model_path,
  case when label like '%answer_only%' and label not like '%hint_full%' then 128 else 4096 end max_new_tokens, "EM", "F1", n_total
from sides left join dim using (k)""")
def run_comparison(spark, sf_dir):
    """CMP1 + JOIN5: each run's metrics beside its model, setup, local model path
    and token budget (the runs of F1 stand for the first runs by name)."""
    paths = spark.createDataFrame([("Qwen/Qwen3-8B", "/models/8b"), ("Qwen/Qwen3-4B", "/models/4b")], "repo_id string, path string")
    dim = runs.run_dimension(runs.setup_dimension(spark), model_paths=paths)
    board = scoring.leaderboard(fx.predictions(spark, sf_dir))
    names = [r["run_name"] for r in dim.orderBy("model_tag", "setup").collect()]          # models x setups
    of_run = {r["run"]: names[k] for k, r in enumerate(board.select("run").orderBy("run").collect())}
    named = board.withColumn("run_name", F.element_at(F.create_map(*[F.lit(x) for kv in of_run.items() for x in kv]), F.col("run")))
    return runs.compare_runs(named, dim).select("run", "run_name", "setup", "model_path", "max_new_tokens", "EM", "F1", "n_total")


@register("pareto_front", """
with m as (select l_suppkey, count(*) n_lines, max(l_extendedprice) top_price, sum(l_quantity) quantity from lineitem group by l_suppkey)
select * from m where not exists (select 1 from m b where b.n_lines >= m.n_lines and b.top_price <= m.top_price and b.quantity <= m.quantity
  and (b.n_lines > m.n_lines or b.top_price < m.top_price or b.quantity < m.quantity))""")
def pareto_front(spark, sf_dir):
    """CMP2: suppliers (as runs) that none beats in lines, top price and quantity."""
    li = fx.table(spark, sf_dir, "lineitem")
    m = li.groupBy("l_suppkey").agg(F.count("*").alias("n_lines"), F.max("l_extendedprice").alias("top_price"), F.sum("l_quantity").alias("quantity"))
    return pareto.pareto_front(m, maximize=["n_lines"], minimize=["top_price", "quantity"])


@register("run_dimension", o.with_(*_CUR, o.ROWS, o.CANON, o.SETUP_ROWS) + f"""
, present as (select distinct setup, mask_history from setups)
select model_tag, repo_id, setup, mask_history, model_tag || '_' || {o.LABELS} run_name,
  setup || '_train' dataset, setup || '_val' val_dataset,
  case when (model_tag || '_' || {o.LABELS}) like '%answer_only%'
        and (model_tag || '_' || {o.LABELS}) not like '%hint_full%' then 128 else 4096 end max_new_tokens,
  'lora_runs/' || model_tag || '_' || {o.LABELS} output_dir
from present cross join {o.MODELS_VALUES}""")
def run_dimension(spark, sf_dir):
    """DIM1 + JOIN4 + PRJ16-17: the model x setup run matrix for the setups
    that have data."""
    # a setup has data if any raw row is valid; the first one found will do
    raw, meta = _raw_meta(spark, sf_dir)
    some = curation.valid_rows(raw, curation.metadata_latest(meta)).select(F.lit(1).alias("some")).limit(1)
    each = F.explode(F.array(*[F.lit(s.name) for s in setups.setups()])).alias("setup")
    dim = some.select(each).join(F.broadcast(runs.setup_dimension(spark)), "setup")
    r = runs.run_dimension(dim)
    return r.select("model_tag", "repo_id", "setup", "mask_history", "run_name", "dataset",
                    "val_dataset", "max_new_tokens", "output_dir")


# ------------------------------------------------------------ manifest, paths
OUT_DIR = "/data/training_data/table_retrieval/sharegpt_setups"
OLD_ROOT = "/mnt/old/box/training_data"


@register("manifest_upsert", o.with_(*_CUR, o.ROWS, o.CANON, o.SPLIT, o.SETUP_ROWS) + f"""
, newm as (select distinct setups.setup || '_' || split.split name,
    '{OUT_DIR}/' || setups.setup || case when split.split = 'train' then '_train' else '_val.json' end file_name
  from setups join split on split.qid = setups.qid),
oldm as (select distinct 'raw_' || dataset name, '{OLD_ROOT}/raw/' || dataset || '.json' file_name from canon
  union all select distinct setup || '_train', '{OLD_ROOT}/sharegpt_setups/' || setup || '_train' from setups),
merged as (select * from oldm where name not in (select name from newm) union all select * from newm)
select name, file_name, 'sharegpt' formatting,
  '{{"messages":"conversations","system":"system"}}' columns_json,
  '{{"role_tag":"from","content_tag":"value","user_tag":"human","assistant_tag":"gpt"}}' tags_json
from merged""")
def manifest_upsert(spark, sf_dir):
    """SNK6: upsert the written setup datasets into an older manifest."""
    canon = materialize(_canonical(spark, sf_dir).select("pos", "qid", "dataset"), "canonical")
    each = F.explode(F.array(*[F.lit(s.name) for s in setups.setups()])).alias("setup")
    fanned = split.assign_split(canon).select("split").distinct().select("split", each)
    new_files = fanned.select(
        F.concat("setup", F.lit("_"), "split").alias("name"),
        F.concat(F.lit(OUT_DIR + "/"), "setup",
                 F.when(F.col("split") == "train", F.lit("_train")).otherwise(F.lit("_val.json")))
        .alias("file_name")).distinct()
    old_files = canon.select(F.concat(F.lit("raw_"), "dataset").alias("name"),
                             F.concat(F.lit(OLD_ROOT + "/raw/"), "dataset", F.lit(".json"))
                             .alias("file_name")).distinct().unionByName(
        fanned.select(F.concat("setup", F.lit("_train")).alias("name"),
                      F.concat(F.lit(OLD_ROOT + "/sharegpt_setups/"), "setup", F.lit("_train"))
                      .alias("file_name")).distinct())
    m = manifest.manifest_upsert(manifest.manifest_entries(old_files), manifest.manifest_entries(new_files))
    return m.select("name", "file_name", "formatting", F.to_json("columns").alias("columns_json"),
                    F.to_json("tags").alias("tags_json"))


REPO_DIR = "/srv/new$repo"
MODEL_CACHE = "/models/cache"


@register("path_rebase", o.with_(o.DOC_PATHS) + f"""
select doc_id, path, regexp_replace(regexp_replace(path,
    '[^"\t\n\x0B\f\r ]*/(training_data|lora_runs|eval_runs)/', '{REPO_DIR}/\\1/', 'g'),
    '[^"\t\n\x0B\f\r ]*/(Qwen__[A-Za-z0-9._-]+)', '{MODEL_CACHE}/\\1', 'g') rebased from docpaths""")
def path_rebase(spark, sf_dir):
    """PRJ15: re-root paths after the last in-repo anchor and model-cache
    paths (paths built from the documents table)."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    k = F.col("doc_id")
    path = F.concat(
        F.lit("/home/u"), "source", F.lit("/proj/"),
        F.when(k % 4 == 0, "training_data").when(k % 4 == 1, "lora_runs").when(k % 4 == 2, "eval_runs")
        .otherwise("misc"), F.lit("/"), "lang", F.lit("/"),
        F.when(k % 3 == 0, F.lit("eval_runs/")).otherwise(F.lit("")), k.cast("string"), F.lit(".json"),
        F.when(k % 5 == 0, F.concat(F.lit(' "/cache/old/Qwen__Qwen3-'), (F.col("n_chars") % 9).cast("string"),
                                    F.lit('B"'))).otherwise(F.lit("")))
    p = d.select("doc_id", path.alias("path"))
    return p.select("doc_id", "path", manifest.rebase_paths(F.col("path"), REPO_DIR, MODEL_CACHE).alias("rebased"))


# ------------------------------------------------------------ streaming
def _arrivals(df: DataFrame, batches: int) -> tuple[DataFrame, int]:
    """The rows dealt to files for so many micro-batches, and the files in each: as
    many as there are tasks to read them, so a batch is never one task's work."""
    each = max(4 // batches, -(-partitions_for(df, 16 << 20) // batches))
    return df.repartition(batches * each), each


def _stage(df: DataFrame, path: str, chunks_by: str | None = None, n_chunks: int = 4) -> str:
    """Write derived input files for a file-source stream. With ``chunks_by``
    the rows are appended in that column's order as successive files (each
    arrival batch is a contiguous range; no row is left out)."""
    if chunks_by is None:
        df.write.mode("overwrite").parquet(path)
        return path
    lo, hi = df.agg(F.min(chunks_by), F.max(chunks_by)).collect()[0]
    step = (hi - lo) // n_chunks + 1
    for i in range(n_chunks):
        part = df.filter((F.col(chunks_by) >= lo + i * step) & (F.col(chunks_by) < lo + (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


@register("stream_progress", ORACLES["run_progress"])
def stream_progress(spark, sf_dir):
    """STR1: run progress maintained by a streaming aggregation over log files."""
    work = scratch_dir(spark, "q-stream-progress")
    log, each = _arrivals(fx.trainer_log(spark, sf_dir), 2)
    src = _stage(log, f"{work}/log")
    runs_dim = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_name").alias("name"))
    return live.stream_progress(spark, src, runs_dim, log_schema=fx.TRAINER_LOG_SCHEMA,
                                max_steps=o.MAX_STEPS, max_files_per_trigger=each,
                                work_dir=f"{work}/stream")


@register("stream_leaderboard", ORACLES["leaderboard"])
def stream_leaderboard(spark, sf_dir):
    """STR2: per-run metrics maintained by a streaming aggregation over
    prediction files."""
    work = scratch_dir(spark, "q-stream-leaderboard")
    pred, each = _arrivals(fx.predictions(spark, sf_dir), 4)
    src = _stage(pred, f"{work}/pred")
    return live.stream_leaderboard(spark, src, max_files_per_trigger=each, work_dir=f"{work}/stream")


@register("stream_dedup", ORACLES["canonical_examples"])
def stream_dedup(spark, sf_dir):
    """STR3: canonical examples from raw files arriving in four batches; the
    first valid row per qid wins across batches."""
    work = scratch_dir(spark, "q-stream-dedup")
    src = _stage(fx.raw_examples(spark, sf_dir), f"{work}/raw", chunks_by="pos")
    out = live.stream_dedup(spark, src, fx.reasoning_metadata(spark, sf_dir), work_dir=f"{work}/stream")
    return out.select("pos", "qid", "dataset", "prompt", "thinking", "answer")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
