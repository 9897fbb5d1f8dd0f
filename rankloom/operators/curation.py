"""Curation of raw ranking examples into canonical SFT examples.

Rules (per raw row, in input order ``pos``):

* recovery: when the thinking is a blank *string* (null is not recoverable)
  and the question's metadata has reasoning text, that text replaces it;
* validity: qid, prompt, thinking and answer present and not blank, and the
  answer's first-``{``-to-last-``}`` block parses strictly as JSON with a
  non-empty ``ranked_tables`` list;
* dedup: first valid row per qid wins;
* cleaning: strip prompt/thinking, canonical answer JSON, defaults.

Plan shape: recovery depends only on (qid, "thinking is blank"), so all of
a qid's rows see the same recovered text. The dedup therefore aggregates
per qid *before* joining the metadata: Spark's partial aggregation collapses
a hot qid to one buffer per task, and the join afterwards sees one row per
qid (no skew, no fan-out). Raw rows are shuffled once (by qid).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rankloom.functions.text import greedy_block, is_blank, py_strip, strict_json
from rankloom.session import cached_column

# Fixed order of the metadata splits: a later split overrides an earlier one.
SPLIT_ORDER = ("train", "dev", "test")
# Fixed order of the metadata keys holding reasoning text.
THINKING_KEYS = ("reasoning_text", "total_thinking")
REQUIRED_FIELDS = ("qid", "prompt", "thinking", "answer")


# --------------------------------------------------------------- metadata
def split_rank(split: Column) -> Column:
    return (F.when(split == SPLIT_ORDER[0], 0).when(split == SPLIT_ORDER[1], 1)
            .when(split == SPLIT_ORDER[2], 2))


def recovered_value(*keys: Column) -> Column:
    """PRJ4: first non-blank string among the keys, stripped."""
    return F.coalesce(*[F.nullif(py_strip(k), F.lit("")) for k in keys])


def metadata_latest(meta: DataFrame) -> DataFrame:
    """AGG4 + PRJ4: one record per qid, the one from the latest split
    (train < dev < test; within a split the later ``pos`` if present). The
    *whole* record is replaced, even by a blank one. Adds ``recovered``.

    ``max_by`` aggregates partially map-side, so a hot qid ships one buffer
    per task."""
    order = [split_rank(F.col("split"))]
    if "pos" in meta.columns:
        order.append(F.col("pos"))
    rec = F.struct(F.col("split"), *[F.col(k) for k in THINKING_KEYS])
    latest = (meta.filter(split_rank(F.col("split")).isNotNull())
              .groupBy("qid").agg(F.max_by(rec, F.struct(*order)).alias("r")))
    return latest.select("qid", "r.split", *[f"r.{k}" for k in THINKING_KEYS],
                         recovered_value(*[F.col(f"r.{k}") for k in THINKING_KEYS]).alias("recovered"))


# --------------------------------------------------------------- row rules
def needs_recovery(df: DataFrame) -> Column:
    """FLT3: thinking is a string and blank (null is *not* recoverable)."""
    return F.coalesce(F.col("thinking").isNotNull() & is_blank(F.col("thinking")), F.lit(False))


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & ~is_blank(F.col(c))


def answer_lists(answer: Column) -> Column:
    """FLT2 helper: ``ranked_tables`` of the strictly-parsed greedy block."""
    return F.try_variant_get(strict_json(greedy_block(answer)), "$.ranked_tables", "array<variant>")


def answer_ok(answer: Column) -> Column:
    return F.coalesce(F.size(answer_lists(answer)) > 0, F.lit(False))


def row_flags(raw: DataFrame) -> DataFrame:
    """Row-local validity parts: everything except the thinking of rows that
    await recovery."""
    return raw.withColumns(_row_flag_exprs())


@cached_column
def _row_flag_exprs() -> dict[str, Column]:
    other = _present("qid") & _present("prompt") & _present("answer") & answer_ok(F.col("answer"))
    return {
        "_rec": F.coalesce(F.col("thinking").isNotNull() & is_blank(F.col("thinking")), F.lit(False)),
        "_other": F.coalesce(other, F.lit(False)),
        "_plain": F.coalesce(_present("thinking"), F.lit(False)),
    }


# --------------------------------------------------------------- answer JSON
_JWS = r"[ \t\n\r]*"
_JINT = r"(?:0|-?[1-9][0-9]*)"
_SIMPLE = (rf"^\{{{_JWS}\"ranked_tables\"{_JWS}:{_JWS}\[{_JWS}({_JINT}(?:{_JWS},{_JWS}{_JINT})*+)"
           rf"{_JWS}\]{_JWS}\}}$")


def _dumps_json_batch(s: pd.Series) -> pd.Series:
    """json.dumps(json.loads(x)) with Python's default separators and ASCII
    escaping; only rows off the integer-list fast path reach it."""
    def one(x):
        if x is None:
            return None
        try:
            return json.dumps(json.loads(x))
        except (ValueError, RecursionError):
            return None
    return s.map(one)


@cached_column
def canonical_answer_of(col: str) -> Column:
    """:func:`canonical_answer` of a named column (memoised)."""
    return canonical_answer(F.col(col))


def canonical_answer(answer: Column) -> Column:
    """PRJ2: the answer's JSON block re-serialised like ``json.dumps``
    (``", "``/``": "`` separators, keys in order, non-ASCII escaped); the
    stripped text when the block does not parse.

    ``{"ranked_tables": [ints]}`` -- nearly every row -- is rebuilt with
    regex on the JVM; any other shape goes through one Arrow-batched
    pandas UDF (null input for fast-path rows)."""
    g = greedy_block(answer)
    simple = g.rlike(_SIMPLE)
    inner = F.regexp_extract(g, _SIMPLE, 1)
    fast = F.concat(F.lit('{"ranked_tables": ['),
                    F.regexp_replace(inner, rf"{_JWS},{_JWS}", ", "), F.lit("]}"))
    parsed_ok = strict_json(g).isNotNull()
    slow = F.pandas_udf(_dumps_json_batch, "string")(F.when(parsed_ok & ~simple, g))
    return (F.when(simple, fast).when(parsed_ok, slow).otherwise(py_strip(answer)))


# --------------------------------------------------------------- operators
def backfill(raw: DataFrame, meta_latest: DataFrame) -> DataFrame:
    """FLT3 + JOIN1 per raw row: ``needs_recovery``, ``recovered`` and the
    thinking after recovery. Left join on qid; the metadata side has one row
    per qid (no fan-out). AQE picks broadcast when the metadata is small at
    runtime and splits a hot raw qid (skew join) otherwise."""
    m = meta_latest.select("qid", F.col("recovered").alias("_text")).filter(F.col("_text").isNotNull())
    j = raw.withColumn("_needs", needs_recovery(raw)).join(m, "qid", "left")
    hit = F.col("_needs") & F.col("_text").isNotNull()
    return j.select(*raw.columns, F.col("_needs").alias("needs_recovery"), hit.alias("recovered"),
                    F.when(hit, F.col("_text")).otherwise(F.col("thinking")).alias("thinking_final"))


def _per_qid(raw: DataFrame, full_rows: bool) -> DataFrame:
    """Per-qid partial-aggregatable summary: row counts by validity class and
    the first candidate of each class (full row, or just its ``pos``)."""
    f = row_flags(raw)
    return f.groupBy("qid").agg(*_per_qid_aggs(full_rows, tuple(raw.columns)))


@cached_column
def _per_qid_aggs(full_rows: bool, columns: tuple[str, ...]) -> list[Column]:
    plain_ok = F.col("_other") & F.col("_plain")
    rec_ok = F.col("_other") & F.col("_rec")
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("_rec")).alias("n_needs"),
        F.count_if(plain_ok).alias("n_plain"),
        F.count_if(rec_ok).alias("n_recok"),
    ]
    if full_rows:
        row = F.struct(*[F.col(c) for c in columns])
        aggs += [F.min_by(F.when(plain_ok, row), F.when(plain_ok, F.col("pos"))).alias("c_plain"),
                 F.min_by(F.when(rec_ok, row), F.when(rec_ok, F.col("pos"))).alias("c_rec")]
    else:
        aggs += [F.min(F.when(plain_ok, F.col("pos"))).alias("p_plain"),
                 F.min(F.when(rec_ok, F.col("pos"))).alias("p_rec")]
    return aggs


def _with_recovery(per_qid: DataFrame, meta_latest: DataFrame | None) -> DataFrame:
    if meta_latest is None:
        return per_qid.withColumn("_text", F.lit(None).cast("string"))
    m = meta_latest.select("qid", F.col("recovered").alias("_text")).filter(F.col("_text").isNotNull())
    # null qids never match (dict.get(None) finds nothing either)
    return per_qid.join(m, "qid", "left")


def curation_audit(raw: DataFrame, meta: DataFrame | None) -> DataFrame:
    """FLT5 + AGG2: one row of counters. Every raw row is exactly one of
    invalid / duplicate (both "dropped") / kept; ``recovered`` counts
    recoveries, made before validity (a recovered duplicate is counted in
    both)."""
    latest = metadata_latest(meta) if meta is not None else None
    q = _per_qid(raw, full_rows=False)
    if latest is not None:
        # one full outer join on the shared qid partitioning yields both the
        # recovery text per raw qid and the metadata size (len of the index)
        m = latest.select("qid", F.col("recovered").alias("_text"), F.lit(1).alias("meta_rows"))
        q = q.join(m, "qid", "full_outer")
    else:
        q = q.withColumns({"_text": F.lit(None).cast("string"), "meta_rows": F.lit(0)})
    # a null raw qid is its own group and never matches the metadata
    has = F.col("_text").isNotNull() & F.col("qid").isNotNull()
    n_rows = F.coalesce(F.col("n_rows"), F.lit(0))
    valid = F.coalesce(F.col("n_plain"), F.lit(0)) + F.when(has, F.coalesce(F.col("n_recok"), F.lit(0))) \
        .otherwise(0)
    per = q.select(
        n_rows.alias("n_rows"),
        F.when(has, F.coalesce(F.col("n_needs"), F.lit(0))).otherwise(0).alias("recovered"),
        valid.alias("valid"),
        F.when(valid > 0, 1).otherwise(0).alias("kept"),
        F.coalesce(F.col("meta_rows"), F.lit(0)).alias("meta_rows"))
    out = per.agg(
        F.sum("n_rows").alias("n_raw"),
        F.sum("recovered").alias("n_recovered"),
        F.sum("kept").alias("n_kept"),
        (F.sum("n_rows") - F.sum("kept")).alias("n_dropped"),
        (F.sum("n_rows") - F.sum("valid")).alias("n_invalid"),
        (F.sum("valid") - F.sum("kept")).alias("n_duplicate"),
        F.sum("meta_rows").alias("n_metadata"))
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in out.columns])


def canonical_examples(raw: DataFrame, meta: DataFrame | None) -> DataFrame:
    """AGG1 + PRJ1-3: first valid row per qid, cleaned.

    Output: pos, qid, dataset, prompt, thinking, answer, ranked_table_ids,
    candidate_ids (``pos`` keeps the input order)."""
    latest = metadata_latest(meta) if meta is not None else None
    return canonical_examples_from_latest(raw, latest)


def canonical_with_audit(raw: DataFrame, meta: DataFrame | None) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """:func:`canonical_examples`, and the counters of :func:`curation_audit` as a
    by-product of the same pass (AGG2): call the second result once the first was
    written (or another action has read all of it). Counters are observed on the
    per-qid summaries and on the metadata, which the pass computes anyway."""
    rows, known = Observation(), Observation()
    latest = metadata_latest(meta).observe(known, F.count(F.lit(1)).alias("n_metadata")) if meta is not None else None
    has = F.col("_text").isNotNull() & F.col("qid").isNotNull()
    valid = F.col("n_plain") + F.when(has, F.col("n_recok")).otherwise(0)
    counters = {"n_raw": F.col("n_rows"), "n_recovered": F.when(has, F.col("n_needs")).otherwise(0), "n_kept": (valid > 0).cast("int"), "_valid": valid}
    counted = _with_recovery(_per_qid(raw, full_rows=True), latest).observe(rows, *[F.sum(v).alias(k) for k, v in counters.items()])

    def audit() -> dict[str, int]:
        c = {k: v or 0 for k, v in rows.get.items()}
        kept, fit = c["n_kept"], c.pop("_valid")
        return {**c, "n_dropped": c["n_raw"] - kept, "n_invalid": c["n_raw"] - fit, "n_duplicate": fit - kept,
                "n_metadata": known.get["n_metadata"] if latest is not None else 0}

    return _first_valid(counted, raw), audit


def canonical_examples_from_latest(raw: DataFrame, latest: DataFrame | None) -> DataFrame:
    """:func:`canonical_examples` with an already reduced metadata table
    (:func:`metadata_latest`), e.g. a static side of a streaming job."""
    return _first_valid(_with_recovery(_per_qid(raw, full_rows=True), latest), raw)


def _first_valid(q: DataFrame, raw: DataFrame) -> DataFrame:
    """The cleaned winner of each per-qid summary that has one."""
    has = F.col("_text").isNotNull()
    use_rec = has & F.col("c_rec").isNotNull() & (
        F.col("c_plain").isNull() | (F.col("c_rec.pos") < F.col("c_plain.pos")))
    win = q.select(F.when(use_rec, F.col("c_rec")).otherwise(F.col("c_plain")).alias("w"),
                   F.when(use_rec, F.col("_text")).alias("_text")).filter(F.col("w").isNotNull())
    return cleaned(win, set(raw.columns))


def valid_rows(raw: DataFrame, latest: DataFrame | None) -> DataFrame:
    """Row by row, for streams: the raw columns of each valid row, and ``_text``,
    the recovered thinking, where it takes the row's place."""
    f = _with_recovery(row_flags(raw), latest)
    recovers = F.col("_rec") & F.col("_text").isNotNull()
    return f.filter(F.col("_other") & (F.col("_plain") | recovers)).select(*raw.columns, F.when(recovers, F.col("_text")).alias("_text"))


def cleaned(win: DataFrame, cols: set[str]) -> DataFrame:
    """PRJ1-3 on (w, _text): a valid raw row with columns ``cols``, and the
    recovered thinking or null."""
    w = lambda c: F.col(f"w.{c}")
    empty = F.array().cast("array<string>")
    out = win.select(
        w("pos").alias("pos"), w("qid").alias("qid"),
        (F.coalesce(w("dataset"), F.lit("unknown")) if "dataset" in cols else F.lit("unknown"))
        .alias("dataset"),
        py_strip(w("prompt")).alias("prompt"),
        F.coalesce(F.col("_text"), py_strip(w("thinking"))).alias("thinking"),
        canonical_answer_of("w.answer").alias("answer"),
        (F.coalesce(w("ranked_table_ids").cast("array<string>"), empty)
         if "ranked_table_ids" in cols else empty).alias("ranked_table_ids"),
        (F.coalesce(w("candidate_ids").cast("array<string>"), empty)
         if "candidate_ids" in cols else empty).alias("candidate_ids"))
    return out


def row_outcomes(raw: DataFrame, meta: DataFrame | None) -> DataFrame:
    """FLT5 per row: ``outcome`` in (kept, duplicate, invalid) plus
    ``recovered``. The per-qid winner comes from the skew-safe aggregate and
    is joined back by qid (AQE splits a hot qid on the raw side)."""
    latest = metadata_latest(meta) if meta is not None else None
    q = _with_recovery(_per_qid(raw, full_rows=False), latest)
    has = F.col("_text").isNotNull()
    use_rec = has & F.col("p_rec").isNotNull() & (
        F.col("p_plain").isNull() | (F.col("p_rec") < F.col("p_plain")))
    winners = q.select("qid", F.when(use_rec, F.col("p_rec")).otherwise(F.col("p_plain"))
                       .alias("_win"), has.alias("_has"))
    f = row_flags(raw).join(winners, "qid", "left")
    recovered = F.col("_rec") & F.coalesce(F.col("_has"), F.lit(False))
    valid = F.col("_other") & (F.col("_plain") | recovered)
    outcome = (F.when(~valid, "invalid").when(F.col("pos") == F.col("_win"), "kept")
               .otherwise("duplicate"))
    return f.select("pos", "qid", recovered.alias("recovered"), outcome.alias("outcome"))
