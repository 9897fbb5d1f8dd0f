"""Curation edge cases (FIXTURES.md 2.4) and invariants."""

from pyspark.sql import functions as F

from rankloom.operators import curation

RAW = "pos long, qid string, dataset string, prompt string, thinking string, answer string"
META = "qid string, split string, reasoning_text string, total_thinking string"
A = '{"ranked_tables": [1, 2]}'


def _run(spark, raw, meta):
    r = spark.createDataFrame(raw, RAW)
    m = spark.createDataFrame(meta, META)
    canon = {x.qid: x for x in curation.canonical_examples(r, m).collect()}
    out = {x.pos: x for x in curation.row_outcomes(r, m).collect()}
    audit = curation.curation_audit(r, m).collect()[0]
    return canon, out, audit


def test_edge_cases(spark):
    raw = [
        (0, "q0", "d", "p", " \n", A),                            # recovered, kept
        (1, "q1", "d", "p", None, A),                             # null thinking: dropped
        (2, "q2", "d", "p", "t", '{"ranked_tables": [1,2]} and {"x": 2}'),  # trailing garbage
        (3, "q3", "d", "p", "t", '{"ranked_tables": []}'),        # empty list
        (4, "q4", "d", "p", "t", "no json"),                      # first row invalid
        (5, "q4", None, " p ", " t ", "\n" + A),                  # second row kept
        (6, "q0", "d", "p", "", A),                               # recovered duplicate
        (7, "q7", "d", "p", "", A),                               # blank test record overrides
        (8, "q8", "d", "p", "t", '{"ranked_tables": [1], "note": "ü"}'),
    ]
    meta = [("q0", "train", "", " why "), ("q1", "dev", "why", None),
            ("q7", "train", "text", None), ("q7", "test", "", "")]
    canon, out, audit = _run(spark, raw, meta)
    assert canon["q0"].thinking == "why" and out[0].outcome == "kept" and out[0].recovered
    assert out[1].outcome == "invalid"
    assert out[2].outcome == "invalid" and out[3].outcome == "invalid"
    assert out[4].outcome == "invalid" and out[5].outcome == "kept"
    assert canon["q4"].prompt == "p" and canon["q4"].thinking == "t" and canon["q4"].dataset == "unknown"
    assert canon["q4"].answer == '{"ranked_tables": [1, 2]}'
    assert out[6].outcome == "duplicate" and out[6].recovered
    assert out[7].outcome == "invalid" and not out[7].recovered
    assert canon["q8"].answer == '{"ranked_tables": [1], "note": "\\u00fc"}'
    assert audit.n_raw == 9 and audit.n_kept == 3 and audit.n_recovered == 2
    assert audit.n_kept + audit.n_dropped == audit.n_raw
    assert audit.n_invalid + audit.n_duplicate == audit.n_dropped
    assert audit.n_metadata == 3


def test_no_metadata_means_no_recovery(spark):
    r = spark.createDataFrame([(0, "q", "d", "p", " ", A)], RAW)
    assert curation.canonical_examples(r, None).count() == 0
    assert curation.curation_audit(r, None).collect()[0].n_recovered == 0


def test_hot_qid_is_deduplicated_without_loss(spark):
    rows = [(i, "hot" if i % 3 else f"q{i}", "d", "p", f"t{i}", A) for i in range(3000)]
    r = spark.createDataFrame(rows, RAW).repartition(8)
    canon = curation.canonical_examples(r, None)
    hot = canon.filter(F.col("qid") == "hot").collect()
    assert len(hot) == 1 and hot[0].pos == 1
    assert canon.count() == 1 + 1000
