"""The five stages of the pipeline, each against a plain version of it on the same
input: what is kept, the texts, and the packed pieces."""

import collections
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from rankloom.llm import packing, pii, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    """(rows before, rows after) of each stage: {doc_id: text}, the last one's rows as they are."""
    from rankloom.llm.common import stored, table
    docs, out = table(spark, SF, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert last or docs.columns == columns
        rows = docs.collect()
        out[name] = before, rows if last else {r["doc_id"]: r["text"] for r in rows}
        assert last or len(rows) == len(out[name][1])
    return out


def test_quality_rules(stages):
    before, after = stages["quality_rules"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(before.items()))
    kept = {r[0] for r in con.execute(f"select doc_id from ({queries.ORACLES['op2_quality_cascade']}) where kept").fetchall()}
    assert after == {d: t for d, t in before.items() if d in kept} and 0 < len(after) < len(before)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    sets = {}
    for d, t in before.items():
        w = WORD.findall((t or "").translate(LOW))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in sets}

    def top(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    assert after == {d: t for d, t in before.items() if top(d) == d} and len(after) < len(before)


def test_repeated_passages(stages):
    before, after = stages["repeated_passages"]
    texts = {d: (t or "").encode() for d, t in before.items()}
    first = {}
    for d in sorted(texts):
        t = texts[d]
        for p in range(len(t) - 49):
            first.setdefault(t[p:p + 50], d)
    want, cut = {}, 0
    for d, t in texts.items():
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p:p + 50]] < d:
                gone[p:p + 50] = True
        want[d] = bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore") if t else before[d]
        cut += gone.sum()
    assert after == want and cut > 0


def test_personal_data(stages):
    """Spans come from the operator, whose base kinds other tests hold against plain patterns."""
    before, after = stages["personal_data"]
    assert after == {d: t if t is None else pii.redacted(t) for d, t in before.items()} and after != before
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(email.search(t or "") for t in after.values()) and any(email.search(t or "") for t in before.values())


def test_packed_sequences(stages):
    from tokenizers import Tokenizer

    from rankloom.llm.tokens import vocabulary
    before, rows = stages["packed_sequences"]
    encode, size = Tokenizer.from_file(vocabulary()), packing.SEQUENCE
    want = []
    for d, t in before.items():
        ids = encode.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), size)):
            own = ids[at:at + size]
            want.append((d, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= size
    assert len(by) <= packing.lower_bound(np.array([r["length"] for r in rows]), size) + 1
