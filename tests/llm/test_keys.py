"""The exchange of keys between shards, over several levels."""

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import jaccard, keys, suffix_dedup
from rankloom.llm.common import id_text


def test_bucket_of():
    rng = np.random.default_rng(1)
    some = np.concatenate((rng.integers(0, 1 << keys.BITS, 5000), [0, (1 << keys.BITS) - 1])).astype(np.uint64)
    for buckets in (1, 2, 3, 255, 1 << 16, (1 << 32) - 5):
        assert keys.bucket_of(some, buckets).tolist() == [int(k) * buckets >> keys.BITS for k in some.tolist()]


@pytest.mark.parametrize("shards", [1, 2, 3, 5, 9, 23])
def test_levels(spark, monkeypatch, shards):
    monkeypatch.setattr(keys, "FAN", 2)
    rng = np.random.default_rng(shards)
    own = [np.unique(rng.integers(0, 60, rng.integers(0, 40)) << (keys.BITS - 6)).astype(np.uint64) for _ in range(shards)]
    counts = [rng.integers(1, 3, len(k)) for k in own]
    handed = [keys.handed_in(s, k, c, keys.first_cut(shards)) for s, (k, c) in enumerate(zip(own, counts))]
    rows = [r for t in handed for r in t.to_pylist()]
    assert len(rows) <= 2 * shards
    table = spark.createDataFrame([(r["bucket"], r["shard"], r["keys"], r["counts"]) for r in rows], keys._HANDED)
    back = keys.shared(table, shards).toArrow()
    total = {}
    for k, c in zip(own, counts):
        for a, b in zip(k.tolist(), c.tolist()):
            total[a] = total.get(a, 0) + b
    for s, k in enumerate(own):
        got, n = keys.returned(back.filter(pa.compute.equal(back.column("shard"), s)))
        want = [a for a in k.tolist() if total[a] >= 2]
        assert got.tolist() == want and n.tolist() == [total[a] for a in want]


def test_operators_over_levels(spark, monkeypatch):
    """Many small shards, merged three at a time, give what one shard gives."""
    words = [f"word{i % 37}x{i * i % 53}" for i in range(400)]
    texts = [" ".join(words[i % 7 * 20:i % 7 * 20 + 30 + i % 3]) + f" own {i} tail" for i in range(60)] + [None, "", "few words"]
    docs = id_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))

    def both():
        runs = suffix_dedup.removed_runs(spark, docs, size).select("id", "copy", "begins", "ends").collect()
        return sorted(map(str, runs)), sorted(map(str, jaccard.join(spark, docs, size).collect()))

    size = 1 << 20
    whole = both()
    monkeypatch.setattr(keys, "FAN", 3)
    size = 1200
    assert both() == whole
