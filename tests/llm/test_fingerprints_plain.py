"""Lempel-Ziv fingerprints and both likenesses against a plain parse."""

import hashlib
import random

import numpy as np

from rankloom.llm import lz
from rankloom.llm.common import mix
from rankloom.llm.shingles import span_hashes


def plain_units(raw):
    out, start, natural = [], 0, 0
    for p in range(1, len(raw)):
        cut = raw[p - 1] in b" \t\n\x0b\x0c\r" or raw[p] >= 0xE0
        if cut or (p - natural >= 32 and raw[p] & 0xC0 != 0x80):
            out.append(raw[start:p])
            start = p
        if cut:
            natural = p
    return [*out, raw[start:]] if raw else []


def plain_phrases(text):
    known, phrase, out = set(), [], set()
    for u in plain_units(text.encode("utf-8", "surrogatepass")):
        phrase.append(u)
        if tuple(phrase) not in known:
            known.add(tuple(phrase))
            out.add(b"".join(phrase))
            phrase = []
    return out | ({b"".join(phrase)} if phrase else set())


def plain_signature(text):
    hashes = [int(span_hashes(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0]) >> 32 for p in plain_phrases(text)]
    out = []
    for a, b in zip(lz._A.tolist(), lz._B.tolist()):
        least = min(((h * a + b) % (1 << 32) for h in hashes), default=None)
        out.append(0xFFFF if least in (None, 0xFFFFFFFF) else int(mix(np.array([least], np.uint64))[0]) >> 48)
    return out


def likeness(a, b):
    return sum(x == y for x, y in zip(a, b)) / lz.HASHES


def test_units_and_phrases():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\té日本語🙂x") * rng.choice([1, 1, 1, 40]) for _ in range(rng.randint(0, 30)))
        raw = text.encode()
        assert lz.units(raw)[0] == plain_units(raw)


def test_fingerprints_and_likenesses(spark):
    rng = random.Random(5)
    words = ["tree", "river", "日本", "über", "stone", "\n", "of", "x" * 70]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    rows = [(i if i % 11 else 7, t, i) for i, t in enumerate(texts)] + [(None, texts[3], 0), (None, None, 0), (60, "", 0), (61, texts[5], 0), (62, texts[5], 0), (62, texts[5], 0)]
    chain = sorted(((1 << 63) - 1 if d is None else d, t or "") for d, t, _ in rows)
    chain.sort(key=lambda r: -r[0])     # stable: ties stay in order of the text
    want = []
    for (d, t), (_, following) in zip(chain, chain[1:] + chain[:1]):
        half = len(t) // 2
        new = t[:len(t) - half] + following[:half]
        a, b, c = plain_signature(t), plain_signature(new), plain_signature(following)
        want.append((None if d == (1 << 63) - 1 else d, len(t), hashlib.sha256(new.encode()).hexdigest(), "".join(f"{x:04x}" for x in a),
                     "".join(f"{x:04x}" for x in b), likeness(a, b), likeness(a, c)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long").repartition(4)
    for size in (lz.RANGE_BYTES, 900):      # one range of ids, and many
        got = [tuple(r) for r in lz.digest(docs, size).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
