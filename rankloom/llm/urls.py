"""Operator 4: URL rules by Bloom filter cascades.

A cascade holds the listed keys of a side exactly over all keys that the corpus
can ask for: level 0 encodes the listed keys, level 1 the corpus keys that level
0 lets through wrongly, level 2 the listed keys that level 1 lets through, and
so on until no key is wrong. A lookup walks the levels until one says no; its
parity is the answer. The keys of a URL are its host and parent domains, each
with the path cut to the lengths that listed paths have; the longest listed one
decides. Nothing is joined: the levels travel with the tasks. The first level's
error rate is the share of listed keys over sqrt(2), so later levels hold about
as many keys as the list, and all levels together stay in proportion to it.

Null URLs and those without ``://`` have an empty host and path and fit no rule.
Repeated rows and null ids stay; an empty table gives no rows; a URL with very
many labels has a key for each. Unlisted URLs get ``default``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import UPPER, configure, mix, stored

#: (verdict, host, path); fixed values of the query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_path(url):
    """(host, path) columns of a URL column."""
    rule = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, rule, 1), UPPER, UPPER.lower()), F.regexp_extract(url, rule, 2)


def keys_of(host: str, path: str, lengths: tuple[int, ...]):
    """(host, cut path) candidates, longest text first, longer host first."""
    if not host:
        return []
    hosts, at = [host], host.find(".")
    while at >= 0:
        hosts.append(host[at + 1:])
        at = host.find(".", at + 1)
    out = [(h, path[:n]) for h in hosts for n in lengths if n <= len(path)]
    return sorted(out, key=lambda k: (-len(k[0]) - len(k[1]), -len(k[0])))


class Bloom:
    """k bits of m for each 128-bit key, one of a level's own."""

    def __init__(self, level: int, n: int, rate: float):
        self.level = level
        self.k = max(1, round(-math.log2(rate)))
        self.m = max(64, 64 * math.ceil(max(1, n) * -math.log(rate) / math.log(2) ** 2 / 64))
        self.words = np.zeros(self.m // 64, np.uint64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        a = mix(keys[:, 0] ^ np.uint64(0x632BE59BD9B4E019 * (self.level + 1) & (1 << 64) - 1))
        b = mix(keys[:, 1] + a) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(self.k, dtype=np.uint64)) % np.uint64(self.m)

    def add(self, keys: np.ndarray) -> None:
        at = self.places(keys).ravel()
        np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys)
        bits = self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))
        return (bits & np.uint64(1)).all(axis=1)


def hashed(keys: list[str]) -> np.ndarray:
    raw = b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys)
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


def passes(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Which keys all of these levels let through."""
    ok = np.ones(len(keys), bool)
    for b in levels:
        ok[ok] = b.has(keys[ok])
    return ok


def member(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Exact for every key of the universe that the cascade was built on."""
    answer = np.zeros(len(keys), bool)
    left = np.arange(len(keys))
    for i, b in enumerate(levels):
        ok = b.has(keys[left])
        answer[left[~ok]] = i % 2 == 1
        left = left[ok]
    answer[left] = len(levels) % 2 == 1
    return answer


def candidate_keys(urls: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The universe: distinct (a, b) halves of all keys' hashes, over (host, path)."""
    def run(batches):
        for b in batches:
            pairs = zip(b.column("host").to_pylist(), b.column("path").to_pylist())
            keys = hashed(sorted({h + p for host, path in pairs for h, p in keys_of(host, path, lengths)}))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64))],
                                             names=["a", "b"])

    return urls.select("host", "path").mapInArrow(run, "a long, b long").distinct()


def build_cascade(universe: DataFrame, listed: list[str], size: int) -> list[Bloom]:
    """Levels for ``listed`` over ``universe`` of about ``size`` keys. Wrong keys
    are found and gathered as bits on the executors; a level's words, in
    proportion to the list, are what the driver gets."""
    own = hashed(sorted(set(listed)))
    if not len(own):
        return []
    inside = np.unique(own.copy().view("V16").ravel())
    levels = [Bloom(0, len(own), min(0.5, len(own) * math.sqrt(0.5) / max(1, size)))]
    levels[0].add(own)
    while True:
        def wrong(batches, levels=tuple(levels)):
            for b in batches:
                keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in "ab"], axis=1)
                keys = np.ascontiguousarray(keys[passes(levels, keys)])
                keys = keys[~np.isin(keys.view("V16").ravel(), inside)] if len(keys) else keys
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i in (0, 1)],
                                                 names=["a", "b"])

        found = universe.mapInArrow(wrong, "a long, b long")
        n = found.count()
        if not n:
            return levels
        nxt = Bloom(len(levels), n, 0.5)

        def bits(batches, nxt=nxt):
            for b in batches:
                keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in "ab"], axis=1)
                at = np.unique(nxt.places(keys).ravel())
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                                  pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))],
                                                 names=["word", "bits"])

        for r in found.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
            nxt.words[r["word"]] |= np.uint64(r["bits"] & (1 << 64) - 1)
        levels.append(nxt)
        own = own[passes(levels, own)]
        if not len(own):
            return levels
        levels.append(Bloom(len(levels), len(own), 0.5))
        levels[-1].add(own)


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """pages' page_id with host, path, rule (the longest that fits, else null)
    and verdict."""
    configure(pages.sparkSession)
    host, path = host_path(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    lengths = tuple(sorted({len(p) for _, _, p in rules}))
    universe = stored(candidate_keys(urls, lengths), "universe")     # read by every level of both sides
    size = universe.count()
    sides = {v: build_cascade(universe, [h + p for w, h, p in rules if w == v], size) for v in ("allow", "block")}
    kind = next((f.dataType for f in pages.schema.fields if f.name == "page_id"))

    def run(batches):
        for b in batches:
            keys = [keys_of(h, p, lengths) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            flat = [h + p for own in keys for h, p in own]
            hs = hashed(flat) if flat else np.zeros((0, 2), np.uint64)
            known = {v: member(c, hs) if c else np.zeros(len(flat), bool) for v, c in sides.items()}
            rule, verdict, at = [], [], 0
            for own in keys:
                hit = next((j for j in range(at, at + len(own)) if known["allow"][j] or known["block"][j]), None)
                rule.append(None if hit is None else flat[hit])
                verdict.append(default if hit is None else "block" if known["block"][hit] else "allow")
                at += len(own)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"),
                                              pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, f"page_id {kind.simpleString()}, host string, path string, rule string, verdict string")
