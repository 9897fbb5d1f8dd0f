"""Operator 3: Lempel-Ziv phrase fingerprints.

Each text is parsed into dictionary phrases (a phrase is the longest one known
yet and one unit more; units are words with one of the blanks 0x09-0x0D and 0x20,
or single characters of scripts without blanks and past the first bytes of a very
long word), the set of phrase hashes is reduced to
64 minimum hashes of 16 bits, and the share of equal ones estimates how many
phrases two texts have in common, as a compressor that has read one finds in the
other. Phrases that end before an
edit are parsed and hashed once.

The edited text and the next document come from neighbours in descending id:
documents are dealt by id ranges whose ends are existing ids, and the row at an
end also travels to the range that follows it, so no window or join moves the
texts again.

Null texts count as empty: no phrases, and two empty texts are alike (1.0).
Rows with equal ids are neighbours by text; null ids come first in descending
order. A single row is its own next. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import NO_ID, configure, id_text, mix, out_id, pieces, text_bytes
from rankloom.llm.shingles import span_hashes

HASHES, RANGE_BYTES = 64, 8 << 20
#: Bytes of a word that make one unit at most.
LONG = 32
_A = mix(np.arange(1, HASHES + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)).astype(np.uint32)


def units(raw: bytes) -> tuple[list[bytes], np.ndarray]:
    """What phrases are made of, and where the first n of them end: words with the blank that
    follows them, and each character of three bytes or more (scripts without
    blanks) on its own, as each one beyond a word's first LONG bytes. Where a unit
    ends depends on nothing past the next byte."""
    x = np.frombuffer(raw, np.uint8)
    if not len(x):
        return [], np.zeros(1, np.int64)
    cut = (x[:-1] == 32) | ((x[:-1] >= 9) & (x[:-1] <= 13)) | (x[1:] >= 0xE0)
    place = np.arange(1, len(x))
    since = place - np.maximum.accumulate(np.append(0, np.where(cut, place, 0))[:-1]) if len(x) > 1 else place
    ends = np.append(np.flatnonzero(cut | ((since >= LONG) & (x[1:] & 0xC0 != 0x80))) + 1, len(x))
    to = ends.tolist()
    return [raw[i:j] for i, j in zip([0, *to[:-1]], to)], np.append(0, ends)


def phrases(parts: list[bytes], root: dict, added: list) -> list[int]:
    """Parse: each phrase is the longest known one and one unit more. Gives how
    many units were read at each phrase's end; what the trie gained is noted, in
    the same order."""
    node, ends = root, []
    for i, u in enumerate(parts, 1):
        known = node.get(u)
        if known is None:
            node[u] = {}
            added.append((node, u))
            ends.append(i)
            node = root
        else:
            node = known
    if node is not root:
        ends.append(len(parts))
    return ends


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minimum hashes (32 bits) of the segments of phrase hashes beginning at
    ``first``; a segment without phrases keeps the largest value."""
    out = np.full((len(first), HASHES), np.uint32(0xFFFFFFFF))
    end = np.append(first[1:], len(hashes))
    full = np.flatnonzero(end > first)
    if len(full):
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(h * _A[k] + _B[k], first[full])
    return out


def short(signature: np.ndarray) -> np.ndarray:
    """16 bits of each minimum (mixed: the minimum of many hashes is small)."""
    empty = signature == 0xFFFFFFFF
    return np.where(empty, np.uint16(0xFFFF), (mix(signature.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16))


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(texts: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the texts, and of each text's edited form, which begins alike."""
    data, spans_at, spans_to, first = [], [], [], []
    base = count = 0

    def take(raw: bytes, ends: np.ndarray) -> None:
        nonlocal base, count
        first.append(count)
        at = np.concatenate((np.zeros(1, np.int64), ends)) + base
        spans_at.append(at[:-1])
        spans_to.append(at[1:])
        data.append(raw)
        base += len(raw)
        count += len(ends)

    for text, other in zip(texts, others):
        raw, new = text.encode("utf-8", "surrogatepass"), other.encode("utf-8", "surrogatepass")
        keep = len(text[:len(text) - len(text) // 2].encode("utf-8", "surrogatepass"))
        root, added = {}, []
        parts, to = units(raw)
        ends = to[phrases(parts, root, added)]
        same = int(np.searchsorted(ends, keep))  # those that end before the edit
        at = int(ends[same - 1]) if same else 0
        for node, u in reversed(added[same:]):
            del node[u]
        take(raw[:at], ends[:same])
        take(raw[at:], ends[same:] - at)
        parts, to = units(new)
        done = int(np.searchsorted(to, at))
        take(new[at:], to[done:][phrases(parts[done:], root, [])] - at)
    if not first:
        return np.zeros((0, HASHES), np.uint16), np.zeros((0, HASHES), np.uint16)
    whole = np.frombuffer(b"".join(data), np.uint8)
    sig = signatures(span_hashes(whole, np.concatenate(spans_at), np.concatenate(spans_to)), np.array(first))
    return short(np.minimum(sig[0::3], sig[1::3])), short(np.minimum(sig[0::3], sig[2::3]))


def _hex(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def neighbours(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, np.ndarray]:
    """(part, extra, id, text): rows by id range; extra marks the row that follows
    the range's smallest id. The range ends (one id for each) reach the driver."""
    n = pieces(text_bytes(docs), range_bytes)
    guess = docs.select("id").filter(F.col("id") != NO_ID).stat.approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else []
    guess = np.unique(np.array(guess, np.float64).astype(np.int64))

    def largest(batches):
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(guess, ids), pa.int64()), b.column("id")], names=["part", "id"])

    found = docs.select("id").mapInArrow(largest, "part long, id long").groupBy("part").agg(F.max("id").alias("id")).collect()
    ends = np.unique(np.array([r["id"] for r in found] or [0], np.int64))

    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            part = np.searchsorted(ends, ids)
            at = np.flatnonzero(ends[part] == ids)
            for extra, rows, own in ((False, b, part), (True, b.take(pa.array(at)), (part[at] + 1) % len(ends))):
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([extra] * rows.num_rows, pa.bool_()), *rows.columns],
                                                 names=["part", "extra", "id", "text"])

    return docs.select("id", "text").mapInArrow(run, "part long, extra boolean, id long, text string"), ends


def _range(t: pa.Table) -> pa.Table:
    rows = sorted(zip(t.column("extra").to_pylist(), t.column("id").to_pylist(), t.column("text").to_pylist()),
                  key=lambda r: (r[0], -r[1], r[2]))
    own = [r for r in rows if not r[0]]
    after = next((r for r in rows if r[0]), None)
    chain = [r[2] for r in own] + ([after[2]] if after else [])
    texts = chain[:len(own)]
    others = [edited(x, y) for x, y in zip(chain, chain[1:])]
    sig, new = fingerprints(chain, [*others, ""])
    out = [([r[1] for r in own], pa.int64()), ([len(x) for x in texts], pa.int64()),
           ([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in others], pa.string()),
           ([_hex(x) for x in sig[:len(own)]], pa.string()), ([_hex(x) for x in new[:len(own)]], pa.string()),
           ((sig[:len(own)] == new[:len(own)]).mean(axis=1), pa.float64()), ((sig[:len(own)] == sig[1:]).mean(axis=1), pa.float64())]
    return pa.table([pa.array(c, k) for c, k in out],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def digest(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    configure(docs.sparkSession)
    rows, _ = neighbours(id_text(docs), range_bytes)
    out = rows.groupBy("part").applyInArrow(
        _range, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(out_id(), *out.columns[1:])
