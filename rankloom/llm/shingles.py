"""64-bit hashes of words and of runs of words, for many texts at once."""

from __future__ import annotations

import numpy as np

from rankloom.llm.common import kept_between_tasks, mix, word_spans

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20


def _tables():
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return table, np.cumprod(np.full(_BLOCK, _BASE, np.uint64)), np.cumprod(np.full(_BLOCK, pow(_BASE, -1, 1 << 64), np.uint64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each span of the bytes, mixed. Spans are ascending;
    one that is longer than a block is hashed by blocks."""
    table, power, inverse = kept_between_tasks("powers", _tables)
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = int(np.searchsorted(end, lo + _BLOCK, "right"))
        if j <= i:
            h = np.uint64(0)
            for k in range(lo, int(end[i]), _BLOCK):
                part = data[k:min(k + _BLOCK, int(end[i]))]
                h = mix(np.array([h + (table[part] * power[:len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
            out[i] = h
            i += 1
            continue
        part = data[lo:int(end[j - 1])]
        done = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[part] * power[:len(part)], dtype=np.uint64)))
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((done[e] - done[s]) * inverse[np.maximum(s, 1) - 1] * np.where(s > 0, np.uint64(1), np.uint64(_BASE))
                       + (e - s).astype(np.uint64))
        i = j
    return out


def windows(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of k words (a text of fewer words: of all its
    words), each hash's text, and the number of words of each text."""
    start, end, text = word_spans(data, off)
    words = span_hashes(data, start, end)
    n = np.bincount(text, minlength=len(off) - 1)
    at = np.flatnonzero(text[:-k + 1] == text[k - 1:]) if len(text) >= k else np.zeros(0, np.int64)
    h = np.full(len(at), k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[at + i])
    few = np.flatnonzero((n > 0) & (n < k))
    first = np.searchsorted(text, few)
    whole = np.array([_fold(words[f:f + c]) for f, c in zip(first, n[few])], np.uint64)
    return np.concatenate((h, whole)), np.concatenate((text[at], few)), n


def _fold(words: np.ndarray) -> np.uint64:
    h = np.full(1, len(words), np.uint64)
    for w in words:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h[0]


def sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of window hashes, sorted."""
    h, text, _ = windows(data, off, k)
    order = np.argsort(text, kind="stable")
    h = h[order]
    to = np.cumsum(np.bincount(text, minlength=len(off) - 1))
    return [np.unique(x) for x in np.split(h, to[:-1])] if len(to) else []
