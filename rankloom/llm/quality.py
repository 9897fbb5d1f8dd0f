"""Operator 2: quality rules as a short-circuit cascade.

Every rule is judged on a bounded sample: the share it rejects and the CPU time
it takes, the columns it needs included. The cascade runs rules by rejections
per second, and each rule sees only the texts that those before it let pass. A
text is kept if all rules pass, so the order changes the time and never the
verdict. Columns that a caller asks for are computed for every text.

Words are runs of anything but ASCII blanks. A null or empty text has no words,
all counts 0, and fails. Repeated rows are judged alike; null ids and other
columns are carried along; an empty table gives no rows. Long texts are read
whole, a batch at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import configure, id_text, lean_batches, mix, out_id, raw, small_batches, word_codes, word_spans

SAMPLE = 2000
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def repeated_windows(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words lie in a window of WINDOW words that its text has twice or
    more. Windows meet by hash and are then compared word by word."""
    n = len(codes)
    hit = np.zeros(n, bool)
    if n <= WINDOW:
        return hit
    at = np.flatnonzero(text[:-WINDOW + 1] == text[WINDOW - 1:])
    h = text[at].astype(np.uint64)
    for k in range(WINDOW):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    many = ~new
    many[:-1] |= ~new[1:]
    at = at[many]
    if not len(at):
        return hit
    rows = np.stack([text[at], *(codes[at + k] for k in range(WINDOW))], axis=1)
    _, same, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    at = at[count[same.ravel()] > 1]
    for k in range(WINDOW):
        hit[at + k] = True
    return hit


class Batch:
    """Columns of a batch of texts, each computed when first asked for."""

    def __init__(self, texts: pa.Array):
        self.texts, self.n = texts, len(texts)
        self._known: dict[str, np.ndarray] = {}

    def take(self, keep: np.ndarray) -> Batch:
        out = Batch(self.texts.filter(pa.array(keep)))
        out._known = {k: v[keep] for k, v in self._known.items() if not k.startswith("_")}
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, name)()
        return self._known[name]

    def _words(self):
        data, off = raw(self.texts)
        return (data, off, *word_spans(data, off))

    def per_text(self, where: np.ndarray, weights=None) -> np.ndarray:
        return np.bincount(where, weights, self.n).astype(np.int64)

    def of_class(self, table: np.ndarray) -> np.ndarray:
        data, off = self["_words"][:2]
        done = np.concatenate(([0], np.cumsum(table[data])))
        return done[off[1:]] - done[off[:-1]]

    def n_words(self):
        return self.per_text(self["_words"][4])

    def word_chars(self):
        data, off = self["_words"][:2]
        table = np.ones(256, bool)
        table[[32, *range(9, 14)]] = False
        table[128:192] = False  # continuation bytes
        return self.of_class(table)

    def n_symbols(self):
        return self.of_class(_SYMBOL)

    def n_letters(self):
        table = _LETTER.copy()
        table[128:192] = False
        return self.of_class(table)

    def n_digits(self):
        return self.of_class(_DIGIT)

    def n_lines(self):
        return self["_lines"][0]

    def n_dup_lines(self):
        return self["_lines"][1]

    def _lines(self):
        lines = pc.split_pattern(self.texts, "\n")
        where = pc.list_parent_indices(lines).to_numpy()
        flat = pc.list_flatten(lines)
        full = pc.match_substring_regex(flat, "[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
        where = where[full].astype(np.int64)
        code = flat.filter(pa.array(full)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = where * max(1, len(code)) + code
        seen = np.unique(key)
        n = self.per_text(where)
        return n, n - self.per_text(seen // max(1, len(code)))

    def n_repeat_words(self):
        data, off, start, end, text = self["_words"]
        codes, _ = word_codes(data, start, end)
        return self.per_text(text[repeated_windows(codes, text)])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails``: a mask of the batch's texts that the rule rejects."""
    name: str
    fails: Callable[[Batch], np.ndarray]


RULES = (
    Rule("few_words", lambda b: b["n_words"] < 10),
    Rule("repeated_windows", lambda b: 100 * b["n_repeat_words"] > 20 * b["n_words"]),
    Rule("word_length", lambda b: (b["word_chars"] > 15 * b["n_words"]) | (b["word_chars"] < 2 * b["n_words"])),
    Rule("symbols", lambda b: 5 * b["n_symbols"] > b["n_words"]),
    Rule("repeated_lines", lambda b: 2 * b["n_dup_lines"] > b["n_lines"]),
    Rule("few_letters", lambda b: 10 * b["n_letters"] < 5 * b["word_chars"]),
)


def plan(texts: pa.Array, rules=RULES) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds a text) on a sample, best first."""
    found = []
    for rule in rules:
        took = []
        for _ in range(2):
            began = time.process_time()
            fails = rule.fails(Batch(texts))
            took.append(time.process_time() - began)
        cost = max(min(took), 1e-6) / max(1, len(texts))
        found.append((rule, float(fails.mean()) if len(fails) else 0.0, cost))
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(batch: Batch, rules: list[Rule]) -> np.ndarray:
    """Indexes of the texts that all rules let pass; a rule sees what is left."""
    alive = np.arange(batch.n)
    for rule in rules:
        if not len(alive):
            break
        ok = ~rule.fails(batch)
        if not ok.all():
            alive, batch = alive[ok], batch.take(ok)
    return alive


def sample_plan(docs: DataFrame, rules=RULES, sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """The plan from at most ``sample`` texts: timing needs no more, and it
    decides the order only."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).take(sample)
    return plan(pa.array([r["text"] for r in rows], pa.large_string()), rules)


def judge(docs: DataFrame, rules=RULES, columns=BASE, sample: int = SAMPLE) -> DataFrame:
    """id, the asked columns (for every text) and kept."""
    configure(docs.sparkSession)
    docs = id_text(docs)
    order = [r for r, _, _ in sample_plan(docs, rules, sample)]

    def run(batches):
        for b in small_batches(batches, "text", 1 << 19):
            batch = Batch(b.column("text").cast(pa.large_string()))
            cols = [pa.array(batch[c], pa.int64()) for c in columns]
            kept = np.zeros(b.num_rows, bool)
            kept[cascade(batch, order)] = True
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols, pa.array(kept)], names=["id", *columns, "kept"])

    return docs.mapInArrow(lean_batches(run), "id long, " + "".join(f"{c} long, " for c in columns) + "kept boolean")


def keep(docs: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """The rows, with all their columns, whose text all rules let pass."""
    configure(docs.sparkSession)
    order = [r for r, _, _ in sample_plan(docs, rules, sample)]

    def run(batches):
        for b in small_batches(batches, "text", 1 << 19):
            texts = b.column("text").cast(pa.large_string()).fill_null("")
            yield b.take(pa.array(cascade(Batch(texts), order)))

    return docs.mapInArrow(lean_batches(run), docs.schema)


def digest(judged: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(out_id(), *BASE, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))
