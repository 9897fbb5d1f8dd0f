"""One JSON document, read by many tasks, strictly.

A JSON array or object of records is one value, so a plain reader gives the whole
file to one task. Here Spark's text source reads it with ``}`` as the line end: every
record ends in one, so rows are records or parts of them and a file falls into blocks
that any file system serves, at any offset. What a block means depends on what comes
before it: whether it begins within a string, and how deep. Both compose:

1. each block reports, for either case at its begin, where it ends (in a string or
   not, deeper or higher by how much) and how many commas it has at each relative
   depth: one small row a block;
2. the driver folds these rows in order: the true state at each block's begin, and
   how many elements come before it;
3. each block then cuts its elements out, numbered. An element that runs over a
   block's end comes in parts, of which there are two a block at most, and is put
   together by its number. The text of all others is not shuffled.

A folder of ``part-*`` files is one document, too: what its files hold one after
another, by the number in their names. Blocks are numbered by file and offset.

The document has to be one whole JSON value: an open string or bracket at the end,
or anything but blanks before or after the value, is an error. Elements come as
their text; the readers parse it and fail on anything that isn't exactly one value.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLANK = b" \t\r\n"
_FILE_BITS = 44     # a block's number: its file's, and its offset in these low bits
_QUOTE, _BACK, _COMMA = 34, 92, 44
_SUMMARY = "block long, n long, size long, odd boolean, head string, d0 long, d1 long, c0 array<long>, c1 array<long>"
_PARTS = "t long, pos long, block long, whole boolean, opens boolean, closed_by string, text string"


@dataclass
class Entry:
    """What is known at a block's begin."""
    in_string: bool
    depth: int
    commas: tuple[int, int]     # at depths 1 and 2, before the block
    begun: bool                 # the value has begun
    unended: bool               # the block's last row ends its file and has no line end


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    number = F.coalesce(F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1), F.lit("")).cast("long"), F.lit(0))
    reader = spark.read.option("lineSep", "}")
    if _is_folder(spark, path):
        reader = reader.option("pathGlobFilter", "part-*")
    return reader.text(path).select(
        (F.shiftleft(number, _FILE_BITS) + F.col("_metadata.file_block_start")).alias("block"), F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("value"))


def _quotes(x: np.ndarray) -> np.ndarray:
    """Places of the quotes that begin or end a string: those after an even
    number of backslashes. (A row begins after a ``}``, never within an escape.)"""
    q = np.flatnonzero(x == _QUOTE)
    back = x == _BACK
    if len(q) and back.any():
        last_other = np.maximum.accumulate(np.where(back, -1, np.arange(len(x))))
        before = np.where(q > 0, last_other[q - 1], -1)
        q = q[(q - 1 - before) % 2 == 0]
    return q


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Brackets and commas: places, characters, quotes before each; all quotes."""
    x = np.frombuffer(data, np.uint8)
    low = x | 32                         # [ and { differ from each other in this bit, as do ] and }
    at = np.flatnonzero((low == 123) | (low == 125) | (x == _COMMA))
    q = _quotes(x)
    return at, x[at], np.searchsorted(q, at), len(q)


def _steps(chars: np.ndarray) -> np.ndarray:
    return np.where(chars == _COMMA, 0, np.where(chars | 32 == 123, 1, -1))


def _runs(batches):
    """(block, size, rows joined with their line ends) of consecutive rows."""
    for b in batches:
        block = b.column("block").to_numpy()
        if not len(block):
            continue
        edge = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for i, j in zip(edge, edge[1:]):
            yield int(block[i]), b.column("size")[i].as_py(), b"}".join(b.column("value").slice(i, j - i).to_pylist()) + b"}"


def _summaries(batches):
    now, rows = None, []

    def done():
        counts = [[v for k in sorted(c) for v in (k, c[k])] for c in now["c"]]
        rows.append((now["block"], now["n"], now["size"], bool(now["odd"]), now["head"], *now["d"], *counts))

    for block, size, data in _runs(batches):
        if now is None or now["block"] != block:
            if now:
                done()
            now = {"block": block, "n": 0, "size": size, "odd": 0, "head": None, "d": [0, 0], "c": [{}, {}]}
        if now["head"] is None and data.strip(_BLANK):
            now["head"] = data.strip(_BLANK)[:1].decode("latin-1")
        at, chars, before, quotes = _marks(data)
        for s in (0, 1):
            out = (before + now["odd"] + s) % 2 == 0
            step = _steps(chars[out])
            depth = now["d"][s] + np.cumsum(step)
            for k, n in zip(*np.unique(depth[step == 0], return_counts=True)):
                now["c"][s][int(k)] = now["c"][s].get(int(k), 0) + int(n)
            now["d"][s] += int(step.sum())
        now["odd"] ^= quotes & 1
        now["n"] += len(data)
    if now:
        done()
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in _SUMMARY.split(", ")], r)) for r in rows],
                                         schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("odd", pa.bool_()), ("head", pa.string()),
                                                           ("d0", pa.int64()), ("d1", pa.int64()), ("c0", pa.list_(pa.int64())), ("c1", pa.list_(pa.int64()))]))


def _entries(rows, path: str) -> tuple[dict[int, Entry], str]:
    """The state at each block's begin, and the value's first character."""
    rows = sorted(rows, key=lambda r: r["block"])
    total, size, end = Counter(), {}, {}        # by file; end: its last block that has rows
    for r in rows:
        k = r["block"] >> _FILE_BITS
        total[k] += r["n"]
        size[k], end[k] = r["size"], r["block"]
    if any(total[k] not in (size[k], size[k] + 1) for k in size):
        raise ValueError(f"{path}: not plain JSON text (compressed, or with a byte order mark)")
    entries, in_string, depth, commas, head = {}, False, 0, [0, 0], None
    for r in rows:
        k = r["block"] >> _FILE_BITS
        unended = r["block"] == end[k] and total[k] > size[k]
        entries[r["block"]] = Entry(in_string, depth, tuple(commas), head is not None, unended)
        c = r["c1"] if in_string else r["c0"]
        at = dict(zip(c[::2], c[1::2]))
        commas = [commas[k] + at.get(k + 1 - depth, 0) for k in (0, 1)]
        depth += r["d1"] if in_string else r["d0"]
        in_string ^= r["odd"]
        head = head or r["head"]
        if unended and not in_string:
            depth += 1              # the last row's line end isn't there
            if head == "}" and size[k] == 0:
                head = None
    if head is None or in_string or depth != 0:
        raise ValueError(f"{path}: not a whole JSON value")
    return entries, head


class _Cutter:
    """Cuts the elements at one depth out of one block."""

    def __init__(self, block: int, entry: Entry, level: int):
        self.block, self.level = block, level
        self.quotes, self.depth, self.n = int(entry.in_string), entry.depth, list(entry.commas)
        self.begun, self.unended = entry.begun, entry.unended
        self.held: list[bytes] = []           # the open element's (or head's) text so far
        self.inside = entry.depth >= level    # in a container of elements
        self.whole, self.opens = False, False
        self.head_whole, self.tail = False, False   # a member's text before and after its elements
        self.rows: list[tuple] = []

    def _emit(self, text: bytes, closed_by: str, ends: bool = True):
        self.rows.append((self.n[0], self.n[self.level - 1], self.block, self.whole and ends, self.opens, closed_by, text.decode()))

    def _head(self, text: bytes, ends: bool):
        """What a member has outside of its value's elements; pos is below 0
        and tells the elements before."""
        if self.tail:
            if text.strip(_BLANK):
                raise ValueError(f"text after a value: {text.strip(_BLANK)[:40]!r}")
        elif self.level == 2:
            self.rows.append((self.n[0], -1 - self.n[1], self.block, self.head_whole and ends, False, "", text.decode()))

    def _outer(self, text: bytes):
        if self.depth == 0 and text.strip(_BLANK):
            raise ValueError(f"text outside of the JSON value: {text.strip(_BLANK)[:40]!r}")

    def feed(self, data: bytes):
        level = self.level
        at, chars, before, quotes = _marks(data)
        out = (before + self.quotes) % 2 == 0
        at, chars = at[out], chars[out]
        step = _steps(chars)
        depth = self.depth + np.cumsum(step)
        own = np.flatnonzero(np.minimum(depth, depth - step) < level + (step == 0))
        done = 0                               # all before is emitted
        for k in own.tolist():
            p, d, s = int(at[k]), int(depth[k]), int(step[k])
            was = d - s
            if was == 0:
                self._outer(data[done:p])
                if self.begun or s <= 0:
                    raise ValueError("more than one JSON value")
            if s > 0 and d == level:           # a container of elements begins
                if level == 2:
                    self._head(b"".join(self.held) + data[done:p + 1], True)
                self.inside, self.whole, self.opens, self.held, done = True, True, True, [], p + 1
                self.tail = False
            elif s > 0 and d == 1:             # the object whose members hold the containers
                self.head_whole, self.held, done = True, [], p + 1
            elif self.inside and ((s == 0 and d == level) or (s < 0 and was == level)):
                self._emit(b"".join(self.held) + data[done:p], chr(chars[k]) if s < 0 else "")
                self.whole, self.opens, self.held, done = True, False, [], p + 1
                if s == 0:
                    self.n[level - 1] += 1
                else:
                    self.inside, self.tail = False, True
            elif level == 2 and not self.inside and ((s == 0 and d == 1) or (s < 0 and d == 0)):
                self._head(b"".join(self.held) + data[done:p], True)
                self.head_whole, self.tail, self.held, done = True, False, [], p + 1
                self.n[0] += s == 0
            self.begun = self.begun or d > 0
            self.depth = d
        self.depth = int(depth[-1]) if len(depth) else self.depth
        rest = data[done:]
        if self.depth == 0:
            self._outer(rest)
        elif rest:
            self.held.append(rest)
        self.quotes = (self.quotes + quotes) % 2

    def end(self):
        text = b"".join(self.held)
        if self.inside:
            self._emit(text, "", False)
        elif self.depth >= 1:
            self._head(text, False)


def _cut(entries: dict[int, Entry], level: int, want):
    def run(batches):
        cutter, block_now = None, None
        pending = None
        for block, _, data in _runs(batches):
            if block != block_now:
                if cutter is not None:
                    yield from _finish(cutter, pending, want)
                cutter, block_now, pending = _Cutter(block, entries[block], level), block, None
            if pending is not None:
                cutter.feed(pending)
                yield from _out(cutter, want)
            pending = data
        if cutter is not None:
            yield from _finish(cutter, pending, want)

    return run


def _finish(cutter: _Cutter, data: bytes, want):
    cutter.feed(data[:-1] if cutter.unended else data)
    cutter.end()
    yield from _out(cutter, want)


def _out(cutter: _Cutter, want):
    rows, cutter.rows = [r for r in cutter.rows if want(r)], []
    if rows:
        names = [c.split()[0] for c in _PARTS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _texts(spark: SparkSession, path: str, entries, level: int, head: bool) -> DataFrame:
    """(t, pos, opens, closed_by, text) of the elements at ``level``, or of the heads."""
    def part(whole):
        def want(r):
            return r[3] == whole and (r[1] < 0) == head
        return _blocks(spark, path).mapInArrow(_cut(entries, level, want), _PARTS)

    done = part(True).select("t", "pos", "opens", "closed_by", "text")
    if len(entries) == 1:
        return done
    joined = part(False).groupBy("t", "pos").agg(
        F.bool_or("opens").alias("opens"), F.max("closed_by").alias("closed_by"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "").alias("text"))
    return done.unionByName(joined)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _file(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(f"input not found: {path}")
    if fs.getFileStatus(p).isDirectory() and not any(s.getPath().getName().startswith("part-") for s in fs.listStatus(p)):
        raise IsADirectoryError(f"one JSON file, or a folder with its parts expected: {path}")


def _members(batches):
    """(t, pos, key, list?) of an object's members, from their heads."""
    for b in batches:
        rows = []
        for t, pos, opens, text in zip(*(b.column(c).to_pylist() for c in ("t", "pos", "opens", "text"))):
            close = {"[": "]", "{": "}"}.get(text[-1:]) if opens else ""
            member = json.loads("{" + text + close + "}")
            rows += [(t, pos, key, text[-1:] == "[" and opens) for key in member]
        types = {"t": pa.int64(), "pos": pa.int64(), "key": pa.string(), "is_list": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values())], names=list(types))


def json_elements(spark: SparkSession, path: str, top: str = "[", wrapped_by: tuple[str, ...] = ()) -> DataFrame:
    """(pos, text) of the elements of a JSON file that is an array (``top`` is
    ``[``) or of the members of one that is an object (``{``), with ``pos`` counting
    from 0. With ``wrapped_by``, an object that has one of these members instead gives
    the elements of the first one's array, and none if it has none of them; its other
    members are checked for balanced brackets and strings, and their keys as JSON.
    Another top level is an error."""
    _file(spark, path)
    rows = _blocks(spark, path).mapInArrow(_summaries, _SUMMARY).collect()
    entries, head = _entries(rows, path)
    if head == top:
        found = _texts(spark, path, entries, 1, False)
        base = 0
    elif wrapped_by and head == "{":
        heads = _texts(spark, path, entries, 2, True).select("t", "pos", F.col("text").rlike(r"[\[{]\s*$").alias("opens"), F.rtrim("text").alias("text"))
        keys = heads.filter(F.trim("text") != "").mapInArrow(_members, "t long, pos long, key string, is_list boolean")
        last = {r["key"]: r["m"] for r in keys.filter(F.col("key").isin(*wrapped_by)).groupBy("key").agg(
            F.max_by(F.struct("t", "pos", "is_list"), "t").alias("m")).collect()}
        chosen = next((last[k] for k in wrapped_by if k in last), None)
        if chosen is None:
            return spark.createDataFrame([], "pos long, text string")
        if not chosen["is_list"]:
            raise ValueError(f"{path}: {wrapped_by} is no array")
        found = _texts(spark, path, entries, 2, False).filter(F.col("t") == chosen["t"])
        base = -1 - chosen["pos"]
    else:
        raise ValueError(f"{path}: expected a top-level JSON {'array' if top == '[' else 'object'}")
    close = "}" if head == top == "{" else "]"
    empty = F.col("opens") & (F.col("closed_by") == close) & F.col("text").rlike(r"^[ \t\r\n]*$")
    text = F.when(F.col("closed_by").isin("", close), F.col("text")).otherwise(F.raise_error(F.lit(f"brackets don't match in {path}")))
    return found.filter(~empty).select((F.col("pos") - F.lit(base)).alias("pos"), text.alias("text"))
