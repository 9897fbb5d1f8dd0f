"""Operator 1: suffix-array removal of byte strings seen in earlier documents.

A byte goes if some 50-byte string that covers it also starts in a document
with a smaller id. Sorting every suffix of a corpus would move fifty bytes for
each one, so a window filter comes first: each 50-byte string is filed under the
smallest-hashed of its 26-byte parts, and only strings whose part occurs in two
documents go on. Neighbouring strings filed under the same part travel as one
run, once for each shard that has it, to the bucket of that part.

A bucket cuts its runs into shards of a bounded size. Each gets a suffix array
(Larsson-Sadakane: sorted by 7 bytes, then groups that are still tied are refined
by the ranks 7, 14, 28 bytes on and so forth) and the common prefixes of neighbours (Kasai:
in text order, from one less than the last). Neighbours that share 50 bytes are
one string; its smallest id is noted. The shards' sorted strings are merged by
binary search, two at a time, and each shard looks its own up in the merged list.
Parts that very many documents have can begin very many different runs, so their
runs are filed string by string instead, under each string's own hash.

Null texts count as empty; equal texts stand as one, the smallest id first;
different texts of one id, or without an id, each stand for themselves; ids
that are equal are not smaller, so rows of one id keep what they share; null ids count as larger than others. An empty table gives no rows. Matches
never cross documents, whatever bytes they hold.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import keys as kx
from rankloom.llm.common import NO_ID, configure, id_text, joined_ranges, lean, lean_batches, lean_group, mix, out_id, pieces, raw, run_starts, stored, text_bytes

LENGTH, PART = 50, 26
SPAN = LENGTH - PART + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 18
#: Documents that share a part beyond which its strings are filed one by one.
COMMON = 10_000
#: Bytes of runs that one suffix array takes.
ARRAY_BYTES = 1 << 20
#: A shard's text where rows carry their other columns through all steps.
REMOVE_SHARD_BYTES = kx.SHARD_BYTES // 2


def part_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the PART bytes from each position, by doubling."""
    x = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[data]
    n = len(data) - PART + 1
    out, have, m = None, 0, 1
    while True:
        if PART & m:
            own = x[PART - have - m:PART - have - m + n]
            out = own.copy() if out is None else out + own * np.uint64(pow(_BASE, have, 1 << 64))
            have += m
        if have == PART:
            return mix(out)
        x = x[:-m] * np.uint64(pow(_BASE, m, 1 << 64)) + x[m:]
        m *= 2


def runs(data: np.ndarray, off: np.ndarray):
    """Runs of neighbouring 50-byte strings filed under the same part: hash of the
    part, first and last string's start, and the text."""
    out = []
    to = np.maximum(off[1:] - LENGTH + 1, off[:-1])  # past the last start in each text
    for lo in range(0, max(0, len(data) - LENGTH + 1), _BLOCK):
        hi = min(lo + _BLOCK, len(data) - LENGTH + 1)
        h = part_hashes(data[lo:hi + LENGTH - 1])
        low = np.uint64((1 << 21) - 1)
        x = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        m = 1
        while 2 * m <= SPAN:
            x = np.minimum(x[:-m], x[m:])
            m *= 2
        x = np.minimum(x[:hi - lo], x[SPAN - m:SPAN - m + hi - lo])
        at = (x & low).astype(np.int64)
        new = np.concatenate(([True], at[1:] != at[:-1]))
        edge = np.concatenate((off[:-1], to)) - lo
        new[edge[(edge >= 0) & (edge < hi - lo)]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], hi - lo) - 1
        text = np.searchsorted(off, first + lo, "right") - 1
        ok = first + lo < to[text]
        first, last, text = first[ok], last[ok], text[ok]
        out.append((mix(h[at[first]]), first + lo, last + lo, text))  # mixed: smallest hashes are small
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))]


def filed(data, off, known, counts, buckets):
    """Runs that go on, and for each distinct one: its bytes, first text and
    bucket; which distinct one each run is. Texts are in order of id."""
    h, first, last, text = runs(data, off)
    k = kx.short(h)
    at = np.minimum(np.searchsorted(known, k), max(0, len(known) - 1))
    hit = known[at] == k if len(known) else np.zeros(len(k), bool)
    k, first, last, text, at = k[hit], first[hit], last[hit], text[hit], at[hit]
    single = np.where(counts[at] > COMMON, last - first + 1, 1) if len(at) else np.zeros(0, np.int64)
    one = np.repeat(np.arange(len(k)), single)
    step = joined_ranges(np.zeros(len(k), np.int64), single)
    alone = single[one] > 1
    alone |= (counts[at] > COMMON)[one] if len(at) else False
    first, last, text, k = first[one] + step, np.where(alone, first[one] + step, last[one]), text[one], k[one]
    whole = data.tobytes()
    ids: dict[bytes, int] = {}
    mine = [whole[a:b] for a, b in zip(first.tolist(), (last + LENGTH).tolist())]
    which = np.array([ids.setdefault(s, len(ids)) for s in mine], np.int64)
    begin = np.zeros(len(ids), np.int64)
    begin[which[::-1]] = np.arange(len(which))[::-1]  # the first run of each
    strings = list(ids)
    key = k[begin]
    for i in np.flatnonzero(alone[begin]).tolist():
        key[i] = np.uint64(zlib.crc32(strings[i]) << kx.BITS - 32)
    bucket = kx.bucket_of(key, buckets)
    return first, last, text, which, strings, text[begin], bucket


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order; a suffix that another one begins with comes first."""
    n = len(data)
    pad = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)))  # 0: past the end
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | pad[i:n + i]
    sa = np.argsort(key)
    new = np.concatenate(([True], key[sa][1:] != key[sa][:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    h = 7
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        rank[sa] = np.repeat(first, size)
        tied = np.repeat(size > 1, size)
        slots = np.flatnonzero(tied)
        if not len(slots):
            return sa
        own = sa[slots]
        key = rank[own] * (n + 2) + rank[np.minimum(own + h, n)] + 1
        order = np.argsort(key)
        sa[slots] = own[order]
        key = key[order]
        new[slots[1:]] |= key[1:] != key[:-1]
        h *= 2


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int = LENGTH, lanes: int = 1 << 14) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``sa``, up to
    ``most``. Kasai's walk in text order, over lanes of the text side by side: a
    lane's next suffix shares one byte less than its last one at least."""
    n = len(data)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n
    shared = np.zeros(n, np.int64)
    width = -(-n // lanes)
    start = np.arange(0, n, width)
    pad = np.concatenate((data.astype(np.int16), np.full(most + 1, -1, np.int16)))
    have = np.zeros(len(start), np.int64)
    for step in range(width):
        at = start + step
        at = at[at < n]
        have = np.maximum(have[:len(at)] - 1, 0)
        other = before[at]
        go = np.flatnonzero((other < n) & (have < most))
        while len(go):
            a, b = pad[at[go] + have[go]], pad[other[go] + have[go]]
            go = go[(a == b) & (a >= 0)]
            have[go] += 1
            go = go[have[go] < most]
        have[other == n] = 0
        shared[at] = have
    return shared


def sorted_strings(data: np.ndarray, starts: np.ndarray, ids: np.ndarray):
    """Of the 50-byte strings at ``starts`` (with their documents' ids): the
    distinct ones in order, each one's smallest id, and which one each is."""
    sa = suffix_array(data)
    shared = common_prefixes(data, sa)
    group = np.cumsum(shared[sa] < LENGTH) - 1
    of = np.empty(len(data), np.int64)
    of[sa] = group
    of = of[starts]
    used, which = np.unique(of, return_inverse=True)
    least = np.full(len(used), NO_ID, np.int64)
    np.minimum.at(least, which, ids)
    begin = np.empty(len(used), np.int64)
    begin[which] = starts
    text = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begin]
    return np.ascontiguousarray(text).view(f"V{LENGTH}").ravel(), least, which


def _as_s(x: np.ndarray) -> np.ndarray:
    """Fixed-width strings that compare by byte (zero bytes only pad)."""
    return x.view(f"S{LENGTH}")


def merged(a, b):
    """Two sorted lists of strings with their smallest ids, as one."""
    at = np.searchsorted(_as_s(a[0]), _as_s(b[0]))
    same = np.zeros(len(b[0]), bool)
    inside = at < len(a[0])
    same[inside] = _as_s(a[0])[at[inside]] == _as_s(b[0])[inside]
    least = a[1].copy()
    least[at[same]] = np.minimum(least[at[same]], b[1][same])
    return np.insert(a[0], at[~same], b[0][~same]), np.insert(least, at[~same], b[1][~same])


def settle(lengths: np.ndarray, data: bytes, ids: np.ndarray, limit: int = ARRAY_BYTES):
    """For runs of strings (bytes one after another, their lengths, smallest ids):
    the smallest id of each of their 50-byte strings, run after run. Equal runs
    enter an array once."""
    ends = np.cumsum(lengths)
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], np.int64)
    least = np.full(len(number), NO_ID, np.int64)
    np.minimum.at(least, of, ids)
    ids, own = least, list(number)
    size = np.array([len(x) for x in own], np.int64)
    ends = np.cumsum(size)
    whole = np.frombuffer(b"".join(own), np.uint8)
    del number, own
    lists, whiches = [], []
    i = 0
    while i < len(size):
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
        n = size[i:j] - LENGTH + 1
        starts = joined_ranges(ends[i:j] - size[i:j] - base, n)
        strings, least, which = sorted_strings(whole[base:ends[j - 1]], starts, np.repeat(ids[i:j], n))
        lists.append((strings, least))
        whiches.append((strings, which))
        i = j
    while len(lists) > 1:
        lists = [merged(*lists[k:k + 2]) if k + 1 < len(lists) else lists[k] for k in range(0, len(lists), 2)]
    strings, least = lists[0]
    each = np.concatenate([least[np.searchsorted(_as_s(strings), _as_s(mine))][which] for mine, which in whiches])
    to = np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1)
    return each[joined_ranges(to[of], size[of] - LENGTH + 1)]


_RUNS = "bucket long, shard long, lengths binary, data binary, ids binary"
_ANSWER = ["shard", "kind", "id", "keys", "counts"]


def _settle_bucket(t: pa.Table) -> pa.Table:
    """Back to each shard (kind 2; id is the bucket): run number, first string,
    strings, smallest id, where that is below the run's own."""
    t = t.sort_by("shard")
    lengths = [np.frombuffer(x, "<u4").astype(np.int64) for x in t.column("lengths").to_pylist()]
    ids = [np.frombuffer(x, "<i8") for x in t.column("ids").to_pylist()]
    data = b"".join(t.column("data").to_pylist())
    least = settle(np.concatenate(lengths), data, np.concatenate(ids))
    out, at = [], 0
    for shard, n, own in zip(t.column("shard").to_pylist(), lengths, ids):
        n = n - LENGTH + 1
        mine = least[at:at + n.sum()]
        at += n.sum()
        run = np.repeat(np.arange(len(n)), n)
        place = joined_ranges(np.zeros(len(n), np.int64), n)
        less = mine < own[run]
        new = np.concatenate(([True], (run[1:] != run[:-1]) | (mine[1:] != mine[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(run)))
        first, size = first[less[first]], size[less[first]]
        if len(first):
            rows = np.stack([run[first], place[first], size, mine[first]], axis=1).astype("<i8")
            out.append((shard, rows.tobytes()))
    return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([2] * len(out), pa.int32()),
                     pa.array([t.column("bucket")[0].as_py()] * len(out), pa.int64()), pa.array([r[1] for r in out], pa.binary()),
                     pa.nulls(len(out), pa.binary())], names=_ANSWER)


def _covered(n: int, starts: np.ndarray) -> np.ndarray:
    """Bytes 0..n that the 50-byte strings at ``starts`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def removed_runs(spark: SparkSession, docs: DataFrame, shard_bytes: int = kx.SHARD_BYTES) -> DataFrame:
    """The columns of docs (id, text, and at most a struct ``row``), copy (a
    smaller id has the whole text), and the start and end bytes of what goes, as
    arrays."""
    shards = pieces(text_bytes(docs), shard_bytes)
    buckets = kx.first_cut(shards)
    named, classes = kx.first_copies(docs)
    classes = stored(classes.select("digest", "rep"), "classes")

    columns, schema = docs.columns, docs.schema
    for name, kind in (("copy", T.BooleanType()), ("begins", T.ArrayType(T.LongType())), ("ends", T.ArrayType(T.LongType()))):
        schema = T.StructType([*schema.fields, T.StructField(name, kind)])

    def standing(left, right):
        left, ids = kx.standing(left, right)
        return (left, ids, *raw(left.column("text").combine_chunks()))

    def hand_in(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, data, off = standing(left, right)
        h, _, _, text = runs(data, off)
        k = kx.short(h)
        order = np.lexsort((text, k))
        k, text = k[order], text[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (text[1:] != text[:-1]))) if len(k) else np.zeros(0, bool)
        return kx.handed_in(key[0].as_py(), *np.unique(k[new], return_counts=True), buckets)

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, ids, data, off = standing(left, right)
        _, _, _, _, strings, text, bucket = filed(data, off, *kx.returned(right), shards)
        rows = []
        order = np.argsort(bucket, kind="stable")
        begin = run_starts(bucket[order])
        for own in np.split(order, begin[1:]) if len(order) else []:
            mine = [strings[i] for i in own]
            rows.append((int(bucket[own[0]]), np.array([len(s) for s in mine], "<u4").tobytes(), b"".join(mine),
                         ids[text[own]].astype("<i8").tobytes()))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int64()),
                         *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
                        names=["bucket", "shard", "lengths", "data", "ids"])

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        every = left
        left, ids, data, off = standing(left, right)
        first, last, text, which, strings, begin, bucket = filed(data, off, *kx.returned(right), shards)
        # smallest id of each string of each distinct run: its own first text's, or what came back
        n = np.array([len(s) - LENGTH + 1 for s in strings], np.int64)
        to = np.concatenate(([0], np.cumsum(n))).astype(np.int64)
        least = np.repeat(ids[begin], n) if len(n) else np.zeros(0, np.int64)
        order = np.argsort(bucket, kind="stable")
        back = right.filter(pa.compute.equal(right.column("kind"), 2))
        for b, rows in zip(back.column("id").to_pylist(), back.column("keys").to_pylist()):
            rows = np.frombuffer(rows, "<i8").reshape(-1, 4)
            run = order[np.searchsorted(bucket[order], b) + rows[:, 0]]
            least[joined_ranges(to[run] + rows[:, 1], rows[:, 2])] = np.repeat(rows[:, 3], rows[:, 2])
        size = last - first + 1
        starts = joined_ranges(first, size)
        gone = least[joined_ranges(to[which], size)] < np.repeat(ids[text], size) if len(size) else np.zeros(0, bool)
        cover = _covered(len(data), starts[gone])
        by_text = {(d, x): i for i, (d, x) in enumerate(zip(ids.tolist(), left.column("digest").to_pylist()))}
        begins, ends, copy = [], [], []
        for own in zip(every.column("id").to_pylist(), every.column("digest").to_pylist()):
            i = by_text.get(own)
            copy.append(i is None)
            if i is None:
                begins.append([])
                ends.append([])
                continue
            own = np.concatenate(([0], cover[off[i]:off[i + 1]].view(np.int8), [0]))
            step = np.diff(own)
            begins.append(np.flatnonzero(step == 1))
            ends.append(np.flatnonzero(step == -1))
        kind = pa.list_(pa.int64())
        return pa.table([*(every.column(c) for c in columns), pa.array(copy, pa.bool_()), pa.array(begins, kind), pa.array(ends, kind)],
                        names=[*columns, "copy", "begins", "ends"])

    left = kx.by_shard(docs, shards)
    mem = kx.members(classes, shards)
    known = stored(kx.shared(left.groupBy("shard").cogroup(mem.groupBy("shard")).applyInArrow(lean(hand_in), kx._HANDED), shards), "parts")
    right = mem.unionByName(known)
    sent = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(lean(send), _RUNS)
    answers = stored(sent.groupBy("bucket").applyInArrow(lean_group(_settle_bucket), kx.ROWS), "answers")
    return left.groupBy("shard").cogroup(right.unionByName(answers).groupBy("shard")).applyInArrow(lean(finish), schema)


def cut(text: bytes, begins, ends) -> bytes:
    out, at = [], 0
    for a, b in zip(begins, ends):
        out.append(text[at:a])
        at = b
    return b"".join(out) + text[at:]


def _rows(b: pa.RecordBatch):
    for text, copy, begins, ends in zip(b.column("text"), b.column("copy").to_pylist(), b.column("begins").to_pylist(), b.column("ends").to_pylist()):
        text = text.as_py().encode("utf-8", "surrogatepass")
        if copy and len(text) >= LENGTH:
            begins, ends = [0], [len(text)]
        yield text, begins, ends


def digest(docs: DataFrame) -> DataFrame:
    spark = configure(docs.sparkSession)

    def run(batches):
        for b in batches:
            out = [(len(t), sum(ends) - sum(begins), len(begins), hashlib.sha256(cut(t, begins, ends)).hexdigest())
                   for t, begins, ends in _rows(b)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = removed_runs(spark, id_text(docs)).mapInArrow(lean_batches(run), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(out_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove(docs: DataFrame, shard_bytes: int = REMOVE_SHARD_BYTES) -> DataFrame:
    """The same rows and columns with what goes cut from the texts (a character
    that a cut splits goes too) and n_chars, where there is one, counted anew for
    changed texts. A text may become empty; its row stays."""
    spark = configure(docs.sparkSession)
    rest = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text"), docs["text"].isNull().alias("_null_text"))
    named = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"),
                         F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), rest.alias("row"))
    found = removed_runs(spark, named, shard_bytes)

    def run(batches):
        for b in batches:
            texts = [cut(t, begins, ends).decode("utf-8", "ignore") for t, begins, ends in _rows(b)]
            changed = [bool(c or e) for c, e in zip(b.column("copy").to_pylist(), b.column("ends").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(changed, pa.bool_())],
                                             names=["row", "text", "changed"])

    schema = T.StructType([found.schema["row"], T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
    out = found.mapInArrow(lean_batches(run), schema)

    def column(c):
        if c == "text":
            return F.when(~out["row"]["_null_text"], out["text"]).alias(c)
        own = out["row"][c]
        if c == "n_chars":
            return F.when(out["changed"], F.length(out["text"]).cast(docs.schema[c].dataType)).otherwise(own).alias(c)
        return own.alias(c)

    return out.select(*map(column, docs.columns))
