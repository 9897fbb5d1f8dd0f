"""Operator 9: byte-level BPE by higher-order functions over distinct words.

Texts are split once, into compressed chunks that hold the distinct words
(matches of the split pattern) and each word's number. A chunk's distinct words
go to buckets by hash; a bucket's distinct words are
encoded once, in Spark expressions: a word's bytes are folded, the adjacent pair
with the lowest rank merging first, with ranks from a literal map that is cut
into small maps by hash (a map lookup reads the whole map). The ids go back
to the chunks that asked, whose texts become id arrays; decoding concatenates
the ids' byte strings.

A word of more than ``WINDOW`` bytes is folded in windows that overlap by half,
so that its cost grows with its length. Ids are what the fold gives for a word
where each two neighbours are what it gives for their bytes: the first merge
over a boundary would be one of that pair alone, too. So two overlapping windows
join at a piece that both have; where they have none, the bytes around the seam
are merged anew, from further back until a piece is shared.

Null texts count as empty: no ids. Repeated rows stay; null ids are kept; an
empty table gives no rows. Texts and words of any length are encoded whole.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import configure, give_back, id_text, joined_ranges, kept_between_tasks, lean, lean_batches, lean_group, out_id, pieces, raw, small_batches, text_bytes

CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: How hard chunks, words asked for and ids are compressed, which pass through shuffles.
LEVEL = 3
SMALL_MAPS = 4096
#: Bytes of a word that are folded at once; more than any piece of a vocabulary has.
WINDOW = 256


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def sizes_of(ranks: dict[bytes, int]) -> np.ndarray:
    """Bytes of each id."""
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    return sizes


def splitter(pattern: str | None = None):
    """findall of the split pattern, white space by its Unicode property. Texts
    of Latin letters and general punctuation alone take the standard library's
    faster matcher, with those letters, numbers and blanks spelled out."""
    import re
    import unicodedata

    import public_tokenizers
    import regex
    pattern = pattern or public_tokenizers.PATTERN
    latin = [chr(i) for i in range(0x250)]
    kinds = {r"\p{L}": [c for c in latin if unicodedata.category(c)[0] == "L"], r"\p{N}": [c for c in latin if unicodedata.category(c)[0] == "N"],
             r"\s": [c for c in latin if regex.match(r"\p{White_Space}", c)]}
    plain = every = pattern.replace(r"\S", r"[^\s]")
    every = every.replace(r"\s", r"\p{White_Space}")
    for name, chars in kinds.items():
        own = re.escape("".join(chars))
        # inside brackets the characters alone, outside them a class
        plain = re.sub(r"(\[[^\]]*\])|" + re.escape(name), lambda m: m[1].replace(name, own) if m[1] else f"[{own}]", plain)
    every, plain = regex.compile(every).findall, re.compile(plain).findall
    other = re.compile("[^\x00-\u024f\u2010-\u2027]").search
    return lambda text: every(text) if other(text) else plain(text)


def rank_maps(spark: SparkSession, ranks: dict[bytes, int], maps: int = SMALL_MAPS) -> Column:
    """The ranks as a literal array of maps, a piece's map being its hash modulo
    ``maps``, a power of two. Pieces are strings of one character (0-255) for each byte."""
    rows = spark.createDataFrame([(k.decode("latin-1"), v) for k, v in ranks.items()], "piece string, rank int")
    own = [{} for _ in range(maps)]
    for piece, rank, k in rows.select("piece", "rank", F.hash("piece").bitwiseAND(F.lit(maps - 1))).collect():
        own[k][piece] = rank
    return F.from_json(F.lit(json.dumps(own)), "array<map<string,int>>")


def let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def encode_word(word: Column, maps: Column, n_maps: int = SMALL_MAPS) -> Column:
    """ids of a binary word, array<int>. The maps are named once, since each task
    reads every literal of its plan."""
    return let(maps, lambda own: let(F.decode(word, "ISO-8859-1"), lambda s: _encoded(s, own, n_maps)))


def _encoded(word: Column, maps: Column, n_maps: int) -> Column:
    """The fold holds where the word's parts
    begin (``cuts``, with the end) and the pairs of neighbours that have a rank,
    as rank and place in one number: the least is the leftmost of the lowest rank. ``word`` has a character for each byte."""
    def rank(piece: Column) -> Column:
        return F.element_at(F.get(maps, F.hash(piece).bitwiseAND(F.lit(n_maps - 1))), piece)

    def folded(s: Column) -> Column:
        def pair(start: Column, end: Column) -> Column:
            return F.shiftleft(rank(F.substring(s, start, end - start)).cast("long"), 32) + start

        def place_of(pair: Column) -> Column:
            return pair.bitwiseAND(F.lit((1 << 32) - 1))

        def merge(acc: Column, low: Column) -> Column:
            cuts = acc["cuts"]

            def cut(place: Column, k: Column) -> Column:
                before, mid, end = F.get(cuts, k - 2), F.get(cuts, k), F.get(cuts, k + 1)
                # pairs that begin from the part before to the one merged are gone, and null ones
                others = F.filter(acc["pairs"], lambda p: (place_of(p) < F.coalesce(before, place)) | (place_of(p) > mid))
                return F.struct(F.array_remove(cuts, mid).alias("cuts"),
                                F.concat(others, F.array(pair(before, end), pair(place, F.get(cuts, k + 2)))).alias("pairs"))

            return let(place_of(low).cast("int"), lambda place: let(F.array_position(cuts, place).cast("int"), lambda k: cut(place, k)))

        def step(acc: Column, _) -> Column:
            return let(F.array_min(acc["pairs"]), lambda low: F.when(low.isNull(), acc).otherwise(merge(acc, low)))

        n = F.length(s)
        each = F.sequence(F.lit(1), n - 1)
        start = F.struct(F.sequence(F.lit(1), n + 1).alias("cuts"), F.transform(each, lambda i: pair(i, i + 2)).alias("pairs"))
        return let(F.aggregate(each, start, step)["cuts"], lambda c: F.transform(
            F.slice(c, F.lit(1), F.size(c) - 1), lambda a, i: rank(F.substring(s, a, F.get(c, i + 1) - a))))

    return let(rank(word), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(folded(word)))


_PARTS = ["ids", "sizes", "words", "codes"]


def pack(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, parts of its words): rows of (id, text) split in chunks, numbered by task:
    ids, the words of each text, distinct words, and each word's number among them."""
    def run(batches):
        from pyspark import TaskContext
        chunk = TaskContext.get().partitionId() << 32
        for b in small_batches(batches, "text", chunk_bytes):
            every, n = _words(b.column("text").to_pylist())
            every = every.dictionary_encode()
            parts = (_squeeze(b.column("id").to_numpy(zero_copy_only=False).astype("<i8").tobytes()), _squeeze(n.astype("<i8").tobytes()),
                     _squeeze(_join(every.dictionary.cast(pa.binary()).to_pylist()), LEVEL), _planed(every.indices.to_numpy()))
            del every
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], names=["chunk", *_PARTS])
            chunk += 1

    return docs.mapInArrow(lean_batches(run), "chunk long, " + ", ".join(f"{x} binary" for x in _PARTS))


def _join(words: list[bytes]) -> bytes:
    return np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    to = 4 * (n + 1) + np.cumsum(np.concatenate(([0], np.frombuffer(data, "<u4", n, 4)))).astype(np.int64)
    return [data[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist())]


def _squeeze(data: bytes, level: int = 1) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def _swell(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _planed(codes: np.ndarray) -> bytes:
    """Small numbers compressed: all their lowest bytes, then the next ones."""
    return _squeeze(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), LEVEL)


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_swell(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _by_bucket(words: list[bytes], buckets: int) -> dict[int, np.ndarray]:
    """Places of the words in each bucket, in the order of the words."""
    own = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
    order = np.argsort(own, kind="stable")
    return {int(own[p[0]]): p for p in np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(p)}


def _words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the words of each text."""
    find = kept_between_tasks("split", splitter)
    own = [pa.array(find(t), pa.string()) for t in texts]
    return pa.concat_arrays(own or [pa.array([], pa.string())]), np.array([len(x) for x in own], np.int64)


def _windows(word: bytes) -> list[int]:
    """Where the windows of a long word begin."""
    return [*range(0, len(word) - WINDOW, WINDOW // 2), len(word) - WINDOW]


def _units(words: list[bytes]) -> list[bytes]:
    """What is folded for these distinct words: the word, or the windows of a longer one."""
    if max(map(len, words), default=0) <= WINDOW:
        return words
    return list(dict.fromkeys(u for w in words for u in ([w] if len(w) <= WINDOW else [w[k:k + WINDOW] for k in _windows(w)])))


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces of a few bytes, lowest rank first, leftmost of equal ones."""
    n = len(data)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        rank = ranks.get(data[a:end[b]])
        if rank is not None:
            heapq.heappush(heap, (rank, a, b, end[b]))

    for a in range(n - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
            offer(a, c)
        if before[a] >= 0:
            offer(before[a], a)
    out, a = [], 0
    while a < n:
        out.append(data[a:end[a]])
        a = end[a]
    return out


def _graft(stem: list[tuple[int, int]], shoot: list[tuple[int, int]]) -> bool:
    """Let the stem's (begin, end) go on as the shoot's after a piece that both have."""
    place = {p: i for i, p in enumerate(shoot)}
    for k in range(len(stem) - 1, -1, -1):
        if stem[k][0] < shoot[0][0]:
            break
        if stem[k] in place:
            stem[k:] = shoot[place[stem[k]]:]
            return True
    return False


def _spans(sizes, start: int) -> list[tuple[int, int]]:
    to = (start + np.cumsum(sizes)).tolist()
    return list(zip([start, *to], to))


def long_word(word: bytes, ids_of, ranks: dict[bytes, int], sizes: np.ndarray) -> bytes:
    """ids of a word of more than WINDOW bytes, by those of its windows
    (``ids_of`` their bytes) and the number of bytes of each id."""
    stem: list[tuple[int, int]] = []
    for at in _windows(word):
        end = at + WINDOW
        shoot = _spans(sizes[np.frombuffer(ids_of(word[at:end]), "<u4")], at)
        if not stem:
            stem = shoot
        back = WINDOW
        while stem[-1][1] < end and not _graft(stem, shoot):
            back *= 2
            start = next((a for a, _ in reversed(stem) if a <= end - back), 0)
            shoot = _spans([len(x) for x in merged(word[start:end], ranks)], start)
            if not start:
                stem = shoot
    return np.array([ranks[word[a:b]] for a, b in stem], "<u4").tobytes()


def encode(spark: SparkSession, docs: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, ids binary): little-endian 32-bit ids of every row of (id, text)."""
    path = path or vocabulary()
    buckets = pieces(text_bytes(docs), BUCKET_BYTES)
    chunks = pack(docs, chunk_bytes)

    def ask(t: pa.Table) -> pa.Table:
        words = _units(_split(_swell(t.column("words")[0].as_py())))
        own = _by_bucket(words, buckets)
        return pa.table([pa.array(list(own), pa.int64()), pa.array([t.column("chunk")[0].as_py()] * len(own), pa.int64()),
                         pa.array([_squeeze(_join([words[i] for i in p]), LEVEL) for p in own.values()], pa.binary())],
                        names=["bucket", "chunk", "words"])

    def distinct(t: pa.Table) -> pa.Table:
        every: set[bytes] = set()
        for x in t.column("words"):
            every.update(_split(_swell(x.as_py())))
        return pa.table([pa.array([t.column("bucket")[0].as_py()] * len(every), pa.int64()), pa.array(list(every), pa.binary())],
                        names=["bucket", "word"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("ids").combine_chunks()
        to = (ids.offsets.to_numpy() - ids.offsets[0].as_py()).astype(np.int64) * 4
        flat = ids.flatten().to_numpy().astype("<u4").tobytes()
        known = {w: flat[a:b] for w, a, b in zip(right.column("word").to_pylist(), to[:-1].tolist(), to[1:].tolist())}
        data = [_planed(np.frombuffer(_join([known[w] for w in _split(_swell(x.as_py()))]), "<u4")) for x in left.column("words")]
        return pa.table([left.column("chunk"), left.column("bucket"), pa.array(data, pa.binary())], names=["chunk", "bucket", "ids"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids_of, n, words, codes = (left.column(x)[0].as_py() for x in _PARTS)
        ids_of, n = (np.frombuffer(_swell(x), "<i8") for x in (ids_of, n))
        words, codes = _split(_swell(words)), _unplaned(codes)
        units = _units(words)
        own = _by_bucket(units, buckets)
        ids = [b""] * len(units)
        for b, x in zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist()):
            for i, y in zip(own[b].tolist(), _split(_unplaned(x).tobytes())):
                ids[i] = y
        if units is not words:
            known = dict(zip(units, ids))
            ranks, sizes = kept_between_tasks("ranks:" + path, table)
            ids = [known[w] if len(w) <= WINDOW else long_word(w, known.__getitem__, ranks, sizes) for w in words]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(size) - size
        del words, units, ids, own
        out, at = [], 0
        for k in n.tolist():
            mine = codes[at:at + k]
            out.append(flat[joined_ranges(first[mine], size[mine])].tobytes())
            at += k
        return pa.table([pa.array(ids_of), pa.array(out, pa.binary())], names=["id", "ids"])

    def table():
        ranks = read_ranks(path)
        return ranks, sizes_of(ranks)

    ranks = read_ranks(path)
    if max(map(len, ranks)) >= WINDOW:
        raise ValueError(f"a piece of {path} has {WINDOW} bytes or more")
    maps = rank_maps(spark, ranks)
    asked = chunks.groupBy("chunk").applyInArrow(lean_group(ask), "bucket long, chunk long, words binary")
    words = asked.groupBy("bucket").applyInArrow(lean_group(distinct), "bucket long, word binary")
    words = words.select("bucket", "word", encode_word(F.col("word"), maps).alias("ids"))
    answers = asked.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(lean(lambda key, a, b: answer(a, b)), "chunk long, bucket long, ids binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lean(lambda key, a, b: finish(a, b)), "id long, ids binary")


def joined(token: pa.Array, ids: pa.Array) -> pa.Array:
    """The byte strings of each row's little-endian 32-bit ids, concatenated: ids
    are looked up for all rows at once, and rows end where their last id does."""
    data, off = raw(ids)
    data, to = raw(token.take(pa.array(np.frombuffer(data.tobytes(), "<u4"))))
    end = to[off // 4].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(end), pa.py_buffer(np.ascontiguousarray(data))])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, ids, decoded binary): the ids' byte strings, concatenated."""
    path = path or vocabulary()

    def table():
        ranks = read_ranks(path)
        out = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            out[v] = k
        return pa.array(out, pa.large_binary())

    def run(batches):
        token = kept_between_tasks("bytes:" + path, table)
        for b in small_batches(batches, "ids"):
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ids"), joined(token, b.column("ids"))], names=["id", "ids", "decoded"])

    return encoded.mapInArrow(run, "id long, ids binary, decoded binary")


def digest(spark: SparkSession, docs: DataFrame, path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    configure(spark)
    out = decode(encode(spark, id_text(docs), path, chunk_bytes), path)
    return out.select(out_id(), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
