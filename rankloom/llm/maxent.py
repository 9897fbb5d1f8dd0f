"""Operator 8: hashed maximum-entropy language model.

Tokens are lower-cased words and an end. A token's probability is its class's
given the history, times its own within the class. Classes: each of the most
frequent tokens is one; the others are cut into classes of like weight in order
of their last two bytes, so that endings (and with them languages) stay
together. The class softmax is a maximum-entropy model over hashed features: the
previous word, the previous two, the one before the previous (a skip), and a
bias. Within a class a token has a place in a tree of ``DEPTH`` levels, by its
checksum; each branch is a maximum-entropy model of its own over the same hashed
features, with the branch's share of the class's training tokens (each token's count
plus one) as its bias. Tokens that end at one leaf share it by the same counts; the
last class also holds one unseen token.

Counting, training and scoring go over compressed chunks of the table, which a
row's id and text deal it to, so scores do not depend on the table's layout. Texts are
cut into tokens once; a chunk holds its distinct words and each token's number. It
asks the buckets of its words for their counts, which buckets sum over all
chunks. Training runs in rounds: each round deals its share of the chunks, every
chunk walks its training tokens in sparse numpy batches from the round's common
weights, and the changes are averaged, block by block of the weights, in groups
of bounded size. In that average a chunk counts for a row by its training tokens
that have the row, so chunks that never saw it do not hold it back. The weights (fixed size) travel to the tasks.

Null texts count as empty: the end alone. Repeated rows are counted and scored
each; a null id hashes as an empty text. Without training documents every score
is what an empty count gives. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.byte_bpe import _join, _split, _squeeze, _swell
from rankloom.llm.common import NO_ID, ascii_lower, configure, mix, out_id, pieces, raw, stored, text_bytes, word_spans
from rankloom.llm.shingles import span_hashes

CHUNK_BYTES = 8 << 20
CLASSES, ALONE = 32, 12
#: Hashed rows of each of the three history features.
ROWS, FEATURES = 1 << 13, 3
ROUNDS, BATCH, RATE, TREE_RATE = 3, 2048, 0.5, 0.1
#: Levels of the tree within a class, levels that a weight row has, and hashed rows of the trees.
DEPTH, LEVELS, TREE_ROWS = 10, 5, 1 << 14
#: Weight rows in a block, and blocks that one task averages.
BLOCK, TOGETHER = 1024, 64
END = b""
UNSEEN = 0
_PARTS = ["ids", "held", "words", "hashes", "code", "size"]


def prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       (F.crc32(text.cast("binary")) % 7 == 2).alias("held_out"))


class Tokens:
    """A chunk's tokens in text order: code into its distinct words (the last code
    is the end), text and hash; and its rows' ids and which are held out."""

    def __init__(self, ids: np.ndarray, held: np.ndarray, words: list[bytes], hashes: np.ndarray, code: np.ndarray, size: np.ndarray):
        self.ids, self.held, self.words, self.code, self.n = ids, held, words, code, len(ids)
        self.hashes, self.size = hashes, size
        self.text = np.repeat(np.arange(self.n), size)
        self.hash = hashes[code]

    @cached_property
    def sums(self) -> np.ndarray:
        return checksums(self.words)

    @classmethod
    def of(cls, t: pa.Table) -> Tokens:
        data, off = raw(ascii_lower(t.column("text").combine_chunks()))
        start, end, text = word_spans(data, off)
        to = np.concatenate(([0], np.cumsum(end - start)))
        inside = data[(data != 32) & ((data < 9) | (data > 13))]    # the words' bytes: all that are no blanks
        d = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(to), pa.py_buffer(inside)]).dictionary_encode()
        own, to = raw(d.dictionary)
        every = own.tobytes()
        words = [every[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist())] + [END]
        n = t.num_rows
        at = np.searchsorted(text, np.arange(n), "right")  # the end follows each text's words
        code = d.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        hashes = np.append(span_hashes(own, to[:-1], to[1:]), np.uint64(0))
        return cls(t.column("id").to_numpy(), t.column("held_out").to_numpy(zero_copy_only=False), words, hashes,
                   np.insert(code, at, len(words) - 1), np.bincount(text, minlength=n) + 1)

    def packed(self) -> list[bytes]:
        return [_squeeze(x) for x in (self.ids.astype("<i8").tobytes(), self.held.astype(np.uint8).tobytes(), _join(self.words),
                                      self.hashes.astype("<u8").tobytes(), self.code.astype("<i4").tobytes(), self.size.astype("<i4").tobytes())]

    @classmethod
    def opened(cls, t: pa.Table) -> Tokens:
        ids, held, words, hashes, code, size = (_swell(t.column(c)[0].as_py()) for c in _PARTS)
        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(held, np.uint8).astype(bool), _split(words), np.frombuffer(hashes, "<u8"),
                   np.frombuffer(code, "<i4"), np.frombuffer(size, "<i4"))

    def history(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the features of the tokens at these places (a feature's lie together)."""
        h, text, last, other = self.hash, take(self.text, at), np.maximum(at - 1, 0), np.maximum(at - 2, 0)
        one = np.where((at >= 1) & (take(self.text, last) == text), take(h, last), np.uint64(1))
        two = np.where((at >= 2) & (take(self.text, other) == text), take(h, other), np.uint64(2))
        return np.stack([one, mix(one * np.uint64(3) + two), mix(two + np.uint64(7))]).T


def take(x: np.ndarray, at: np.ndarray, out: np.ndarray | None = None, axis: int = 0) -> np.ndarray:
    """``x[at]`` in one pass, into ``out`` if there is one; all places are within ``x``."""
    return np.take(x, at, axis, out, mode="clip")


def row_values(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` as single values, which numpy writes at once."""
    return x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel()


def class_rows(seen: np.ndarray) -> np.ndarray:
    """Weight rows of the features with these hashes, by feature."""
    return (seen.T & np.uint64(ROWS - 1)).astype(np.int64) + (1 + np.arange(FEATURES) * ROWS)[:, None]


def checksums(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def leaves(words: list[bytes]) -> np.ndarray:
    """The leaf of each word in its class's tree."""
    return checksums(words) >> 32 - DEPTH


class Trees:
    """The branches on the way from the root of a word's class to its leaf, and the
    odds of the right one by the counts alone."""

    def __init__(self, weight: np.ndarray):
        """``weight`` (class, leaf): training tokens, plus one for each distinct one."""
        level, odds = weight.astype(np.float64), [np.zeros((CLASSES, 1))]
        for _ in range(DEPTH):
            odds.append(np.log(np.maximum(level[:, 1::2], 1e-9) / np.maximum(level[:, ::2], 1e-9)))
            level = level[:, ::2] + level[:, 1::2]
        # by node: the root is 1, the branches of node k are 2k and 2k + 1; sides without any token are certain
        self.odds = np.concatenate([odds[0], *odds[:0:-1]], axis=1).clip(-30, 30).astype(np.float32)
        self.weight = weight

    def ways(self, cls: np.ndarray, leaf: np.ndarray):
        """By level and word: the odds, and whether it goes right; its weights' hash
        (a weight row holds LEVELS levels below some node) and columns."""
        levels = np.arange(DEPTH)[:, None]
        node = (1 << levels) + (leaf >> DEPTH - levels)
        right = (leaf >> DEPTH - 1 - levels & 1).astype(np.float32)
        salt = mix((cls << DEPTH | node[::LEVELS]).astype(np.uint64) + np.uint64(11))
        inner = 1 << levels % LEVELS
        return self.odds[cls, node], right, salt, inner + (node & inner - 1)

    def tables(self):
        """The same of each leaf of every class, (part, leaf, level) with LEVELS levels a
        part: odds; by the leaf alone the right side and columns; hash by part and leaf."""
        every = np.arange(CLASSES << DEPTH)
        odds, right, salt, column = self.ways(every >> DEPTH, every & (1 << DEPTH) - 1)
        odds, right, column = (np.ascontiguousarray(x.reshape(-1, LEVELS, x.shape[1]).transpose(0, 2, 1))
                               for x in (odds, right[:, :1 << DEPTH], column[:, :1 << DEPTH]))
        return odds, right, column, salt


def tree_rows(seen: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """(feature, part, token) of the trees' weight rows."""
    return (seen.T[:, None] ^ salt) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - TREE_ROWS.bit_length())


def tree_places(seen: np.ndarray, salt: np.ndarray, column: np.ndarray):
    """(feature, row, token) of the trees' weight rows, and (feature, level, token) of their single weights."""
    row = tree_rows(seen, salt).astype(np.int64)
    place = (row * CLASSES)[:, :, None, :] + column.reshape(-1, LEVELS, column.shape[1])
    return row, place.reshape(FEATURES, DEPTH, -1)


def tree_odds(tree: np.ndarray, odds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Odds of the right branch by level and token."""
    x = odds + take(tree, places[0])
    for own in places[1:]:
        x += take(tree, own)
    return x


def ending(words: list[bytes]) -> np.ndarray:
    """The last two bytes as a number, the last one first."""
    to = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"\0\0" + b"".join(words), np.uint8).astype(np.int64)  # two more in front: the shortest words
    n = np.diff(to, prepend=0)
    return np.where(n > 0, data[to + 1] << 8, 0) | np.where(n > 1, data[to], 0)


class Classes:
    """Class and probability within it for a token's bytes and count."""

    def __init__(self, alone: list[bytes], of_ending: np.ndarray, weight: np.ndarray):
        self.alone = {w: i for i, w in enumerate(alone)}
        self.of_ending, self.weight = of_ending, weight
        self.trees: Trees | None = None

    def of(self, words: list[bytes]) -> np.ndarray:
        out = self.of_ending[ending(words)]
        for i in [i for i, w in enumerate(words) if w in self.alone]:
            out[i] = self.alone[words[i]]
        return out

    def at_leaf(self, cls: np.ndarray, leaf: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of a token's (c + 1) among those of its leaf."""
        return np.log10((count + 1) / self.trees.weight[cls, leaf])

    def places(self, tokens: Tokens, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and leaf of the words; unseen words share one of the last class."""
        cls, leaf = self.of(tokens.words), tokens.sums >> 32 - DEPTH
        cls[count == 0], leaf[count == 0] = CLASSES - 1, UNSEEN
        return cls, leaf


def learn_classes(words: DataFrame) -> tuple[Classes, int, int]:
    """From (word, n): classes, N and V. The driver gets the ALONE most frequent
    tokens and the weights of the 65,536 endings and of the classes' leaves (32,768) at most."""
    total, number = words.agg(F.sum("n"), F.count("*")).first()
    top = words.orderBy(F.desc("n"), "word").limit(ALONE).collect()
    alone = [bytes(r["word"]) for r in top if r["n"] * CLASSES * 4 >= (total or 0)]
    n = F.length("word")
    code = [F.conv(F.hex(F.substring("word", k, 1)), 16, 10).cast("int") for k in (-1, -2)]
    by_end = words.filter(~F.col("word").isin([bytearray(w) for w in alone]) if alone else F.lit(True)) \
        .select(F.when(n == 0, 0).when(n == 1, code[0] * 256).otherwise(code[0] * 256 + code[1]).alias("e"), "n") \
        .groupBy("e").agg(F.sum("n").alias("w")).collect()
    weight = np.zeros(1 << 16, np.int64)
    for r in by_end:
        weight[r["e"]] = r["w"]
    rest = CLASSES - len(alone)
    done = np.cumsum(weight)
    share = (done - weight / 2) / max(1, done[-1])
    of_ending = len(alone) + np.minimum(rest - 1, (share * rest).astype(np.int64))
    class_weight = np.bincount(of_ending, weight, CLASSES)
    for i, r in enumerate(top[:len(alone)]):
        class_weight[i] = r["n"]
    classes = Classes(alone, of_ending, class_weight)

    def by_leaf(batches):
        for b in batches:
            own = b.column("word").to_pylist()
            at = classes.of(own) << DEPTH | leaves(own)
            sums = np.bincount(at, b.column("n").to_numpy() + 1)
            found = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums[found].astype(np.int64))], names=["leaf", "w"])

    of_leaf = np.zeros(CLASSES << DEPTH, np.int64)
    for r in words.mapInArrow(by_leaf, "leaf long, w long").groupBy("leaf").agg(F.sum("w").alias("w")).collect():
        of_leaf[r["leaf"]] = r["w"]
    of_leaf = of_leaf.reshape(CLASSES, -1)
    of_leaf[CLASSES - 1, UNSEEN] += 1
    classes.trees = Trees(of_leaf)
    return classes, int(total or 0), int(number)


def start_weights(classes: Classes) -> np.ndarray:
    """Row 0 is the bias: the classes' log shares."""
    w = np.zeros((1 + FEATURES * ROWS + TREE_ROWS, CLASSES), np.float32)
    share = (classes.weight + 1) / (classes.weight.sum() + CLASSES)
    w[0] = np.log(share)
    return w


def probabilities(bias: np.ndarray, parts) -> np.ndarray:
    """Softmax of the bias and the parts, in the room of the first part."""
    parts = iter(parts)
    x = next(parts)
    x += bias
    for p in parts:
        x += p
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


class Shared:
    """The weight rows of one feature that a batch's tokens have: each once, ascending,
    with the number of its tokens; ``of`` says which is a token's."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort
        rows = take(rows, self.order)
        new = np.ones(len(rows) + 1, bool)
        np.not_equal(rows[1:], rows[:-1], out=new[1:-1])
        first = np.flatnonzero(new)
        self.first, self.size = first[:-1], np.diff(first)
        self.rows = take(rows, self.first)
        self.of = np.empty(len(rows), np.int64)
        self.of[self.order] = np.cumsum(new[:-1]) - 1

    def sums(self, g: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Sum of ``g`` over each row's tokens. Most rows have one or two, which are
        gathered; ``reduceat`` takes long for each row and is left those with more."""
        total = take(g, take(self.order, self.first), out)
        values = row_values(total)
        two = np.flatnonzero(self.size == 2)
        np.put(values, two, row_values(take(total, two) + take(g, take(self.order, take(self.first, two) + 1))))
        more = self.size > 2
        some = np.flatnonzero(more)
        if len(some):
            size = take(self.size, some)
            own = take(g, take(self.order, np.flatnonzero(np.repeat(more, self.size))))
            np.put(values, some, row_values(np.add.reduceat(own, np.cumsum(size) - size, axis=0)))
        return total


class ClassSteps:
    """Steps of the class softmax: each feature row by its own gradient summed over the
    batch, over the root of its gradient's square so far. Room is taken once."""

    def __init__(self, w: np.ndarray, most: int):
        self.w, self.values = w, row_values(w)
        self.seen, self.had = np.full(len(w), 1.0, np.float32), np.zeros(len(w), np.int64)
        self.room = np.empty((FEATURES + 3, most, CLASSES), np.float32)

    def step(self, rows: np.ndarray, y: np.ndarray) -> None:
        n, (first, other, total, *own) = len(y), self.room
        shared = [Shared(r) for r in rows]
        own = [take(self.w, s.rows, room[:len(s.rows)]) for s, room in zip(shared, own)]
        g = probabilities(self.w[0], (take(x, s.of, room[:n]) for x, s, room in zip(own, shared, [first] + [other] * FEATURES)))
        g[np.arange(n), y] -= 1
        for x, s in zip(own, shared):
            change = s.sums(g, total[:len(x)])
            self.had[s.rows] += s.size
            seen = take(self.seen, s.rows)
            seen += np.multiply(change, change, out=other[:len(x)]).sum(axis=1)
            self.seen[s.rows] = seen
            change *= np.float32(RATE)
            change /= np.sqrt(seen)[:, None]
            x -= change
            np.put(self.values, s.rows, row_values(x))


class TreeSteps:
    """The same for the branches of the trees, each weight by itself. A batch's weights
    are visited in order of their rows, so that those of a row are read together."""

    def __init__(self, tree: np.ndarray, trees: Trees, most: int):
        # numpy adds at places ten times faster if the type is its own object, which a broadcast array's is not
        self.tree, self.seen, self.summed = tree, np.ones(tree.shape, np.float32), np.zeros(tree.shape, np.float32)
        self.had = np.zeros(TREE_ROWS, np.int64)
        self.odds, self.right, self.column, self.salt = trees.tables()
        most *= FEATURES * DEPTH // LEVELS
        self.places, self.room = np.empty((most, LEVELS), np.int64), np.empty((4, most, LEVELS), np.float32)

    def step(self, seen: np.ndarray, key: np.ndarray) -> None:
        """``key``: class and leaf of each token."""
        leaf = key & (1 << DEPTH) - 1
        row = tree_rows(seen, take(self.salt, key, axis=1)).astype(np.uint16).ravel()
        n = len(row)
        order = np.argsort(row, kind="stable")
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        which = order % (n // FEATURES)     # of the parts and tokens, which features share
        row = take(row, order).astype(np.int64)
        self.had += np.bincount(row, minlength=TREE_ROWS)
        row *= CLASSES
        places = take(take(self.column, leaf, axis=1).reshape(-1, LEVELS), which, self.places[:n])
        for level in range(LEVELS):
            places[:, level] += row
        flat, (w, total, square, other) = places.ravel(), self.room[:, :n]

        w = take(self.tree, places, w)
        x = take(self.odds, key, axis=1).reshape(-1, LEVELS)
        for part in take(w, back, other).reshape(FEATURES, -1, LEVELS):
            x += part
        np.negative(x, out=x)
        np.exp(x, out=x)
        x += 1
        np.divide(1, x, out=x)
        x -= take(self.right, leaf, axis=1).reshape(-1, LEVELS)

        np.add.at(self.summed, flat, take(x, which, other).ravel())
        total = take(self.summed, places, total)
        self.summed[flat] = 0
        square = take(self.seen, places, square)
        square += np.multiply(total, total, out=other)
        self.seen[flat] = square.ravel()
        total *= np.float32(TREE_RATE)
        total /= np.sqrt(square, out=square)
        w -= total
        self.tree[flat] = w.ravel()         # one value a place, however often it is there


def descend(w: np.ndarray, tokens: Tokens, cls: np.ndarray, leaf: np.ndarray, trees: Trees, at: np.ndarray) -> np.ndarray:
    """Walk the tokens at these places in batches, changing ``w``. Returns how many
    tokens had each row."""
    low, most = 1 + FEATURES * ROWS, min(BATCH, len(at))
    classes, branches = ClassSteps(w, most), TreeSteps(w[low:].reshape(-1), trees, most)
    key = cls << DEPTH | leaf
    for i in range(0, len(at), BATCH):
        own = at[i:i + BATCH]
        seen, code = tokens.history(own), take(tokens.code, own)
        classes.step(class_rows(seen), take(cls, code))
        branches.step(seen, take(key, code))
    classes.had[low:] = branches.had
    return classes.had


_CHANGES = "block int, turn long, data binary, had binary"


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, parts of its tokens): rows of (id, text, held_out) dealt by id and text
    and put in order, so that chunks hold the same rows however the table is laid out.
    They are cut into tokens and written once; counting, training and scoring read them."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("digest", "ascending")])
        parts = Tokens.of(t).packed()
        return pa.table([pa.array([t.column("chunk")[0].as_py()], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], names=["chunk", *_PARTS])

    dealt = docs.withColumn("digest", F.xxhash64("text")).withColumn("chunk", F.pmod(F.xxhash64("id", "digest"), F.lit(chunks)))
    return stored(dealt.groupBy("chunk").applyInArrow(run, "chunk long, " + ", ".join(f"{x} binary" for x in _PARTS)), "chunks")


def model(spark: SparkSession, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, rounds: int = ROUNDS):
    """(chunks, answers, classes, N, V, weights) trained on the rows that are not
    held out."""
    buckets = max(rounds, pieces(text_bytes(docs), chunk_bytes))     # each round has some chunk
    chunks = chunked(docs, buckets)

    def ask(t: pa.Table) -> pa.Table:
        own = Tokens.opened(t)
        train = ~own.held[own.text]
        n = np.bincount(own.code[train], minlength=len(own.words))
        bucket = own.sums % buckets
        order = np.argsort(bucket, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
        return pa.table([pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array([t.column("chunk")[0].as_py()] * len(parts), pa.int64()),
                         pa.array([_squeeze(_join([own.words[i] for i in p])) for p in parts], pa.binary()),
                         pa.array([n[p].astype("<u4").tobytes() for p in parts], pa.binary())], names=["bucket", "chunk", "words", "counts"])

    def total(t: pa.Table) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
        """A bucket's distinct words, their counts, and each chunk's words as numbers of them."""
        held = [_swell(x) for x in t.column("words").to_pylist()]
        size = [np.frombuffer(x, "<u4", int(np.frombuffer(x, "<u4", 1)[0]), 4) for x in held]      # as _join writes them
        to = np.cumsum(np.concatenate([np.zeros(1, np.int64), *size]), dtype=np.int64)
        data = b"".join(x[4 * (len(n) + 1):] for x, n in zip(held, size))
        d = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(to) - 1, [None, pa.py_buffer(to), pa.py_buffer(data)]).dictionary_encode()
        code = d.indices.to_numpy(zero_copy_only=False)
        n = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("counts").to_pylist()])
        sums = np.zeros(len(d.dictionary), np.int64)
        np.add.at(sums, code, n.astype(np.int64))
        return d.dictionary, sums, np.split(code, np.cumsum([len(x) for x in size])[:-1])

    def count(t: pa.Table) -> pa.Table:
        own, n, _ = total(t)
        found = np.flatnonzero(n)
        return pa.table([own.take(pa.array(found)).cast(pa.binary()), pa.array(n[found])], names=["word", "n"])

    def answer(t: pa.Table) -> pa.Table:
        _, n, parts = total(t)
        return pa.table([t.column("chunk"), t.column("bucket"), pa.array([n[p].astype("<u4").tobytes() for p in parts], pa.binary())],
                        names=["chunk", "bucket", "counts"])

    asked = stored(chunks.groupBy("chunk").applyInArrow(ask, "bucket long, chunk long, words binary, counts binary"), "words")
    words = stored(asked.groupBy("bucket").applyInArrow(count, "word binary, n long"), "counts")
    classes, n, v = learn_classes(words)
    answers = stored(asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, counts binary"), "answers")
    w = start_weights(classes)
    for r in range(rounds):
        mine = F.col("chunk") % rounds == r
        w = w + average(changes(chunks.filter(mine), answers.filter(mine), w, classes, buckets), w.shape)
    return chunks, answers, classes, n, v, w, buckets


def own_counts(tokens: Tokens, right: pa.Table, buckets: int) -> np.ndarray:
    """Training counts of a chunk's distinct words, from what came back."""
    bucket = tokens.sums % buckets
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = np.zeros(len(tokens.words), np.int64)
    for b, x in zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist()):
        out[order[at[b]:at[b + 1]]] = np.frombuffer(x, "<u4")
    return out


def changes(chunks: DataFrame, answers: DataFrame, w: np.ndarray, classes: Classes, buckets: int) -> DataFrame:
    """(block, turn, data, had): each chunk's changes of the weights, by blocks,
    and how many of its tokens had each row."""
    spark = chunks.sparkSession
    common = spark.sparkContext.broadcast(w)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Tokens.opened(left)
        cls, leaf = classes.places(own, own_counts(own, right, buckets))
        mine = common.value.copy()
        at = np.flatnonzero(~own.held[own.text])
        had = descend(mine, own, cls, leaf, classes.trees, at)
        mine -= common.value
        blocks, hads = ([_squeeze(x[i:i + BLOCK].astype(kind).tobytes()) for i in range(0, len(x), BLOCK)] for x, kind in ((mine, "<f2"), (had, "<i8")))
        turn = left.column("chunk")[0].as_py()
        return pa.table([pa.array(range(len(blocks)), pa.int32()), pa.array([turn] * len(blocks), pa.int64()),
                         pa.array(blocks, pa.binary()), pa.array(hads, pa.binary())], names=["block", "turn", "data", "had"])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, _CHANGES)


def _sum_blocks(key, t):
    t = t.sort_by("turn")       # sums of floats in one order
    hads = [np.frombuffer(_swell(x), "<i8") for x in t.column("had").to_pylist()]
    had = np.sum(hads, axis=0)
    total = np.zeros((len(had), CLASSES), np.float32)
    for x, n in zip(t.column("data").to_pylist(), hads):
        total += np.frombuffer(_swell(x), "<f2").reshape(len(had), CLASSES) * (n / np.maximum(had, 1)).astype(np.float32)[:, None]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([_squeeze(total.astype("<f2").tobytes())], pa.binary()),
                     pa.array([_squeeze(had.tobytes())], pa.binary())], names=["block", "turn", "data", "had"])


def average(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Mean change of each row by its tokens: summed in groups of about TOGETHER, level by
    level, until one is left of each; the driver gets one row for each block."""
    parts = stored(parts, "changes")
    while True:
        most = parts.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
        groups = pieces(most, TOGETHER)
        turn = F.pmod(F.xxhash64("turn"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long")
        parts = stored(parts.withColumn("turn", turn).groupBy("block", "turn").applyInArrow(
            _sum_blocks, _CHANGES), "changes")
    out = np.zeros(shape, np.float32)
    for r in parts.collect():
        own = np.frombuffer(_swell(bytes(r["data"])), "<f2").reshape(-1, shape[1])
        out[r["block"] * BLOCK:r["block"] * BLOCK + len(own)] = own
    return out


_SCORED = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(spark: SparkSession, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    configure(spark)
    chunks, answers, classes, n, v, w, buckets = model(spark, prepared(docs), chunk_bytes, rounds)
    common = spark.sparkContext.broadcast(w)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Tokens.opened(left)
        count = own_counts(own, right, buckets)
        cls, leaf = classes.places(own, count)
        base = np.log10((count + 1) / (n + 1 * (v + 1)))
        inner = classes.at_leaf(cls, leaf, count)
        key, every = cls << DEPTH | leaf, np.arange(CLASSES << DEPTH)
        odds, right_side, salt, column = classes.trees.ways(every >> DEPTH, every & (1 << DEPTH) - 1)
        sign, w, tree = 1 - 2 * right_side, common.value, common.value[1 + FEATURES * ROWS:].ravel()
        score = np.empty(len(own.code))
        for i in range(0, len(own.code), BATCH):
            at = np.arange(i, min(i + BATCH, len(own.code)))
            code, seen = own.code[at], own.history(at)
            k = take(key, code)
            p = probabilities(w[0], (take(w, r) for r in class_rows(seen)))[np.arange(len(at)), take(cls, code)]
            x = tree_odds(tree, take(odds, k, axis=1), tree_places(seen, take(salt, k, axis=1), take(column, k, axis=1))[1])
            ways = np.logaddexp(0, take(sign, k, axis=1) * x).sum(axis=0, dtype=np.float64) / np.log(10)
            score[at] = np.log10(np.maximum(p, 1e-30)) - ways + inner[code]
        sums = [np.bincount(own.text, x, own.n) for x in (base[own.code], score)]
        tokens, known = np.bincount(own.text, minlength=own.n), np.bincount(own.text, count[own.code] > 0, own.n)
        return pa.table([pa.array(own.ids), pa.array(own.held), pa.array(tokens, pa.int64()), pa.array(known.astype(np.int64)),
                         pa.array([n] * own.n, pa.int64()), *map(pa.array, sums)],
                        names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, _SCORED)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = scored(spark, docs)
    return out.select(out_id(), *out.columns[1:])
