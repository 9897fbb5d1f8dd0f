"""Operator 7: bound-certified best-fit packing into fixed-size sequences.

Each text becomes token ids and the end id; only what is longer than a
sequence is cut. The pieces (ids and lengths alone) are dealt over partitions;
each packs its own best-fit decreasing and computes a lower bound on its
sequences from dual-feasible functions. Where count and bound agree, the
partition is certified and its sequences are final but for the emptiest one. The
others hand in more of their emptiest sequences. Those are dealt anew over fewer
partitions and packed again, until one partition has packed all that is left.
A partition keeps what it was given if packing again gives no fewer sequences.

Nulls and empty texts are one end id; repeated rows are pieces of their own;
null ids are kept; an empty table gives no rows; a very long text gives as many
pieces as it needs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import configure, id_text, lean_batches, out_id, pieces, small_batches, stored
from rankloom.llm.tokens import encoder, vocabulary

SEQUENCE, END_ID = 4096, 1
#: Pieces that one partition packs; sequences handed in for each that the bound
#: says may be too many (beside the emptiest one).
PART_PIECES, HANDED_IN = 40_000, 8
#: After so many exchanges every partition's sequences are final.
ROUNDS = 40
ITEM = "id long, piece int, start long, length long, ids_crc32 long, row long"


def cut_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE,
                  end_id: int = END_ID, remembered: int | None = None) -> DataFrame:
    """id, piece, start, length, ids_crc32 of each piece; row tells apart pieces
    of repeated rows. ``remembered``: words that a worker remembers."""
    path = tokenizer or vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 33
        enc = encoder(path, remembered)
        for b in small_batches(batches, "text"):
            out = []
            for d, ids in zip(b.column("id").to_pylist(), enc.ids(b.column("text").to_pylist())):
                ids += end
                for k in range(0, len(ids), 4 * size):
                    own = ids[k:k + 4 * size]
                    out.append((d, k // (4 * size), k // 4, len(own) // 4, zlib.crc32(own), row))
                    row += 1
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=["id", "piece", "start", "length", "ids_crc32", "row"])

    return id_text(docs).mapInArrow(lean_batches(cut), ITEM)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin number of each length: longest first, into the fullest bin it fits."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some open bin has r left
    n = 0
    for i, x in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            own = by_room[r]
            b = own.pop()
            if not own:
                rooms &= ~(1 << r)
        else:
            b, r = n, size
            n += 1
        bins[i] = b
        if r > x:
            by_room[r - x].append(b)
            rooms |= 1 << (r - x)
    return bins


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Most of the bounds by two families of dual-feasible functions over
    lengths/size: u_k rounds down to multiples of 1/k where (k+1)x isn't whole;
    f_e sets x to 1 above 1-e, to 0 below e."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int(count @ x) // size)
    for k in range(1, 41):
        whole = (k + 1) * x % size == 0
        # k * size * u_k(x), in whole numbers
        u = np.where(whole, k * x, (k + 1) * x // size * size)
        best = max(best, -(-int(count @ u) // (k * size)))
    number, total = np.cumsum(count), np.cumsum(count * x)
    for e in range(1, size // 2 + 1):
        big = int(number[-1] - number[size - e])
        mid = int(total[size - e] - total[e - 1])
        best = max(best, big + -(-mid // size))
    return best


def packer(size: int, handed_in: int, stamp: int, last: bool):
    """The packing of one partition in round ``stamp``."""
    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins = best_fit_decreasing(lengths, size)
        n = int(bins.max()) + 1
        old = np.unique(pdf["old"].to_numpy(), return_inverse=True)
        if stamp and n >= len(old[0]):
            bins, n = old[1], len(old[0])
        gap = n - lower_bound(lengths, size)
        used = np.bincount(bins, lengths, n).astype(np.int64)
        done = np.ones(n, bool)
        if not last:
            # a certified partition hands in its emptiest sequence only, unless that is full
            emptiest = np.argsort(used, kind="stable")[:1 + max(0, gap) * handed_in]
            done[emptiest[used[emptiest] < size]] = False
        order = np.argsort(bins, kind="stable")
        run = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate(([0], np.cumsum(used)))[:-1]
        offset = np.empty(len(pdf), np.int64)
        offset[order] = run - first[bins[order]]
        # round, partition, bin: 6, 25 and 32 bits
        pdf["sequence_id"] = (np.int64(stamp) << 57) | (np.int64(key[0]) << 32) | bins
        pdf["offset"], pdf["done"], pdf["old"] = offset, done[bins], pdf["sequence_id"]
        return pdf.drop(columns="part")

    return one


def pack(spark: SparkSession, items: DataFrame, size: int = SEQUENCE, part_pieces: int = PART_PIECES,
         handed_in: int = HANDED_IN) -> DataFrame:
    """items with sequence_id and offset added. Each round's sequences are
    written to the shared folder; only counts reach the driver."""
    configure(spark)
    items = stored(items.withColumn("old", F.lit(-1).cast("long")), "pieces")
    left, rounds, packed = items.count(), 0, None
    schema = ITEM + ", old long, sequence_id long, offset long, done boolean"
    while left:
        parts = pieces(left, part_pieces)
        one = packer(size, handed_in, rounds, last=parts == 1 or rounds == ROUNDS)

        # whole sequences move, so that what was packed together can stay
        deal = F.when(F.col("old") < 0, F.xxhash64("row", F.lit(rounds))).otherwise(F.xxhash64("old", F.lit(rounds)))
        out = stored(items.withColumn("part", F.pmod(deal, F.lit(parts)))
                          .groupBy("part").applyInPandas(one, schema), "packed")
        ready = out.filter("done")
        packed = ready if packed is None else packed.unionByName(ready)
        items = out.filter("NOT done").drop("sequence_id", "offset", "done")
        left = items.count()
        rounds += 1
    cols = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if packed is None:
        return items.select(out_id(), *cols[:4], F.lit(0).cast("long").alias("sequence_id"),
                            F.lit(0).cast("long").alias("offset"))
    return packed.select(out_id(), *cols)


def pack_documents(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    cut = {k: how.pop(k) for k in ("tokenizer", "end_id", "remembered") if k in how}
    return pack(spark, cut_documents(docs, size=how.get("size", SEQUENCE), **cut), **how)
