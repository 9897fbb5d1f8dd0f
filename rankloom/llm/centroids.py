"""Centroid clustering in integers, with a LAESA table of pivot distances.

A vector is kept if it has exactly ``DIM`` components, none of them null or
non-finite; component x becomes floor(64 * x). The first centroids are the kept
vectors with the smallest SHA-256 of ``1:<vec_id>``; they are the pivots, too.
Every vector's distances to the pivots are worked out once and stored beside it.
In each round |d(v, p) - d(c, p)| <= d(v, c) bounds the distance to each
centroid c from below, over all pivots p, without touching the vector. The
centroid with the least bound gets an exact integer distance first; of the
others only those whose bound doesn't exceed the best distance so far. Bounds are
floats and are lowered by more than their rounding error, so no centroid is lost,
and distances, ties (the smaller number wins) and means are exact.

A task hands in count and component sums of each centroid, so a round moves
some thousand numbers a task, whatever a cluster's size, and the driver gets one
row a centroid and component. The vectors are not shuffled.

Null vec_ids are kept and never become centroids. Of repeated vec_ids, or equal
hashes, the vector that is smaller component by component comes first as a
centroid; repeated vectors give equal centroids, of which the smaller number wins
all ties, and an empty cluster keeps its centroid. With fewer kept vectors than
centroids there are as many centroids as vectors with an id. No kept vector with
an id gives an empty result. Integer components beyond 2^27 are an error, since
squared distances would not fit into a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored

DIM, CENTROIDS, ROUNDS = 64, 16, 3
#: Vectors that are compared at a time.
BLOCK = 8192
LARGEST = 1 << 27
#: Bounds are lowered by this part of what they are made of: distances are
#: stored in 24 bits.
SLACK = 2.0 ** -22


def kept(embeddings: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, v): integer vectors."""
    x = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = x.filter((F.size("e") == dim) & F.coalesce(finite, F.lit(False)))
    def whole(c):
        ok = F.abs(c) * 64 <= float(LARGEST)
        return F.floor(64 * F.when(ok, c).otherwise(F.raise_error(F.lit("component beyond 2^27")).cast("double"))).cast("int")

    return x.select("vec_id", F.transform("e", whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in their order."""
    hashed = vectors.filter("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    rows = hashed.orderBy("h", "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(kind)


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The table with each vector's distances to the pivots."""
    width = pivots.shape[1]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                v = _matrix(part.column("v"), width, np.int64)
                table = np.sqrt(np.stack([_squares(v, p) for p in pivots], 1)).astype(np.float32)
                ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots))
                yield pa.record_batch([part.column("vec_id"), part.column("v"), pa.ListArray.from_arrays(ends, pa.array(table.ravel()))],
                                      names=["vec_id", "v", "p"])

    return vectors.mapInArrow(run, "vec_id long, v array<int>, p array<float>")


def nearest(v: np.ndarray, p: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how
    many exact distances it took. ``p`` holds the vectors' distances to the
    pivots, ``to_pivots`` the centroids'."""
    n, k = len(v), len(centroids)
    bound = np.zeros((n, k))
    for j in range(p.shape[1]):
        a, b = p[:, j:j + 1], to_pivots[None, :, j]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    order = np.argsort(bound, 1, kind="stable")
    best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    root, left, exact = np.full(n, np.inf), np.arange(n), 0
    for step in range(k):
        c = order[left, step]
        open_ = bound[left, c] <= root[left]
        left, c = left[open_], c[open_]
        if not len(left):
            break
        exact += len(left)
        d = _squares(v[left], centroids[c])
        better = (d < best[left]) | ((d == best[left]) & (c < at[left]))
        won = left[better]
        best[won], at[won] = d[better], c[better]
        root[won] = np.sqrt(best[won]) * (1 + SLACK)
    return at, best, exact


def _pivot_distances(centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([_squares(centroids, p) for p in pivots], 1).astype(np.float64))


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: the floor of each cluster's mean; empty clusters stay."""
    k, width = centroids.shape
    to_pivots = _pivot_distances(centroids, pivots)

    def run(batches):
        sums, counts = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                v = _matrix(part.column("v"), width, np.int64)
                c, _, _ = nearest(v, _matrix(part.column("p"), len(pivots), np.float64), centroids, to_pivots)
                counts += np.bincount(c, minlength=k)
                for j in np.unique(c):
                    sums[j] += v[c == j].sum(0)
        own = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.repeat(own, width)), pa.array(np.tile(np.arange(width), len(own))),
                               pa.array(np.repeat(counts[own], width)), pa.array(sums[own].ravel())], names=["c", "i", "n", "s"])

    parts = table.select("v", "p").mapInArrow(run, "c long, i long, n long, s long")
    new = centroids.copy()
    for r in parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        new[r["c"], r["i"]] = int(r["s"]) // r["n"]
    return new


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    width, to_pivots = centroids.shape[1], _pivot_distances(centroids, pivots)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                c, d, _ = nearest(_matrix(part.column("v"), width, np.int64), _matrix(part.column("p"), len(pivots), np.float64), centroids, to_pivots)
                yield pa.record_batch([part.column("vec_id"), pa.array(c, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """Every kept vector's (vec_id, cluster, distance), and the final centroids."""
    vectors = kept(embeddings, dim)
    pivots = first_centroids(vectors, k)
    if not len(pivots):
        return embeddings.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), pivots
    table = stored(with_pivots(vectors, pivots), "pivots")
    centroids = pivots
    for _ in range(rounds):
        centroids = moved(table, centroids, pivots)
    return stored(assigned(table, centroids, pivots), "assigned"), centroids


def digest(embeddings: DataFrame) -> DataFrame:
    result, centroids = cluster(embeddings)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    totals = {r["cluster"]: int(r["s"]) for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def of_cluster(values, kind):
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1) if values else F.lit(None).cast(kind)

    return result.select("vec_id", "cluster", "distance", of_cluster([totals.get(c, 0) for c in range(len(shas))], "long").alias("cluster_inertia"),
                         F.lit(sum(totals.values())).cast("long").alias("inertia"), of_cluster(shas, "string").alias("centroid_sha256"))
