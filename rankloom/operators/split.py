"""Seeded train/val split (SPL1) with an exact val size and no global sort.

The reference shuffles example indices with a seeded RNG and takes the first
``n_val``. Here each example gets a deterministic pseudo-random key,
``md5('<seed>:<qid>')`` (tie-break by qid), and the ``n_val`` smallest keys
form the val set: same size rule, independent of partitioning, and the same
examples are val in every setup. Python's Mersenne-Twister shuffle
membership itself is not reproduced.

The cut-off is found by radix selection on the hex key, the same way at every
size: count rows per 3 further hex digits (one aggregate of at most 4096
groups), go into the bucket that holds the n_val-th key, and stop when the key
is alone in its bucket or all digits are used. Each level takes 1/4096 of the
rows before it, so a trillion rows take four. Only the counts of a level and
the cut-off key reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VAL_FRACTION = 0.05
SEED = 42
_DIGITS = 3            # hex digits per radix level (16**3 buckets)


def n_val_for(n: int, val_fraction: float = VAL_FRACTION) -> int:
    """max(1, int(n * fraction)) when n > 20, else 0 (note: fraction 0 still
    yields one val row, as in the reference)."""
    return max(1, int(n * val_fraction)) if n > 20 else 0


def split_key(qid: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), qid.cast("string")))


def _bucket_counts(keyed: DataFrame, prefix: str) -> list[tuple[str, int]]:
    """Rows per bucket of the next ``_DIGITS`` digits under ``prefix``, in key order."""
    b = F.substring("_key", 1, len(prefix) + _DIGITS)
    rows = keyed.filter(F.col("_key").startswith(prefix)).groupBy(b.alias("b")).count().collect()
    return sorted((r["b"], r["count"]) for r in rows)


def _kth_key(keyed: DataFrame, counts: list[tuple[str, int]], k: int) -> tuple[str, str]:
    """(key, qid) of the k-th smallest (1-based) by (key, qid)."""
    while True:
        for prefix, n in counts:
            if k <= n:
                break
            k -= n
        if n == 1 or len(prefix) >= 32:     # alone, or equal keys: those are ordered by qid
            row = (keyed.filter(F.col("_key").startswith(prefix)).orderBy("_key", "qid")
                   .offset(k - 1).limit(1).collect()[0])
            return row["_key"], row["qid"]
        counts = _bucket_counts(keyed, prefix)


def assign_split(canonical: DataFrame, val_fraction: float = VAL_FRACTION,
                 seed: int = SEED) -> DataFrame:
    """Adds ``split`` ('train'/'val'). ``canonical`` must be unique by qid."""
    keyed = canonical.withColumn("_key", split_key(F.col("qid"), seed))
    narrow = keyed.select("_key", "qid")
    counts = _bucket_counts(narrow, "")
    n_val = n_val_for(sum(n for _, n in counts), val_fraction)
    if n_val == 0:
        return canonical.withColumn("split", F.lit("train"))
    key, qid = _kth_key(narrow, counts, n_val)
    is_val = (F.col("_key") < F.lit(key)) | ((F.col("_key") == F.lit(key)) & (F.col("qid") <= F.lit(qid)))
    return keyed.withColumn("split", F.when(is_val, "val").otherwise("train")).drop("_key")
