"""Per-row ranking metrics over ``struct<ids, numeric>`` rankings (MET1-7).

All metrics but Kendall tau are array expressions evaluated inside one
projection; tau is one Arrow-batched pass over all rows. Scoring never shuffles. Ids of different kinds (int vs str) never compare equal,
which reproduces Python's ``1 != "1"``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _same_kind(p: Column, g: Column) -> Column:
    return p["numeric"] == g["numeric"]


def exact_match(p: Column, g: Column) -> Column:
    """Lists equal: order and duplicates count."""
    return (_same_kind(p, g) & (p["ids"] == g["ids"])).cast("int")


def set_match(p: Column, g: Column, dp: Column | None = None, dg: Column | None = None) -> Column:
    """Same id set, order ignored (RelaxedEM). ``dp``/``dg``: precomputed
    ``array_distinct`` of the ids, if available."""
    dp = F.array_distinct(p["ids"]) if dp is None else dp
    dg = F.array_distinct(g["ids"]) if dg is None else dg
    return (_same_kind(p, g) & (F.sort_array(dp) == F.sort_array(dg))).cast("int")


def set_f1(p: Column, g: Column, dp: Column | None = None, dg: Column | None = None) -> Column:
    """F1 of the id sets; both empty -> 1.0, one empty or disjoint -> 0.0."""
    dp = F.array_distinct(p["ids"]) if dp is None else dp
    dg = F.array_distinct(g["ids"]) if dg is None else dg
    np_ = F.size(dp).cast("double")
    ng = F.size(dg).cast("double")
    inter = F.when(_same_kind(p, g), F.size(F.array_intersect(dp, dg))) \
        .otherwise(F.lit(0)).cast("double")
    precision = inter / np_
    recall = inter / ng
    return (F.when((np_ == 0) & (ng == 0), F.lit(1.0))
            .when((np_ == 0) | (ng == 0) | (inter == 0), F.lit(0.0))
            .otherwise(F.lit(2.0) * precision * recall / (precision + recall)))


def top1(p: Column, g: Column) -> Column:
    """First predicted id equals the first gold id (both non-empty)."""
    return F.coalesce(
        _same_kind(p, g)
        & (F.try_element_at(p["ids"], F.lit(1)) == F.try_element_at(g["ids"], F.lit(1))),
        F.lit(False)).cast("int")


def _flat(lists: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and place in its row of each list element, and the elements."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(rows, n), place, lists.flatten()


def _last_places(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, with the last place of each."""
    order = np.argsort(key, kind="stable")
    last = np.flatnonzero(np.concatenate((key[order][1:] != key[order][:-1], [True]))) if len(key) else np.zeros(0, np.int64)
    return key[order][last], place[order][last]


def _pairs(row: np.ndarray, *columns: np.ndarray, n_rows: int) -> np.ndarray:
    """Pairs of one row's elements that are equal in the columns, per row."""
    order = np.lexsort((*columns, row))
    new = np.concatenate(([True], np.any([x[order][1:] != x[order][:-1] for x in (row, *columns)], axis=0)))
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(row)))
    return np.bincount(row[order][start], n * (n - 1) // 2, n_rows)


def _inversions(row: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
    """Pairs i < j of one row with value[i] > value[j], per row (rows are
    consecutive): they differ first in some bit, with the 1 before the 0, so
    each bit is counted among elements that agree in the higher ones."""
    out = np.zeros(n_rows)
    order, group = np.arange(len(row)), np.concatenate(([0], np.cumsum(row[1:] != row[:-1])))
    for bit in reversed(range(int(value.max()).bit_length())):
        one = (value[order] >> bit) & 1
        ones = np.cumsum(one) - one
        first = np.concatenate(([True], group[1:] != group[:-1]))
        before = ones - np.maximum.accumulate(np.where(first, ones, 0))
        out += np.bincount(row[order], before * (1 - one), n_rows)
        part = 2 * group + one
        turn = np.argsort(part, kind="stable")
        order, part = order[turn], part[turn]
        group = np.concatenate(([0], np.cumsum(part[1:] != part[:-1])))
    return out


def tau_of_lists(pred: pa.Array, gold: pa.Array) -> pa.Array:
    """Kendall tau of each pair of id lists: over the gold ids that pred has too
    (gold duplicates kept; an id's rank is its last place), pairs in the same order
    less pairs in the other order, over their number; tied pairs count neither
    way. Null without two shared ids or a comparable pair, or for a null list.
    All rows of a batch go through one pass of O(k log k) for k ids."""
    n = len(gold)
    rows = np.arange(n)
    p_row, p_place, p_ids = _flat(pred, rows)
    g_row, g_place, g_ids = _flat(gold, rows)
    codes = pa.concat_arrays([p_ids, g_ids]).dictionary_encode()
    code = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    width = len(codes.dictionary) + 1
    p_key, g_key = p_row * width + code[:len(p_row)], g_row * width + code[len(p_row):]
    p_known, p_last = _last_places(p_key, p_place)
    g_known, g_last = _last_places(g_key, g_place)
    if not len(p_known) or not len(g_known):
        return pa.nulls(n, pa.float64())
    at = np.minimum(np.searchsorted(p_known, g_key), len(p_known) - 1)
    shared = p_known[at] == g_key
    row, g, p = g_row[shared], g_last[np.searchsorted(g_known, g_key[shared])], p_last[at[shared]]
    if not len(row):
        return pa.nulls(n, pa.float64())
    order = np.lexsort((p, g, row))
    row, g, p = row[order], g[order], p[order]
    m = np.bincount(row, minlength=n)
    apart = m * (m - 1) / 2 - _pairs(row, g, n_rows=n) - _pairs(row, p, n_rows=n) + _pairs(row, g, p, n_rows=n)
    other = _inversions(row, p, n)
    with np.errstate(invalid="ignore"):
        return pa.array((apart - 2 * other) / apart, mask=apart == 0)


def kendall_tau(p: Column, g: Column) -> Column:
    """MET6: tau of two rankings; null where they are of different kinds."""
    same = p.isNotNull() & g.isNotNull() & _same_kind(p, g)
    return F.arrow_udf(tau_of_lists, "double")(F.when(same, p["ids"]), F.when(same, g["ids"]))
