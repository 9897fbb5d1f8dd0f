"""Ranking extraction: free text (or a native array) -> ``struct<ids, numeric>``.

A ranking is a list of ids. The source coerces a list to integers
all-or-nothing: when every element passes ``int()`` the list is numeric,
otherwise *every* element becomes ``str(x).strip()``. We keep the ids as
canonical text plus a ``numeric`` flag, which makes equality type-sensitive
exactly like comparing Python ints with Python strings. ``null`` means
"unparseable".

Everything is built from Spark built-ins (regex, variant, higher-order
functions): no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from rankloom.functions.text import (WS, canonical_int, int_text, lazy_blocks,
                                     py_strip, py_strip_chars)
from rankloom.session import cached_column

RANKING_TYPE = "struct<ids:array<string>,numeric:boolean>"

_INTEGRAL = ("BIGINT", "INT", "SMALLINT", "TINYINT")
# First bare list after the key, used when no {...} block parses.
_BARE_LIST = r'(?s)"ranked_tables"' + WS + r"*:" + WS + r"*\[([^\]]*)\]"


def elem_info(e: Column) -> Column:
    """Decode a JSON element once: its type name and string/double/boolean views."""
    return F.struct(F.schema_of_variant(e).alias("t"),
                    F.try_variant_get(e, "$", "string").alias("s"),
                    F.try_variant_get(e, "$", "double").alias("d"),
                    F.try_variant_get(e, "$", "boolean").alias("b"),
                    F.when(~F.schema_of_variant(e).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE"
                                                         "|FLOAT|BOOLEAN|STRING|VOID)"),
                           F.to_json(e)).alias("j"))


def _elem_int(x: Column) -> Column:
    """``str(int(v))`` of a decoded JSON element, or null when ``int(v)`` fails."""
    t, s, d = x["t"], x["s"], x["d"]
    return (F.when(t.isin(*_INTEGRAL), s)
            .when(t.startswith("DECIMAL"),
                  canonical_int(F.regexp_extract(s, r"^(-?)", 1),
                                F.regexp_extract(s, r"^-?([0-9]+)", 1)))
            .when(t.isin("DOUBLE", "FLOAT"),
                  F.coalesce(d.try_cast("bigint").cast("string"),
                             d.try_cast("decimal(38,0)").cast("string")))
            .when(t == "BOOLEAN", F.when(x["b"], F.lit("1")).otherwise(F.lit("0")))
            .when(t == "STRING", int_text(s)))


def _elem_str(x: Column) -> Column:
    """``str(v).strip()`` of a decoded JSON element (Python rendering of scalars).

    Floats render through Spark's double formatting, which equals Python's
    ``repr`` for 1e-3 <= |v| < 1e7; nested lists/objects render as compact
    JSON instead of Python's repr (documented deviations)."""
    t, s, d = x["t"], x["s"], x["d"]
    big_int = t.rlike(r"^DECIMAL\((19|[2-9][0-9]|[1-9][0-9]{2,}),0\)$")
    return (F.when(t == "STRING", py_strip(s))
            .when(t.isin(*_INTEGRAL) | big_int, s)
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), d.cast("string"))
            .when(t == "BOOLEAN", F.when(x["b"], F.lit("True")).otherwise(F.lit("False")))
            .when(t == "VOID", F.lit("None"))
            .otherwise(x["j"]))


def _coerce(items: Column, as_int, as_str) -> Column:
    """All-or-nothing integer coercion of an array -> ranking struct."""
    ints = F.transform(items, as_int)
    numeric = F.forall(ints, lambda x: x.isNotNull())
    ids = F.when(numeric, ints).otherwise(F.transform(items, as_str))
    return F.struct(ids.alias("ids"), numeric.alias("numeric"))


def _bare_list_items(text: Column) -> Column:
    """Fallback: items of the first bare ``"ranked_tables": [...]`` list."""
    inner = F.regexp_extract(text, _BARE_LIST, 1)
    parts = F.filter(F.split(inner, ","), lambda p: py_strip(p) != F.lit(""))
    return F.transform(parts, lambda p: py_strip_chars(py_strip(p), "\"'"))


_JWS = r"[ \t\n\r]*"
_JSON_INT = r"-?(?:0|[1-9][0-9]*)"
_JSON_COMMA = _JWS + "," + _JWS
_SIMPLE_BLOCK = (r"^\{" + _JWS + r"\"ranked_tables\"" + _JWS + ":" + _JWS + r"\[" + _JWS
                 + f"({_JSON_INT}(?:{_JSON_COMMA}{_JSON_INT})*+)" + _JWS + r"\]" + _JWS + r"\}$")


def _valid_lists_of(blocks: Column) -> Column:
    """``ranked_tables`` values (as variants) of the {...} blocks that parse
    and hold a non-empty list under that key, in text order."""
    vals = F.transform(blocks,
                       lambda b: F.try_variant_get(F.try_parse_json(b), "$.ranked_tables", "variant"))
    return F.filter(vals, lambda v: F.coalesce(
        F.size(F.try_variant_get(v, "$", "array<variant>")) > 0, F.lit(False)))


def _simple_ids(blocks: Column) -> Column:
    """Ids of the last block when it is a plain ``{"ranked_tables": [ints]}``
    object (then it is valid, hence the answer; no JSON parser needed)."""
    last = F.try_element_at(blocks, F.lit(-1))
    return F.when(last.rlike(_SIMPLE_BLOCK), F.transform(
        F.split(F.regexp_extract(last, _SIMPLE_BLOCK, 1), _JSON_COMMA),
        lambda x: F.when(x == "-0", F.lit("0")).otherwise(x)))


def _general(text: Column, blocks: Column) -> Column:
    """Full rules for the rows off the fast path: last strictly-parsing block
    with a non-empty list (elements decoded once each), else the first bare
    list; then all-or-nothing int coercion."""
    arr = F.try_variant_get(F.try_element_at(_valid_lists_of(blocks), F.lit(-1)), "$", "array<variant>")
    items = _bare_list_items(text)
    return (F.when(arr.isNotNull(), _coerce(F.transform(arr, elem_info), _elem_int, _elem_str))
            .when(F.size(items) > 0, _coerce(items, int_text, py_strip)))


def parse_ranking(text: Column) -> Column:
    """Extract a ranking from model/gold text (RNK1-4, RNK6).

    1. the last lazy ``{...}`` block that strictly parses and has a non-empty
       ``ranked_tables`` list; else
    2. the first bare ``"ranked_tables": [...]`` list, split on commas;
    3. empty -> null; then all-or-nothing int coercion.
    """
    text = text.cast("string")
    blocks = lazy_blocks(text)
    simple = _simple_ids(blocks)
    return (F.when(text.isNull(), F.lit(None).cast(RANKING_TYPE))
            .when(simple.isNotNull(), F.struct(simple.alias("ids"), F.lit(True).alias("numeric")))
            .otherwise(_general(text, blocks)))


def with_rankings(df: DataFrame, texts: dict[str, str], keep: list[str]) -> DataFrame:
    """``parse_ranking`` for several text columns as staged projections: the
    block list and the plain-list fast path are computed once as columns; the
    general rules sit in a CASE branch that only rows off the fast path
    evaluate (CASE branches are lazy), so common rows never reach the JSON
    parser and the rare ones pay for the full rules alone."""
    cur = df.select(*keep, *texts.values(),
                    *[_blocks_expr(t).alias(f"_blocks_{o}") for o, t in texts.items()])
    cur = cur.select(*keep, *texts.values(), *[f"_blocks_{o}" for o in texts],
                     *[_simple_expr(f"_blocks_{o}").alias(f"_simple_{o}") for o in texts])
    return cur.select(*keep, *[_final_expr(o, t).alias(o) for o, t in texts.items()])


@cached_column
def _blocks_expr(text_col: str) -> Column:
    return lazy_blocks(F.col(text_col).cast("string"))


@cached_column
def _simple_expr(blocks_col: str) -> Column:
    return _simple_ids(F.col(blocks_col))


@cached_column
def _final_expr(o: str, t: str) -> Column:
    text, simple = F.col(t).cast("string"), F.col(f"_simple_{o}")
    return (F.when(text.isNull(), F.lit(None).cast(RANKING_TYPE))
            .when(simple.isNotNull(), F.struct(simple.alias("ids"), F.lit(True).alias("numeric")))
            .otherwise(_general(text, F.col(f"_blocks_{o}"))))


def ranking_from_variant_array(arr: Column) -> Column:
    """Ranking of a native JSON list (``array<variant>``): no text parsing;
    an empty list is a valid ranking."""
    return F.when(arr.isNotNull(), _coerce(F.transform(arr, elem_info), _elem_int, _elem_str))


def ranking_from_variant(v: Column) -> Column:
    """RNK5/RNK6 for a JSON value: strings are parsed as text, lists are used
    natively, anything else is unparseable."""
    t = F.schema_of_variant(v)
    return (F.when(t == "STRING", parse_ranking(F.try_variant_get(v, "$", "string")))
            .when(t.startswith("ARRAY"),
                  ranking_from_variant_array(F.try_variant_get(v, "$", "array<variant>"))))


def ranking_from_array(arr: Column, element_type: DataType | None = None) -> Column:
    """Ranking of a native array column (RNK5): no text parsing, and an empty
    array is a valid (numeric) ranking. String elements follow ``int()``'s
    text rules; fractional numbers truncate toward zero; null elements make
    the list fall back to strings (``"None"``)."""
    name = element_type.typeName() if element_type is not None else "string"
    if name == "string":
        as_int, as_str = int_text, py_strip
    elif name == "boolean":
        def as_int(x):
            return F.when(x, F.lit("1")).when(~x, F.lit("0"))

        def as_str(x):
            return F.when(x, F.lit("True")).when(~x, F.lit("False")).otherwise(F.lit("None"))
    else:
        fractional = name in ("double", "float") or name.startswith("decimal")

        def as_int(x):
            if fractional:
                return F.coalesce(x.try_cast("bigint").cast("string"),
                                  x.try_cast("decimal(38,0)").cast("string"))
            return x.cast("string")

        def as_str(x):
            return F.coalesce(x.cast("string"), F.lit("None"))
    return F.when(arr.isNull(), F.lit(None).cast(RANKING_TYPE)).otherwise(
        _coerce(arr, as_int, as_str))
