"""Python-compatible text primitives expressed as Spark Columns.

Python's ``str.strip()`` and regex ``\\s`` use Unicode whitespace, while
Spark's ``trim`` removes only the space character. Everything here stays
JVM-side (no UDF) so it runs inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points for which Python's str.isspace() is true
# (29 in all): TAB, LF, VT, FF, CR, FS, GS, RS, US, SPACE, NEL, NBSP,
# OGHAM SPACE MARK, U+2000..U+200A, LINE SEPARATOR, PARAGRAPH SEPARATOR,
# NARROW NBSP, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE.
PY_WS = "".join(chr(c) for c in (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

# The same set as a java.util.regex character class body.
WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A"
            r"\u2028\u2029\u202F\u205F\u3000")
WS = f"[{WS_CLASS}]"

# The whitespace int() skips around a number -- the isspace()
# set without the information separators U+001C..U+001F (25 code points).
INT_WS = r"[\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# A Python int() literal in base 10: optional whitespace and sign, digits
# with single underscores between them. Group 1 = sign, group 2 = digits.
_INT_TEXT = rf"^{INT_WS}*([+-]?)([0-9]+(?:_[0-9]+)*){INT_WS}*$"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(c, F.lit(PY_WS))


def py_strip_chars(c: Column, chars: str) -> Column:
    """Python ``str.strip(chars)``."""
    return F.btrim(c, F.lit(chars))


def is_blank(c: Column) -> Column:
    """True when a non-null string is empty after Python strip (null stays null)."""
    return py_strip(c) == F.lit("")


def canonical_int(sign: Column, digits: Column) -> Column:
    """Decimal text of an integer given its sign and digit string (digits may
    carry underscores and leading zeros): the form ``str(int(x))`` prints."""
    d = F.regexp_replace(F.regexp_replace(digits, "_", ""), "^0+(?=[0-9])", "")
    return F.when((sign == F.lit("-")) & (d != F.lit("0")), F.concat(F.lit("-"), d)).otherwise(d)


def int_text(c: Column) -> Column:
    """``str(int(s))`` for a string ``s`` accepted by Python's ``int()``, else null.

    Unicode (non-ASCII) decimal digits are not accepted (documented deviation)."""
    # canonical decimal text (the common case) round-trips through bigint
    plain = c.try_cast("bigint").cast("string") == c
    ok = c.rlike(_INT_TEXT)
    return (F.when(F.coalesce(plain, F.lit(False)), c)
            .when(ok, canonical_int(F.regexp_extract(c, _INT_TEXT, 1),
                                    F.regexp_extract(c, _INT_TEXT, 2))))


def greedy_block(c: Column) -> Column:
    """First ``{`` to last ``}`` (dot matches newline); empty string when absent."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def lazy_blocks(c: Column) -> Column:
    """All non-overlapping ``{...}`` blocks, each ending at its first ``}``."""
    return F.regexp_extract_all(c, F.lit(r"(?s)\{.*?\}"), F.lit(0))


def strict_json(c: Column) -> Column:
    """``try_parse_json`` that, like Python ``json.loads``, rejects trailing text.

    ``try_parse_json`` stops after the first complete value; wrapping the
    text in an array and in an object exposes any garbage after it."""
    as_array = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    n = F.size(as_array.cast("array<variant>"))
    in_obj = F.try_parse_json(F.concat(F.lit('{"r":'), c, F.lit("}")))
    return F.when((n == 1) & in_obj.isNotNull(), F.try_parse_json(c))
