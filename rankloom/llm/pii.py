"""Operator 10: personal data by proposal, validation and context.

Regular expressions propose spans, validators (number ranges, Luhn, digit
counts, mod-97) confirm them, and words nearby move each span's score. Base
kinds (email, ip, card, phone) stay whatever their score; added kinds (iban,
ssn) stay from ``KEEP`` upwards. An account number is as long as its country's
are, so what follows it doesn't matter; context words count as whole words. Offsets count code points.

Null texts count as empty and give no spans; repeated rows stay rows of their
own; an empty table gives no rows. Each expression takes time in proportion to
the text, so very long ones are searched whole.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import configure, id_text, lean_batches, out_id, small_batches

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
KEEP, NEAR = 0.6, 48
# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
TOUCHING = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
# A leftmost match starts where its run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Characters of an account number by country, fixed values of the public registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
# Only the start: how far it goes is its country's to say.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Score of a validated span of each kind, and words that raise it by 0.3.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "email", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "telephone", "call", "tel", "fax", "mobile"),
    "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social security"),
}
#: Whole words, with a plural; a span's other neighbours may be anything.
NEARBY = {k: re.compile(rf"(?<![a-z0-9])(?:{'|'.join(v)})s?(?![a-z0-9])") for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def iban_end(text: str, start: int) -> int:
    """Where an account number that starts here ends by its country's length, or 0:
    capital letters and digits, run together or in blocks of four parted by
    single spaces, and no letter or digit right behind."""
    left = IBAN_LENGTHS.get(text[start:start + 2], 0)
    at, spaced = start, text[start + 4:start + 5] == " "
    while left:
        block = min(4, left) if spaced else left
        part = text[at:at + block]
        if len(part) < block or not ALNUM.issuperset(part):
            return 0
        at, left = at + block, left - block
        if left:
            if text[at:at + 1] != " ":
                return 0
            at += 1
    return 0 if at == start or text[at:at + 1] in TOUCHING else at


def emails(text: str):
    """Leftmost matches, found from each @ backwards so that long runs cost their length once."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def proposals(text: str):
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "." in text:
        for m in IP.finditer(text):
            parts = m[0].split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts):
                yield "ip", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    end = 0
    for m in IBAN.finditer(text):
        if m.start() >= end and (stop := iban_end(text, m.start())) and mod97(text[m.start():stop]):
            end = stop
            yield "iban", m.start(), stop
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind."""
    out = []
    for kind, a, b in proposals(text):
        around = (text[max(0, a - NEAR):a] + " " + text[b:b + NEAR]).lower()
        score = min(1.0, SCORES[kind] + 0.3 * bool(NEARBY[kind].search(around)))
        if kind in BASE or score >= KEEP:
            out.append((kind, a, b, score))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """(id, spans) of each text."""
    configure(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in small_batches(batches, "text"):
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(spans, kind)], names=["id", "spans"])

    return id_text(docs).mapInArrow(lean_batches(run), f"id long, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    def joined(spans):
        one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(one, ",")

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    def count(kind):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(out_id(), *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(spans).alias("spans"))


def redacted(text: str) -> str:
    out, end = [], 0
    for kind, a, b, _ in find(text):
        if b <= end:
            continue
        out.append(text[end:max(a, end)])
        if a >= end:
            out.append(f"<{kind.upper()}>")
        end = b
    return "".join(out) + text[end:]


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with each span replaced by its kind in angle
    brackets, and n_chars (where there is one) counted anew for changed texts."""
    configure(docs.sparkSession)
    i = docs.columns.index("text")

    def run(batches):
        for b in small_batches(batches, "text"):
            texts = [None if t is None else redacted(t) for t in b.column(i).to_pylist()]
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    out = docs.mapInArrow(lean_batches(run), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(kind))
    return out
