"""SentencePiece BPE ids by a table of prefixes, and texts from ids.

The best-scored merge, leftmost among equals, is applied until none is left;
that is the library's rule. Here no merge is ever applied to a text. Each prefix
of a text has one last token in its own encoding, and the encoding of a prefix
is that of the part before its last token, then this token. So one pass fills a
table: an automaton gives the pieces that end at a position, longest first, and
the one that goes with the last token before it (``goes_with``) is the entry.
Following the table backwards from the end gives the ids. Time and memory are
linear in the text, whatever its words.

Two pieces go together if no merge crosses their border while both are built up
from characters. Only the pieces at the border matter: those on the right edge
of the left piece's merges, and on the left edge of the right piece's. Walking
both edges in the order of merges, a merge across the border wins if its piece
has a better score than the next step of the left edge, and no worse one than
that of the right edge (the leftmost goes first). What a piece is merged from is
found by the same walk over its cuts, when first asked for.

A blank is written as U+2581, one is put before every text that isn't empty, and
characters that no piece has become byte pieces. No piece of this vocabulary has
U+2581 after another character, and none has a letter beside most signs, so a
text's ids are those of its parts between such borders, and workers remember
parts (words without the signs and line ends behind them); of more than
``REMEMBERED`` the older ones go when they aren't asked for again. A vocabulary that has such pieces is
taken whole text by whole text.

Null texts are encoded like empty ones: no ids. Null ids decode to null. Rows
are independent: repeated rows and null doc_ids stay as they are, other columns
of the table are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import itertools
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import kept_between_tasks, lean_batches, small_batches

BLANK = "▁"
#: Parts that a worker remembers twice over, and pairs of pieces that it has compared.
REMEMBERED = 300_000
COMPARED = 1_000_000
#: Longer parts are encoded, not remembered.
LONG = 256


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _each_byte(error):
    return "�", error.start + 1


codecs.register_error("rankloom-each-byte", _each_byte)


class Pieces:
    """The pieces of a vocabulary file: what goes with what, and surfaces."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        special = [model.is_unknown(i) or model.is_control(i) or model.is_byte(i) for i in range(n)]
        self.text = [model.id_to_piece(i) for i in range(n)]
        if any(model.is_unused(i) for i in range(n)):
            raise ValueError("vocabularies with unused pieces are not supported")
        self.id = {t: i for i, t in enumerate(self.text) if not special[i]}
        # smaller is better; equal scores have equal ranks; characters are there from the start
        ranks = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in self.id.values()}, reverse=True))}
        self.rank = [-1 if special[i] or len(self.text[i]) == 1 else ranks[model.get_score(i)] for i in range(n)]
        self.size = [len(t) for t in self.text]
        self.byte = {int(t[3:5], 16): i for i, t in enumerate(self.text) if model.is_byte(i)}
        unknown = model.decode([model.unk_id()]).encode()
        self.surface = [unknown if model.is_unknown(i) else b"" if model.is_control(i) else t.replace(BLANK, " ").encode()
                        for i, t in enumerate(self.text)]
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        self.unknown, self.control = model.unk_id(), {i for i in range(n) if model.is_control(i)}
        self.blanks_first = not any(BLANK in t.lstrip(BLANK) for t in self.id)
        self.parts = parts_of(self.id) if self.blanks_first else None
        #: id -> (pieces on its left edge, on its right edge), or None if merges never give it
        self.edges: dict[int, tuple | None] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id.items():
            if self.edges_of(i):
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        #: id -> what was compared with it as the right piece -> does it go with it
        self.compared: list[dict[int, bool]] = [{} for _ in range(n)]
        self.n_compared = 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def edges_of(self, piece: int):
        """The pieces at a piece's two ends, from its first (last) character up
        to itself, in the order in which merges make them."""
        if piece in self.edges:
            return self.edges[piece]
        text, found = self.text[piece], None
        if len(text) == 1:
            found = (piece,), (piece,)
        else:
            rank = self.rank[piece]
            for cut in range(1, len(text)):
                a, b = self.id.get(text[:cut]), self.id.get(text[cut:])
                if a is None or b is None or max(self.rank[a], self.rank[b]) > rank:
                    continue
                if self.edges_of(a) and self.edges_of(b) and self.meet(a, b):
                    found = (*self.edges_of(a)[0], piece), (*self.edges_of(b)[1], piece)
                    break
        self.edges[piece] = found
        return found

    def meet(self, a: int, b: int) -> bool:
        """Both pieces come to stand side by side, built up from characters."""
        left, right = self.edges_of(a)[1], self.edges_of(b)[0]
        text, rank, ids = self.text, self.rank, self.id
        i = j = 0
        while True:
            more_left, more_right = i + 1 < len(left), j + 1 < len(right)
            if not more_left and not more_right:
                return True
            across = ids.get(text[left[i]] + text[right[j]])
            if across is not None and not (more_left and rank[left[i + 1]] <= rank[across]) \
                    and not (more_right and rank[right[j + 1]] < rank[across]):
                return False
            if more_left and not (more_right and rank[right[j + 1]] < rank[left[i + 1]]):
                i += 1
            else:
                j += 1

    def goes_with(self, a: int, b: int) -> bool:
        if self.n_compared >= COMPARED:
            for right in self.compared:
                right.clear()
            self.n_compared = 0
        self.n_compared += 1
        self.compared[a][b] = goes = self.text[a] + self.text[b] not in self.id and self.meet(a, b)
        return goes

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix its unique last token; -1 ends in a character without a piece."""
        last = [-1] * len(text)
        size, compared, done = self.size, self.compared, -1
        for end, piece in self.automaton.iter(text):
            if end == done:
                continue
            before = end - size[piece]
            left = last[before] if before >= 0 else -1
            if left >= 0:
                goes = compared[left].get(piece)
                if goes is None:
                    goes = self.goes_with(left, piece)
                if not goes:
                    continue
            last[end] = piece
            done = end
        return last

    def part_ids(self, text: str) -> bytes:
        last, size, out, at = self.last_tokens(text), self.size, [], len(text) - 1
        while at >= 0:
            piece = last[at]
            if piece >= 0:
                out.append(piece)
                at -= size[piece]
            else:
                out.extend([self.byte[x] for x in reversed(text[at].encode())] if self.byte else [self.unknown])
                at -= 1
        out.reverse()
        return array("i", out).tobytes()

    def learned(self, part: str) -> bytes:
        """The ids of a part that isn't among the known ones."""
        ids = self.older.get(part)
        if ids is None:
            ids = self.part_ids(part)
        if len(part) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[part] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a text as native 32-bit integers."""
        if not text:
            return b""
        text = BLANK + text.replace(" ", BLANK)
        parts = self.parts(text) if self.blanks_first else [text]
        out = list(map(self.known.get, parts))
        if None in out:
            out = [self.learned(part) if ids is None else ids for part, ids in zip(parts, out)]
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        surface, control = self.surface, self.control
        out = b"".join([surface[i] for i in ids])
        if control.isdisjoint(ids):
            out = out.decode("utf-8", "rankloom-each-byte")
            first = ids[:1]
        else:  # bytes on both sides of a control piece make no character
            runs = itertools.groupby(ids, control.__contains__)
            out = "".join(b"".join([surface[i] for i in run]).decode("utf-8", "rankloom-each-byte") for cut, run in runs if not cut)
            first = [i for i in ids if i not in control][:1]
        return out[1:] if first and self.text[first[0]].startswith(BLANK) else out


def parts_of(pieces):
    """Cuts a text before U+2581, and between a character that stands beside letters in
    some piece (or beside such a one) and one that doesn't: no merge crosses there."""
    beside: dict[str, set[str]] = {}
    for t in pieces:
        for a, b in zip(t, t[1:]):
            if BLANK not in (a, b):
                beside.setdefault(a, set()).add(b)
                beside.setdefault(b, set()).add(a)
    joined, new = set(), {c for t in pieces for c in t if c.isalpha()}
    while new:
        joined |= new
        new = set().union(*(beside.get(c, ()) for c in new)) - joined
    if not joined:
        return re.compile(f"{BLANK}+[^{BLANK}]*").findall
    own = "".join(map(re.escape, sorted(joined)))
    return re.compile(f"{BLANK}+(?:[{own}]+|[^{own}{BLANK}]*)|[{own}]+|[^{own}{BLANK}]+").findall


def pieces_of(path: str) -> Pieces:
    return kept_between_tasks("pieces:" + path, lambda: Pieces(path))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    path = path or vocabulary()

    def run(batches):
        pieces = pieces_of(path)
        for b in small_batches(batches, "text"):
            ids = [pieces.ids(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(x) // 4 for x in ids])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                                  names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean_batches(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the text of each row's ids."""
    path = path or vocabulary()

    def run(batches):
        pieces = pieces_of(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                own = part.column("ids")
                values, to = own.values.to_numpy(), own.offsets.to_pylist()
                texts = [pieces.decode(values[i:j].tolist()) if there else None
                         for i, j, there in zip(to, to[1:], own.is_valid().to_pylist())]
                yield pa.record_batch([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())],
                                      names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean_batches(run), "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
