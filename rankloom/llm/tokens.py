"""Token ids by a vocabulary file, with each worker remembering the words it has
seen: the file's white space is dropped between words, so the ids of a text are
those of its blank-separated parts, one after another."""

from __future__ import annotations

import re
from array import array

import numpy as np

from rankloom.llm.common import kept_between_tasks

#: Words that a worker remembers where no other number is given; beyond it starts
#: afresh (ids stay the same). They take about 160 MB of it.
REMEMBERED = 500_000
#: Words of these alone fall into runs of letters, digits and runs of symbols by
#: the file's split rule (no apostrophes, nor what special tokens begin with),
#: and lower-casing and composing them is the same in any library.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SYMBOLS = r"!-&(-/:;=-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_SYMBOLS}\t-\r]*").fullmatch
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SYMBOLS}]+").findall


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself,
    the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Known(dict):
    """Ids of words and of their parts, as bytes, found when first asked for."""

    def __init__(self, path: str):
        self.remembered = REMEMBERED
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if _PLAIN(word):
            parts = self.parts
            out = b"".join([parts[x] if x in parts else self.part(x) for x in _PARTS(word.lower())])
        else:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.remembered:
            self.clear()
        self[word] = out
        return out

    def part(self, x: str) -> bytes:
        spelled = x if x.isascii() else x.encode().decode("latin-1").translate(self.letters)
        out = array("I", [t.id for t in self.merge(spelled)]).tobytes()
        if len(self.parts) >= self.remembered:
            self.parts.clear()
        self.parts[x] = out
        return out


class WordEncoder:
    """ids(text) as little-endian 32-bit bytes, equal to the library's encode(text).ids."""

    def __init__(self, path: str):
        self.known = Known(path)

    def ids(self, texts: list[str]):
        known = self.known
        for t in texts:
            yield b"".join([known[w] for w in t.split(" ")])


def encoder(path: str, remembered: int | None = None) -> WordEncoder:
    own = kept_between_tasks("words:" + path, lambda: WordEncoder(path))
    own.known.remembered = remembered or REMEMBERED
    return own
