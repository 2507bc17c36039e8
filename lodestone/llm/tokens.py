"""Token ids of texts by a public tokenizer file, one white-space word at a time.

The vocabulary splits texts at white space and its merges never cross a word,
so the ids of a text are those of its words in order. Words repeat, so each
Python worker keeps the ids of recent words; the library encodes the others.
"""

from __future__ import annotations

import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Words that a worker remembers, in two generations, and the longest of them in characters: memory is bounded by their product.
REMEMBERED, LONGEST = 250_000, 64
#: Bytes of an id: little-endian unsigned 32-bit.
WIDTH = 4


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Known words and their ids; others are asked of the encoder."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__({"": b""})
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        return self.ask(word)


class WordEncoder:
    """``encode(text)`` gives the ids of a text as little-endian bytes, equal to the library's ids for the whole text."""

    #: The vocabulary's split pattern (a fixed value of the file).
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.special = [str(x.content) for x in self.whole.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = _Words(self._word)
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            spelled = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode("utf-8", "surrogatepass")))
            if part.isascii() and not part.isprintable():
                spelled = "".join(map(self.letters.__getitem__, part.encode()))
            found = _packed([x.id for x in self.model.tokenize(spelled)])
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            if len(part) <= LONGEST:
                self.parts[part] = found
        return found

    def _word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if "<|" in word and any(x in word for x in self.special):
                found = _packed(self.whole.encode(word, add_special_tokens=False).ids)
            elif word.isascii() and word.isalpha():
                # one run of letters
                found = self._part(word.lower())
            elif word.isascii() and word[:-1].isalpha() and word[-1] in ".,":
                found = self._part(word[:-1].lower()) + self._part(word[-1])
            else:
                found = b"".join(map(self._part, self.SPLIT.findall("".join(_lower(c) for c in unicodedata.normalize("NFC", word)) if not word.isascii() else word.lower())))
        if len(self.words) >= REMEMBERED:
            self.older, self.words = self.words, _Words(self._word)
        if len(word) <= LONGEST:
            self.words[word] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(4096)
def _lower(letter: str) -> str:
    return letter.lower()


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    return WordEncoder(path)
