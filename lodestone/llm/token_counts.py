"""Edit-aware token counts: a stored segment tree of pre-token counts for each document.

Pre-tokens are what the vocabulary's pattern splits a text into; merges never
cross them, so a document's count is the sum of its pre-tokens' counts. A tree's
slots hold up to BLOCK pre-tokens each, with their text, and above them lie sums
of characters and tokens, pairwise up to the root. ``build`` encodes texts once
and gives a table of trees that is kept; ``apply_edits`` reads it back. An edit
descends to the first slot it can change, opens the slots it touches, re-splits
from the first pre-token that can see it (the pattern looks one character beyond
a pre-token and the next) until a split falls on an old one beyond it, encodes
those pre-tokens again, and updates the sums above the touched slots. Other
slots are never opened.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common

#: Pre-tokens in a slot of a new tree; a slot that edits make this many times larger is cut anew, with its tree.
BLOCK, GROWN = 64, 16
#: Characters beyond a split that can move it: the pattern's longest contraction, and the character after white space.
SIGHT = 4
#: Characters of the pre-tokens whose counts a worker remembers.
REMEMBERED = 1_500_000


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    return public_tokenizers.path(name)


class Counter:
    """``count(pre_token)`` and ``split``, by a file of byte-pair ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.held = 0

    def count(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            found = len(self.encoding.encode_ordinary(piece))
            if self.held + len(piece) > REMEMBERED:
                self.known.clear()
                self.held = 0
            if len(piece) <= 64:
                self.known[piece] = found
                self.held += len(piece)
        return found

    def leaves(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """(characters, tokens) of the pre-tokens of ``text`` from ``start`` on."""
        for m in self.pattern.finditer(text, start):
            yield m.end() - m.start(), self.count(m.group())


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


Slot = tuple[str, list[int], list[int]]


def slots_of(text: str, counts: Counter) -> list[Slot]:
    """The slots (text, characters and tokens of each pre-token) of a new tree."""
    pieces, out = counts.pattern.findall(text), []
    known, count = counts.known, counts.count
    # most pieces are remembered; the others are counted, and remembered then
    sizes = [known[p] if p in known else count(p) for p in pieces]
    for i in range(0, len(pieces), BLOCK):
        block = pieces[i : i + BLOCK]
        out.append(("".join(block), list(map(len, block)), sizes[i : i + BLOCK]))
    return out


class Tree:
    """A segment tree over slots; ``opened`` reads slot i and is asked for touched slots only."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray, leaves: np.ndarray, opened: Callable[[int], Slot], counts: Counter):
        self.opened, self.counts, self.encoded = opened, counts, 0
        self.slots: dict[int, Slot] = {}
        self.n = len(chars)
        self.base = 1 << max(0, self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.base, 3), np.int64)
        self.sums[self.base : self.base + self.n] = np.stack([chars, tokens, leaves], axis=1)
        at = self.base
        while at > 1:
            self.sums[at // 2 : at] = self.sums[at : 2 * at : 2] + self.sums[at + 1 : 2 * at : 2]
            at //= 2

    @classmethod
    def of(cls, text: str, counts: Counter) -> Tree:
        slots = slots_of(text, counts)
        sizes = np.array([(sum(c), sum(n), len(c)) for _, c, n in slots], np.int64).reshape(-1, 3)
        return cls(*sizes.T, slots.__getitem__, counts)

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def n_leaves(self) -> int:
        return int(self.sums[1, 2])

    def slot(self, i: int) -> Slot:
        if i not in self.slots:
            self.slots[i] = self.opened(i)
        return self.slots[i]

    @property
    def text(self) -> str:
        return "".join(self.slot(i)[0] for i in range(self.n))

    def _seek(self, at: int) -> tuple[int, int]:
        """(slot, its first character) of the first slot with characters that ends at or after ``at``; the last such slot if none does."""
        node, start, at = 1, 0, max(1, min(at, self.n_chars))
        while node < self.base:
            node *= 2
            if start + self.sums[node, 0] < at:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.base, start

    def _put(self, i: int, slot: Slot) -> None:
        """Replace slot i and add up the sums on its path to the root."""
        self.slots[i] = slot
        node = self.base + i
        self.sums[node] = len(slot[0]), sum(slot[2]), len(slot[1])
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end) by ``new``; returns the characters that were encoded again."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        if not self.n_chars:
            fresh = Tree.of(new, self.counts)
            self.__dict__.update({**fresh.__dict__, "encoded": self.encoded + len(new)})
            return len(new)
        first, begin = self._seek(start - 1)
        last, reach = first, begin + len(self.slot(first)[0])
        shift = len(new) - (end - start)
        while True:
            # slots first to last are open; the window ends at reach
            while reach < end and last + 1 < self.n:
                last += 1
                reach += len(self.slot(last)[0])
            done = self._resplit(first, last, begin, reach, start, end, new, shift)
            if done is not None:
                break
            last += 1
            reach += len(self.slot(last)[0])
        slot, encoded = done
        self._put(first, slot)
        for i in range(first + 1, last + 1):
            if self.sums[self.base + i, 0]:
                self._put(i, ("", [], []))
        self.encoded += encoded
        if len(slot[1]) > GROWN * BLOCK or not self.n_chars:
            self._cut_anew()
        return encoded

    def _resplit(self, first: int, last: int, begin: int, reach: int, start: int, end: int, new: str, shift: int) -> tuple[Slot, int] | None:
        """The slot that the window's slots become after the edit, and the characters encoded; None if the window is too short to tell."""
        old = [self.slot(i) for i in range(first, last + 1)]
        text = "".join(x[0] for x in old)
        chars, tokens = [c for x in old for c in x[1]], [n for x in old for n in x[2]]
        text = text[: start - begin] + new + text[end - begin :]
        ends_text = reach == self.n_chars
        # pre-tokens that end before the character before the edit can't see it
        keep, at = 0, 0
        while keep < len(chars) and begin + at + chars[keep] < start - 1:
            at += chars[keep]
            keep += 1
        where, j, place = at, keep, at
        made: list[tuple[int, int]] = []
        limit = start - begin + len(new)
        for n, size in self.counts.leaves(text, at):
            while place + shift < at and j < len(chars):
                place += chars[j]
                j += 1
            if at >= limit and place + shift == at and begin + place >= end:
                break
            if not ends_text and at + n > len(text) - SIGHT:
                return None
            made.append((n, size))
            at += n
        else:
            if not ends_text:
                return None
            j = len(chars)
        c = chars[:keep] + [n for n, _ in made] + chars[j:]
        t = tokens[:keep] + [n for _, n in made] + tokens[j:]
        return (text, c, t), at - where

    def _cut_anew(self) -> None:
        """New slots of BLOCK pre-tokens from those there are; nothing is encoded."""
        slots = []
        for i in range(self.n):
            text, chars, tokens = self.slot(i)
            at = 0
            for k in range(0, len(chars), BLOCK):
                size = sum(chars[k : k + BLOCK])
                slots.append((text[at : at + size], chars[k : k + BLOCK], tokens[k : k + BLOCK]))
                at += size
        sizes = np.array([(sum(c), sum(n), len(c)) for _, c, n in slots], np.int64).reshape(-1, 3)
        fresh = Tree(*sizes.T, slots.__getitem__, self.counts)
        self.__dict__.update({**fresh.__dict__, "encoded": self.encoded})


EDITS = "array<struct<start:bigint,end:bigint,text:string>>"
SLOTS = "array<struct<text:string,chars:array<int>,tokens:array<int>,n_chars:bigint,n_tokens:bigint>>"
_SLOT = pa.struct([("text", pa.string()), ("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32())), ("n_chars", pa.int64()), ("n_tokens", pa.int64())])


#: Characters of text that are made into trees at once.
SHARE = 1 << 20


def _shares(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SHARE characters of column ``text``, a row at least."""
    sizes = np.cumsum(np.asarray(pc.utf8_length(batch.column(text)).fill_null(0)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SHARE, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _offsets(lists: list) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())


def _stored(slots: list[Slot]) -> pa.StructArray:
    """Slots as they are stored, with their sums."""
    texts, chars, tokens = zip(*slots, strict=True) if slots else ((), (), ())
    ends = _offsets(chars)
    lists = [pa.ListArray.from_arrays(ends, pa.array(itertools.chain.from_iterable(x), pa.int32())) for x in (chars, tokens)]
    sums = [pa.array(map(size, x), pa.int64()) for size, x in ((len, texts), (sum, tokens))]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), *lists, *sums], fields=list(_SLOT))


def build(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """(id, ``keep``, n_tokens, slots): the tree of each row's text, to be stored as a table.

    A null text is an empty text, which has no slots. Repeated rows and null
    ids stay, other columns are left out, an empty table gives no rows. No shuffle.
    """
    path = path or vocabulary()
    rows = df.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(common.Names(df)("text")))
    names = rows.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            for part in _shares(batch, batch.num_columns - 1):
                trees = [slots_of(x.as_py() or "", counts) for x in part.column(part.num_columns - 1)]
                total = [sum(sum(n) for _, _, n in tree) for tree in trees]
                made = pa.ListArray.from_arrays(_offsets(trees), _stored([slot for tree in trees for slot in tree]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(total, pa.int64()), made], [*names, "n_tokens", "slots"])

    return rows.mapInArrow(run, f"{schema}, n_tokens bigint, slots {SLOTS}")


def stored_tree(slots: pa.ListArray, row: int, counts: Counter) -> Tree:
    """The tree of a stored row; a slot's text and pre-tokens are read when an edit opens it."""
    a, n = slots.offsets[row].as_py(), slots.offsets[row + 1].as_py()
    mine = slots.values.slice(a, n - a)
    chars, tokens = np.asarray(mine.field("n_chars")), np.asarray(mine.field("n_tokens"))
    ends = np.asarray(mine.field("chars").offsets)[: n - a + 1] if n > a else np.zeros(1, np.int64)

    def opened(i: int) -> Slot:
        x = mine[i]
        return x["text"].as_py(), x["chars"].as_py(), x["tokens"].as_py()

    return Tree(chars, tokens, np.diff(ends), opened, counts)


def apply_edits(trees: DataFrame, edits_col: str, path: str | None = None, trees_after: bool = False) -> DataFrame:
    """(id, n_tokens, n_tokens_after, n_pretokens_after, n_chars_after, n_chars_encoded) of each stored tree (id, n_tokens, slots) after the row's edits, in order.

    With ``trees_after`` the row has the edited tree too, as ``slots``: with
    n_tokens_after as its n_tokens, it takes the next batch of edits.
    ``edits`` are replacements [start, end) -> text in characters of the text
    as it is then; ranges are cut to the text. Null edits are none, a null in an
    edit makes it an empty text or position 0. n_tokens is the count before.
    n_chars_encoded counts what the edits encoded again. Repeated rows and null
    ids stay, other columns are left out. No shuffle.
    """
    path = path or vocabulary()
    rows = trees.select("id", "n_tokens", "slots", F.col(f"`{edits_col}`").cast(EDITS).alias("edits"))
    names = ["n_tokens_after", "n_pretokens_after", "n_chars_after", "n_chars_encoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            out, kept = [], []
            for row in range(batch.num_rows):
                tree = stored_tree(batch.column(2), row, counts)
                for e in batch.column(3)[row].as_py() or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                out.append((tree.n_tokens, tree.n_leaves, tree.n_chars, tree.encoded))
                if trees_after:
                    kept.append([slot for slot in map(tree.slot, range(tree.n)) if slot[0]])
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(names)
            if trees_after:
                columns.append(pa.ListArray.from_arrays(_offsets(kept), _stored([slot for tree in kept for slot in tree])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "n_tokens", *names, *(["slots"] if trees_after else [])])

    made = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, " + ", ".join(f"{n} bigint" for n in names)
    return rows.mapInArrow(run, made + (f", slots {SLOTS}" if trees_after else ""))
