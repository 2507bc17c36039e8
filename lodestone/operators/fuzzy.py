"""Fuzzy grounding over a corpus: where a quote with errors stands in whole texts, and how like it is.

A quote is cut in pieces of a few bytes. A window that is nearly the quote has
some pieces unharmed, each about as far from the window's begin as from the
quote's; so a text's known pieces give alignments, and only windows of words
around an alignment that pieces agree on are compared. The length of the longest
common subsequence, worked out in parallel bits, bounds the ratio from above;
the ratio itself comes last. Quotes go to the executors in blocks of bounded
size, every text is read whole once a block.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators.substrings import CHUNK, Known, _runs

#: Bytes of pieces, longest first; a quote takes the longest of which it has PIECES.
WIDTHS, PIECES = (8, 4, 2, 1), 4
#: Pieces that must agree on an alignment, where a quote has enough of them.
AGREE = 2
#: Bytes of quotes in a block, about.
BLOCK = 1 << 20


def bare(text: str | None) -> str:
    """Words in lower case with single spaces between them."""
    return " ".join((text or "").lower().split())


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each character of ``a``, all of them moved at once for each character of ``b``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Quotes:
    """A block's quotes, filed under their pieces."""

    def __init__(self, quotes: list[tuple[object, str]], least: float):
        self.quotes, self.least = quotes, least
        self.known: list[tuple[Known, np.ndarray, np.ndarray, np.ndarray]] = []
        self.sizes = np.array([len(text.encode()) for _, text in quotes])
        #: How far a piece may have moved against the quote's begin in a window that is still alike.
        self.slack = (self.sizes * 2 * (1 - least)).astype(np.int64) + 2
        filed: dict[int, list[tuple[int, int, int]]] = {}
        for q, (_, text) in enumerate(quotes):
            data = np.frombuffer(text.encode(), np.uint8)
            width = next((w for w in WIDTHS if len(data) >= PIECES * w), 1)
            runs = _runs(data, width)
            filed.setdefault(width, []).extend((int(runs[p]), q, p) for p in range(0, len(data) - width + 1, width))
        for width, rows in filed.items():
            rows.sort()
            run, quote, place = (np.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64), strict=True))
            known = Known(width, run)
            first = np.searchsorted(run, known.runs)
            self.known.append((known, np.append(first, len(run)), quote, place))

    def alignments(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(quote, first, last): ranges of places in ``data`` where pieces agree that the quote begins."""
        for known, first, quote, place in self.known:
            found = []
            for lo in range(0, max(1, len(data) - known.width + 1), CHUNK):
                at, number = known.places(data[lo : lo + CHUNK + known.width - 1])
                n = first[number + 1] - first[number]
                entry = np.arange(n.sum()) + np.repeat(first[number] - (np.cumsum(n) - n), n)
                found.append(np.stack([quote[entry], np.repeat(at + lo, n) - place[entry], place[entry]]))
            q, start, piece = np.concatenate(found, axis=1)
            if not len(q):
                continue
            order = np.lexsort((start, q))
            q, start, piece = q[order], start[order], piece[order]
            opens = np.concatenate(([True], (q[1:] != q[:-1]) | (start[1:] - start[:-1] > self.slack[q[1:]])))
            begins = np.flatnonzero(opens)
            for a, z in zip(begins.tolist(), np.append(begins[1:], len(q)).tolist(), strict=True):
                if len(np.unique(piece[a:z])) >= min(AGREE, self.sizes[q[a]] // known.width):
                    yield int(q[a]), int(start[a]), int(start[z - 1])

    def best(self, text: str) -> dict[int, float]:
        """The best ratio of each quote with a window of as many words, where it is ``least`` or more."""
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.concatenate(([0], np.flatnonzero(data == 32) + 1)) if len(data) else np.empty(0, np.int64)
        out: dict[int, float] = {}
        seen: set[tuple[int, int]] = set()
        for q, first, last in self.alignments(data) if len(data) else ():
            quote = self.quotes[q][1]
            n, slack = quote.count(" ") + 1, int(self.slack[q])
            match = difflib.SequenceMatcher(None)
            match.set_seq2(quote)
            lo, hi = np.searchsorted(starts, (first - slack, last + slack + 1))
            for i in range(int(lo), min(int(hi), len(starts) - n + 1)):
                if (q, i) in seen:
                    continue
                seen.add((q, i))
                end = int(starts[i + n]) - 1 if i + n < len(starts) else len(data)
                window = data[starts[i] : end].tobytes().decode()
                wanted = max(self.least, out.get(q, 0.0)) * (len(window) + len(quote)) / 2
                if min(len(window), len(quote)) < wanted or common_subsequence(quote, window) < wanted:
                    continue
                match.set_seq1(window)
                ratio = match.ratio()
                if ratio >= max(self.least, out.get(q, 0.0)):
                    out[q] = ratio
        return out


def grounded_quotes(docs: DataFrame, id_col: str, text_col: str, quotes: DataFrame, quote_id: str, quote_col: str, least: float = 0.85) -> DataFrame:
    """(id, quote, ratio): texts with a window of as many words as the quote has whose sequence ratio with it is ``least`` or more, and the best one.

    Case and white space don't count. Null and empty texts and quotes have no
    windows. A window is found where AGREE pieces of the quote (all of them in a
    quote of one piece) are unharmed; tests measure the recall against every
    window. Repeated rows give repeated results.
    """
    kind, quote_type = docs.schema[id_col].dataType.simpleString(), quotes.schema[quote_id].dataType
    arrow, schema = to_arrow_type(quote_type), f"id {kind}, quote {quote_type.simpleString()}, ratio double"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    asked = quotes.select(F.col(quote_id).alias("i"), F.col(quote_col).alias("quote")).where("quote IS NOT NULL")
    total = asked.agg(F.sum(F.octet_length("quote"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Quotes(sent.value, least)
            for batch in batches:
                rows, names, ratios = [], [], []
                for row, text in enumerate(batch.column(1)):
                    for q, ratio in sorted(held.best(bare(text.as_py())).items()):
                        rows.append(row)
                        names.append(held.quotes[q][0])
                        ratios.append(ratio)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, arrow), pa.array(ratios, pa.float64())], ["id", "quote", "ratio"])

        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        held = [(r["i"], bare(r["quote"])) for r in asked.where(F.pmod(F.xxhash64("i", "quote"), F.lit(blocks)) == b).collect()]
        held = [(i, q) for i, q in held if q]
        if held:
            out = out.unionByName(texts.mapInArrow(search(docs.sparkSession.sparkContext.broadcast(held)), schema))
    return out
