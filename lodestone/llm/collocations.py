"""Phrase mining by position bitmaps: shift, AND and popcount extend phrases depth-first inside shards.

Texts are cut in pieces and words, and stored in shares of one group (a
language); a share's words have positions, with a free position between pieces.
A word's bitmap is compressed: it has its non-zero bytes only. The bitmap of a
phrase's last words, shifted by one place and ANDed with a word's, is the bitmap
of the longer phrase; shifts land on free positions at the ends of pieces, so no
phrase crosses one. Popcounts are a share's counts, and Spark sums them over
shares. Only words, then pairs, that are frequent in the whole group are
extended, so shares send few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common, shares

#: Stands between pieces; no word has it.
END = b"\n"
#: A-Z in lower case, and what ends a piece as END.
_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + END * 10)
#: Bytes of bitmaps that are extended at once, about: those of one phrase stay together.
AT_ONCE = 1 << 18


def words(text: bytes | None) -> list[bytes]:
    """The words of each piece, and END after each."""
    out: list[bytes] = []
    for piece in (text or b"").translate(_TO).split(END):
        found = piece.split()
        if found:
            out += found
            out.append(END)
    return out


class Bitmaps:
    """Compressed position bitmaps of a share's words, numbered 0 to n - 1: (word, byte, mask) in the order of (word, byte)."""

    def __init__(self, numbers: np.ndarray, n: int):
        """``numbers`` has the word at each position; -1 is none."""
        at = np.flatnonzero(numbers >= 0)
        n_bytes = len(numbers) // 8 + 2
        key = numbers[at].astype(np.int64) * n_bytes + (at >> 3)
        order = np.argsort(key, kind="stable")
        key, bit = key[order], np.left_shift(1, at[order] & 7).astype(np.uint8)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.n, self.mask = n, np.bitwise_or.reduceat(bit, first) if len(key) else bit
        self.word, self.byte = np.divmod(key[first], n_bytes)
        # the same entries by byte, to find what shares a byte with a shifted bitmap
        self.placed = np.argsort(self.byte, kind="stable")
        self.start = np.concatenate(([0], np.cumsum(np.bincount(self.byte, minlength=n_bytes))))
        self.word_at, self.mask_at = self.word[self.placed], self.mask[self.placed]

    def roots(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The bitmaps of some words at a time."""
        begins = np.flatnonzero(np.concatenate(([True], self.word[1:] != self.word[:-1]))) if len(self.word) else np.empty(0, np.int64)
        ends = np.append(begins[1:], len(self.word))
        lo = 0
        while lo < len(begins):
            hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + AT_ONCE, side="right")))
            yield tuple(x[begins[lo] : ends[hi - 1]] for x in (self.word, self.byte, self.mask))
            lo = hi

    def extended(self, phrase: np.ndarray, byte: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, next word, byte, mask) of the phrases' bitmaps shifted by one place and ANDed with the words'."""
        carry = mask >> 7
        on, over = np.flatnonzero(mask & 0x7F), np.flatnonzero(carry)
        phrase, byte = np.concatenate((phrase[on], phrase[over])), np.concatenate((byte[on], byte[over] + 1))
        mask = np.concatenate(((mask[on] << 1).astype(np.uint8), carry[over]))
        n = self.start[byte + 1] - self.start[byte]
        source = np.repeat(np.arange(len(byte)), n)
        entry = np.arange(len(source)) + np.repeat(self.start[byte] - (np.cumsum(n) - n), n)
        both = mask[source] & self.mask_at[entry]
        hit = np.flatnonzero(both)
        source = source[hit]
        return phrase[source], self.word_at[entry[hit]], byte[source], both[hit]


def _counted(phrase: np.ndarray, word: np.ndarray, mask: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, word, popcount over all bytes) of each pair there is."""
    key = phrase * n + word
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return *np.divmod(key[first], n), np.add.reduceat(np.bitwise_count(mask[order]).astype(np.int64), first)


def _bitmaps(share: pa.Table, looked: pa.Table) -> tuple[Bitmaps, np.ndarray]:
    """Bitmaps of the frequent words of a share, and the words' ids; ``looked`` has (code, a) of each."""
    code, ids = looked.column("code").to_numpy(), looked.column("a").to_numpy()
    ids, order = np.sort(ids), np.argsort(ids)
    codes = shares.unpacked(share.column("codes")[0].as_py())
    number = np.full(int(max(codes.max(initial=0), code.max(initial=0))) + 1, -1, np.int64)
    number[code[order]] = np.arange(len(ids))
    return Bitmaps(number[codes], len(ids)), ids


def _table(names: list[str], parts: list[list[np.ndarray]]) -> pa.Table:
    empty = [np.empty(0, np.int64)] * len(names)
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], names) for part in parts or [empty]])


def _pairs(share: pa.Table, looked: pa.Table) -> pa.Table:
    """(share, a, b, n) of the pairs of frequent words in a share."""
    bitmaps, ids = _bitmaps(share, looked)
    number, out = share.column("share")[0].as_py(), []
    for word, byte, mask in bitmaps.roots():
        first, second, _, both = bitmaps.extended(word, byte, mask)
        if len(first):
            first, second, n = _counted(first, second, both, bitmaps.n)
            out.append([np.full(len(n), number), ids[first], ids[second], n])
    return _table(["share", "a", "b", "n"], out)


def _triples(share: pa.Table, looked: pa.Table) -> pa.Table:
    """(a, b, c, n) of the triples of a share whose pairs are frequent; ``looked`` has words (code, a) and pairs (a, b)."""
    pairs = looked.filter(looked.column("code").is_null())
    bitmaps, ids = _bitmaps(share, looked.filter(looked.column("code").is_valid()))
    known = np.sort(np.searchsorted(ids, pairs.column("a").to_numpy()) * bitmaps.n + np.searchsorted(ids, pairs.column("b").to_numpy()))
    out = []

    def among(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those that are frequent pairs, and the pairs' numbers."""
        key = first * bitmaps.n + second
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = np.flatnonzero(known[at] == key)
        return hit, at[hit]

    for word, byte, mask in bitmaps.roots() if len(known) else ():
        first, second, byte, mask = bitmaps.extended(word, byte, mask)
        hit, pair = among(first, second)
        if not len(hit):
            continue
        pair, third, _, mask = bitmaps.extended(pair, byte[hit], mask[hit])
        hit, _ = among(known[pair] % bitmaps.n, third)
        if len(hit):
            pair, third, n = _counted(pair[hit], third[hit], mask[hit], bitmaps.n)
            first, second = np.divmod(known[pair], bitmaps.n)
            out.append([ids[first], ids[second], ids[third], n])
    return _table(["a", "b", "c", "n"], out)


def phrase_counts(df: DataFrame, group_col: str, text_col: str, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored counts per group: totals (grp, n), words (grp, word, id, f), pairs (a, b, f), triples (a, b, c, f) of word ids; f is ``least`` or more.

    A null group is ``und``, a null text is empty. Repeated rows count each.
    """
    rows = df.select(F.lit(None).cast("bigint").alias("id"), F.coalesce(F.col(f"`{group_col}`").cast("string"), F.lit("und")).alias("grp"), F.col(f"`{text_col}`").cast("binary").alias("value"))
    stored = shares.shares(rows, words, "string")
    found = shares.entries(stored).where(F.col("entry") != END.decode())
    totals = common.stage(found.groupBy("grp").agg(F.sum("uses").alias("n")), "totals")
    # a word has a row for each share at most; one shuffle gives its sum, its id, and which shares hold it
    same = Window.partitionBy("grp", "entry")
    often = found.withColumn("i", F.monotonically_increasing_id()).withColumns({"f": F.sum("uses").over(same), "id": F.min("i").over(same)}).where(F.col("f") >= least)
    once = [F.when(F.col("i") == F.col("id"), F.col(c)).alias(c) for c in ("grp", "entry", "f")]
    looked = common.stage(often.select(F.col("share").alias("share"), "code", F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), *once), "looked", codec="zstd")
    known = common.stage(looked.where("entry IS NOT NULL").select("grp", F.col("entry").alias("word"), F.col("a").alias("id"), "f"), "frequent")
    looked_up = looked.select("share", "code", "a", "b")
    texts = stored.select("share", "codes").groupBy("share")
    made = texts.cogroup(looked_up.groupBy("share")).applyInArrow(_pairs, "share bigint, a bigint, b bigint, n bigint")
    # so has a pair
    same = Window.partitionBy("a", "b")
    summed = made.withColumns({"f": F.sum("n").over(same), "one": F.min("share").over(same) == F.col("share")}).where(F.col("f") >= least)
    held = common.stage(summed.drop("n"), "pairs", codec="zstd")
    pairs = common.stage(held.where("one").select("a", "b", "f"), "counts")
    both = looked_up.unionByName(held.select("share", F.lit(None).cast("int").alias("code"), "a", "b"))
    made = texts.cogroup(both.groupBy("share")).applyInArrow(_triples, "a bigint, b bigint, c bigint, n bigint")
    triples = common.stage(made.groupBy("a", "b", "c").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "counts")
    common.drop(looked, held)
    shares.drop(stored)
    return totals, known, pairs, triples


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exact for counts below 10^15."""
    a, l, r = (x.cast("decimal(15,0)") for x in (a, l, r))  # noqa: E741
    square, product = (F.lit(1_000_000).cast("decimal(7,0)") * (a * a)), l * r
    return F.call_function("div", square, product)


def collocations(df: DataFrame, group_col: str, text_col: str, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score): each group's ``top`` phrases of two and three words by score.

    A phrase that occurs ``least`` times is cut in two parts, and scores by its
    count a against theirs, l and r; the lowest-scoring cut counts. Phrases
    inside a longer one that has ``covered`` percent of their count or more are
    left out. Texts may be null, empty or very long; groups without a phrase
    have no rows, nor has an empty table; other columns are not read.
    """
    totals, known, pairs, triples = phrase_counts(df, group_col, text_col, least)

    def word(name: str) -> DataFrame:
        return common.small(known).select(F.col("id").alias(name), F.col("word").alias(f"w{name}"), F.col("f").alias(f"f{name}"), F.col("grp").alias(f"g{name}"))

    inside = triples.select("a", "b", "f").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f")).groupBy("a", "b").agg(F.max("f").alias("longer"))
    left = pairs.join(inside, ["a", "b"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("f") * covered, F.lit(True)))
    two = left.join(word("a"), "a").join(word("b"), "b")
    two = two.select(F.col("ga").alias("grp"), F.concat_ws(" ", "wa", "wb").alias("phrase"), F.col("f").alias("a"), F.struct(_score(F.col("f"), F.col("fa"), F.col("fb")).alias("score"), F.lit(1).alias("k"), F.col("fa").alias("l"), F.col("fb").alias("r")).alias("cut"))
    three = triples.join(pairs.select("a", "b", F.col("f").alias("fab")), ["a", "b"]).join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("fbc")), ["b", "c"])
    three = three.join(word("a"), "a").join(word("b"), "b").join(word("c"), "c")
    cuts = [F.struct(_score(F.col("f"), F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for k, x, y in ((1, "fa", "fbc"), (2, "fab", "fc"))]
    three = three.select(F.col("ga").alias("grp"), F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("f").alias("a"), F.least(*cuts).alias("cut"))
    best = Window.partitionBy("grp").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    placed = two.unionByName(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    shown = placed.join(totals.withColumnRenamed("grp", "g"), F.col("grp") == F.col("g"))
    return shown.select("grp", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
