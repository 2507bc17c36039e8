"""Substring join: which texts contain which needles, by the rarest run of bytes of each needle.

A needle has runs of 8, 4, 2 or 1 bytes, the longest that fit. A first pass over
the texts counts in how many of them each run of a needle occurs; a needle is
then filed under its rarest one. A second pass looks up the texts' runs, and
tests the needles filed under those that are there. Runs are compared as
integers of their bytes, so none is missed, wherever a needle begins and ends;
texts are never moved. Needles go to the executors in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of runs, longest first.
WIDTHS = (8, 4, 2, 1)
#: Bytes of needles in a block, about, and bytes of text that are looked through at once.
BLOCK, CHUNK = 4 << 20, 1 << 20
#: Texts of a batch whose hits are held at once.
TEXTS = 256
#: Bits of the table that rules most runs out.
BITS = 20


def _runs(data: np.ndarray, width: int) -> np.ndarray:
    """Each run of ``width`` bytes as an integer."""
    out, n = data.astype(np.uint64), 1
    while n < width:
        out = out[:-n] | (out[n:] << np.uint64(8 * n)) if len(out) > n else out[:0]
        n *= 2
    return out


def _slot(runs: np.ndarray) -> np.ndarray:
    return (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Known:
    """Sorted runs of one width, found by a table of bits and a binary search."""

    def __init__(self, width: int, runs: np.ndarray):
        self.width, self.runs = width, np.unique(runs)
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[_slot(self.runs)] = True

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the run) where ``data`` has a known run."""
        found = _runs(data, self.width)
        at = np.flatnonzero(self.maybe[_slot(found)])
        number = np.minimum(np.searchsorted(self.runs, found[at]), len(self.runs) - 1)
        hit = self.runs[number] == found[at]
        return at[hit], number[hit]


def _hits(texts: pa.Array, known: Known) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, number of a run) for the different known runs of each text, some of a batch's texts at a time; long texts come in overlapping pieces."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    for lo in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        hi = min(lo + CHUNK + known.width - 1, int(offsets[-1]))
        at, number = known.places(data[lo:hi])
        row = np.searchsorted(offsets, at + lo, side="right") - 1
        inside = at + lo + known.width <= offsets[row + 1]
        pair = np.unique(row[inside] * len(known.runs) + number[inside])
        yield np.divmod(pair, len(known.runs))


def _width(needle: bytes) -> int:
    return next(w for w in WIDTHS if w <= len(needle))


def _block(docs: DataFrame, kind: str, needles: list[tuple[object, bytes]], needle_type: T.DataType) -> DataFrame:
    """(id, needle) of one block; docs are (id, text) with binary texts."""
    spark, needle_kind, arrow = docs.sparkSession, needle_type.simpleString(), to_arrow_type(needle_type)
    runs: dict[int, list[np.ndarray]] = {}
    for _, needle in needles:
        runs.setdefault(_width(needle), []).append(_runs(np.frombuffer(needle, np.uint8), _width(needle)))
    known = [Known(w, np.concatenate(r)) for w, r in runs.items()]
    sent = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(k.runs), np.int64) for k in sent.value]
        for batch in batches:
            for k, n in zip(sent.value, counts, strict=True):
                for _, number in _hits(batch.column(0), k):
                    n += np.bincount(number, minlength=len(n))
        for k, n in zip(sent.value, counts, strict=True):
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), k.width), pa.int32()), pa.array(there), pa.array(n[there])], ["width", "number", "n"])

    found = docs.select("text").mapInArrow(count, "width int, number bigint, n bigint").groupBy("width", "number").agg(F.sum("n").alias("n"))
    # at most one row for each run of the block's needles
    often = {(r["width"], r["number"]): r["n"] for r in found.collect()}
    filed: dict[int, dict[int, list[int]]] = {}
    for i, (_, needle) in enumerate(needles):
        k = next(x for x in known if x.width == _width(needle))
        own = np.searchsorted(k.runs, np.unique(_runs(np.frombuffer(needle, np.uint8), k.width)))
        rarest = min(own.tolist(), key=lambda x: often.get((k.width, x), 0))
        # a run that no text has rules its needle out
        if (k.width, rarest) in often:
            filed.setdefault(k.width, {}).setdefault(int(k.runs[rarest]), []).append(i)
    chosen = spark.sparkContext.broadcast((needles, [(Known(w, np.array(sorted(under), np.uint64)), [under[x] for x in sorted(under)]) for w, under in filed.items()]))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, files = chosen.value
        for batch in (whole.slice(lo, TEXTS) for whole in batches for lo in range(0, whole.num_rows, TEXTS)):
            texts = batch.column(1)
            seen: set[tuple[int, int]] = set()
            for k, under in files:
                for rows, numbers in _hits(texts, k):
                    for row, number in zip(rows.tolist(), numbers.tolist(), strict=True):
                        seen.update((row, i) for i in under[number])
            by_row: dict[int, list[int]] = {}
            for row, i in seen:
                by_row.setdefault(row, []).append(i)
            hits = []
            for row, asked in by_row.items():
                text = texts[row].as_py()
                hits += [(row, i) for i in asked if held[i][1] in text]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in hits], pa.int64())), pa.array([held[i][0] for _, i in hits], arrow)], ["id", "needle"])

    return docs.mapInArrow(match, f"id {kind}, needle {needle_kind}") if filed else spark.createDataFrame([], f"id {kind}, needle {needle_kind}")


def contained(docs: DataFrame, id_col: str, text_col: str, needles: DataFrame, needle_id: str, needle_col: str) -> DataFrame:
    """(id, needle): for every row of ``docs`` the ids of the ``needles`` that its text contains, as ``contains`` has it.

    Null texts contain nothing, null and empty needles are in nothing. Repeated
    rows give repeated results. Needles come to the driver in blocks of about
    BLOCK bytes, each of which reads the texts twice.
    """
    kind, needle_kind = docs.schema[id_col].dataType.simpleString(), needles.schema[needle_id].dataType.simpleString()
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = needles.select(F.col(needle_id).alias("i"), F.col(needle_col).cast("binary").alias("needle")).where(F.length("needle") > 0)
    total = asked.agg(F.sum(F.length("needle"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK))
    out = docs.sparkSession.createDataFrame([], f"id {kind}, needle {needle_kind}")
    for b in range(blocks):
        held = [(r["i"], bytes(r["needle"])) for r in asked.where(F.pmod(F.xxhash64("i", "needle"), F.lit(blocks)) == b).collect()]
        if held:
            out = out.unionByName(_block(texts, kind, held, needles.schema[needle_id].dataType))
    return out
