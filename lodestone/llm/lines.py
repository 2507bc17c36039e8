"""Line dedup: hashes of lines in ranges, sorted by document; decisions leave as keep bitmaps, not as text.

Line keys are hashed to 128 bits. The rows (hash, document, position) are
partitioned by ranges of (hash, document), so that one very common line spreads
over many partitions, and each partition is streamed in order: the first
document of a run (the largest id) keeps its lines, the others lose theirs once
the run has enough documents. Runs cut by a partition border are resolved from
the partitions' partial counts. Texts move once, to meet their bitmaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import common

#: Production parameters: shortest key in code points, and documents that make a line common.
MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(common.SPACES)), common.UPPER, common.LOWER)


def _lines(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    parts = df.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = parts.select("doc", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc", "th", "pos")


#: kind 0: a line to drop; 1: a line of a run that goes beyond the partition; 2: a partition's part of such a run (pos: documents, doc: largest).
_SCHEMA = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("pos", pa.int64())])


class _Run:
    """A run of one key that may go on in the next batch: what has been seen of it."""

    def __init__(self, key: tuple[int, int], largest: int, first: bool):
        self.key, self.largest, self.first = key, largest, first
        self.n_docs, self.current = 0, None
        self.waiting: list[np.ndarray] = []

    def add(self, rows: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """The next rows (columns of _ROW): those to drop, and those that wait for the other partitions."""
        doc = rows["doc"]
        opens = np.concatenate(([doc[0] != self.current], doc[1:] != doc[:-1])) if self.n_docs else np.concatenate(([True], doc[1:] != doc[:-1]))
        n = self.n_docs + np.cumsum(opens)
        self.n_docs, self.current = int(n[-1]), doc[-1]
        if self.first:
            return rows[:0], rows
        if self.n_docs < min_docs:
            self.waiting.append(rows)
            return rows[:0], rows[:0]
        held = np.concatenate([*self.waiting, rows])
        self.waiting = []
        return held[held["doc"] != self.largest], rows[:0]


#: A row of a run; a null id is NO_ID, which sorts after all others.
_ROW = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("doc", "<i8"), ("th", "<i8"), ("pos", "<i8")])
NO_ID = -(1 << 63)


def _stream(min_docs: int):
    """Read one partition sorted by (hash, document descending) and decide each run.

    Runs inside a batch are decided together; the first and the last of a batch
    may go on beyond it and are carried. What is beyond the partition's first
    and last run is complete.
    """

    def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(rows), kind, np.int32)), *[pa.array(rows[c]) for c in _ROW.names]]
        columns[3] = pa.array(rows["doc"], mask=rows["doc"] == NO_ID)
        return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    def part(run: _Run) -> pa.RecordBatch:
        return out(2, np.array([(*run.key, run.largest, 0, run.n_docs)], _ROW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: _Run | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.empty(batch.num_rows, _ROW)
            for name, column in zip(_ROW.names, batch.columns, strict=True):
                rows[name] = column.fill_null(NO_ID) if column.null_count else column
            begins = np.flatnonzero(np.concatenate(([True], (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1]))))
            ends = np.append(begins[1:], len(rows))
            drop = []
            # the first run, which may be a carried one, and the last are decided on their own
            single = [0] if len(begins) == 1 else [0, len(begins) - 1]
            for i in single:
                mine = rows[begins[i] : ends[i]]
                key = (int(mine["h1"][0]), int(mine["h2"][0]))
                if here is None or here.key != key:
                    if here is not None and here.first:
                        yield part(here)
                    here = _Run(key, int(mine["doc"][0]), here is None)
                gone, wait = here.add(mine, min_docs)
                drop.append(gone)
                if len(wait):
                    yield out(1, wait)
                if i == 0 and len(begins) > 2:
                    inner = rows[ends[0] : begins[-1]]
                    own = np.repeat(np.arange(len(begins) - 2), np.diff(begins[1:]))
                    opens = np.concatenate(([True], (own[1:] != own[:-1]) | (inner["doc"][1:] != inner["doc"][:-1])))
                    common_runs = np.bincount(own, weights=opens) >= min_docs
                    largest = rows["doc"][begins[1:-1]]
                    drop.append(inner[common_runs[own] & (inner["doc"] != largest[own])])
            yield out(0, np.concatenate(drop))
        if here is not None:
            yield part(here)
            if here.waiting:
                yield out(1, np.concatenate(here.waiting))

    return run


def _bitmaps(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    # dealing by ranges looks at its rows twice: keys are staged, so that texts are split once
    lines = common.stage(_lines(df, id_col, text_col, min_chars), "keys")
    # ranges of (hash, document): one document's lines of a key stay together
    placed = lines.repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc").desc_nulls_last()).sortWithinPartitions("h1", "h2", F.col("doc").desc_nulls_last(), "th", "pos")
    seen = common.stage(placed.mapInArrow(_stream(min_docs), "kind int, h1 bigint, h2 bigint, doc bigint, th bigint, pos bigint"), "runs")
    common.drop(lines)
    runs = seen.where("kind = 2").groupBy("h1", "h2").agg(F.sum("pos").alias("n"), F.max("doc").alias("largest")).where(F.col("n") >= min_docs).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "largest")
    # a partition has two such parts at most: the table is small unless there are tens of thousands of partitions
    cut = seen.where("kind = 1").join(common.small(common.stage(runs, "cut")), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).where(~F.col("doc").eqNullSafe(F.col("largest")))
    dropped = seen.where("kind = 0").select("doc", "th", "pos").unionByName(cut.select("doc", "th", "pos"))
    return dropped.groupBy("doc", "th").agg(F.collect_set("pos").alias("pos")).select("doc", "th", F.size("pos").cast("long").alias("n_dropped"), _pack("pos").alias("keep_bitmap"))


@F.arrow_udf(T.BinaryType())
def _pack(dropped: pa.Array) -> pa.Array:
    out = []
    for places in dropped:
        at = np.array(places.as_py(), np.int64)
        bits = np.ones((int(at.max()) // 8 + 1) * 8, np.uint8)
        bits[at] = 0
        out.append(zlib.compress(np.packbits(bits).tobytes(), 1))
    return pa.array(out, pa.binary())


def kept_lines(text: str, bitmap: bytes) -> str:
    """``text`` without the lines whose bit is 0; lines beyond the bitmap stay."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return "\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i])


@F.arrow_udf(T.StringType())
def _apply(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
    return pa.array([kept_lines(t.as_py(), b.as_py()) if b.is_valid else None for t, b in zip(texts, bitmaps, strict=True)], pa.string())


#: What ``keep_bitmaps`` adds.
COLUMNS = ("n_lines", "n_dropped", "keep_bitmap")


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``df`` with n_lines, n_dropped and keep_bitmap (zlib; a bit for each line, null: all lines stay).

    Lines whose key has ``min_chars`` code points and occurs in ``min_docs``
    documents (distinct ids; a null id counts as one document before all
    others) are dropped except in the largest id that has them. A null or empty
    text is one empty line. Repeated rows get equal bitmaps; other columns
    stay, but for those called like the three, which are replaced.
    """
    own = common.Names(df)
    doc, th = own("doc"), own("th")
    df = df.drop(*COLUMNS)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    maps = _bitmaps(df, id_col, text_col, min_chars, min_docs).withColumnsRenamed({"doc": doc, "th": th})
    joined = df.join(maps, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(th)), "left").drop(doc, th)
    n_lines = (F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1).cast("long")
    return joined.withColumns({"n_lines": n_lines, "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("long")})


def kept_text(text_col: str = "text") -> Column:
    """The text that a row of ``keep_bitmaps`` keeps; rows that lose nothing do not go through Python's hands."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.coalesce(_apply(F.when(F.col("keep_bitmap").isNotNull(), text), F.col("keep_bitmap")), text)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with the dropped lines taken out of its texts (null texts stay null) and ``length_col`` set to the new length; columns may have any names."""
    own = common.Names(df)
    held = {c: own(c) for c in df.columns}
    text, length = held[text_col], held.get(length_col)
    done = keep_bitmaps(df.select(*[F.col(f"`{c}`").alias(n) for c, n in held.items()]), held[id_col], text)
    done = done.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), kept_text(text)))
    if length:
        new = F.char_length(F.col(f"`{text}`")).cast(df.schema[length_col].dataType)
        done = done.withColumn(length, F.when(F.col("keep_bitmap").isNull(), F.col(f"`{length}`")).otherwise(new))
    return done.select(*[F.col(f"`{n}`").alias(c) for c, n in held.items()])
