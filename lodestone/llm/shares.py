"""Shares: rows taken together, so many that their distinct words are few against all their words.

A share holds the positions of its words as codes of a dictionary of its own,
compressed. Only the dictionaries' entries go through shuffles to meet what is
known about a word; looked-up entries come back to their share, and codes turn
into values by position. A share is a row, so its size is bounded by a
parameter and by the longest single text. Shares are stored in buckets by their
number, so that their codes needn't be shuffled to meet what comes back.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of the values in a share, about (bytes or characters of texts); a value is never cut.
SHARE = 1 << 25
#: Shares of different groups that a task holds open, in lengths of SHARE.
OPEN = 3


def packed(codes: np.ndarray) -> bytes:
    """Codes as compressed bytes, those of equal weight together."""
    flat = codes.astype("<u4")
    return len(flat).to_bytes(8, "little") + pa.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").ravel()


class Filling:
    """A share that is being filled; a word's code is its place in the order of first sight."""

    def __init__(self, number: int):
        self.number = number
        self.known = defaultdict(count().__next__)
        self.ids: list = []
        self.sizes: list[int] = []
        self.parts: list[np.ndarray] = []
        self.length = 0

    def add(self, row_id, words: list, length: int) -> None:
        self.parts.append(np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words)))
        self.ids.append(row_id)
        self.sizes.append(len(words))
        self.length += length

    def row(self, grp, schema: pa.Schema) -> pa.RecordBatch:
        codes = np.concatenate(self.parts)
        values = [self.number, grp, self.ids, self.sizes, packed(codes), list(self.known), np.bincount(codes, minlength=len(self.known))]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)


def shares(rows: DataFrame, split: Callable[[object], list], entry: str) -> DataFrame:
    """(share, grp, ids, sizes, codes, entries, uses) of rows (id, grp, value), stored as a table in buckets of ``share``.

    ``split`` makes the list of words of a value, which may be null; ``entry``
    is a word's SQL type. A share has rows of one ``grp``; ``sizes`` are the
    words of each row, ``uses`` the occurrences of each entry. No shuffle.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    made = f"share bigint, grp string, ids array<{id_type}>, sizes array<int>, codes binary, entries array<{entry}>, uses array<bigint>"
    word = pa.string() if entry == "string" else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        filled: dict[str | None, Filling] = {}
        schema = None
        for batch in batches:
            kinds = [pa.int64(), pa.string(), pa.list_(batch.schema.field("id").type), pa.list_(pa.int32()), pa.binary(), pa.list_(word), pa.list_(pa.int64())]
            schema = pa.schema(list(zip(["share", "grp", "ids", "sizes", "codes", "entries", "uses"], kinds, strict=True)))
            for row_id, grp, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                value = value.as_py()
                if grp not in filled:
                    filled[grp] = Filling(next(number))
                filled[grp].add(row_id, split(value), len(value or ""))
                if filled[grp].length >= SHARE:
                    yield filled.pop(grp).row(grp, schema)
                elif len(filled) > OPEN and sum(x.length for x in filled.values()) >= OPEN * SHARE:
                    for other in list(filled):
                        yield filled.pop(other).row(other, schema)
        for grp, filling in filled.items():
            yield filling.row(grp, schema)

    spark, name = rows.sparkSession, f"shares_{uuid.uuid4().hex}"
    # a task's shares go to their buckets without a shuffle: a file each
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.select("id", "grp", "value").mapInArrow(run, made).write.option("compression", "zstd").bucketBy(n, "share").saveAsTable(name)
    out = spark.table(name)
    out.table_name = name
    return out


def entries(stored: DataFrame) -> DataFrame:
    """(share, grp, code, entry, uses): what the shares' dictionaries hold; codes of words are not read."""
    zipped = stored.select("share", "grp", F.posexplode(F.arrays_zip("entries", "uses")).alias("code", "x"))
    return zipped.select("share", "grp", "code", F.col("x.entries").alias("entry"), F.col("x.uses").alias("uses"))


def drop(stored: DataFrame) -> None:
    """Delete stored shares that nothing reads any more."""
    stored.sparkSession.sql(f"DROP TABLE {stored.table_name}")
