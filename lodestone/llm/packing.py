"""Harmonic packing: pieces of documents in classes of reciprocal capacity, a fixed number of pieces to a bin.

Class k holds pieces of at most capacity / k tokens, k to a bin. Documents may
be cut, so a document longer than its class's slot by little, or shorter by
much, gives up a piece that fills a slot exactly and goes on with the rest; a
piece leaves at most SLACK tokens of its slot empty. A piece's class depends on
its length alone, and its bin on its rank in the class, which comes from counts
per hash range: bins fill independently on all workers. Only the last, unfilled
bin of each class remains; those pieces (fewer than k of class k, whatever the
corpus) are dealt in SHARES shares, and the shares of all classes are packed
together, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import common, tokens

CAPACITY = 4096
#: Id that closes each document.
END_ID = 2
#: Tokens of a slot that a piece may leave empty, and the share of its length that it may.
SLACK, SLACK_SHARE = 8, 128
#: Shares of what a class leaves over.
SHARES = 16


def classes(capacity: int = CAPACITY) -> list[int]:
    """Pieces to a bin, ascending: all up to 32, then those whose slots are multiples of 4 tokens, then slots of 2 and 1."""
    found = {*range(1, 33), *(capacity // s for s in range(4, 128, 4)), capacity // 2, capacity}
    return sorted(k for k in found if 1 <= k <= capacity)


def cut(n: int, capacity: int = CAPACITY, kinds: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of ``n`` tokens."""
    kinds = kinds or classes(capacity)
    out, start = [], 0
    while start < n:
        left = n - start
        if left >= capacity:
            out.append((start, capacity, 1))
            start += capacity
            continue
        i = max(i for i, k in enumerate(kinds) if capacity // k >= left)
        if capacity // kinds[i] - left <= max(SLACK, left // SLACK_SHARE):
            out.append((start, left, kinds[i]))
            break
        slot = capacity // kinds[i + 1]
        out.append((start, slot, kinds[i + 1]))
        start += slot
    return out


_PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, k int"


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, id, start, length, ids, doc_tokens, k): each document's tokens with ``end_id``, cut to pieces; ids are little-endian 32-bit.

    A null or empty text is the end token alone. Repeated rows and null ids stay.
    """
    vocabulary = vocabulary or tokens.vocabulary()
    kept = df.select(*keep, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [*keep, "id"]
    schema = ", ".join(f"`{x}` {kept.schema[x].dataType.simpleString()}" for x in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kinds = tokens.encoder(vocabulary).encode, classes(capacity)
        end, w = end_id.to_bytes(4, "little"), tokens.WIDTH
        memo: dict[int, list] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows, at = [], []
                for i, text in enumerate(batch.column(len(names)).slice(lo, 1000).to_pylist()):
                    ids = encode(text or "") + end
                    n = len(ids) // w
                    if n not in memo:
                        memo[n] = cut(n, capacity, kinds)
                        if len(memo) > 50_000:
                            memo.clear()
                            memo[n] = cut(n, capacity, kinds)
                    for start, length, k in memo[n]:
                        rows.append((start, length, ids[start * w : (start + length) * w], n, k))
                        at.append(lo + i)
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32()), strict=True)]
                    place = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*[c.take(place) for c in batch.columns[:-1]], *columns], [*names, "start", "length", "ids", "doc_tokens", "k"])

    return kept.mapInArrow(run, f"{schema}, {_PIECES}")


def assign(found: DataFrame, capacity: int = CAPACITY, order: tuple[str, str] | None = None) -> DataFrame:
    """``found`` (staged pieces: id, start, length, doc_tokens, k and any more) with sequence_id and offset.

    Pieces fill bins in a hashed order, or by the columns ``order`` (a coarse
    and a fine one, as file and row). Sequence ids are gapless: the full bins
    of each class in turn, then the bins of what the classes left over.
    """
    kinds, own = classes(capacity), common.Names(found)
    rank, slot, share = own("rank"), own("slot"), own("share")
    told = [F.col("id"), F.col("start"), F.col("length"), F.col("doc_tokens")]
    if order:
        placed, totals = common.numbered(found, ["k"], [F.col(f"`{order[1]}`"), *told], rank, order[0], own)
        placed = placed.drop(*order)
    else:
        placed, totals = common.ranked(found, ["k"], told, rank, own)
    names = [c for c in found.columns if c not in (order or ())]
    # one row for each class, so at most len(kinds) rows come to the driver
    sizes = {r["k"]: r["n"] for r in totals.collect()}
    base, at = {}, 0
    for k in kinds:
        base[k] = at
        at += sizes.get(k, 0) // k

    def per_class(values: dict[int, int]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for k in kinds for x in (k, values[k])]), F.col("k"))

    full = per_class({k: sizes.get(k, 0) // k * k for k in kinds})
    binned = placed.where(F.col(rank) < full).withColumn("sequence_id", (per_class(base) + F.expr(f"`{rank}` div k")).cast("long")).withColumn(slot, F.expr(f"`{rank}` % k"))
    binned = binned.withColumn("offset", _before("sequence_id", order=slot))
    # fewer than k pieces of class k, whatever the corpus: all of them fit in one bin
    rest = placed.where(F.col(rank) >= full).withColumn(share, F.expr(f"`{rank}` % {SHARES}"))
    # at most SHARES rows for each class
    parts = sorted(((-r["n"], r["k"], r[share]) for r in rest.groupBy("k", share).agg(F.sum("length").alias("n")).collect()))
    used: list[int] = []
    table = []
    for n, k, part in parts:
        i = next((i for i, u in enumerate(used) if u - n <= capacity), len(used))
        if i == len(used):
            used.append(0)
        table.append((k, part, at + i, used[i]))
        used[i] -= n
    bins = found.sparkSession.createDataFrame(table, f"k int, `{share}` bigint, sequence_id bigint, `{slot}` bigint")
    rest = rest.withColumn(share, F.col(share).cast("long")).join(F.broadcast(bins), ["k", share])
    rest = rest.withColumn("offset", F.col(slot) + _before("k", share, order=rank))
    return binned.select(*names, "sequence_id", "offset").unionByName(rest.select(*names, "sequence_id", F.col("offset").cast("long").alias("offset")))


def _before(*group: str, order: str) -> Column:
    """Tokens of the pieces before a piece in its group."""
    rows = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("length").over(rows), F.lit(0)).cast("long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, order: tuple[str, str] | None = None) -> DataFrame:
    """(id, start, length, ids or ids_crc32, doc_tokens, k, sequence_id, offset) of every piece of every document.

    Each token of a document lies in one piece; the pieces of a sequence are
    gapless from offset 0. With ``with_ids`` false the ids are replaced by
    their CRC-32 before anything moves. An empty table gives no rows.
    """
    found = pieces(df, id_col, text_col, vocabulary, capacity, end_id, order or ())
    if not with_ids:
        found = found.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    return assign(common.stage(found, "pieces"), capacity, order)
