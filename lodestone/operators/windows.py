"""Order-dependent operators: newest N, budgets, carried headers, spans, sliding limits."""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.scans import running_max_before, running_sum

def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the window group limit drops the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def beyond(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The rows after the first ``n`` of each key (what a retention rule purges)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") > n).drop("__n")


def replace_and_keep(df: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """The last row of each key, then the newest ``keep`` of those."""
    return first_per(df, [key], order).orderBy(*order).limit(keep)


def budget(df: DataFrame, key: str, order: list[Column], tokens: str, hard: Column, target: Column) -> DataFrame:
    """Rows in order while the sum stays within ``hard`` and the sum before is below ``target``.

    The running sum never falls, so the prefix is a filter. A hot key's sum is
    made in two levels. Rows without a count of tokens are left out.
    """
    counted = df.where(F.col(tokens).isNotNull())
    return running_sum(counted, key, order, F.col(tokens), "running").where((F.col("running") <= hard) & (F.col("running") - F.col(tokens) < target))


def carry_forward(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """``value`` of the last row that has one, up to each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def nearest_before(df: DataFrame, key: str, position: str, value: str, reach: int, out: str) -> DataFrame:
    """As-of lookup in one table: the last ``value`` at most ``reach`` positions before each row."""
    w = Window.partitionBy(key).orderBy(position).rangeBetween(-reach, -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def sliding(df: DataFrame, key: str, order: str, value: str, width: int, out: str) -> DataFrame:
    """The values of each row and the ``width - 1`` after it, joined by blank lines (shorter at the end)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, width - 1)
    return df.withColumn(out, F.array_join(F.collect_list(value).over(w), "\n\n"))


def attempts_within(df: DataFrame, key: str, seconds: Column, span: int, out: str) -> DataFrame:
    """How many rows of the key lie in the ``span`` seconds up to each row: an upper bound of accepted attempts."""
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(-span, 0)
    return df.withColumn(out, F.count("*").over(w))


def _judged(df: DataFrame, key: str, order: list[str], begin: Callable[[], Callable[..., bool]], columns: list[str], out: str, part: str | None = None) -> DataFrame:
    """``df`` with the verdict ``out`` of a judge that sees each key's rows in order.

    ``begin`` makes a key's judge, which takes the values of ``columns``. Sorted
    partitions are streamed, so a task holds one batch and one judge's state,
    however many rows a key has. Each value of ``part`` has a judge of its own.
    """
    keys = [key] if part is None else [key, part]
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: object = begin
        judge = begin()
        for batch in batches:
            verdicts = []
            for row in zip(*[batch.column(names.index(c)).to_pylist() for c in (*keys, *columns)], strict=True):
                k, values = row[: len(keys)], row[len(keys) :]
                if k != here:
                    here, judge = k, begin()
                verdicts.append(judge(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts, pa.bool_())], [*names, out])

    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, f"{schema}, `{out}` boolean")


def rate_limited(df: DataFrame, key: str, order: str, seconds: str, limit: int, span: int) -> DataFrame:
    """``df`` with ``accepted``: fewer than ``limit`` accepted rows in the ``span`` seconds before; refused rows don't count.

    Sequential within a key; what is remembered of it is at most ``limit`` times.
    """

    def begin() -> Callable[[float], bool]:
        taken: deque[float] = deque()

        def judge(at: float) -> bool:
            while taken and at - taken[0] >= span:
                taken.popleft()
            if len(taken) < limit:
                taken.append(at)
                return True
            return False

        return judge

    return _judged(df, key, [seconds, order], begin, [seconds], "accepted")


def free_spans(df: DataFrame, key: str, priority: str, start: str, end: str) -> DataFrame:
    """Spans in (priority, start) order that overlap no span of the key taken before; a span meets its two neighbours only.

    A key is cut where no span covers the place, which spans cannot overlap
    across, and each component is judged on its own: a long text with many
    spans is spread over many tasks. The cuts are a running maximum and a
    running count, both in two levels.
    """

    def begin() -> Callable[[int, int], bool]:
        taken: list[tuple[int, int]] = []

        def judge(a: int, z: int) -> bool:
            i = bisect.bisect_right(taken, (a, float("inf")))
            if (i and taken[i - 1][1] > a and taken[i - 1][0] < z) or (i < len(taken) and taken[i][0] < z):
                return False
            bisect.insort(taken, (a, z))
            return True

        return judge

    order = [F.col(start), F.col(end)]
    covered = running_max_before(df, key, order, F.col(end), "__covered")
    opens = F.when(F.col("__covered") > F.col(start), 0).otherwise(1)
    # of equal spans the one that opens a component comes first, as it did in the maximum
    parted = running_sum(covered, key, [*order, F.col("__covered").asc_nulls_first()], opens, "__part").drop("__covered")
    judged = _judged(parted, key, [priority, start, end], begin, [start, end], "__free", "__part")
    return judged.where("__free").drop("__free", "__part")


def row_windows(df: DataFrame, key: str, number: str, size: int, overlap: int, line: str, out: str) -> DataFrame:
    """(key, window, out): windows of ``size`` rows that overlap by ``overlap``; a row goes to each window it lies in.

    Rows are numbered from 0 in ``number``; no join is needed, as a row's windows follow from its number.
    """
    step = size - overlap
    last = F.floor(F.col(number) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col(number) - size + 1) / step))
    placed = df.withColumn("window", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    grouped = placed.groupBy(key, "window").agg(F.array_sort(F.collect_list(F.struct(number, line))).alias("rows"), F.max(number).alias("last"))
    total = df.groupBy(key).agg(F.max(number).alias("end"))
    grouped = grouped.join(total, key).where((F.col("window") == 0) | ((F.col("window") - 1) * step + size - 1 < F.col("end")))
    return grouped.select(key, "window", F.array_join(F.transform("rows", lambda r: r[line]), "\n").alias(out))


def char_chunks(text: str, target: int = 1000, overlap: int = 200) -> Iterator[str]:
    """Pieces of about ``target`` characters that end, where one is near, at a blank line, a line end or a space."""
    text = text.strip()
    start = 0
    while start < len(text):
        end = start + target
        if len(text) <= end:
            yield text if start == 0 else text[start:]
            return
        for mark, reach in (("\n\n", 150), ("\n", 100), (" ", 50)):
            # the mark may begin at the end position itself, up to reach - 1 before it, and after the start
            at = text.rfind(mark, max(start + 1, end - reach + 1), end + len(mark))
            if at != -1:
                end = at + len(mark)
                break
        piece = text[start:end].strip()
        if piece:
            yield piece
        start = end - overlap if overlap > 0 else end - 1


def chunk_documents(df: DataFrame, id_col: str, text_col: str, target: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, chunk, content) of ``char_chunks``; sequential in a text, so it runs per row in Arrow batches, without a shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, c) for i, t in zip(pdf["id"], pdf["text"], strict=True) for n, c in enumerate(char_chunks(t or "", target, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk", "content"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, chunk int, content string")


def pack_paragraphs(paragraphs: list[str], target: int = 1000, overlap: int = 200) -> Iterator[tuple[int, int]]:
    """[first, last] paragraph of each chunk: filled up to ``target`` characters, then begun again with an overlap."""
    held: list[int] = []

    def size(items: list[int]) -> int:
        return sum(len(paragraphs[i]) + 2 for i in items)

    for i in range(len(paragraphs)):
        held.append(i)
        if size(held) >= target or i == len(paragraphs) - 1:
            yield held[0], held[-1]
            back = held[-1:]
            while len(back) < len(held) and size(back) + len(paragraphs[back[0] - 1]) + 2 <= overlap:
                back.insert(0, back[0] - 1)
            held = back if len(back) < len(held) else back[1:]


def chunk_paragraphs(df: DataFrame, id_col: str, paragraphs_col: str, target: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, chunk, first, last, content) of ``pack_paragraphs`` over an array of paragraphs."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, p in zip(pdf["id"], pdf["paragraphs"], strict=True):
                p = [] if p is None else list(p)
                rows += [(i, n, a, z, "\n\n".join(p[a : z + 1])) for n, (a, z) in enumerate(pack_paragraphs(p, target, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk", "first", "last", "content"])

    return df.select(F.col(id_col).alias("id"), F.col(paragraphs_col).alias("paragraphs")).mapInPandas(run, f"id {kind}, chunk int, first int, last int, content string")
