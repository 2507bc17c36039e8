"""Running totals in two levels: a key's rows are cut in ranges, and ranges are joined by their summaries.

Rows are sorted by key and order in ranges and stored, so a hot key has many
files. Each (key, file) is scanned on its own; its summary is one row, and a
scan of the summaries gives each file what came before. No task has a key whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.staging import stage

#: Rows of the summaries that are broadcast to the ranges.
SMALL = 50_000
_FILE, _ROW, _SUM, _TOP, _BEFORE, _OVER = "__file", "__row", "__sum", "__top", "__before", "__over"


def ranges(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df`` stored in ranges of (key, order), with the file and the row's place in it."""
    by = [F.col(f"`{key}`").asc_nulls_first(), *order]
    stored = stage(df.repartitionByRange(*by).sortWithinPartitions(*by), "ranges")
    return stored.select("*", F.col("_metadata.file_name").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))


def _with_summaries(rows: DataFrame, key: str, summary: list[Column], before: Callable[[Window], list[dict[str, Column]]]) -> DataFrame:
    """``rows`` with what ``before`` makes of the summaries of the key's earlier files: columns that may use those before them."""
    parts = stage(rows.groupBy(key, _FILE).agg(*summary), "summaries")
    number = F.regexp_extract(_FILE, r"^part-(\d+)", 1).cast("long")
    known, names = parts, []
    for columns in before(Window.partitionBy(key).orderBy(number, _FILE).rowsBetween(Window.unboundedPreceding, -1)):
        known = known.withColumns(columns)
        names += columns
    known = known.select(F.col(f"`{key}`").alias("__k"), F.col(_FILE).alias("__f"), *names)
    if parts.count() <= SMALL:
        known = F.broadcast(known)
    return rows.join(known, F.col(f"`{key}`").eqNullSafe(F.col("__k")) & (F.col(_FILE) == F.col("__f"))).drop("__k", "__f")


def _within(key: str) -> Window:
    return Window.partitionBy(key, _FILE).orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0)


def running_sum(df: DataFrame, key: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` up to each row of its key, nulls counting 0. Null keys are one key."""
    rows = ranges(df.withColumn(_SUM, F.coalesce(value, F.lit(0))), key, order)
    placed = _with_summaries(rows, key, [F.sum(_SUM).alias(_TOP)], lambda w: [{_BEFORE: F.sum(_TOP).over(w)}])
    total = F.sum(_SUM).over(_within(key))
    return placed.withColumn(out, F.coalesce(F.col(_BEFORE), F.lit(0)) + total).drop(_FILE, _ROW, _SUM, _BEFORE)


def running_max_before(df: DataFrame, key: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the greatest ``value`` of the rows before each row of its key; null before the first."""
    rows = ranges(df.withColumn(_SUM, value), key, order)
    placed = _with_summaries(rows, key, [F.max(_SUM).alias(_TOP)], lambda w: [{_BEFORE: F.max(_TOP).over(w)}])
    here = F.max(_SUM).over(_within(key).rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn(out, F.greatest(_BEFORE, here)).drop(_FILE, _ROW, _SUM, _BEFORE)


def clamped_balance(df: DataFrame, key: str, order: list[Column], cost: Column, start: Column, out: str) -> DataFrame:
    """``df`` with ``out``: a balance that begins with ``start`` and is max(0, balance - cost) after each row; costs may be negative.

    "Subtract, then clamp" is a map x -> max(x - s, x's floor), and maps of that
    form can be joined in any grouping: with S the running sum of costs and P
    its greatest value so far, the balance is start - S + max(0, P - start). A
    file's summary is its sum and its greatest running sum. ``start`` is the
    same for all rows of a key; a null cost is 0.
    """
    rows = ranges(df.withColumn(_SUM, F.coalesce(cost, F.lit(0))), key, order)
    inside = rows.withColumn(_OVER, F.sum(_SUM).over(_within(key)))

    def before(w: Window) -> list[dict[str, Column]]:
        return [{_BEFORE: F.coalesce(F.sum(_TOP).over(w), F.lit(0))}, {"__high": F.max(F.col(_BEFORE) + F.col("__peak")).over(w)}]

    met = _with_summaries(inside, key, [F.sum(_SUM).alias(_TOP), F.max(_OVER).alias("__peak")], before)
    total = F.col(_BEFORE) + F.col(_OVER)
    peak = F.greatest(F.col("__high"), F.max(total).over(_within(key)))
    return met.withColumn(out, start - total + F.greatest(F.lit(0), peak - start)).drop(_FILE, _ROW, _SUM, _BEFORE, _OVER, "__high")
