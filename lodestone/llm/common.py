"""Shared pieces of the corpus operators: staging in the cluster's shared folder, ranks without hot groups."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of the word and line definitions: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Used only where a session on this machine alone names no shared folder, as in tests.
OWN_FOLDER = "file:///tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``; without it, a cluster raises ValueError."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name the folder that driver and executors share")
        shared = OWN_FOLDER
    return shared.rstrip("/") + "/lodestone"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


#: The folder of the innermost ``scratch``, below the shared one.
_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}{_SCRATCH.get()}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators stage while it lasts goes when it ends; results must be written elsewhere by then."""
    folder = f"/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(folder)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        remove(spark, shared_folder(spark) + folder)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def stage(df: DataFrame, label: str, path: str | None = None, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: what was made from them has been staged itself."""
    for df in staged:
        remove(df.sparkSession, df.staged_at)


#: Rows of a staged table that is broadcast.
SMALL_ROWS = 50_000


def small(staged: DataFrame) -> DataFrame:
    """A staged table, marked for broadcast if it has at most SMALL_ROWS rows (read from the files' footers).

    Rows then meet it where they are, also where a group has a third of them;
    beyond, the join is dealt by key, and AQE splits what is skewed.
    """
    return F.broadcast(staged) if staged.count() <= SMALL_ROWS else staged


class Names:
    """Column names that no given frame has: ``names("rank")`` is ``__rank``, with more underscores where that is taken."""

    def __init__(self, *frames: DataFrame):
        self.taken = {c.lower() for df in frames for c in df.columns}

    def __call__(self, label: str) -> str:
        name = f"__{label}"
        while name.lower() in self.taken:
            name = f"_{name}"
        self.taken.add(name.lower())
        return name

    def prefix(self, label: str) -> str:
        """A prefix that no name has."""
        name = f"__{label}_"
        while any(c.startswith(name.lower()) for c in self.taken):
            name = f"_{name}"
        return name


#: Rows that a range of ``ranked`` has on average.
RANGE_ROWS = 4096


def ranked(df: DataFrame, group: list[str], order: list[Column], out: str, own: Names, part: Callable[[int], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Number the rows of each group from 0 in an order, without bringing a group together.

    The order is cut in ranges: ``part(digits)`` gives the first hexadecimal
    digits of ``order``, so many that a range has about RANGE_ROWS rows; the
    numbers don't depend on how many. Without ``part`` the order is that of the
    64-bit hash of ``order``, then ``order``. Rows are numbered inside a
    (group, range) pair, and the small table of counts per pair gives each pair
    its first number. ``df`` is read three times, so pass a staged frame if it
    is costly. Returns the numbered rows, and (group, n) counts.
    """
    h, b, first, gb = own("h"), own("b"), own("first"), own("gb")
    digits = max(1, min(5, math.ceil(math.log(max(1, df.count() / RANGE_ROWS), 16))))
    if part is None:
        keyed = df.withColumn(h, F.xxhash64(*order)).withColumn(b, F.shiftrightunsigned(h, 64 - 4 * digits).cast("int"))
        # a range of the bits read as an unsigned number has the hashes of one sign
        order = [F.col(h), *order]
    else:
        keyed = df.withColumn(b, part(digits))
    placed, totals = numbered(keyed, group, order, out, b, own)
    return placed.drop(h, b, first, gb), totals


def numbered(keyed: DataFrame, group: list[str], order: list[Column], out: str, b: str, own: Names) -> tuple[DataFrame, DataFrame]:
    """``ranked`` for rows that have their range in column ``b``, which ``order`` refines."""
    first, gb, n = own("first"), own("gb"), own("n")
    keys = {g: own("g") for g in group}
    counts = keyed.groupBy(*group, b).agg(F.count("*").alias(n))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(k) for g, k in keys.items()], F.col(b).alias(gb), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    within = Window.partitionBy(*group, b).orderBy(*order)
    rows = keyed.withColumn(out, F.row_number().over(within) - 1)
    same = F.col(b).eqNullSafe(F.col(gb))
    for g, k in keys.items():
        same = same & F.col(g).eqNullSafe(F.col(k))
    placed = rows.join(starts, same).withColumn(out, (F.col(out) + F.col(first)).cast("long"))
    return placed.drop(first, gb, *keys.values()), counts.groupBy(*group).agg(F.sum(n).alias("n"))
