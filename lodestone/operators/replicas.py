"""Replication by difference: a hash tree over key ranges tells which ranges of a replica are out of date.

Keys are whole numbers and a range has a fixed width. A range's digest is its
number of rows and the sums of two hashes of each, so rows need no order; 16
nodes make one of the level above, and a root stands over all. A replica keeps
its tree beside its data. Trees are compared from the root down: only children
of nodes that differ are looked at, and only ranges that differ are taken from
the table and written again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.staging import stage

#: Ranges that a table is cut in when its first replica is made, levels between the ranges and the root, and bits of a level.
RANGES, LEVELS, BITS = 256, 1, 4


def _ranged(df: DataFrame, key: str, width: int) -> DataFrame:
    """``df`` with the range of each row; null keys have a range of their own."""
    return df.withColumn("__range", F.expr(f"CAST(floor(CAST(`{key}` AS DECIMAL(20,0)) / {width}) AS BIGINT)"))


def _digest(text: Column) -> list[Column]:
    sums = [F.sum(F.xxhash64(*seed, text).cast("decimal(38,0)")).cast("string") for seed in ((), (F.lit("second"),))]
    return [F.sha2(F.concat_ws(" ", F.count("*").cast("string"), *sums), 256).alias("digest")]


def tree(df: DataFrame, key: str, width: int) -> DataFrame:
    """(level, node, rows, digest) of a table: ranges are level 0, the root is level LEVELS + 1."""
    # a row as text has its columns' names and its nulls
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    hashed = _ranged(df, key, width).select(F.col("__range").alias("node"), text.alias("t"))
    level = stage(hashed.groupBy("node").agg(F.count("*").alias("rows"), *_digest(F.col("t"))), "tree")
    out = level.withColumn("level", F.lit(0))
    for number in range(1, LEVELS + 2):
        above = F.shiftright("node", BITS) if number <= LEVELS else F.lit(None).cast("bigint")
        # a child's number goes into its part of the digest, so equal ranges can't change places
        child = F.concat_ws(" ", F.coalesce(F.col("node").cast("string"), F.lit("null")), "digest")
        level = level.select(above.alias("node"), "rows", child.alias("t")).groupBy("node").agg(F.sum("rows").alias("rows"), *_digest(F.col("t")))
        out = out.unionByName(level.withColumn("level", F.lit(number)))
    return stage(out, "tree")


def differing(mine: DataFrame, other: DataFrame) -> DataFrame:
    """(node, rows): the ranges whose digests differ in two trees, or that only one has, with the rows that ``mine`` has in them."""
    above = None
    for number in range(LEVELS + 1, -1, -1):
        left = mine.where(F.col("level") == number).select("node", "rows", "digest")
        right = other.where(F.col("level") == number).select(F.col("node").alias("n"), F.col("digest").alias("d"))
        if above is not None:
            parents = F.broadcast(above.select(F.col("node").alias("p")))
            parent = (lambda c: F.shiftright(c, BITS)) if number < LEVELS else (lambda c: F.lit(None).cast("bigint"))
            left = left.join(parents, parent("node").eqNullSafe(F.col("p")), "left_semi")
            right = right.join(parents, parent("n").eqNullSafe(F.col("p")), "left_semi")
        met = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), F.col("node").eqNullSafe(F.col("n")), "full")
        unequal = met.where("l IS NULL OR r IS NULL OR digest <> d")
        # a handful of nodes a level: as many as have changes below them
        above = stage(unequal.select(F.when(F.col("l").isNull(), F.col("n")).otherwise(F.col("node")).alias("node"), F.coalesce("rows", F.lit(0)).alias("rows")), "differing")
        if above.isEmpty():
            break
    return above


class Replica:
    """A copy of a table at ``path``: a folder for each range, and the tree of what is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _drop(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data").drop("__range")

    def sync(self, table: DataFrame, key: str) -> dict[str, int]:
        """Make the replica equal to ``table``; returns how many ranges there are, how many differed, and how many rows were written.

        The first call writes all ranges; their width follows from the least and
        greatest key. Later calls need the same columns. The tree is written
        after the data, so a call that fails is made good by the next one:
        ranges that it had written differ from the old tree and are written
        again. Repeated rows and null keys stay.
        """
        if self._there("tree/_SUCCESS"):
            width = self.spark.read.parquet(f"{self.path}/width").first()["width"]
            mine = tree(table, key, width)
            changed = differing(mine, self.spark.read.parquet(f"{self.path}/tree"))
        else:
            ends = table.agg(F.min(key).alias("a"), F.max(key).alias("z")).first()
            width = max(1, -(-((ends["z"] or 0) - (ends["a"] or 0) + 1) // RANGES))
            self.spark.createDataFrame([(width,)], "width bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/width")
            mine = tree(table, key, width)
            changed = mine.where("level = 0").select("node", "rows")
        ranges = mine.where("level = 0").count()
        # at most one row a range
        moved = changed.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        if moved["n"] or not self._there("tree/_SUCCESS"):
            rows = _ranged(table, key, width).join(F.broadcast(changed.select("node")), F.col("__range").eqNullSafe(F.col("node")), "left_semi")
            rows.repartitionByRange("__range", key).write.partitionBy("__range").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/data")
            for r in changed.where("rows = 0").collect():
                self._drop(f"data/__range={'__HIVE_DEFAULT_PARTITION__' if r['node'] is None else r['node']}")
            mine.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/tree")
        return {"ranges": ranges, "changed": moved["n"], "rows": moved["rows"]}
