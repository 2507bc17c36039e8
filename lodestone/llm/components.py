"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import common


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component is the least node it reaches.

    Each round links every node to the least node it knows of and halves the
    distances, so the rounds grow with the logarithm of the longest path. Every
    round is two aggregates with map-side minima and two joins (a hub's rows
    may be split), written to the shared folder. Loops and repeated edges are
    harmless, edges with a null end are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    held = common.new_path(spark, "edges")
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = common.stage(clean, "edges", held)
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        down = large.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = down.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        path = common.new_path(spark, "edges")
        now = common.stage(small, "edges", path)
        common.remove(spark, held)
        held = path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        state = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
