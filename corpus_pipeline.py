"""The corpus pipeline: quality rules, line dedup, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``; the mixed order of stage four is the order of the
rows in its files, which stage five reads back from the files' names and row
numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, lines, mixing, packing, quality, simhash
from lodestone.llm.queries import WEIGHTS

#: The stages aren't expressible in SQL as a whole (hashes of 64 bits, robust estimates, tokenizer ids); tests compare them with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or are outliers of their language and source go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines stay in one document only; n_chars follows the text."""
    return lines.dedup_lines(docs, length_col="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, whose members a chain of Jaccard similarities of 0.8 in 5-word shingles links."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in an order that holds the sources' target weights."""
    return mixing.mixed(docs, WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences; pieces keep the CRC-32 of their ids.

    The bins of each class fill in the order of the rows in the files of ``docs``, which is the mixed order.
    """
    own = common.Names(docs)
    file, row = own("file"), own("row")
    placed = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    return packing.pack(placed, with_ids=False, order=(file, row)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what lies between them goes to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = None
    for _, stage in STAGES[:-1]:
        path = common.new_path(spark, "stage")
        with common.scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if held:
            common.remove(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
