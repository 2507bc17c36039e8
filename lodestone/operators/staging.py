"""Tables that operators write between steps, in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.streaming.counters import new_folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, and read again."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
