import corpus_pipeline
import pytest

import __spark_entry__
from lodestone.llm import queries

from ..compare import DATA, connection, rows_of, rows_of_sql
from . import data


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, held = docs.columns, docs
    counts = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, DATA).write.parquet(f"{tmp_path}/{i}")
        held = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert held.columns == names
            counts.append(held.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] == counts[4]
    assert held.select("doc_id").distinct().count() == counts[4]
    assert rows_of(corpus_pipeline.run(spark, DATA).drop("sequence_id", "offset")) == rows_of(held.drop("sequence_id", "offset"))


def test_stages_survive_awkward_rows(spark, tmp_path):
    held = data.frame(spark, clash=False)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held, DATA).write.parquet(f"{tmp_path}/{i}")
        held = spark.read.parquet(f"{tmp_path}/{i}")
    empty = data.frame(spark, clash=False).limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty.write.parquet(f"{tmp_path}/e{i}")
        empty = stage(spark, spark.read.parquet(f"{tmp_path}/e{i}"), DATA)
    assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    names, expected = rows_of_sql(connection(), queries.oracle_sql()[name])
    df = queries.queries()[name](spark, DATA)
    assert sorted(df.columns) == names and rows_of(df) == expected


def test_registered_names():
    found = __spark_entry__.queries()
    assert {"pipeline", *queries.queries()} <= set(found) and len([n for n in found if n.startswith("op")]) == 13
