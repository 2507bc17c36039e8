import pytest
from pyspark.sql import functions as F

from lodestone.llm import compaction

from . import data


def key(r):
    return repr(tuple(r))


def test_appends_compaction_and_versions(spark, tmp_path):
    df = data.frame(spark)
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.read(df.schema).count() == 0
    assert store.append(df, shard_rows=5) == 1
    many = store.manifest().count()
    assert many > 8
    assert store.append(df.where("doc_id < 3"), shard_rows=5) == 2
    before = store.manifest()
    assert before.agg(F.sum("rows")).first()[0] == store.read(df.schema).count()
    assert store.compact() == 3
    after = store.manifest()
    assert after.count() < many and after.agg(F.sum("rows")).first()[0] == before.agg(F.sum("rows")).first()[0]
    everything = sorted(map(key, df.unionByName(df.where("doc_id < 3")).collect()))
    assert sorted(map(key, store.read(df.schema).collect())) == everything
    # older versions stay readable until their files are deleted
    assert sorted(map(key, store.read(df.schema, 1).collect())) == sorted(map(key, df.collect()))
    assert store.compact(min_merge=1000) == 3
    assert store.vacuum() >= 1
    assert sorted(map(key, store.read(df.schema).collect())) == everything


def test_tiers_hold_similar_sizes(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(data.frame(spark), shard_rows=1000)
    for r in store.manifest().collect():
        assert r["tier"] == 0 or compaction.FLOOR_BYTES * compaction.FANOUT ** (r["tier"] - 1) < r["bytes"] <= compaction.FLOOR_BYTES * compaction.FANOUT ** r["tier"]


#: Where a second writer comes in: before the first one lists the version again, writes its manifest, or takes its name.
STEPS = ["_shards", "_commit", "_place"]


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("kind", ["append", "compact"])
def test_one_of_two_interleaved_writers_wins(spark, tmp_path, step, kind):
    root, df = f"file://{tmp_path}/store", data.frame(spark, clash=False)
    first, second = compaction.ShardStore(spark, root), compaction.ShardStore(spark, root)
    first.append(df, shard_rows=5)
    own, came = getattr(first, step), []

    def interrupted(*args):
        if not came:
            came.append(second.append(df.where("doc_id < 3")))
            second.vacuum()
        return own(*args)

    setattr(first, step, interrupted)
    with pytest.raises(compaction.CommitConflict):
        first.append(df) if kind == "append" else first.compact()
    assert came == [2] and first.version() == 2
    wanted = sorted(map(key, df.unionByName(df.where("doc_id < 3")).collect()))
    assert sorted(map(key, first.read(df.schema).collect())) == wanted
    setattr(first, step, own)
    assert first.append(df.limit(1)) == 3 and len(list((tmp_path / "store" / "commits").glob("[!.]*"))) == 3
    first.vacuum()
    assert first.read(df.schema).count() == len(wanted) + 1


@pytest.mark.parametrize("step", STEPS)
def test_vacuum_during_an_append_loses_nothing(spark, tmp_path, step):
    root, df = f"file://{tmp_path}/store", data.frame(spark, clash=False)
    store = compaction.ShardStore(spark, root)
    own = getattr(store, step)

    def interrupted(*args):
        compaction.ShardStore(spark, root).vacuum()
        return own(*args)

    setattr(store, step, interrupted)
    assert store.append(df) == 1
    assert sorted(map(key, store.read(df.schema).collect())) == sorted(map(key, df.collect()))


def test_a_lost_writer_cannot_commit(spark, tmp_path):
    root, df = f"file://{tmp_path}/store", data.frame(spark, clash=False)
    store = compaction.ShardStore(spark, root)

    def late(*args):
        # the files have gone with the lease
        assert compaction.ShardStore(spark, root).vacuum(lease=-1) == 1
        return spark.createDataFrame([], compaction._MANIFEST)

    store._shards = late
    with pytest.raises(compaction.CommitConflict, match="lease"):
        store.append(df)
    assert store.version() == 0


def test_settings_of_the_session_stay(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    store.append(data.frame(spark, clash=False), shard_rows=5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "77777")
    try:
        store.compact()
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "77777"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_table(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    df = data.frame(spark).limit(0)
    assert store.append(df) == 1
    assert store.compact() == 1 and store.read(df.schema).count() == 0


def test_arrivals_with_added_columns(spark, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/store")
    df = data.frame(spark, clash=False)
    wide = df.withColumns({"score": F.length("text"), "tags": F.struct(F.lit("a").alias("x"))})
    wider = df.withColumn("tags", F.struct(F.lit("b").alias("y"))).drop("source")
    for arrival in (df, wide, wider, df):
        store.append(arrival, shard_rows=10)
    schema = f"{data.SCHEMA}, score int, tags struct<x:string,y:string>"
    before = sorted(map(key, store.read(schema).collect()))
    shards = store.manifest().count()
    store.compact()
    store.vacuum()
    assert store.manifest().count() < shards
    assert sorted(map(key, store.read(schema).collect())) == before
    with pytest.raises(TypeError, match="n_chars"):
        store.append(df.withColumn("n_chars", F.col("n_chars").cast("string")))
    assert sorted(map(key, store.read(schema).collect())) == before
