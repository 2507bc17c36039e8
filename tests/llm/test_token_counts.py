import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import token_counts as tc

from . import data


def leaves_of(tree):
    return [x for i in range(tree.n) for x in zip(tree.slot(i)[1], tree.slot(i)[2], strict=True)]


def add_up(tree):
    below = tree.sums[2 : 2 * tree.base]
    return np.array_equal(tree.sums[1 : tree.base], below[0::2] + below[1::2])


@pytest.mark.parametrize("block", [1, 4, 64])
def test_trees_after_edits_equal_new_trees(monkeypatch, block):
    monkeypatch.setattr(tc, "BLOCK", block)
    counts = tc.counter(tc.vocabulary())
    rnd = random.Random(block)
    letters = "ab cd 'S's'll've\n\t  　é中9.,!?🙂"
    for _ in range(400):
        x = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 30, 400])))
        tree = tc.Tree.of(x, counts)
        for _ in range(5):
            a = rnd.randint(0, len(x) + 2)
            z = rnd.choice([rnd.randint(a, a + 10), rnd.randint(a, len(x) + 3) if a <= len(x) else a])
            new = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 8, 90])))
            tree.edit(a, z, new)
            x = x[:a] + new + x[z:]
            assert tree.text == x and leaves_of(tree) == list(counts.leaves(x)) and add_up(tree)
            assert (tree.n_chars, tree.n_leaves) == (len(x), len(list(counts.leaves(x))))
        assert tree.n_tokens == len(counts.encoding.encode_ordinary(x))


def test_edits_open_and_encode_little_of_a_long_text():
    counts = tc.counter(tc.vocabulary())
    text = "some words of a long text, " * 40_000
    tree = tc.Tree.of(text, counts)
    assert tree.edit(500_000, 500_004, "new") < 60
    assert tree.edit(900_000, 900_000, " again") < 60
    assert len(tree.slots) <= 6 and tree.n > 4000
    assert tree.n_tokens == len(counts.encoding.encode_ordinary(tree.text))


def test_stored_trees_read_touched_slots_only(spark, tmp_path):
    counts = tc.counter(tc.vocabulary())
    text = "one and another sentence of a stored text.\n" * 3000
    tc.build(spark.createDataFrame([(1, text), (2, "short")], "id long, text string"), "id", "text").write.parquet(f"{tmp_path}/trees")
    table = pq.read_table(f"{tmp_path}/trees").sort_by("id").combine_chunks()
    slots = table.column("slots").chunk(0)
    tree = tc.stored_tree(slots, 0, counts)
    assert (tree.n_chars, tree.n_tokens) == (len(text), table.column("n_tokens")[0].as_py())
    tree.edit(60_000, 60_003, "x")
    assert len(tree.slots) <= 3
    assert tree.n_tokens == len(counts.encoding.encode_ordinary(text[:60_000] + "x" + text[60_003:]))
    assert tc.stored_tree(slots, 1, counts).text == "short"


def test_awkward_rows(spark):
    rows = data.documents()
    edits = F.expr("CASE WHEN doc_id % 3 = 0 THEN array(named_struct('start', 2L, 'end', 9L, 'text', ' new text'), named_struct('start', null, 'end', null, 'text', null), null, named_struct('start', 999999L, 'end', 0L, 'text', 'end')) WHEN doc_id % 3 = 1 THEN array() END")
    build = lambda df: tc.build(df, "doc_id", "text", keep=("edits",))
    got = tc.apply_edits(build(data.frame(spark).withColumn("edits", edits)), "edits").collect()
    counts = tc.counter(tc.vocabulary())
    size = lambda t: len(counts.encoding.encode_ordinary(t))
    expected = []
    for i, t, *_ in rows:
        t = t or ""
        after = t
        if i is not None and i % 3 == 0:
            after = t[:2] + " new text" + t[9:] if len(t) > 2 else t + " new text"
            after += "end"
        expected.append((repr(i), size(t), size(after), len(after)))
    assert sorted((repr(r["id"]), r["n_tokens"], r["n_tokens_after"], r["n_chars_after"]) for r in got) == sorted(expected)
    assert tc.apply_edits(build(data.frame(spark).limit(0).withColumn("edits", F.lit(None).cast(tc.EDITS))), "edits").count() == 0


def test_two_batches_of_edits_go_on_from_each_other(spark):
    counts = tc.counter(tc.vocabulary())
    rows = [(1, "some words of a text. " * 200), (2, ""), (3, "short one")]
    one = F.expr("array(named_struct('start', 4L, 'end', 9L, 'text', ' new'), named_struct('start', 2L, 'end', 2L, 'text', 'x y'))")
    two = F.expr("array(named_struct('start', 0L, 'end', 1L, 'text', '12 '), named_struct('start', 40L, 'end', 900L, 'text', ''))")
    trees = tc.build(spark.createDataFrame(rows, "id long, text string"), "id", "text").withColumn("edits", one)
    first = tc.apply_edits(trees, "edits", trees_after=True)
    second = first.select("id", F.col("n_tokens_after").alias("n_tokens"), "slots", two.alias("edits"))
    got = {r["id"]: r for r in tc.apply_edits(second, "edits", trees_after=True).collect()}
    whole = {r["id"]: r for r in tc.apply_edits(trees.withColumn("edits", F.concat(one, two)), "edits").collect()}
    for i, text in rows:
        for a, z, new in ((4, 9, " new"), (2, 2, "x y"), (0, 1, "12 "), (40, 900, "")):
            a, z = min(a, len(text)), min(z, len(text))
            text = text[:a] + new + text[z:]
        assert "".join(s["text"] for s in got[i]["slots"]) == text
        assert got[i]["n_tokens_after"] == whole[i]["n_tokens_after"] == len(counts.encoding.encode_ordinary(text))
        assert sum(s["n_tokens"] for s in got[i]["slots"]) == got[i]["n_tokens_after"]
