import hashlib
import random

import pyarrow as pa

from lodestone.llm import lines

from . import data

WS = " \t\n\x0b\x0c\r"
LOW = {i: i + 32 for i in range(65, 91)}


def key(line):
    return line.strip(WS).translate(LOW)


def brute(rows, min_chars=20, min_docs=3):
    docs = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                docs.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        kept, all_lines = [], (t or "").split("\n")
        for x in all_lines:
            d = docs.get(key(x), set())
            if len(d) >= min_docs and i != max(d, key=lambda v: (v is not None, v or 0)):
                continue
            kept.append(x)
        out.append((repr(i), len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(df):
    done = lines.keep_bitmaps(df).withColumn("kept", lines.kept_text())
    return sorted((repr(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in done.collect())


def test_against_dictionaries(spark):
    rows = data.documents()
    assert run(data.frame(spark)) == brute([(r[0], r[1]) for r in rows])


def test_one_line_over_many_partitions(spark):
    line = "one very common line of text"
    rows = [(i, f"{line}\nown {i} {line}\n {line.upper()}\t\n{line[:19]}", "en", "s", 0) for i in range(300)] + [(None, line, None, None, 0), (7, line, "en", "s", 0)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark.createDataFrame(rows, data.SCHEMA).repartition(6)) == brute([(r[0], r[1]) for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rewritten_documents_keep_their_columns(spark):
    df = data.frame(spark)
    done = lines.dedup_lines(df, length_col="n_chars")
    assert done.columns == df.columns and done.count() == df.count()
    for r in done.collect():
        assert r["n_chars"] == len(r["text"] or "")
    assert done.where("text IS NULL").count() == 2 and done.where("n_lines = 'own n_lines' AND keep_bitmap = 'own keep_bitmap'").count() == df.count()
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_bitmap_round_trip():
    import zlib

    import numpy as np

    bits = np.array([1, 0, 1, 1, 1, 1, 1, 1], np.uint8)
    assert lines.kept_lines("a\nb\nc\n\nd\ne\nf\ng\nh\ni", zlib.compress(np.packbits(bits).tobytes())) == "a\nc\n\nd\ne\nf\ng\nh\ni"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_partitions_stream_alike_however_batches_fall():
    rnd = random.Random(11)
    for _ in range(150):
        rows = []
        for key in sorted(rnd.sample(range(-50, 50), rnd.randint(1, 8))):
            for doc in sorted((rnd.randint(0, 4) for _ in range(rnd.choice([1, 1, 2, 7, 30]))), reverse=True):
                rows.append((key, key % 3, None if doc == 0 else doc, 5, len(rows)))
        runs = {}
        for r in rows:
            runs.setdefault(r[:2], []).append(r)
        expected = []
        for i, (key, mine) in enumerate(runs.items()):
            docs = list(dict.fromkeys(r[2] for r in mine))
            if i == 0:
                expected += [(1, *r) for r in mine]
            elif len(docs) >= 3:
                expected += [(0, *r) for r in mine if r[2] != docs[0]]
            elif i == len(runs) - 1:
                expected += [(1, *r) for r in mine]
            if i in (0, len(runs) - 1):
                expected.append((2, *key, docs[0], 0, len(docs)))
        cuts = sorted({0, len(rows), *(rnd.randint(0, len(rows)) for _ in range(rnd.randint(0, 6)))})
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a:z]], pa.int64()) for c in range(5)], ["h1", "h2", "doc", "th", "pos"]) for a, z in zip(cuts, cuts[1:])]
        got = [tuple(r.values()) for b in lines._stream(3)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
