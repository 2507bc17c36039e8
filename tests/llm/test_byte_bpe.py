import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lodestone.llm import byte_bpe, queries, shares

from . import data


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(byte_bpe.vocabulary()), special_tokens={})


def odd_texts(n=400):
    rnd = random.Random(5)
    marks = [" ", "  ", "\n", "\t", "　", "\x85", "\x1c", "'s", "'LL", "don't", "123", "٣", "é", "é", "中文", "🙂", "​", "<|endoftext|>", "word", "Straße", "\x00", "﻿", "ǅ", "²", "_"]
    return ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_ids_are_the_librarys(spark, library):
    rows = list(enumerate(odd_texts())) + [(-1, None), (-2, "x" * 50_000), (-3, " " * 3000), (None, "no id")]
    got = byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "doc_id", "text", decoded=True).collect()
    shown = sorted((repr(r["id"]), r["n_tokens"], list(r["ids"]), bytes(r["decoded"]).decode()) for r in got)
    assert shown == sorted((repr(i), len(x), x, t or "") for i, t in rows for x in [library.encode_ordinary(t or "")])


@pytest.mark.parametrize("size", [1 << 24, 500])
def test_awkward_documents_round_trip(spark, monkeypatch, library, size):
    monkeypatch.setattr(shares, "SHARE", size)
    rows = data.documents()
    encoded = byte_bpe.encode(data.frame(spark), "doc_id", "text")
    assert encoded.columns == ["id", "n_tokens", "ids"]
    assert sorted((repr(r["id"]), list(r["ids"])) for r in encoded.collect()) == sorted((repr(i), library.encode_ordinary(t or "")) for i, t, *_ in rows)
    assert sorted((repr(r["id"]), bytes(r["bytes"]).decode()) for r in byte_bpe.decode(encoded, "id", "ids").collect()) == sorted((repr(i), t or "") for i, t, *_ in rows)


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    monkeypatch.setattr(shares, "SHARE", 100)
    df = spark.createDataFrame([(i, "the same words again") for i in range(300)], "doc_id long, text string").repartition(4)
    stored = shares.shares(df.selectExpr("doc_id AS id", "CAST(NULL AS STRING) AS grp", "text AS value"), lambda t: t.split(), "string")
    found = shares.entries(stored)
    assert stored.count() >= 60 and found.groupBy("entry").sum("uses").count() == 4
    calls = []
    monkeypatch.setattr(byte_bpe, "_merges", lambda *_: type("Merges", (), {"encode_ordinary": staticmethod(lambda w: calls.append(w) or [len(w)])}))
    monkeypatch.setattr(byte_bpe, "HELD", 30)
    sorted_rows = found.select("share", "code", "entry").orderBy("entry").toArrow().to_batches(max_chunksize=7)
    sent = list(byte_bpe._coded("", "")(iter(sorted_rows)))
    assert sorted(calls) == ["again", "same", "the", "words"]
    assert sum(len(shares.unpacked(b.column("codes")[0].as_py())) for b in sent) == found.count()


def test_query_digests(spark, library, tmp_path):
    rows = data.documents()
    data.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_byte_bpe(spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = [(repr(i), len(x), sha(",".join(map(str, x))), sha(t or "")) for i, t, *_ in rows for x in [library.encode_ordinary(t or "")]]
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(expected)


def test_empty(spark):
    empty = data.frame(spark, [])
    assert byte_bpe.encode(empty, "doc_id", "text", decoded=True).count() == 0
    lists = spark.createDataFrame([(1, [72, None]), (2, None), (None, [])], "doc_id long, ids array<int>")
    assert sorted((repr(r["id"]), bytes(r["bytes"])) for r in byte_bpe.decode(lists, "doc_id", "ids").collect()) == [("1", byte_bpe_bytes(72)), ("2", b""), ("None", b"")]


def byte_bpe_bytes(token):
    return {i: t for t, i in byte_bpe.ranks(byte_bpe.vocabulary()).items()}[token]
