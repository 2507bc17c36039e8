"""Queries against their SQL on small tables with odd rows, each of which once gave another result."""

import datetime
import difflib
import math
import random
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.operators import leaks as L
from lodestone.operators import retrieval as R
from lodestone.operators import set_join as J
from lodestone.operators import substrings as SUB
from lodestone.operators import windows as W
from lodestone.plans import registry
from lodestone.plans import search_queries as Q
from lodestone.sources import files as S
from lodestone.streaming import sessions as ST

from .compare import connection, rows_of, rows_of_sql


def same_as_sql(spark, folder, name, **tables):
    """Whether the query over ``tables`` (name to columns) has the rows of its SQL."""
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
    df = registry.queries()[name](spark, str(folder))
    names, expected = rows_of_sql(connection(str(folder)), registry.oracle_sql()[name])
    return sorted(df.columns) == names and rows_of(df) == expected


def test_attempts_within_an_hour_of_parts_of_seconds(spark, tmp_path):
    at = [0, 499_999, 500_000, 1_500_000, 3_600_400_000, 3_600_500_000, 3_600_600_000, 3_601_499_999, 3_601_500_000, 7_201_700_000]
    ts = [datetime.datetime(2024, 1, 5) + datetime.timedelta(microseconds=x) for x in at]
    events = {"event_id": list(range(2 * len(ts))), "ts": ts * 2, "user_id": [1] * len(ts) + [None] * len(ts)}
    assert same_as_sql(spark, tmp_path, "w11_attempts_in_span", events=events)


def test_sentences_of_documents_with_marks_and_breaks_at_odd_places(spark, tmp_path):
    texts = ["", None, ".", "!", "...", "abc", "abc\n", "abc def.\n", "a" * 50 + "\n", "a" * 50 + "\r\n", "a" * 39 + "!\n\nmore", "a" * 39 + "? more. End", "a" * 60 + "\u2028", "a" * 60 + "!\u2028more", "a" * 45 + "!\x0bmore? end"]
    texts += ["b" * 40 + "c" * 449 + "\n" + "d", "b" * 40 + "c" * 449 + ".d", "é" * 45 + "😀.\rx", ".starts. so", "one. Two three four five six seven eight nine. ten", "a" * 45 + "\n\n\n", "a" * 45 + "?!\n", "a" * 45 + "\u0085"]
    documents = {"doc_id": list(range(len(texts))), "text": texts}
    assert same_as_sql(spark, tmp_path, "t26_document_sentences", documents=documents)


def test_database_scan_reads_files_that_every_executor_sees(spark, tmp_path, monkeypatch):
    customer = {"c_custkey": [*range(1, 12), None], "c_name": ["a", None, "c'", "é", "e", "f", "g", "h", "i", "j", "k", "l"], "c_nationkey": pa.array([1] * 12, pa.int32()), "c_acctbal": [5000.0, 5000.5, None, 6000.25, -1.0] + [7000.0] * 7, "c_mktsegment": ["BUILDING"] * 9 + ["AUTO", None, "BUILDING"]}
    # a database in the driver's memory is not there for others
    monkeypatch.setattr(S, "read_table", None)
    assert same_as_sql(spark, tmp_path, "s15_database_scan", customer=customer)
    rows = spark.read.parquet(f"{tmp_path}/customer.parquet")
    files = S.database_files(rows, "t", "c_custkey", 3).collect()
    assert sum(r["n"] for r in files) == 12 and max(r["n"] for r in files) <= 3


def test_relational_database_over_jdbc(spark):
    url, driver = f"jdbc:derby:memory:x{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(10).selectExpr("id", "id * 2 AS x").write.jdbc(url, "t", properties={"driver": driver})
    rows = S.read_table(spark, url, "t", "id", (0, 10), 4, driver=driver)
    assert rows.rdd.getNumPartitions() == 4 and sorted(tuple(r) for r in rows.where("x > 10").collect()) == [(i, 2 * i) for i in range(6, 10)]


def test_files_of_documents_are_texts_whatever_the_documents_begin_with(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "FILE_ROWS", 2)
    texts = ["a,b\nc,d\ne,f\n", "<html>\nx y z", '{"a": 1}\nb', "%PDF-1", "plain", None, "", "x\n\n  \ny"]
    pages = {"page_id": [1, 2, 3], "url": ["u"] * 3, "html": ["<p>one two three</p>\n<p>four five six</p>", "<h1>T</h1>", None]}
    supplier = {"s_suppkey": [1, 2, 3, 4, 5], "s_name": [f"Supplier#{i}" for i in range(5)], "s_nationkey": [1] * 5, "s_acctbal": [1.5] * 5}
    assert same_as_sql(spark, tmp_path, "s1_dispatch", documents={"doc_id": list(range(8)), "text": texts}, pages=pages, supplier=supplier)


def test_bm25_moves_only_terms_of_the_queries(spark):
    """Scores with null and empty texts; a text's other words are dropped before the exchange by chunk."""
    texts = ["alpha beta beta", "beta gamma_x", None, "", "no-thing here alpha alpha", "gamma_x gamma_x delta"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")
    got = R.bm25(chunks, spark.createDataFrame([("q", "beta", 1.0), ("q", "alpha", 2.0), ("p", "delta", 0.2), ("p", "absent", 1.0)], "query string, term string, weight double"))
    tokens = [re.findall(r"[a-z0-9_-]{3,}", (t or "").lower()) for t in texts]
    n, mean = len(tokens), sum(map(len, tokens)) / len(tokens)
    idf = {t: math.log((n - d + 0.5) / (d + 0.5)) for t in {x for ts in tokens for x in ts} for d in [sum(t in ts for ts in tokens)]}
    average = sum(idf.values()) / len(idf)
    expected = {}
    for q, t, times in (("q", "beta", 1), ("q", "alpha", 2), ("p", "delta", 1)):
        for i, ts in enumerate(tokens):
            if (tf := ts.count(t)):
                score = times * (idf[t] if idf[t] >= 0 else 0.25 * average) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / mean))
                expected[q, i] = expected.get((q, i), 0.0) + score
    found = {(r["query"], r["chunk"]): r["bm25"] for r in got.collect()}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_of_odd_vectors_without_a_row_for_each_pair(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(3000)]
    rows += [(5000 + i, rows[3][1]) for i in range(700)] + [(7000, None), (7001, []), (7002, [0.0] * 8), (7003, [1.0]), (7004, [1.0, None] + [0.0] * 6), (None, rows[3][1]), (7005, [math.nan] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    asked = df.where("vec_id % 500 = 3 OR vec_id >= 7000 OR vec_id = 5100").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    scored = R.similarities(df, asked)
    wanted = W.first_per(scored, ["query"], [F.desc("similarity"), F.col("id")], 20)
    got = R.nearest(df, asked, 20)
    shown = lambda x: sorted(((r["query"], r["id"], str(round(r["similarity"], 9))) for r in x.collect()), key=repr)
    assert shown(got) == shown(wanted)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_similar_pairs_keep_the_links_of_texts_with_one_set_of_words(spark, tmp_path):
    long = [f"w{i}" for i in range(60)]
    texts = ["a b c", "c b a", "a b c", "x", " ".join(long), " ".join(reversed(long)), " ".join([*long, "more"]), " ".join([*long, "more", "more"]), None, None, "c a b"]
    documents = {"doc_id": list(range(11)), "text": texts, "lang": ["en"] * 9 + ["de", None]}
    assert same_as_sql(spark, tmp_path, "j16_similar_pairs", documents=documents)
    found = {(r["a"], r["b"]) for r in registry.queries()["j16_similar_pairs"](spark, str(tmp_path)).collect()}
    assert found == {(0, 1), (0, 2), (4, 5), (4, 6), (6, 7)}


@pytest.mark.parametrize("least,common", [(0.6, 1 << 20), (0.8, 1 << 20), (0.8, 3), (0.97, 0)])
def test_near_copies_are_compared_in_blocks_and_not_pair_by_pair(spark, monkeypatch, least, common):
    """A crowd of near copies gives all its pairs, few of which meet by words."""
    monkeypatch.setattr(J, "BLOCK", 40)
    monkeypatch.setattr(J, "WIDTH", 16)
    monkeypatch.setattr(J, "COMMON", common)
    monkeypatch.setattr(J, "RARE", 2)
    met, plain = [], J.stage
    monkeypatch.setattr(J, "stage", lambda df, label: met.append(plain(df, label)) or met[-1] if label == "near" else plain(df, label))
    rnd = random.Random(7)
    rows, base = [], [f"base{i}" for i in range(60)]
    for i in range(170):
        words = list(base)
        for _ in range(rnd.randint(0, 8)):
            words[rnd.randrange(60)] = f"own{rnd.randrange(500)}"
        rows.append((i, words, "x" if i % 10 else "y"))
    rows += [(1000 + i, [f"w{rnd.randrange(90)}" for _ in range(rnd.randint(1, 9))], "x") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, words array<string>, g string").repartition(3)
    classes, pairs = J.similar_sets(df, "id", "g", F.col("words"), least)
    sets = {i: (g, frozenset(words)) for i, words, g in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = [(i, *sets[i]) for i in first.values()]
    expected = {(a, b) for a, ga, wa in reps for b, gb, wb in reps if a < b and ga == gb and len(wa & wb) / len(wa | wb) >= least}
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert sorted(got) == sorted(expected)
    assert least > 0.9 or met[0].count() < len(expected) / 4


@pytest.mark.parametrize("bits", [1 << 5, 1 << 17, 1 << 26])
def test_sets_that_no_comparison_needs_stay_where_they_are(spark, monkeypatch, bits):
    """However few bits there are, and also where the planner would broadcast nothing, the pairs are those of a loop."""
    monkeypatch.setattr(J, "BITS", bits)
    moved, plain = {}, J.stage
    monkeypatch.setattr(J, "stage", lambda df, label: moved.update({label: df}) or plain(df, label))
    rnd = random.Random(3)
    sets = {i * (-1) ** i: [f"w{i}x{k}" for k in range(40)] for i in range(300)}
    for i in range(0, 300, 3):
        sets[1000 + i] = [*sets[i * (-1) ** i][rnd.randrange(3):], "more"]
    df = spark.createDataFrame([(i, w, "g") for i, w in sets.items()], "id long, words array<string>, g string").repartition(3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = J.similar_sets(df, "id", "g", F.col("words"), 0.9)[1].collect()
        plan = moved["compared"]._jdf.queryExecution().executedPlan().toString()
        n = moved["compared"].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    words = {i: set(w) for i, w in sets.items()}
    expected = sorted((a, b) for a in words for b in words if a < b and len(words[a] & words[b]) / len(words[a] | words[b]) >= 0.9)
    assert len(expected) == 100 and sorted((r["a"], r["b"]) for r in got) == expected
    assert n >= 200 and (bits < 1 << 26 or n < 210)
    assert "Exchange hashpartitioning(id" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("bits", [64, 512])
def test_sets_with_the_same_rare_words_alone_are_not_fetched(spark, monkeypatch, bits):
    """Pairs that share all their first words and differ in the frequent ones end at their sketches; no similar pair does."""
    monkeypatch.setattr(J, "SKETCH", bits)
    met, plain = {}, J.stage
    monkeypatch.setattr(J, "stage", lambda df, label: met.update({label: plain(df, label)}) or met[label])
    rnd = random.Random(11)
    sets = []
    for k in range(80):
        rare, pool = [f"rare{k}x{i}" for i in range(12)], rnd.sample(range(100), 56)
        sets += [rare + [f"often{i}" for i in pool[:28]], rare + [f"often{i}" for i in (pool[28:] if k % 8 else [*pool[:rnd.randint(23, 27)], pool[40]])]]
    df = spark.createDataFrame([(i, w, "g") for i, w in enumerate(sets)], "id long, words array<string>, g string").repartition(3)
    got = sorted((r["a"], r["b"]) for r in J.similar_sets(df, "id", "g", F.col("words"), 0.8)[1].collect())
    words = list(map(set, sets))
    expected = [(a, b) for a in range(160) for b in range(a + 1, 160) if len(words[a] & words[b]) / len(words[a] | words[b]) >= 0.8]
    assert len(expected) >= 10 and got == expected
    assert bits < 512 or met["near"].count() < 20


def test_state_sees_pieces_of_sessions_and_not_events(spark, tmp_path, monkeypatch):
    """Pieces are those of a loop, however a task's events are cut; odd events give the sessions of the SQL."""
    hour = 3_600_000_000
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 0, 1, 2, -3]), rnd.randrange(100) * 6 * hour + rnd.randrange(2), float(rnd.randrange(9))) for _ in range(120)]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("user_id", "at", "value"), map(list, zip(*part))))) for part in (rows[:50], rows[50:51], rows[51:])]

    def sessions(pieces):
        found = {}
        for user, first, last, n, total in sorted(pieces, key=lambda p: (p[0] is None, p[0] or 0, p[1:])):
            own = found.setdefault(user, [])
            if own and first - own[-1][1] <= 24 * hour:
                own[-1] = (own[-1][0], max(last, own[-1][1]), own[-1][2] + n, own[-1][3] + total)
            else:
                own.append((first, last, n, total))
        return found

    expected = sessions((u, at, at, 1, v) for u, at, v in rows)
    for held in (1 << 21, 40):
        monkeypatch.setattr(ST, "HELD", held)
        pieces = [tuple(r.values()) for b in ST._pieces(24)(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
        assert sessions(pieces) == expected and len(pieces) < len(rows)
        assert held == 40 or len(pieces) == sum(map(len, expected.values()))
    start = datetime.datetime(2024, 1, 5)
    at = [start + datetime.timedelta(hours=h, microseconds=u) for h, u in [(0, 0), (0, 0), (24, 0), (48, 1), (72, 1), (96, 2), (200, 0), (224, 0), (400, 5), (423, 0), (600, 0), (624, 0)]]
    events = {"event_id": list(range(3 * len(at) + 1)), "ts": at * 3 + [start], "user_id": [1] * len(at) + [None] * len(at) + [2] * len(at) + [9], "value": [1.5, None] * (3 * len(at) // 2) + [None]}
    # a session that ends with the last event is not over; many users share a state
    for k, (user, hours) in enumerate([(7, 600), (8, 599), *((u, u % 625) for u in range(100, 900, 2))]):
        for name, value in (("event_id", 1000 + k), ("ts", start + datetime.timedelta(hours=hours)), ("user_id", user), ("value", 2.0)):
            events[name].append(value)
    for buckets in (4096, 3):
        monkeypatch.setattr(ST, "BUCKETS", buckets)
        assert same_as_sql(spark, tmp_path, "x2_refreshed_state", events=events)


def test_terms_of_quotes_are_looked_for_in_one_pass(spark, tmp_path):
    benchmark = {"item_id": [0, 10, 20, 5, 30], "text": ["Alpha beta alpha gamma", "the a an", "delta epsilon zeta été", "alpha beta gamma", None]}
    texts = ["ALPHABET gamma", "alpha", "beta gamma", None, "", "delta epsilon", "zeta delta t", "gammabetaalpha deltaepsilonzeta"]
    assert same_as_sql(spark, tmp_path, "t25_terms_grounded", benchmark=benchmark, documents={"doc_id": list(range(8)), "text": texts})
    df = registry.queries()["t25_terms_grounded"](spark, str(tmp_path))
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_hits_of_many_texts_are_held_for_some_at_a_time(spark, monkeypatch):
    """Results do not depend on how a batch is cut, and small cuts are what a task holds."""
    monkeypatch.setattr(SUB, "TEXTS", 3)
    monkeypatch.setattr(SUB, "CHUNK", 16)
    texts = [f"x{i % 7} needle{i % 5} é" * (i % 4) for i in range(50)] + [None, ""]
    needles = [(0, "needle3 é"), (1, "x6"), (2, "é"), (3, ""), (4, "nothing here")]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = SUB.contained(docs, "id", "t", spark.createDataFrame(needles, "i int, n string"), "i", "n")
    assert sorted((r["id"], r["needle"]) for r in got.collect()) == sorted((i, j) for i, t in enumerate(texts) if t for j, n in needles if n and n in t)


def test_pairs_far_apart_in_letters_have_no_ratio_worked_out(monkeypatch):
    a, b = "the quick brown fox jumps", "zzzz zzzz zzzz zzzz zzzz"
    near = "the quick brown fix jumps"
    assert L._bounded_ratio(a, near, {}) == difflib.SequenceMatcher(None, a, near).ratio()
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert L._bounded_ratio(a, b, {}) == 0.0
