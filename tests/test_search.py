"""Indexes and joins against brute force: neighbours, similar sets, substrings, many patterns, scans in two levels."""

import difflib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import fuzzy as Z
from lodestone.operators import matching as M
from lodestone.operators import patterns as A
from lodestone.operators import replicas as R
from lodestone.operators import scans as S
from lodestone.operators import set_join as J
from lodestone.operators import substrings as SUB
from lodestone.operators import vector_index as X
from lodestone.operators import windows as W
from lodestone.operators.retrieval import nearest

from .compare import DATA


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_index_finds_nine_of_ten_neighbours_of_clustered_and_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "ROWS", 100)
    monkeypatch.setattr(X, "QUERIES", 3)
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 20))
    rows = [(i, (centres[i % 12] + 0.3 * rnd.normal(size=20)).tolist()) for i in range(900)]
    # a hot list of repeated vectors, and rows without a direction
    rows += [(1000 + i, rows[0][1]) for i in range(400)] + [(2000, None), (2001, []), (2002, [0.0] * 20), (2003, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    index = X.VectorIndex(spark, str(tmp_path / "index"), X.fit(df, "id", "v", k=10))
    index.save()
    index.add(df, "id", "v")
    index = X.VectorIndex.load(spark, str(tmp_path / "index"))
    assert index.rows().count() == len(rows)
    asked = df.where("id % 50 = 7").select(F.col("id").alias("query"), F.col("v").alias("vector"))
    found = index.search(asked, df, "id", "v", 10)
    assert max(n for (n,) in values(found.groupBy("query").count(), "count")) == 10
    got = X.recall(found, nearest(df, asked, 10, "id", "v"))
    assert sum(h for (h,) in values(got, "hits")) >= 0.9 * sum(n for (n,) in values(got, "wanted"))
    assert index.model.probes(X.RECALL) < len(index.model.centroids) / 2


def test_an_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "id long, v array<double>")
    index = X.VectorIndex(spark, str(tmp_path), X.fit(df, "id", "v"))
    assert index.model.probes(1.0) == 1


@pytest.mark.parametrize("least", [0.5, 0.8, 0.97])
def test_similar_sets_against_all_pairs(spark, least):
    rnd = random.Random(int(100 * least))
    base = [[f"w{rnd.randrange(300)}" for _ in range(rnd.randint(1, 60))] for _ in range(12)]
    rows = [(1000, None, "x"), (1001, [], "x"), (1002, [None], "x"), (1003, ["w1"], None), (1004, ["w1"], None)]
    for i in range(150):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(400)}"
        rows.append((i, [*words, words[0], "the"], rnd.choice("xxy")))
    df = spark.createDataFrame(rows, "id int, words array<string>, g string").repartition(4)
    classes, pairs = J.similar_sets(df, "id", "g", F.col("words"), least)
    sets = {i: (g, frozenset(w for w in words or [] if w is not None)) for i, words, g in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert dict(values(classes, "id", "class")) == {i: first[s] for i, s in sets.items()}
    reps = [(i, *sets[i]) for i in first.values() if sets[i][0] is not None and sets[i][1]]
    expected = {(a, b) for a, ga, wa in reps for b, gb, wb in reps if a < b and ga == gb and len(wa & wb) / len(wa | wb) >= least}
    assert sorted(values(pairs, "a", "b")) == sorted(expected) and (expected or least > 0.9)
    links = dict(values(J.class_links(classes, pairs), "id", "n_links"))
    assert links == {i: sum(first[s] in p for p in expected) for i, s in sets.items()}


@pytest.mark.parametrize("block,chunk", [(4 << 20, 4 << 20), (40, 37)])
def test_substrings_against_contains(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(SUB, "BLOCK", block)
    monkeypatch.setattr(SUB, "CHUNK", chunk)
    rnd = random.Random(block)
    texts = ["".join(rnd.choice(["ab", "é", " ", "policy", "x", "internationalization", "日本"]) for _ in range(rnd.randint(0, 40))) for _ in range(120)]
    needles = ["a", "é", "b ", "xé", "policy", "nternational", "internationalization", "日", "ionab", "no such text", "cyx", "polic", "ab" * 5]
    needles += [t[a : a + rnd.randint(1, 25)] for t in texts[:25] if len(t) > 5 for a in [rnd.randrange(len(t))]]
    docs = spark.createDataFrame([*enumerate(texts), (500, None), (501, ""), (7, texts[7])], "id int, t string").repartition(3)
    known = spark.createDataFrame([*((f"n{i}", n) for i, n in enumerate(needles)), ("null", None), ("empty", "")], "n string, s string")
    got = sorted(values(SUB.contained(docs, "id", "t", known, "n", "s"), "id", "needle"))
    assert got == sorted((i, f"n{k}") for i, t in [*enumerate(texts), (7, texts[7])] for k, n in enumerate(needles) if n in t)


def test_passages_in_documents_as_contains_has_them(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.lower("text").alias("t"))
    whole = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", F.lower("text").alias("p"))
    # whole passages, one word of each, and a piece that begins and ends inside words
    needles = whole.select(F.concat(F.lit("w"), "item_id").alias("n"), "p").unionByName(whole.select(F.concat(F.lit("o"), "item_id").alias("n"), F.get(F.split("p", " "), F.lit(3)).alias("p")))
    needles = needles.unionByName(whole.select(F.concat(F.lit("m"), "item_id").alias("n"), F.substring("p", 8, 30).alias("p")))
    got = sorted(values(SUB.contained(docs, "doc_id", "t", needles, "n", "p"), "id", "needle"))
    texts = values(docs, "doc_id", "t")
    assert got == sorted((i, n) for n, p in values(needles, "n", "p") if p for i, t in texts if p in t) and len({n[0] for _, n in got}) == 3


def places_of(text, patterns, whole=False):
    wordy = lambda c: c == "_" or c.isalnum()
    out = []
    for p in patterns:
        at = text.find(p)
        while at >= 0:
            z = at + len(p)
            if not whole or not ((at and wordy(text[at - 1]) and wordy(text[at])) or (z < len(text) and wordy(text[z]) and wordy(text[z - 1]))):
                out.append((at, z, p))
            at = text.find(p, at + 1)
    return out


@pytest.mark.parametrize("block", [8 << 20, 6])
def test_many_patterns(spark, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK", block)
    rnd = random.Random(3)
    patterns = ["a", "ab", "bab", "abab", "b b", "é", "bé", " a", "zz"]
    texts = ["".join(rnd.choice("abé _") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (100, None), (None, "ab")], "id int, t string").repartition(3)
    rules = spark.createDataFrame([*((p, i % 4) for i, p in enumerate(patterns)), ("", 0), (None, 1), ("ab", 9)], "p string, rank int")
    cases = [*enumerate(texts), (None, "ab")]
    for whole in (False, True):
        got = values(A.occurrences(docs, "id", "t", rules, "p", whole), "id", "start", "end", "pattern")
        assert sorted(got, key=repr) == sorted(((i, *x) for i, t in cases for x in places_of(t, patterns, whole)), key=repr)
    assert A.occurrences(docs, "id", "t", rules, "p", distinct=True).count() == sum(len({p for _, _, p in places_of(t, patterns)}) for _, t in cases)
    all_places = A.occurrences(docs, "id", "t", rules, "p")
    rank = {p: i % 4 for i, p in enumerate(patterns)}
    for got, order in ((A.leftmost_longest(all_places), lambda x: (x[0], -x[1])), (A.by_priority(all_places, rules, "p", "rank"), lambda x: (rank[x[2]], x[0], x[1]))):
        expected = []
        for i, t in cases:
            taken = []
            for a, z, p in sorted(places_of(t, patterns), key=order):
                if all(z <= x or a >= y for x, y, _ in taken):
                    taken.append((a, z, p))
            expected += [(i, *x) for x in taken]
        assert sorted(values(got, "id", "start", "end", "pattern"), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("block", [8 << 20, 6])
def test_spans_are_judged_where_the_text_is_read(spark, monkeypatch, block):
    """The same spans as of all places, without a shuffle or a stored table, also for several blocks of patterns."""
    monkeypatch.setattr(A, "BLOCK", block)
    rnd = random.Random(5)
    patterns = ["a", "ab", "bab", "abab", "b b", "é", "bé", " a", "zz", "😀", "a😀"]
    docs = spark.createDataFrame([*enumerate("".join(rnd.choice("abé _😀") for _ in range(rnd.randint(0, 60))) for _ in range(80)), (100, None), (None, "ab")], "id int, t string").repartition(3)
    rules = spark.createDataFrame([*((p, i % 4) for i, p in enumerate(patterns)), ("", 0), (None, 1), ("ab", 9)], "p string, rank int")
    places = A.occurrences(docs, "id", "t", rules, "p")
    wanted = sorted(values(A.leftmost_longest(places), "id", "start", "end", "pattern"), key=repr)
    got = A.longest_spans(docs.localCheckpoint(), "id", "t", rules, "p")
    assert sorted(values(got, "id", "start", "end", "pattern"), key=repr) == wanted
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert A.longest_spans(docs, "id", "t", rules.where("p = ''"), "p").count() == 0


@pytest.mark.parametrize("block", [8 << 20, 6])
def test_priorities_are_judged_where_the_text_is_read(spark, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK", block)
    rnd = random.Random(6)
    docs = spark.createDataFrame([*enumerate("".join(rnd.choice("abé _😀") for _ in range(rnd.randint(0, 60))) for _ in range(80)), (100, None), (None, "ab")], "id int, t string").repartition(3)
    patterns = ["a", "ab", "bab", "abab", "b b", "é", "bé", " a", "zz", "a😀"]
    rules = spark.createDataFrame([*((p, None if p == "bab" else i % 4) for i, p in enumerate(patterns)), ("", 0), (None, 1), ("ab", 9)], "p string, rank int")
    names = ("id", "start", "end", "pattern", "priority")
    wanted = values(A.by_priority(A.occurrences(docs, "id", "t", rules, "p"), rules, "p", "rank"), *names)
    got = A.priority_spans(docs, "id", "t", rules, "p", "rank")
    assert sorted(values(got, *names), key=repr) == sorted(wanted, key=repr)
    assert block == 6 or "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert A.priority_spans(docs, "id", "t", rules.where("p = ''"), "p", "rank").count() == 0


def test_ten_thousand_patterns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    texts = values(docs, "doc_id", "text")
    words = sorted({w for _, t in texts for w in t.split() if len(w) > 3})[:10_000]
    got = A.occurrences(docs, "doc_id", "text", spark.createDataFrame([(w,) for w in words], "p string"), "p", distinct=True)
    counted = dict(values(got.groupBy("pattern").count(), "pattern", "count"))
    rnd = random.Random(1)
    for w in rnd.sample(words, 300):
        assert counted[w] == sum(w in t for _, t in texts)


def test_spans_of_one_long_text(spark):
    """Components of one text are dealt to several tasks, and are what the loop over all spans takes."""
    rnd = random.Random(8)
    rows = [(1, rnd.randint(0, 3), a, a + rnd.randint(0, 40)) for a in (rnd.randrange(200_000) for _ in range(20_000))] + [(None, 0, 1, 3), (None, 1, 2, 4)]
    rows += rows[:500]
    df = spark.createDataFrame(rows, "doc int, rank int, a int, z int").repartition(5)
    got = sorted(values(W.free_spans(df, "doc", "rank", "a", "z"), "doc", "rank", "a", "z"), key=repr)
    expected = []
    for doc in (1, None):
        held = defaultdict(bool)
        for r in sorted(x for x in rows if x[0] == doc) if doc else sorted((x for x in rows if x[0] is None), key=lambda x: x[1:]):
            inside = range(r[2], r[3])
            # a place is a unit interval; an empty span only lies inside another
            free = not any(held[2 * i + 1] for i in inside) and not (not inside and held[2 * r[2]])
            if free and not any(held[2 * i] == "empty" for i in range(r[2] + 1, r[3])):
                for i in inside:
                    held[2 * i + 1] = True
                    if i > r[2]:
                        held[2 * i] = True
                if not inside:
                    held[2 * r[2]] = held[2 * r[2]] or "empty"
                expected.append(r)
    assert sorted(set(got), key=repr) == sorted(set(expected), key=repr)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = W.free_spans(df.where("doc = 1"), "doc", "rank", "a", "z").withColumn("p", F.spark_partition_id())
        assert parts.select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_balances_with_top_ups_equal_the_loop(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), i, rnd.choice([None, -30, -7, 4, 11, 25])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, cost long").repartition(6)
    got = {(k, i): b for k, i, b in values(S.clamped_balance(df, "k", [F.col("i")], F.col("cost"), F.lit(100).cast("long"), "balance"), "k", "i", "balance")}
    held = defaultdict(lambda: 100)
    for k, i, cost in rows:
        held[k] = max(0, held[k] - (cost or 0))
        assert got[k, i] == held[k]
    sums, before = defaultdict(int), {}
    total = {(k, i): n for k, i, n in values(S.running_sum(df, "k", [F.col("i")], F.col("cost"), "n"), "k", "i", "n")}
    top = {(k, i): n for k, i, n in values(S.running_max_before(df, "k", [F.col("i")], F.col("cost"), "n"), "k", "i", "n")}
    for k, i, cost in rows:
        sums[k] += cost or 0
        assert total[k, i] == sums[k] and top[k, i] == before.get(k)
        if cost is not None:
            before[k] = max(cost, before.get(k, cost))


def test_citations_of_long_and_short_lists_agree(spark, monkeypatch):
    rnd = random.Random(2)
    words = ["policy", "Annex", "2024", "audit", ".pdf", " ", "é"]
    make = lambda n: "".join(rnd.choice(words) for _ in range(n))
    cited = spark.createDataFrame([(make(rnd.randint(1, 4)),) for _ in range(60)] + [(None,), ("",), ("Policy",)], "c string")
    names = spark.createDataFrame([(make(rnd.randint(1, 6)),) for _ in range(60)] + [(None,), ("",)], "n string")
    short = sorted(values(M.containment(cited, "c", names, "n"), "cited", "name"))
    monkeypatch.setattr(M, "UPLOADS", 3)
    assert sorted(values(M.containment(cited, "c", names, "n"), "cited", "name")) == short and len(short) > 30


def test_replicas_take_only_ranges_that_differ(spark, tmp_path):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    n = orders.count()
    everything = lambda df: sorted(map(tuple, df.collect()), key=repr)
    copies = [R.Replica(spark, f"{tmp_path}/{i}") for i in range(2)]
    for copy in copies:
        first = copy.sync(orders, "o_orderkey")
        assert first["changed"] == first["ranges"] and first["rows"] == n and everything(copy.read()) == everything(orders)
        assert copy.sync(orders.orderBy(F.rand()), "o_orderkey") == {"ranges": first["ranges"], "changed": 0, "rows": 0}
    # a hundred rows that lie together, one more, one gone from a range, and a repeated one
    changed = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey").between(200, 299), 0.0).otherwise(F.col("o_totalprice"))).where("o_orderkey <> 1000")
    changed = changed.unionByName(orders.where("o_orderkey = 600")).unionByName(spark.createDataFrame([(None, 1, 2.0), (-70_000, None, None)], orders.schema))
    for copy in copies:
        done = copy.sync(changed, "o_orderkey")
        assert everything(copy.read()) == everything(changed) and 0 < done["rows"] < 110 and done["changed"] < 110
    # whole ranges that go
    some = changed.where("o_orderkey < 1000")
    copies[0].sync(some, "o_orderkey")
    assert everything(copies[0].read()) == everything(some)


def test_quotes_with_typing_errors_against_every_window(spark):
    rnd = random.Random(12)
    words = "access review monthly board policy é record backup server owner approves daily weekly of the and 日本".split()
    make = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", "s", "ed"]) for _ in range(n))
    texts = [make(rnd.randint(0, 120)) for _ in range(40)] + ["", None]
    quotes = []
    for i in range(40):
        own = (texts[i] or "").split()
        n = rnd.choice([1, 2, 5, 12, 25])
        at = rnd.randrange(max(1, len(own) - n))
        letters = list(" ".join(own[at : at + n]))
        for _ in range(len(letters) // rnd.choice([8, 12, 20])):
            k = rnd.randrange(len(letters))
            letters[k] = rnd.choice(["x", "", letters[k] * 2, letters[k].upper()])
        quotes.append((i, "".join(letters)))
    quotes += [(100, None), (101, "  "), (102, make(10))]
    got = {(i, q): r for i, q, r in values(Z.grounded_quotes(spark.createDataFrame([*enumerate(texts)], "id int, t string").repartition(3), "id", "t", spark.createDataFrame(quotes, "q int, s string"), "q", "s"), "id", "quote", "ratio")}
    expected = {}
    for q, quote in quotes:
        quote = Z.bare(quote)
        n = len(quote.split())
        for i, text in enumerate(texts):
            held = Z.bare(text).split()
            for k in range(len(held) - n + 1 if n else 0):
                match = difflib.SequenceMatcher(None, " ".join(held[k : k + n]), quote)
                if match.real_quick_ratio() >= 0.85 and match.quick_ratio() >= 0.85 and match.ratio() >= 0.85:
                    expected[i, q] = max(expected.get((i, q), 0), match.ratio())
    assert set(got) <= set(expected) and all(r <= expected[k] for k, r in got.items())
    right = sum(got.get(k) == r for k, r in expected.items())
    long = [k for k in expected if len(dict(quotes)[k[1]]) >= 32]
    print(f"windows found: {right} of {len(expected)}; of quotes of 32 characters or more {sum(k in got for k in long)} of {len(long)}")
    assert right >= 0.9 * len(expected) and len(long) > 15


def test_common_subsequences():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 70))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            above = row[:]
            for j, d in enumerate(b, 1):
                row[j] = above[j - 1] + 1 if c == d else max(above[j], row[j - 1])
        assert Z.common_subsequence(a, b) == row[-1]
        assert sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) <= row[-1]


def test_files_of_every_kind_by_their_content(spark, tmp_path):
    from lodestone.sources import readers as D

    files = {
        "a.bin": b"plain text of a file,\nwith a second line\n\n", "b.txt": b"id,name\n1,first\n2,\"a, b\"\n", "c.dat": b'{"a": {"b": [1, null, "x"]}}\n{"a": 2}', "d": b'[{"k": 1}, {"k": 2}]',
        "e.txt": b'<?xml version="1.0"?><list xmlns="urn:x"><item id="7"><name> n </name></item><item>t</item></list>', "f": b"<html><head><title>x</title></head><h1>Top</h1><p>one two three</p><p>no</p></html>",
        "g.pdf": b"%PDF-1.7 x", "h": b"", "i.xml": b"<a><b></a>", "j.json": b'{"a": 1', "k": b"\x00\x01",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = defaultdict(list)
    for r in D.read_any(spark, str(tmp_path)).orderBy("path", "place").collect():
        got[r["path"].rsplit("/", 1)[1]].append((r["kind"], r["error"], r["section"], r["text"], r["fields"]))
    assert got == {
        "a.bin": [("text", None, "", "plain text of a file,", {}), ("text", None, "", "with a second line", {})],
        "b.txt": [("csv", None, "", "id=1 | name=first", {"id": "1", "name": "first"}), ("csv", None, "", "id=2 | name=a, b", {"id": "2", "name": "a, b"})],
        "c.dat": [("json", None, "", "a.b[0]=1 | a.b[2]=x", {"a.b[0]": "1", "a.b[2]": "x"}), ("json", None, "", "a=2", {"a": "2"})],
        "d": [("json", None, "", "k=1", {"k": "1"}), ("json", None, "", "k=2", {"k": "2"})],
        "e.txt": [("xml", None, "list", "@id=7 | name=n", {"@id": "7", "name": "n"}), ("xml", None, "list", "t", {})],
        "f": [("html", None, "Top", "Top", {}), ("html", None, "Top", "one two three", {})],
        "g.pdf": [("pdf", "NO_PARSER", None, None, None)],
        "i.xml": [("xml", "BROKEN: ParseError", None, None, None)], "j.json": [("json", "BROKEN: JSONDecodeError", None, None, None)], "k": [("unknown", "NO_PARSER", None, None, None)],
    }
    D.register(spark)
    spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(files.values())], "id int, content binary").createOrReplaceTempView("some_files")
    assert spark.sql("SELECT * FROM some_files, LATERAL file_records(content)").count() == sum(map(len, got.values())) + 1
    assert spark.sql("SELECT kind, error FROM some_files, LATERAL file_records(content) WHERE octet_length(content) = 0").collect() == [("empty", "EMPTY")]
