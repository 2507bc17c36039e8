"""Operators against plain Python, and their edge cases."""

import difflib
import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import leaks as L
from lodestone.operators import matching as M
from lodestone.operators import retrieval as RT
from lodestone.operators import windows as W
from lodestone.sources import files as S
from lodestone.sources import scanners as X
from lodestone.plans import registry
from lodestone.streaming import counters as C

from .compare import DATA


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_empty_allow_list_allows_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, file string")
    assert df.where(P.allowed("file", [])).count() == 0
    assert df.where(P.allowed("file", ["a"])).count() == 1


def test_optional_filters_add_nothing_for_all(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, kind string")
    assert P.optional_filters(df, kind="All", id=None).count() == 2
    assert values(P.optional_filters(df, kind="b"), "id") == [(2,)]


@pytest.mark.parametrize("hard,target", [(10, 7), (50, 20), (3, 3), (1000, 0), (0, 5)])
def test_budget_equals_the_loop(spark, hard, target):
    rnd = random.Random(hard)
    rows = [(k, i, rnd.randint(1, 9)) for k in range(3) for i in range(20)]
    expected = []
    for k in range(3):
        total = 0
        for _, i, t in sorted(r for r in rows if r[0] == k):
            if total >= target or total + t > hard:
                break
            total += t
            expected.append((k, i))
    df = spark.createDataFrame(rows, "k int, i int, t int")
    got = values(W.budget(df, "k", [F.col("i")], "t", F.lit(hard), F.lit(target)), "k", "i")
    assert sorted(got) == expected


def test_free_spans_equal_the_loop(spark):
    rnd = random.Random(5)
    rows = [(d, rnd.randint(0, 4), a, a + rnd.randint(1, 9)) for d in range(4) for a in (rnd.randint(0, 60) for _ in range(25))]
    expected = []
    for d in range(4):
        taken = []
        for _, p, a, z in sorted(r for r in rows if r[0] == d):
            if all(a >= e or z <= s for s, e in taken):
                taken.append((a, z))
                expected.append((d, a, z))
    got = values(W.free_spans(spark.createDataFrame(rows, "doc int, p int, a int, z int"), "doc", "p", "a", "z"), "doc", "a", "z")
    assert sorted(got) == sorted(expected)


def test_char_chunks_cover_the_text():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abc de\n.") for _ in range(5000)).strip()
    pieces = list(W.char_chunks(text, 300, 50))
    assert all(len(p) <= 301 for p in pieces)
    at = 0
    for p in pieces:
        here = text.find(p, max(0, at - 60))
        assert here != -1 and here <= at + 3
        at = here + len(p)
    assert at == len(text)
    assert list(W.char_chunks("", 10, 2)) == [] and list(W.char_chunks(" ab ", 10, 2)) == ["ab"]


def test_pack_paragraphs_advances_and_ends():
    assert list(W.pack_paragraphs([])) == []
    assert list(W.pack_paragraphs(["x" * 3000, "y", "z" * 50], 1000, 200)) == [(0, 0), (1, 2)]
    spans = list(W.pack_paragraphs(["a" * 90] * 30, 500, 200))
    assert spans[0][0] == 0 and spans[-1][1] == 29
    assert all(b[0] <= a[1] + 1 and b[1] > a[1] for a, b in zip(spans, spans[1:]))


def test_rate_limit_counts_accepted_only(spark):
    rows = [(1, i, s) for i, s in enumerate([0, 1, 2, 3, 59, 60, 61, 62])]
    got = dict(values(W.rate_limited(spark.createDataFrame(rows, "k int, i int, s int"), "k", "i", "s", 3, 60), "i", "accepted"))
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True}


def test_absent_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id int, k string")
    b = spark.createDataFrame([(1, None), (2, "y")], "id int, k string")
    assert sorted(values(M.absent(a, b, ["id", "k"]), "id")) == [(2,), (3,)]


def test_cosine_of_nulls_and_zeros(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0, 2.0], [2.0, 4.0]), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert [round(x, 6) for (x,) in values(df.select(V.cosine(F.col("a"), F.col("b")).alias("c")), "c")] == [0.0, 0.0, 0.0, 1.0, 0.0]


def test_bm25_by_hand(spark):
    docs = [(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry cherry dates")]
    got = dict((c, round(s, 6)) for c, s in values(RT.bm25(spark.createDataFrame(docs, "chunk_id int, text string"), spark.createDataFrame([("q", "apple", 1.0)], "query string, term string, weight double")), "chunk", "bm25"))
    import math

    idf = math.log((3 - 1 + 0.5) / 1.5)
    mean = 8 / 3
    assert got == {1: round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / mean)), 6)}


def test_greedy_jaccard_keeps_by_rank(spark):
    rows = [("q", 1, "a b c"), ("q", 2, "c b a"), ("q", 3, "a b d"), ("q", 4, ""), ("q", 5, "!"), ("p", 1, "c b a")]
    got = values(RT.greedy_jaccard(spark.createDataFrame(rows, "query string, rank int, text string"), "query", "rank", "text"), "query", "rank")
    assert sorted(got) == [("p", 1), ("q", 1), ("q", 3), ("q", 4)]


def test_phone_and_mail_redaction(spark):
    rows = [("call +91-9876543210 or a.b@corp.com at 10.1.2.3",), ("id 1234567890123",), (None,)]
    got = values(spark.createDataFrame(rows, "t string").select(T.redact(F.col("t")).alias("r"), T.redact(F.col("t"), False).alias("k")), "r", "k")
    assert got[0][0] == "call [PHONE REDACTED] or [EMAIL REDACTED] at [IP REDACTED]" and "10.1.2.3" in got[0][1]
    assert got[1][0] == "id 1234567890123" and got[2] == (None, None)


def test_exchange_names_are_not_addresses(spark):
    rows = [("kex mlkem768x25519@openssh.com",), ("mail bob.smith@corp.com",), ("password: hunter2",)]
    assert values(spark.createDataFrame(rows, "t string").select(T.has_personal_data(F.col("t")).alias("p")), "p") == [(False,), (True,), (True,)]


def test_tokens_are_those_of_python(spark):
    rows = [("Été naïve the well-known a_b x1 ab",), ("",)]
    got = values(spark.createDataFrame(rows, "t string").select(T.ranking_tokens(F.col("t")).alias("w")), "w")
    assert got == [([w for w in re.findall(r"\b[a-zA-Z0-9_\-]{3,}\b", t[0].lower())],) for t in rows]


def test_risk_matrix_has_all_cells(spark):
    rows = [(a, b) for a in R.LEVELS for b in R.LEVELS]
    df = spark.createDataFrame(rows, "l string, i string")
    n = F.lit("")
    got = values(df.select("l", "i", *[v.alias(k) for k, v in R.risk_levels(F.lit("NON_COMPLIANT"), F.col("l"), F.col("i"), n, n, n).items() if k == "risk_level"]), "l", "i", "risk_level")
    assert {(a, b): c for a, b, c in got} == R.RISK_MATRIX


def test_crypto_scan_of_whole_words(spark):
    df = spark.createDataFrame([("a", "TLS_AES_256_GCM_SHA384 and describes MD55"), ("b", None)], "file string, content string")
    assert values(X.crypto_findings(df), "rule") == [("aes256-gcm",)]


def test_archives_flatten_and_guard(spark):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.csv", "a,b")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.txt", "hello")
        z.writestr("skip.bin", b"\0")
        z.writestr("in.zip", inner.getvalue())
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.txt", "0" * 5_000_000)
    rows = [("p/a.zip", outer.getvalue()), ("p/bad.zip", b"PK\x03\x04junk"), ("p/b.zip", bomb.getvalue()), ("p/c.pdf", b"%PDF-1.4"), ("p/d.pdf", b"nope"), ("p/e.txt", b""), ("p/f.docx", b"PK\x03\x04..vbaProject.bin")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = values(S.expand_archives(df.where("path LIKE '%a.zip' OR path LIKE '%bad.zip'")), "member", "content", "reason")
    assert sorted((m, c and bytes(c), why) for m, c, why in got) == [("", None, "BAD_ARCHIVE"), ("in.zip/deep.csv", b"a,b", None), ("x.txt", b"hello", None)]
    shallow = values(S.expand_archives(df.where("path LIKE '%a.zip'"), deepest=0), "member", "reason")
    assert sorted(shallow) == [("in.zip", "TOO_DEEP"), ("x.txt", None)]
    assert dict(values(S.guard_uploads(df), "path", "verdict")) == {"p/a.zip": "OK", "p/bad.zip": "ZIP_BOMB", "p/b.zip": "ZIP_BOMB", "p/c.pdf": "OK", "p/d.pdf": "KIND_MISMATCH", "p/e.txt": "EMPTY", "p/f.docx": "MACRO"}


def test_flatten_json_paths(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}, " x "]}}'), (2, "no json"), (3, None)], "id int, t string")
    assert values(S.flatten_json(df, "id", "t"), "id", "key", "value") == [(1, "a.b[0]", "1"), (1, "a.b[2]", "x")]


def test_text_files_and_replicas(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    (tmp_path / "in" / "b.csv").write_text('id,note\n1,"x\ny"\n')
    assert values(S.read_texts(spark, str(tmp_path / "in")), "file", "content") == [("a.txt", "one\ntwo")]
    assert values(S.read_rows(spark, str(tmp_path / "in" / "b.csv")), "id", "note") == [("1", "x\ny")]
    done = S.replicate({"t": spark.range(3).toDF("x"), "u": spark.range(1).toDF("x")}, {"t"}, [str(tmp_path / "r1"), str(tmp_path / "r2")])
    assert len(done) == 2 and spark.read.parquet(done[1]).count() == 3


def test_stream_sink_restarts_without_repeats(spark, tmp_path):
    from .compare import DATA

    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    for _ in range(2):
        C.sink_batches(C.event_stream(spark, DATA), out, at).awaitTermination()
    assert spark.read.parquet(out).count() == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_prompt_leaks_against_the_rules_one_by_one(spark):
    rnd = random.Random(6)
    words = "access review monthly board policy record backup server owner approves daily weekly".split()
    hints = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14)))) for i in range(25)]
    hints += [(90, None), (91, ""), (92, '"Access Review Monthly Board"'), (93, "internationalization"), (94, "nternal audit policy")]
    rows = [(1, None), (2, ""), (3, "see Law 7 of it"), (4, "law 11 does not count"), (5, "The Decision Tree says so"), (6, "“access review monthly board”"), (7, "we copied internationalization here"), (8, "xx internal audit policyx"), (9, "we copied internationalization here")]
    for i, h in hints[:25]:
        changed = h.split()
        changed[rnd.randrange(len(changed))] = "other"
        rows += [(100 + i, h.upper()), (200 + i, f"before {h} after"), (300 + i, " ".join(changed)), (400 + i, " ".join(rnd.choice(words) for _ in range(9)))]
    clean = lambda x: re.sub(r"\s*[\"'“”]*\s*$", "", re.sub(r"^\s*[\"'“”]*\s*", "", x)).lower()
    expected, near = [], set()
    for i, e in rows:
        e = clean(e or "")
        if not e:
            continue
        if any(p in e for p in L.PHRASES) or re.search(L.LAW, e):
            expected.append((i, "PHRASE", None))
        for n, h in hints:
            h = clean(h or "")
            if len(h) >= 15 and h in e:
                expected.append((i, "CONTAINED", n))
            elif len(h) >= 15 and difflib.SequenceMatcher(None, h, e).ratio() >= 0.75:
                near.add((i, "NEAR", n))
    got = values(L.prompt_leaks(spark.createDataFrame(rows, "id int, quote string"), spark.createDataFrame(hints, "item int, text string"), ["id"], "quote", "item", "text"), "id", "rule", "hint")
    assert sorted(map(repr, (x for x in got if x[1] != "NEAR"))) == sorted(map(repr, expected))
    assert {r for _, r, _ in expected} == {"PHRASE", "CONTAINED"}
    # near repeats have the plain rule's ratio; most of those there are by the plain rule are found
    found = {x for x in got if x[1] == "NEAR"}
    print(f"near repeats found: {len(found)} of {len(near)}")
    assert found <= near and len(found) >= 0.9 * len(near)


def test_short_and_long_keyword_lists_agree(spark, monkeypatch):
    rnd = random.Random(4)
    words = "red green blue dark light sky sea".split()
    texts = spark.createDataFrame([(i, ", ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for i in range(80)] + [(99, None)], "id int, text string")
    known = spark.createDataFrame([("A", "Red"), ("B", "dark green"), ("C", "light-blue sky"), ("D", "sea"), ("E", "dark Green"), ("F", " ")], "value string, keyword string")
    inside = sorted(values(M.longest_keyword(texts, "id", "text", known), "id", "value", "keyword"))
    monkeypatch.setattr(M, "INLINE", 2)
    assert sorted(values(M.longest_keyword(texts, "id", "text", known), "id", "value", "keyword")) == inside
    assert len(inside) > 40 and {v for _, v, _ in inside} >= {"A", "B", "D"}


def test_absent_files_join_short_lists_only(spark):
    cols = "q int, file string, content string, score double"
    scored = spark.createDataFrame([(1, "a", "x", 0.9), (1, "b", "y", 0.8), (1, "c", "z", 0.5), (1, "c", "zz", 0.6), (1, "d", "w", 0.1), (1, "e", " x ", 0.7), (2, "a", "x", 0.9), (2, "f", "v", 0.9)], cols)
    kept = scored.where("q = 1 AND file IN ('a', 'b')")
    order = [F.desc("score"), F.col("content")]
    got = lambda k: sorted((r["q"], r["rank"], r["file"], r["content"]) for r in RT.diversify(kept, scored, "q", "file", "content", "score", k, order).collect())
    # d scores too little, e repeats a content, query 2 has no rows of its own
    assert got(4) == [(1, 1, "a", "x"), (1, 2, "b", "y"), (1, 3, "c", "zz")]
    assert got(2) == [(1, 1, "a", "x"), (1, 2, "b", "y")]


def test_keywords_over_all_languages_by_brute_force(spark):
    from lodestone.plans.relational import KEYWORDS

    docs = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    hit = lambda k, t: bool(re.search(rf"\b{k}\b", t.lower())) if len(k) <= 4 else k in t.lower()
    expected = {c: n for c, k in KEYWORDS if (n := sum(hit(k, t) for t in docs))}
    assert dict(values(registry.queries()["f9_short_or_substring"](spark, DATA), "control", "n_docs")) == expected


def test_streams_read_files_and_folders_of_parts(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    totals = lambda d: sorted(values(C.drain(C.session_counters(C.event_stream(spark, d))), "user_id", "n"))
    assert totals(str(tmp_path)) == totals(DATA) and sum(n for _, n in totals(DATA)) == events.count()
    # part files in any order: no row is late in a replay
    seen = C.drain(C.first_seen(C.event_stream(spark, str(tmp_path)), "1 minute"), "append")
    assert seen.count() == events.select("event_id").distinct().count()


def test_state_lives_from_its_last_update(spark, tmp_path):
    """Gaps of 23 hours go on, gaps of 25 hours close a session, also across restarts; batches in between."""
    from lodestone.streaming import sessions as L

    hours = [0, 10, 33, 56, 81, 82, 107, 400]
    rows = [(1, h, float(h)) for h in hours] + [(2, 1, None), (2, 24, 1.0), (2, 60, 2.0), (None, 5, 1.0)]
    frame = lambda part: spark.createDataFrame(part, "user_id long, h long, value double").select("user_id", F.timestamp_seconds((F.col("h") + 1000) * 3600).alias("ts"), "value")
    for lo, hi in ((0, 20), (20, 40), (40, 100), (100, 1000)):
        frame([r for r in rows if lo <= r[1] < hi]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
        L.replay(spark, f"{tmp_path}/in", f"{tmp_path}/home")
    got = L.sessions_of(spark, f"{tmp_path}/home").select("user_id", (F.unix_seconds("first") / 3600 - 1000).alias("a"), (F.unix_seconds("last") / 3600 - 1000).alias("z"), "n", "total")
    assert sorted(map(repr, values(got, "user_id", "a", "z", "n", "total"))) == sorted(map(repr, [(1, 0.0, 56.0, 4, 99.0), (1, 81.0, 82.0, 2, 163.0), (1, 107.0, 107.0, 1, 107.0), (2, 1.0, 24.0, 2, 1.0), (2, 60.0, 60.0, 1, 2.0), (None, 5.0, 5.0, 1, 1.0)]))


def test_published_base_scores(spark):
    from lodestone.functions import cvss

    rows = [
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.0/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1),
        ("AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:H", 7.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N", 1.6),
        ("CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:N/I:N/A:H/E:P", 5.9), ("AV:N/AC:L/Au:N/C:P/I:P/A:P", 7.5), ("(AV:N/AC:L/Au:N/C:C/I:C/A:C)", 10.0), ("AV:N/AC:M/Au:N/C:N/I:P/A:N", 4.3), ("AV:L/AC:H/Au:M/C:N/I:N/A:N", 0.0),
        ("AV:N/AC:L", 6.5), ("CVSS:3.1/AV:N/AC:X/PR:N/UI:N/S:U/C:H/I:H/A:H", None), ("nothing", None), (None, None),
    ]
    df = spark.createDataFrame(rows, "vector string, score double")
    assert [r for r in df.withColumn("got", cvss.vector_score(F.col("vector"))).collect() if r["got"] != r["score"]] == []
