"""Context, scope, header and sink operators as queries."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import context as K
from lodestone.operators import matching as M
from lodestone.operators import retrieval as R
from lodestone.operators import set_join as J
from lodestone.operators import windows as W
from lodestone.plans.fixtures import Rows
from lodestone.plans.registry import query, table
from lodestone.sources import files as S
from lodestone.streaming import counters as C


@query("j2_vectors_with_chunks", "SELECT vec_id, lang, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 5) AS similarity FROM embeddings JOIN documents ON vec_id = doc_id WHERE source IN ('src1', 'src2') ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) DESC, vec_id LIMIT 40")
def j2(spark, d):
    e = table(spark, d, "embeddings")
    chunks = table(spark, d, "documents").where(F.col("source").isin("src1", "src2")).select(F.col("doc_id").alias("vec_id"), "lang")
    probe = e.where("vec_id = 1").select(F.lit(0).alias("query"), F.col("embedding").alias("vector"))
    return R.nearest(e.join(chunks, "vec_id"), probe, 40).select(F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity")).join(chunks, "vec_id")


@query("j12_theta_scope", "SELECT k.control, count(*) AS n FROM documents JOIN (VALUES ('A', 'mit license'), ('B', 'apache'), ('C', 'token =')) AS k(control, keyword) ON contains(lower(text), keyword) GROUP BY 1")
def j12(spark, d):
    k = spark.createDataFrame([("A", "mit license"), ("B", "apache"), ("C", "token =")], "control string, keyword string")
    docs = table(spark, d, "documents").select(F.lower("text").alias("t"))
    # three literal rows
    return docs.join(F.broadcast(k), F.contains("t", F.col("keyword"))).groupBy("control").agg(F.count("*").alias("n"))


#: Classes of equal word sets in a language, and pairs of classes that are similar.
SIMILAR_SQL = """
w AS (SELECT doc_id, lang, list_sort(list_distinct(string_split(text, ' '))) AS w FROM documents),
c AS (SELECT min(doc_id) AS id, lang, w FROM w GROUP BY lang, w),
p AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id < b.id AND a.lang = b.lang AND len(a.w) >= {0} * len(b.w) AND len(b.w) >= {0} * len(a.w)
      WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= {0})
"""


def _similar(spark, d, least):
    return J.similar_sets(table(spark, d, "documents"), "doc_id", "lang", F.split("text", " "), least)


@query("j16_similar_pairs", "WITH " + SIMILAR_SQL.format(0.97) + "SELECT 'similar' AS kind, a, b FROM p UNION ALL SELECT 'member', c.id, w.doc_id FROM w JOIN c ON w.lang IS NOT DISTINCT FROM c.lang AND w.w IS NOT DISTINCT FROM c.w WHERE w.doc_id <> c.id")
def j16(spark, d):
    """Pairs of representatives that are similar, and of a representative and each other document with its set of words."""
    classes, pairs = _similar(spark, d, 0.97)
    members = classes.where("id <> class").select(F.lit("member").alias("kind"), F.col("class").alias("a"), F.col("id").alias("b"))
    return pairs.select(F.lit("similar").alias("kind"), "a", "b").unionByName(members)


@query("j16_similar_classes", "WITH " + SIMILAR_SQL.format(0.8) + ", n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id) SELECT w.doc_id AS id, c.id AS class, coalesce(n, 0) AS n_links FROM w JOIN c ON w.lang = c.lang AND w.w = c.w LEFT JOIN n ON n.id = c.id")
def j16b(spark, d):
    """Every document's class, and how many other classes have a similarity of 0.8 or more."""
    return J.class_links(*_similar(spark, d, 0.8))


@query("j18_category_similarity", "SELECT vec_id, label AS category FROM embeddings e WHERE list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) >= 0.1")
def j18(spark, d):
    e = table(spark, d, "embeddings")
    probe = e.where("vec_id = 0").select(F.col("embedding").alias("p"))
    return e.join(F.broadcast(probe), V.cosine(F.col("embedding"), F.col("p")) >= 0.1).select("vec_id", F.col("label").alias("category"))


@query("r4_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 5) AS cosine FROM embeddings")
def r4(spark, d):
    e = table(spark, d, "embeddings")
    probe = e.where("vec_id = 3").select(F.col("embedding").alias("p"))
    return e.join(F.broadcast(probe), F.lit(True)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("p")), 5).alias("cosine"))


@query("r10_top_k_by_type", "WITH m AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 1) SELECT doc_id FROM documents WHERE lang = (SELECT lang FROM m) ORDER BY length(text) DESC, doc_id LIMIT 30")
def r10(spark, d):
    """Top k of the dominant type; k comes from a table of limits by type (30 here)."""
    x = table(spark, d, "documents")
    top = x.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(1).select("lang")
    return x.join(F.broadcast(top), "lang", "left_semi").orderBy(F.desc(F.char_length("text")), "doc_id").limit(30).select("doc_id")


@query("r11_parent_context", "WITH p AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS part, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY lang, trim(regexp_replace(lower(part), '\\s+', ' ', 'g')) ORDER BY doc_id, n) AS k FROM (SELECT doc_id, lang, trim(part, ' ') AS part, n FROM p) WHERE part <> '') SELECT lang, doc_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY n)) AS passage_md5 FROM f WHERE k = 1 GROUP BY 1, 2")
def r11(spark, d):
    x = table(spark, d, "documents").select("lang", "doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("context"))
    return K.expand_context(x, "lang", "doc_id", "context").select("lang", "doc_id", F.md5("passage").alias("passage_md5"))


#: The ranked list of an event type: its best event of each of the first six users by value; files are users, scores are values in hundredths.
W9_SQL = """
WITH scored AS (SELECT event_type, user_id AS file, event_id, event_type || ' ' || CAST(event_id AS VARCHAR) AS content, value / 100 AS score FROM events),
best AS (SELECT *, row_number() OVER (PARTITION BY event_type, file ORDER BY score DESC, event_id) AS own FROM scored),
kept AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, event_id) AS place FROM best WHERE own = 1 QUALIFY place <= 6),
absent AS (SELECT event_type, file, event_id, row_number() OVER (PARTITION BY event_type ORDER BY file) AS nth FROM best b
           WHERE score > 0.15 AND own = 1 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.event_type = b.event_type AND k.file = b.file))
SELECT event_type, file, event_id, CAST(place AS INT) AS rank FROM kept
UNION ALL SELECT event_type, file, event_id, CAST(6 + nth AS INT) FROM absent WHERE nth <= 4
"""


@query("w9_file_diversity", W9_SQL)
def w9(spark, d):
    content = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    scored = table(spark, d, "events").select("event_type", F.col("user_id").alias("file"), "event_id", content.alias("content"), (F.col("value") / 100).alias("score"))
    order = [F.desc("score"), F.col("event_id")]
    kept = W.first_per(W.first_per(scored, ["event_type", "file"], order), ["event_type"], order, 6)
    return R.diversify(kept, scored, "event_type", "file", "content", "score", 10, order).select("event_type", "file", "event_id", "rank")


DATES = Rows("t", "id int, claimed string, document string", [(1, "2024-03-05", "signed on 5 March 2024, page 05"), (2, "2023-01-01", "signed in 2024 on day 01"), (3, "12 May", "12 of May"), (4, None, "2024"), (5, "undated", "2024"), (6, "2024", "")])


@query("t18_date_grounding", "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, false), (6, false)) AS t(id, grounded)")
def t18(spark, d):
    return DATES.df(spark).select("id", T.date_grounded(F.col("claimed"), F.col("document")).alias("grounded"))


SPANS = Rows("t", "id int, content string, start int", [(1, "Certificate : RSA2048", 14), (2, "Key Exchange: then Protocol TLS using RSA2048", 37), (3, "plain RSA2048", 6), (4, "Certificate of the Public Key RSA2048", 30)])


@query("v16_crypto_layer", "SELECT * FROM (VALUES (1, 'CA'), (2, 'PROTOCOL'), (3, ''), (4, 'KEY')) AS t(id, layer)")
def v16(spark, d):
    return SPANS.df(spark).select("id", K.layer(F.col("content"), F.col("start")).alias("layer"))


AROUND = Rows("t", "id int, content string, a int, z int", [(1, "internet facing host port: 8443 RSA2048 production", 33, 40), (2, "internal LAN RSA2048 on gw:22 staging", 13, 20), (3, "public and internal RSA2048 product", 20, 27)])


@query("v14_context_signals", "SELECT * FROM (VALUES (1, 'EXTERNAL', '8443', 'PROD'), (2, 'INTERNAL', '22', 'NON_PROD'), (3, '', '', '')) AS t(id, exposure, port, environment)")
def v14(spark, d):
    x = AROUND.df(spark).withColumn("w", T.window_around(F.col("content"), F.col("a"), F.col("z"), 300, 300))
    w = F.col("w")
    return x.select("id", K.one_of_two(w, K.EXTERNAL, K.INTERNAL, "EXTERNAL", "INTERNAL").alias("exposure"), K.port_near(w).alias("port"), K.one_of_two(w, K.PROD, K.NON_PROD, "PROD", "NON_PROD").alias("environment"))


@query("v11_vendor_match", "SELECT * FROM (VALUES (1, 'Palo Alto PAN-OS'), (2, 'Cisco')) AS t(id, value)")
def v11(spark, d):
    x = Rows("x", "id int, content string", [(1, "Firewall: Palo Alto PAN-OS 11 by palo alto"), (2, "a cisco router"), (3, "franciscos")])
    vendors = spark.createDataFrame([("palo alto", "Palo Alto"), ("palo alto pan-os", "Palo Alto PAN-OS"), ("cisco", "Cisco")], "keyword string, value string")
    return M.longest_keyword(x.df(spark), "id", "content", vendors).select("id", "value")


@query("v18_line_of_match", "SELECT doc_id, regexp_extract(text, '[^\\n]*License[^\\n]*') AS line FROM documents WHERE contains(text, 'License')")
def v18(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("License"))).select("doc_id", F.regexp_extract("text", r"[^\n]*License[^\n]*", 0).alias("line"))


OCR = Rows("t", "id int, quote string, content string", [(1, "multi factor authentication is enabled", "report: mu1ti factor authentlcation is enabled for all"), (2, "backups are tested monthly", "nothing of the kind is written here at all"), (3, "", "x"), (4, "long quote with many words", "short")])


@query("t24_fuzzy_grounding", "SELECT * FROM (VALUES (1, 'GROUNDED_WITH_OCR_WARNING'), (2, 'NOT_GROUNDED'), (3, 'NOT_GROUNDED'), (4, 'NOT_GROUNDED')) AS t(id, grounding)")
def t24(spark, d):
    return OCR.df(spark).select("id", K.fuzzy_grounding(F.col("quote"), F.col("content")).alias("grounding"))


SENTENCES = Rows("t", "id int, prefix string, document string", [(1, "Access is reviewed", "Intro. Access is reviewed each month by the board. Then more."), (2, "not there", "some text"), (3, "last part", "the last part has no end")])


@query("t26_whole_sentence", "SELECT * FROM (VALUES (1, 'Access is reviewed each month by the board.'), (2, 'not there'), (3, 'last part has no end')) AS t(id, quote)")
def t26(spark, d):
    return SENTENCES.df(spark).select("id", T.whole_sentence(F.col("prefix"), F.col("document")).alias("quote"))


@query("t9_personal_data", r"SELECT doc_id, regexp_matches(text, '(?i)(?:password|passwd|pwd|secret|api[_\-]?key|token|credential|private[_\-]?key)\s*[:=]\s*\S+') AS credential, regexp_matches(text, '(?i)(?:ssn|social\s+security|credit\s+card|card\s+number|pan\s+number|aadhaar)') AS identifier FROM documents")
def t9(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(T.CREDENTIAL).alias("credential"), F.col("text").rlike(T.IDENTIFIER).alias("identifier"))


NEEDS = Rows("t", "id int, requirement string, name string, control string", [(1, "A policy shall be approved", None, "8.1"), (2, "Teams shall implement filters", "", "5.1"), (3, "Nothing special", "x", "5.15"), (4, "Nothing special", "x", "8.2"), (5, None, None, None)])


@query("c15_policy_required", "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, false)) AS t(id, required)")
def c15(spark, d):
    return NEEDS.df(spark).select("id", K.policy_required(F.col("requirement"), F.col("name"), F.col("control")).alias("required"))


LOCKED = Rows("t", "id int, quote string, context string, source_file string", [(1, "n/a", "Short. This sentence is long enough to count. More.", "other.pdf"), (2, "a real quote of the file", "unused context sentence here.", "a.pdf"), (3, None, None, None)])


@query("c24_locked_files", "SELECT * FROM (VALUES (1, 'This sentence is long enough to count.', 'a.pdf'), (2, 'a real quote of the file', 'a.pdf'), (3, NULL, NULL)) AS t(id, quote, source_file)")
def c24(spark, d):
    return K.lock_files(LOCKED.df(spark), ["a.pdf", "b.pdf"]).select("id", "quote", "source_file")


@query("c9_first_template", "SELECT doc_id, template FROM (SELECT doc_id, template, row_number() OVER (PARTITION BY doc_id ORDER BY priority) AS n FROM documents JOIN (VALUES (1, 'mit license', 'Keep the notice'), (2, 'license', 'Check the licence'), (3, 'token', 'Rotate the secret')) AS r(priority, keyword, template) ON contains(lower(text), keyword)) WHERE n = 1")
def c9(spark, d):
    rules = [("Keep the notice", ["mit license"]), ("Check the licence", ["license"]), ("Rotate the secret", ["token"])]
    from lodestone.functions.rules import classify

    return table(spark, d, "documents").select("doc_id", classify(F.lower("text"), rules, "").alias("template")).where("template <> ''")


@query("c22_control_cascade", "SELECT o_orderkey, coalesce(a.p_name, b.p_name, 'unresolved') AS control FROM orders LEFT JOIN (SELECT * FROM part WHERE p_size > 40) a ON o_custkey = a.p_partkey LEFT JOIN (SELECT * FROM part WHERE p_size < 5) b ON o_orderkey = b.p_partkey")
def c22(spark, d):
    p = table(spark, d, "part")
    done = M.cascade(table(spark, d, "orders"), [(F.col("o_custkey"), p.where("p_size > 40"), "p_partkey", "p_name"), (F.col("o_orderkey"), p.where("p_size < 5"), "p_partkey", "p_name")], "control")
    return done.select("o_orderkey", F.coalesce("control", F.lit("unresolved")).alias("control"))


@query("c32_best_vector", "SELECT e.vec_id, arg_max(p.label, (list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), -p.vec_id)) AS label FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 10) p WHERE e.vec_id >= 10 GROUP BY 1 HAVING max(list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[])) > 0.2")
def c32(spark, d):
    e = table(spark, d, "embeddings")
    probes = e.where("vec_id < 10").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), F.col("label").alias("probe_label"))
    both = e.where("vec_id >= 10").join(F.broadcast(probes), F.lit(True)).select("vec_id", "query", "probe_label", V.cosine(F.col("embedding"), F.col("vector")).alias("s"))
    best = both.groupBy("vec_id").agg(F.max_by("probe_label", F.struct("s", -F.col("query"))).alias("label"), F.max("s").alias("s"))
    return best.where("s > 0.2").select("vec_id", "label")


HEADERS = Rows("t", "sheet string, row int, cells array<string>", [("A", 0, ["", None]), ("A", 1, ["Control ID", "Requirement Question", "Evidence Files"]), ("A", 2, ["5.1", "Is there a policy?", "a.pdf"]), ("B", 0, ["Ref", "Question", "Severity"])])
#: Words that give a column its role, in order (fixed values).
ROLES = [("control_id", ["control id", "control ref", "ref"]), ("question", ["question", "requirement"]), ("files", ["file", "evidence", "document"]), ("severity", ["severity", "priority"])]


@query("c23_header_roles", "SELECT * FROM (VALUES ('A', 0, 'control_id'), ('A', 1, 'question'), ('A', 2, 'files'), ('B', 0, 'control_id'), ('B', 1, 'question'), ('B', 2, 'severity')) AS t(sheet, col, role)")
def c23(spark, d):
    from lodestone.functions.rules import classify

    filled = HEADERS.df(spark).where(F.size(F.filter("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "")) > 0)
    head = W.first_per(filled, ["sheet"], [F.col("row")])
    return head.select("sheet", F.posexplode("cells").alias("col", "name")).select("sheet", "col", classify(F.lower("name"), ROLES, "").alias("role"))


GATES = Rows("t", "id int, claimed string, grounding string, leak boolean", [(1, "COMPLIANT", "GROUNDED", False), (2, "COMPLIANT", "NOT_GROUNDED", False), (3, "PARTIAL", "NOT_GROUNDED", False), (4, "COMPLIANT", "GROUNDED", True), (5, "NOT_APPLICABLE", None, None)])


@query("c28_gate_order", f"SELECT id, CASE WHEN claimed = 'NOT_APPLICABLE' THEN 'Out of Scope' WHEN coalesce(leak, false) THEN 'NON_COMPLIANT' WHEN claimed IN ('COMPLIANT', 'PARTIAL') AND coalesce(grounding, '') <> 'GROUNDED' THEN 'NON_COMPLIANT' ELSE claimed END AS status, claimed IN ('COMPLIANT', 'PARTIAL') AND (coalesce(leak, false) OR coalesce(grounding, '') <> 'GROUNDED') AS review FROM {GATES.sql}")
def c28(spark, d):
    leak, bad = F.coalesce("leak", F.lit(False)), F.coalesce("grounding", F.lit("")) != "GROUNDED"
    claim = F.col("claimed").isin("COMPLIANT", "PARTIAL")
    status = F.when(F.col("claimed") == "NOT_APPLICABLE", "Out of Scope").when(leak | (claim & bad), "NON_COMPLIANT").otherwise(F.col("claimed"))
    return GATES.df(spark).select("id", status.alias("status"), (claim & (leak | bad)).alias("review"))


ADVICE = Rows("t", "id int, status string, recommendation string", [(1, "NON_COMPLIANT", "No action required."), (2, "COMPLIANT", "No action required."), (3, "NON_COMPLIANT", "Patch it"), (4, "NON_COMPLIANT", None)])


@query("c34_stale_advice", f"SELECT id, CASE WHEN status = 'NON_COMPLIANT' AND (recommendation IS NULL OR regexp_matches(lower(recommendation), 'no (further )?action')) THEN 'Provide the missing evidence' ELSE recommendation END AS recommendation FROM {ADVICE.sql}")
def c34(spark, d):
    r = F.col("recommendation")
    return ADVICE.df(spark).select("id", F.when((F.col("status") == "NON_COMPLIANT") & (r.isNull() | F.lower(r).rlike("no (further )?action")), "Provide the missing evidence").otherwise(r).alias("recommendation"))


@query("s2_archive_members", "SELECT * FROM (VALUES ('a.txt', 5), ('in.zip/b.csv', 3)) AS t(member, size)")
def s2(spark, d):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b.csv", "x,y")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("in.zip", inner.getvalue())
    df = spark.createDataFrame([("p.zip", outer.getvalue())], "path string, content binary")
    return S.expand_archives(df).select("member", F.octet_length("content").alias("size"))


@query("s21_upload_guard", "SELECT * FROM (VALUES ('a.pdf', 'OK'), ('b.pdf', 'KIND_MISMATCH'), ('c.txt', 'EMPTY'), ('d.docx', 'MACRO')) AS t(path, verdict)")
def s21(spark, d):
    df = spark.createDataFrame([("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"MZ"), ("c.txt", b""), ("d.docx", b"PK\x03\x04 vbaProject.bin")], "path string, content binary")
    return S.guard_uploads(df).select("path", "verdict")


@query("s17_replace_on_key", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1 ORDER BY 2 DESC LIMIT 5000")
def s17(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return W.replace_and_keep(e, "user_id", [F.desc("event_id")], 5000)


@query("s23_checklist_rows", "SELECT * FROM (VALUES (2, '5.1', 'Is there a policy?', 'a.pdf')) AS t(row, control_id, question, files)")
def s23(spark, d):
    rows = HEADERS.df(spark).where("sheet = 'A' AND row > 1")
    return rows.select("row", F.get(T.control_ids(F.col("cells")[0]), F.lit(0)).alias("control_id"), F.col("cells")[1].alias("question"), F.array_join(T.citations(F.col("cells")[2]), ", ").alias("files"))


@query("x2_expiring_state", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def x2(spark, d):
    """State with a time to live: an id is remembered for 24 hours of event time."""
    return C.drain(C.first_seen(C.event_stream(spark, d), "24 hours"), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("x5_resume", "SELECT count(*) AS n FROM events")
def x5(spark, d):
    """Checkpoint and resume: a second run of the same stream adds nothing."""
    home = C.new_folder(spark, "resume")
    for _ in range(2):
        C.sink_batches(C.event_stream(spark, d), f"{home}/out", f"{home}/at").awaitTermination()
    return spark.read.parquet(f"{home}/out").agg(F.count("*").alias("n"))


@query("x8_dirty_tables", "SELECT * FROM (VALUES ('nation', 25), ('region', 5)) AS t(name, n)")
def x8(spark, d):
    done = S.replicate({n: table(spark, d, n) for n in ("nation", "region", "part")}, {"nation", "region"}, [C.new_folder(spark, "replica")])
    counts = [spark.read.parquet(p).select(F.lit(p.rsplit("/", 1)[1][:-8]).alias("name")) for p in done]
    return counts[0].unionByName(counts[1]).groupBy("name").agg(F.count("*").alias("n"))


@query("w12_latest_position", "SELECT user_id, max(ts) AS latest FROM events GROUP BY 1")
def w12(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"))
    return table(spark, d, "events").select("user_id", "ts", F.row_number().over(w).alias("n")).where("n = 1").select("user_id", F.col("ts").alias("latest"))
