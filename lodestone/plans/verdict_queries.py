"""Verdicts and retrieval rules over whole tables: order lines are evidence items, orders are findings, order dates are policy dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import verdicts as V
from lodestone.operators import context as K
from lodestone.operators import retrieval as R
from lodestone.operators.matching import resolve_controls
from lodestone.plans.registry import query, table
from lodestone.plans.text_queries import BM25_SQL

AS_OF = "1997-06-30"
_DATES = f"CAST(o_orderdate AS DATE) + 365 AS expires, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) + 180 END AS review_due, DATE '{AS_OF}' AS as_of"
_VALIDITY = "CASE WHEN o_orderkey % 5 = 0 AND review_due IS NULL THEN 'UNKNOWN' WHEN o_orderkey % 5 > 0 AND expires < as_of THEN 'EXPIRED' WHEN review_due < as_of THEN 'REVIEW_OVERDUE' ELSE 'CURRENT' END"


def _policies(spark, d):
    """(o_orderkey, validity): every fifth policy has no end, every seventh no review."""
    day = F.to_date("o_orderdate")
    expires = F.when(F.col("o_orderkey") % 5 > 0, F.date_add(day, 365))
    review = F.when(F.col("o_orderkey") % 7 > 0, F.date_add(day, 180))
    return table(spark, d, "orders").select("o_orderkey", V.policy_validity(expires, review, F.lit(AS_OF).cast("date")).alias("validity"))


@query("c16_order_validity", f"SELECT o_orderkey, {_VALIDITY} AS validity FROM (SELECT o_orderkey, {_DATES} FROM orders)")
def c16(spark, d):
    return _policies(spark, d)


_CADENCE = "CASE WHEN l_linenumber < 6 THEN 90 * l_linenumber END"
_FRESHNESS = f"CASE WHEN {_CADENCE} IS NULL THEN 'UNKNOWN' WHEN DATE '{AS_OF}' - CAST(l_shipdate AS DATE) > {_CADENCE} THEN 'STALE' ELSE 'CURRENT' END"


def _lines(spark, d):
    """Items (l_orderkey, l_linenumber, support, quote, freshness): the ship mode of evidence is its return flag."""
    x = table(spark, d, "lineitem")
    cadence = F.when(F.col("l_linenumber") < 6, 90 * F.col("l_linenumber"))
    support = F.when(F.col("l_returnflag") == "R", "PARTIAL").otherwise("SUPPORTED")
    quote = F.concat(F.lit("line "), F.col("l_partkey").cast("string"), F.when(F.col("l_linestatus") == "F", " is not enabled").when(F.col("l_quantity") > 10, " is Enabled here").otherwise(""))
    return x.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", support.alias("support"), quote.alias("quote"), V.evidence_freshness(F.to_date("l_shipdate"), cadence, F.lit(AS_OF).cast("date")).alias("freshness"))


_LINES = f"l AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'PARTIAL' ELSE 'SUPPORTED' END AS support, 'line ' || l_partkey || CASE WHEN l_linestatus = 'F' THEN ' is not enabled' WHEN l_quantity > 10 THEN ' is Enabled here' ELSE '' END AS quote, {_FRESHNESS} AS freshness FROM lineitem)"


@query("c17_line_freshness", f"SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, {_FRESHNESS} AS freshness FROM lineitem")
def c17(spark, d):
    return _lines(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "freshness")


@query("c19_line_status", f"WITH {_LINES} SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN length(trim(quote)) < 12 THEN 'NON_COMPLIANT' ELSE 'COMPLIANT' END AS status FROM l WHERE support = 'SUPPORTED'")
def c19(spark, d):
    x = _lines(spark, d).where("support = 'SUPPORTED'")
    return x.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", V.consistent_status(F.lit("COMPLIANT"), F.col("quote")).alias("status"))


_CONFLICT = "bool_or(contains(replace(lower(quote), 'not enabled', ' '), 'enabled')) AND bool_or(contains(lower(quote), 'not enabled'))"


@query("c14_order_conflicts", f"WITH {_LINES} SELECT l_orderkey, {_CONFLICT} AS conflict FROM l GROUP BY 1")
def c14(spark, d):
    return _lines(spark, d).groupBy("l_orderkey").agg(V.conflicting(F.col("quote"), ["enabled", "enforced"], ["not enabled", "not enforced"]).alias("conflict"))


@query("c13_order_results", f"WITH {_LINES}, p AS (SELECT o_orderkey, {_VALIDITY} AS validity FROM (SELECT o_orderkey, {_DATES} FROM orders)) SELECT l_orderkey, CASE WHEN bool_and(support = 'SUPPORTED') AND NOT ({_CONFLICT}) AND bool_and(coalesce(validity = 'CURRENT', false)) AND bool_and(freshness <> 'STALE') THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS result FROM l LEFT JOIN p ON l_orderkey = o_orderkey GROUP BY 1")
def c13(spark, d):
    """The final result of every order: all lines supported, no conflict, the policy current, nothing stale."""
    items = _lines(spark, d).join(_policies(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    conflict = V.conflicting(F.col("quote"), ["enabled"], ["not enabled"])
    return items.groupBy("l_orderkey").agg(V.final_result(F.col("support"), conflict, F.col("validity"), F.col("freshness")).alias("result"))


#: Two forms of one question, as policy and as evidence.
FORMS = [("q1", "policy", "license", 2.0), ("q1", "policy", "public", 1.0), ("q1", "evidence", "token", 1.0), ("q1", "evidence", "license", 0.6), ("q2", "policy", "thing", 1.0), ("q2", "evidence", "than", 1.0)]
_FORMS_SQL = "(VALUES " + ", ".join(f"('{q}|{f}', '{t}', {w})" for q, f, t, w in FORMS) + ") AS q(query, term, weight)"
_BM25_FORMS = BM25_SQL[: BM25_SQL.index("FROM tf JOIN fixed")].replace("round(sum(", "(sum(").replace(", 6) AS bm25", ") AS bm25") + f"FROM tf JOIN fixed USING (term) JOIN {_FORMS_SQL} USING (term), stats GROUP BY 1, 2"


@query("r1_better_of_two", f"WITH b AS ({_BM25_FORMS}), g AS (SELECT string_split(query, '|')[1] AS query, chunk, max(bm25) AS s, count(*) AS n FROM b GROUP BY 1, 2) SELECT query, chunk, round(CASE WHEN n < 2 THEN greatest(s, 0) ELSE s END, 6) AS bm25 FROM g")
def r1(spark, d):
    """Each document's better score of the policy and the evidence form of a question."""
    forms = spark.createDataFrame(FORMS, "query string, form string, term string, weight double")
    return R.best_bm25(table(spark, d, "documents"), forms, "doc_id").select("query", "chunk", F.round("bm25", 6).alias("bm25"))


@query("r10_limits_by_type", "WITH m AS (SELECT CASE lang WHEN 'en' THEN 45 WHEN 'de' THEN 12 ELSE 35 END AS k FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lang LIMIT 1)) SELECT doc_id FROM documents ORDER BY length(text) DESC, doc_id LIMIT (SELECT greatest(30, k) FROM m)")
def r10(spark, d):
    return R.top_of_dominant(table(spark, d, "documents"), "lang", [F.desc(F.char_length("text")), F.col("doc_id")], {"en": 45, "de": 12}, 35).select("doc_id")


R14_SQL = """
WITH v AS (SELECT vec_id AS query, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id % 100 = 0 AND vec_id % 200 = 0),
c AS (SELECT query, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], x) AS score FROM embeddings, v),
w AS (SELECT item_id + 1000000 AS query, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda y: length(y) > 3) AS words FROM benchmark WHERE item_id % 100 = 0),
k AS (SELECT query, doc_id AS id, CAST(len(list_filter(words, lambda y: contains(lower(text), y))) AS DOUBLE) AS score FROM documents, w),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT * FROM c UNION ALL SELECT * FROM k))
SELECT query, id, round(score, 5) AS score, rank FROM r WHERE rank <= 5
"""


@query("r14_chat_context", R14_SQL)
def r14(spark, d):
    """Questions with a vector, the vectors of two hundreds, and without, benchmark passages, over all vectors and documents."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("id % 200 = 0").select(F.col("id").alias("query"), F.lit("").alias("text"), "vector")
    bare = table(spark, d, "benchmark").where("item_id % 100 = 0").select((F.col("item_id") + 1_000_000).alias("query"), "text", F.lit(None).cast("array<float>").alias("vector"))
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    done = R.chat_context(chunks, e, asked.unionByName(bare))
    return done.select("query", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query("t25_terms_grounded", rf"WITH q AS (SELECT item_id, list_filter(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F]', 'Z', 'g'), '\b[a-z0-9]{{3,}}\b'), lambda w: NOT list_contains([{_STOP}], w)) AS t FROM benchmark WHERE item_id % 10 = 0), j AS (SELECT item_id, doc_id, t, lower(text) AS x FROM documents, q) SELECT item_id, doc_id FROM j WHERE len(t) >= 3 AND len(list_filter(t, lambda w: contains(x, w))) / len(t) >= 0.6")
def t25(spark, d):
    """Every tenth benchmark passage as a quote, against all documents: those that have six tenths of its key terms."""
    quotes = table(spark, d, "benchmark").where("item_id % 10 = 0").select("item_id", F.col("text").alias("quote"))
    return K.grounded_by_terms(table(spark, d, "documents"), "doc_id", "text", quotes, "item_id", "quote")


#: Nations as controls: an id, a name, the fourth word of a benchmark passage as a keyword, a vector. Documents cite them in one way or another.
C22_SQL = r"""
WITH c AS (SELECT 'n-' || n_nationkey AS control, n_name AS name, trim(regexp_replace(lower(string_split(b.text, ' ')[4]), '[^a-z0-9]+', ' ', 'g')) AS keyword, e.embedding::DOUBLE[] AS x
           FROM nation LEFT JOIN benchmark b ON item_id = n_nationkey LEFT JOIN embeddings e ON vec_id = n_nationkey),
r AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'n-' || doc_id % 30 END AS id_text, CASE WHEN doc_id % 4 = 1 THEN n_name END AS name_text,
             ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, embedding::DOUBLE[] AS v
      FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 40 LEFT JOIN embeddings ON vec_id = doc_id),
a AS (SELECT id, control FROM r JOIN c ON control = id_text),
b AS (SELECT id, min(control) AS control FROM r JOIN c ON name = name_text WHERE id NOT IN (SELECT id FROM a) GROUP BY id),
k AS (SELECT id, control, row_number() OVER (PARTITION BY id ORDER BY length(keyword) DESC, keyword, control) AS n FROM r JOIN c ON keyword <> '' AND contains(t, ' ' || keyword || ' ') WHERE id NOT IN (SELECT id FROM a UNION SELECT id FROM b)),
s AS (SELECT id, control, list_cosine_similarity(v, x) AS s FROM r JOIN c ON v IS NOT NULL AND x IS NOT NULL WHERE id NOT IN (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM k)),
f AS (SELECT id, control, row_number() OVER (PARTITION BY id ORDER BY s DESC, control) AS n FROM s WHERE s > 0.25),
u AS (SELECT id, control, 'id' AS step FROM a UNION ALL SELECT id, control, 'name' FROM b UNION ALL SELECT id, control, 'keyword' FROM k WHERE n = 1 UNION ALL SELECT id, control, 'vector' FROM f WHERE n = 1)
SELECT r.id, control, coalesce(step, 'none') AS step FROM r LEFT JOIN u ON u.id = r.id
"""


@query("c22_resolved_controls", C22_SQL)
def c22(spark, d):
    """The control of every document by id, name, keyword or vector."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = table(spark, d, "nation")
    words = table(spark, d, "benchmark").select("item_id", F.get(F.split("text", " "), F.lit(3)).alias("keyword"))
    controls = n.join(words, F.col("item_id") == F.col("n_nationkey"), "left").join(e, F.col("vec_id") == F.col("n_nationkey"), "left")
    controls = controls.select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("control"), F.col("n_name").alias("name"), "keyword", "vector")
    docs = table(spark, d, "documents").join(n.select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("doc_id") % 40, "left").join(e, F.col("vec_id") == F.col("doc_id"), "left")
    cited = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" N-"), (F.col("doc_id") % 30).cast("string")))
    rows = docs.select(F.col("doc_id").alias("id"), cited.alias("id_text"), F.when(F.col("doc_id") % 4 == 1, F.lower("n_name")).alias("name_text"), "text", "vector")
    return resolve_controls(rows, controls, 0.25)
