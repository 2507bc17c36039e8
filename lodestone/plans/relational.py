"""Filters, joins, aggregates, sorts, windows and set operations as queries.

Stand-ins: customers own sessions (orders), a session's findings are line items,
an order's priority is a severity, events are system events, conversations are
chat messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import predicates as P
from lodestone.functions import text as T
from lodestone.operators import matching as M
from lodestone.operators import windows as W
from lodestone.operators.scans import clamped_balance, running_sum
from lodestone.plans.registry import query, table

AS_OF = "2024-01-31 00:00:00"
#: The three statuses that count as compliant, as order statuses.
PASSED = ["F"]


@query("f1_equality_in_notnull", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IS NOT NULL")
def f1(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_custkey").isNotNull()).select("o_orderkey", "o_custkey")


@query("f2_contains_negated", "SELECT doc_id FROM documents WHERE text ILIKE '%license%' AND NOT text ILIKE '%mit license%'")
def f2(spark, d):
    x = table(spark, d, "documents")
    return x.where(P.icontains(F.col("text"), "license") & ~P.icontains(F.col("text"), "mit license")).select("doc_id")


@query("f3_disjunction", "SELECT event_id FROM events WHERE event_type = 'error' OR value > 90 OR user_id = 7")
def f3(spark, d):
    x = table(spark, d, "events")
    return x.where((F.col("event_type") == "error") | (F.col("value") > 90) | (F.col("user_id") == 7)).select("event_id")


@query("f4_optional_filters", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'click'")
def f4(spark, d):
    return P.optional_filters(table(spark, d, "events"), event_type="click", user_id="All", props="").select("event_id", "event_type", "user_id")


@query("f5_older_than", f"SELECT event_id FROM events WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY")
def f5(spark, d):
    return table(spark, d, "events").where(F.col("ts") < F.expr(f"timestamp_ntz'{AS_OF}' - interval 10 days")).select("event_id")


@query("f6_active_rows", "SELECT c_custkey, c_name FROM customer WHERE NOT (c_acctbal < 0)")
def f6(spark, d):
    return table(spark, d, "customer").withColumn("deleted", F.col("c_acctbal") < 0).where(~F.col("deleted")).select("c_custkey", "c_name")


@query("f7_first_long_text", "SELECT doc_id, CASE WHEN length(trim(lang)) > 5 THEN lang WHEN length(trim(source)) > 5 THEN source WHEN length(trim(text)) > 5 THEN text END AS label FROM documents")
def f7(spark, d):
    return table(spark, d, "documents").select("doc_id", P.first_long(F.col("lang"), F.col("source"), F.col("text")).alias("label"))


@query("f8_whole_word", r"SELECT doc_id, regexp_matches(lower(text), '\blicense\b') AS has_license, regexp_matches(lower(text), '\btoken\b') AS has_token FROM documents")
def f8(spark, d):
    x = F.lower(F.col("text"))
    return table(spark, d, "documents").select("doc_id", P.has_word(x, "license").alias("has_license"), P.has_word(x, "token:").alias("has_token"))


KEYWORDS = [("K1", "the"), ("K2", "license"), ("K3", "mit"), ("K4", "general public"), ("K5", "token")]


@query("f9_short_or_substring")
def f9(spark, d):
    """Over texts in all languages; SQL's regular expressions see word borders beside letters outside ASCII differently, so tests compare with brute force."""
    words = spark.createDataFrame(KEYWORDS, "control string, keyword string")
    docs = table(spark, d, "documents").select(F.lower("text").alias("t"))
    # five literal rows
    return docs.join(F.broadcast(words), P.keyword_hit(F.col("t"), F.col("keyword"))).groupBy("control").agg(F.count("*").alias("n_docs"))


@query("f11_row_access", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3, 10) AND FALSE UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 4, 5)")
def f11(spark, d):
    o = table(spark, d, "orders")
    return o.where(P.allowed("o_custkey", [])).select("o_orderkey").unionByName(o.where(P.allowed("o_custkey", [1, 2, 4, 5])).select("o_orderkey"))


FEEDBACK = [(1, 9, True, False), (2, None, True, False), (3, 7, True, False), (4, 10, False, False), (5, 10, True, True), (6, 8, None, None), (7, 8, True, None)]
FEEDBACK_SQL = "(VALUES (1, 9, true, false), (2, NULL, true, false), (3, 7, true, false), (4, 10, false, false), (5, 10, true, true), (6, 8, NULL, NULL), (7, 8, true, NULL)) AS f(id, confidence, verified, leak)"


@query("f12_feedback_eligible", f"SELECT id FROM {FEEDBACK_SQL} WHERE NOT coalesce(leak, false) AND coalesce(confidence, 8) >= 8 AND coalesce(verified, false)")
def f12(spark, d):
    f = spark.createDataFrame(FEEDBACK, "id int, confidence int, verified boolean, leak boolean")
    return f.where(~F.coalesce("leak", F.lit(False)) & (F.coalesce("confidence", F.lit(8)) >= 8) & F.coalesce("verified", F.lit(False))).select("id")


@query("f13_list_edit", "SELECT * FROM (VALUES (1, 'b.csv', 'a.pdf, b.csv, x.txt'), (2, 'b.csv', 'b.csv, x.txt'), (3, '', 'a.pdf, x.txt'), (4, '', 'x.txt')) AS t(id, without_a, with_x)")
def f13(spark, d):
    x = spark.createDataFrame([(1, "a.pdf, b.csv"), (2, "b.csv"), (3, "a.pdf,a.pdf"), (4, "")], "id int, files string")
    return x.select("id", P.list_without(F.col("files"), "a.pdf").alias("without_a"), P.list_with(F.col("files"), "x.txt").alias("with_x"))


@query("f14_report_scope", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'P') OR o_orderstatus IS NULL GROUP BY 1")
def f14(spark, d):
    o = table(spark, d, "orders")
    return o.where(~F.col("o_orderstatus").isin("O", "P") | F.col("o_orderstatus").isNull()).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("f15_any_keyword", "SELECT doc_id, (contains(lower(text), 'license') OR contains(lower(text), 'public') OR contains(lower(text), 'token')) AS relevant FROM documents")
def f15(spark, d):
    words = F.array(*[F.lit(x) for x in ("license", "public", "token")])
    return table(spark, d, "documents").select("doc_id", F.exists(words, lambda k: F.contains(F.lower("text"), k)).alias("relevant"))


@query("f16_unreviewed", "WITH x AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'), n AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS k FROM x GROUP BY 1) SELECT x.o_custkey, o_orderkey FROM x JOIN n USING (o_custkey) WHERE o_orderpriority <> '5-LOW' OR k = 0")
def f16(spark, d):
    x = table(spark, d, "orders").where("o_orderstatus <> 'F'")
    others = F.count_if(F.col("o_orderpriority") != "5-LOW").over(Window.partitionBy("o_custkey"))
    return x.withColumn("k", others).where("o_orderpriority <> '5-LOW' OR k = 0").select("o_custkey", "o_orderkey")


@query("j1_inner_equi", "SELECT l_orderkey, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1, 2")
def j1(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_custkey").agg(F.count("*").alias("n"))


@query("j3_session_counts", "SELECT c_custkey, c_name, coalesce(n, 0) AS n_sessions, CASE WHEN n > 0 THEN CAST(floor(100.0 * passed / n) AS BIGINT) ELSE 0 END AS score FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def j3(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_sessions"), F.floor(F.count_if(F.col("o_orderstatus").isin(PASSED)) * 100 / F.count("*")).alias("score"))
    return M.left_with(table(spark, d, "customer").select("c_custkey", "c_name"), counts, ["c_custkey"], {"n_sessions": 0, "score": 0})


@query("j4_owner_default", "SELECT o_orderkey, coalesce(nullif(c_name, ''), 'Unknown') AS owner FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o_custkey = c_custkey")
def j4(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce(F.nullif("c_name", F.lit("")), F.lit("Unknown")).alias("owner"))


@query("j5_role_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def j5(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("j6_scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = (SELECT max(c_custkey) FROM customer WHERE c_mktsegment = 'MACHINERY')")
def j6(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("j6_orders")
    table(spark, d, "customer").createOrReplaceTempView("j6_customer")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM j6_orders WHERE o_custkey = (SELECT max(c_custkey) FROM j6_customer WHERE c_mktsegment = 'MACHINERY')")


@query("j7_absent_null_safe", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id % 3 = 0 AND x.event_type IS NOT DISTINCT FROM e.event_type AND x.user_id IS NOT DISTINCT FROM e.user_id AND date_trunc('day', x.ts) IS NOT DISTINCT FROM date_trunc('day', e.ts))")
def j7(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return M.absent(e, e.where("event_id % 3 = 0"), ["event_type", "user_id", "day"]).select("event_id")


@query("j8_new_keys_first", "SELECT l_partkey, l_suppkey, min(l_orderkey) AS first_order FROM lineitem WHERE l_orderkey % 2 = 1 AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey % 10 = 0 AND x.l_partkey = lineitem.l_partkey AND x.l_suppkey = lineitem.l_suppkey) GROUP BY 1, 2")
def j8(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    fresh = M.absent(x.where("l_orderkey % 2 = 1"), x.where("l_orderkey % 10 = 0"), ["l_partkey", "l_suppkey"])
    return W.first_per(fresh, ["l_partkey", "l_suppkey"], [F.col("l_orderkey")]).select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("first_order"))


@query("j9_skip_done", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def j9(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(done, "p_partkey", "left_anti")


@query("j10_two_stage_key", "SELECT s_suppkey, coalesce(a.n_name, b.n_name) AS name FROM supplier LEFT JOIN nation a ON s_nationkey = a.n_nationkey AND a.n_regionkey < 2 LEFT JOIN nation b ON s_nationkey % 5 = b.n_nationkey")
def j10(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier")
    return M.cascade(s, [(F.col("s_nationkey"), n.where("n_regionkey < 2"), "n_nationkey", "n_name"), (F.col("s_nationkey") % 5, n, "n_nationkey", "n_name")], "name").select("s_suppkey", "name")


@query("j11_enrich_catalog", "SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def j11(spark, d):
    r = table(spark, d, "region")
    return table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")


_WORDS_SQL = "(VALUES ('A', 'license'), ('B', 'general public license'), ('C', 'mit license'), ('D', 'token'), ('E', 'released under')) AS k(value, keyword)"


@query("j13_longest_keyword", rf"WITH h AS (SELECT doc_id, value, keyword, row_number() OVER (PARTITION BY doc_id ORDER BY length(keyword) DESC, keyword, value) AS n FROM documents JOIN {_WORDS_SQL} ON contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || keyword || ' ')) SELECT doc_id AS id, value, keyword FROM h WHERE n = 1")
def j13(spark, d):
    words = spark.createDataFrame([("A", "license"), ("B", "general public license"), ("C", "MIT license"), ("D", "token"), ("E", "released under")], "value string, keyword string")
    return M.longest_keyword(table(spark, d, "documents"), "doc_id", "text", words)


@query("j14_token_overlap", "WITH w AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' ')) AS word FROM part), k AS (SELECT DISTINCT p_brand AS key, unnest(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' ')) AS word FROM part), s AS (SELECT id, key, count(*) AS shared FROM w JOIN k USING (word) WHERE length(word) > 3 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, key) AS n FROM s) SELECT id, key, shared FROM r WHERE n = 1 AND shared >= 1")
def j14(spark, d):
    p = table(spark, d, "part")
    brands = p.groupBy("p_brand").agg(F.concat_ws(" ", F.collect_list("p_name")).alias("label"))
    return M.token_overlap(p, "p_partkey", "p_name", brands, "p_brand", "label", least=1)


_CITED = [("Policy.pdf",), ("policy",), ("evidence 2024.xlsx",), ("missing.doc",)]
_UPLOADED = [("policy.pdf",), ("evidence 2024.xlsx",), ("2024",), ("annex policy.pdf",)]


@query("j15_citation_match", "SELECT * FROM (VALUES ('Policy.pdf', 'policy.pdf'), ('policy', 'annex policy.pdf'), ('evidence 2024.xlsx', 'evidence 2024.xlsx')) AS t(cited, name)")
def j15(spark, d):
    return M.containment(spark.createDataFrame(_CITED, "cited string"), "cited", spark.createDataFrame(_UPLOADED, "name string"), "name").select("cited", "name")


@query("j17_reused_quotes", "WITH q AS (SELECT doc_id, source, lower(trim(text)) AS quote FROM documents WHERE length(trim(text)) >= 15) SELECT doc_id, source FROM q WHERE quote IN (SELECT quote FROM q GROUP BY 1 HAVING count(DISTINCT source) >= 2)")
def j17(spark, d):
    q = table(spark, d, "documents").where(F.char_length(F.trim("text")) >= 15).select("doc_id", "source", F.sha2(F.lower(F.trim("text")), 256).alias("quote"))
    reused = q.groupBy("quote").agg(F.count_distinct("source").alias("n")).where("n >= 2")
    return q.join(reused, "quote", "left_semi").select("doc_id", "source")


@query("j19_cascade_delete", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def j19(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("j20_first_source_wins", "SELECT k, label FROM (SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM (SELECT o_orderkey AS k, 'report' AS label, 0 AS i FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT DISTINCT conv_id, 'chat', 1 FROM conversations)) WHERE n = 1")
def j20(spark, d):
    a = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit("report").alias("label"))
    b = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), F.lit("chat").alias("label")).distinct()
    return M.first_source([a, b], "k")


@query("j21_controls_first_per_id", "SELECT p_brand AS id, min(p_partkey) AS part FROM part WHERE p_size < 20 OR p_brand LIKE '%1' GROUP BY 1")
def j21(spark, d):
    p = table(spark, d, "part")
    both = p.where("p_size < 20").unionByName(p.where("p_brand LIKE '%1'"))
    return W.first_per(both, ["p_brand"], [F.col("p_partkey")]).select(F.col("p_brand").alias("id"), F.col("p_partkey").alias("part"))


@query("j22_scope_cascade", "SELECT o_orderkey, coalesce(c.c_name, n.n_name) AS owner, coalesce(c.c_name, n.n_name) IS NULL AS unmatched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 15) n ON o_custkey % 25 = n_nationkey")
def j22(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 3 = 0")
    n = table(spark, d, "nation").where("n_nationkey < 15")
    done = M.cascade(table(spark, d, "orders"), [(F.col("o_custkey"), c, "c_custkey", "c_name"), (F.col("o_custkey") % 25, n, "n_nationkey", "n_name")], "owner")
    return done.select("o_orderkey", "owner", F.col("owner").isNull().alias("unmatched"))


@query("j23_prefix_default", "SELECT s_suppkey, min(r_name) AS label FROM supplier LEFT JOIN region ON s_nationkey // 5 = r_regionkey GROUP BY 1")
def j23(spark, d):
    r = table(spark, d, "region")
    return table(spark, d, "supplier").join(r, F.expr("s_nationkey div 5") == F.col("r_regionkey"), "left").groupBy("s_suppkey").agg(F.min("r_name").alias("label"))


@query("j24_checkpoint_titles", "SELECT c.conv_id, coalesce(o.o_orderpriority, 'Session ' || c.conv_id) AS title, n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c LEFT JOIN orders o ON c.conv_id = o.o_orderkey")
def j24(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return c.join(o, F.col("conv_id") == F.col("o_orderkey"), "left").select("conv_id", F.coalesce("o_orderpriority", F.concat(F.lit("Session "), F.col("conv_id").cast("string"))).alias("title"), "n")


@query("a1_metric_sums", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(user_id) AS top_user, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a1(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("user_id").alias("top_user"), F.count_distinct("user_id").alias("users"))


@query("a2_map_merge", "SELECT o_custkey, map_from_entries(list((o_orderstatus, n) ORDER BY o_orderstatus))::VARCHAR AS counts FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def a2(spark, d):
    per_order = table(spark, d, "orders").select("o_custkey", F.create_map("o_orderstatus", F.lit(1)).alias("m"))
    summed = per_order.select("o_custkey", F.explode("m").alias("k", "v")).groupBy("o_custkey", "k").agg(F.sum("v").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("k", "n")))
    return summed.groupBy("o_custkey").agg(pairs.alias("p")).select("o_custkey", F.concat(F.lit("{"), F.array_join(F.transform("p", lambda x: F.concat(x["k"], F.lit("="), x["n"].cast("string"))), ", "), F.lit("}")).alias("counts"))


@query("a3_compliance_score", "SELECT o_custkey, CAST(CASE WHEN count(*) = 0 THEN 0 ELSE floor(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)) END AS BIGINT) AS score, CAST(coalesce(floor(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')), 0)), 0) AS BIGINT) AS score_in_scope FROM orders GROUP BY 1")
def a3(spark, d):
    ok, scope = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus").isin("F", "O"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.floor(100 * ok / F.count("*")).alias("score"), F.coalesce(F.floor(F.try_divide(100 * ok, scope)), F.lit(0)).cast("long").alias("score_in_scope"))


@query("a4_severity_counts", "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS critical, count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS high, count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS medium, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def a4(spark, d):
    names = {"critical": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "low": "5-LOW"}
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(*[F.count_if(F.col("o_orderpriority") == v).alias(k) for k, v in names.items()])


@query("a5_real_accuracy", "SELECT count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS grounded_compliant, count(*) FILTER (WHERE l_returnflag = 'N') AS correct_non_compliant, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') AS hallucinated, round_even((count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') + count(*) FILTER (WHERE l_returnflag = 'N')) / count(*) * 100, 1) AS real_accuracy FROM lineitem")
def a5(spark, d):
    g = F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"))
    n = F.count_if(F.col("l_returnflag") == "N")
    return table(spark, d, "lineitem").agg(F.count("*").alias("total"), g.alias("grounded_compliant"), n.alias("correct_non_compliant"), F.count_if((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")).alias("hallucinated"), F.bround((g + n) / F.count("*") * 100, 1).alias("real_accuracy"))


@query("a6_confusion", "WITH x AS (SELECT quality = 1 AS actual, length(text) > 500 AS predicted FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE actual AND predicted) AS tp, count(*) FILTER (WHERE NOT actual AND NOT predicted) AS tn, count(*) FILTER (WHERE NOT actual AND predicted) AS fp, count(*) FILTER (WHERE actual AND NOT predicted) AS fn FROM x) SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision_, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def a6(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", (F.char_length("text") > 500).alias("p")), "doc_id").select((F.col("quality") == 1).alias("a"), "p")
    c = x.agg(F.count_if(F.col("a") & F.col("p")).alias("tp"), F.count_if(~F.col("a") & ~F.col("p")).alias("tn"), F.count_if(~F.col("a") & F.col("p")).alias("fp"), F.count_if(F.col("a") & ~F.col("p")).alias("fn"))
    r = lambda a, b: F.round(F.try_divide(F.expr(a), F.expr(b)), 6)
    return c.select("tp", "tn", "fp", "fn", r("tp + tn", "tp + tn + fp + fn").alias("accuracy"), r("tp", "tp + fp").alias("precision_"), r("tp", "tp + fn").alias("recall"), r("2 * tp", "2 * tp + fp + fn").alias("f1"))


@query("a7_child_counts", "SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey AND n_nationkey > 20 GROUP BY 1")
def a7(spark, d):
    n = table(spark, d, "nation").where("n_nationkey > 20").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    return M.left_with(table(spark, d, "region").select("r_regionkey"), n, ["r_regionkey"], {"n": 0})


@query("a8_counters_global", "SELECT event_type, user_id % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY GROUPING SETS ((event_type, user_id % 10), (event_type), ())")
def a8(spark, d):
    e = table(spark, d, "events").withColumn("bucket", F.col("user_id") % 10)
    return e.groupingSets([["event_type", "bucket"], ["event_type"], []], "event_type", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("a9_rollup_average", "SELECT user_id, count(*) AS n, round(sum(value) / greatest(1, count(*)), 6) AS avg_value, grouping(user_id) AS is_total FROM events GROUP BY ROLLUP (user_id)")
def a9(spark, d):
    e = table(spark, d, "events")
    return e.rollup("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value") / F.greatest(F.lit(1), F.count("*")), 6).alias("avg_value"), F.grouping("user_id").cast("bigint").alias("is_total"))


@query("a10_distinct_hosts", r"SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ', ') AS hosts FROM orders GROUP BY 1")
def a10(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ", ").alias("hosts"))


_DATES = [(1, "2024-03-05"), (1, "05/02/2024"), (1, "bad"), (2, "Jan 15, 2024"), (2, None), (3, "20 March 2024"), (4, "n/a")]


@query("a11_first_scan_date", "SELECT * FROM (VALUES (1, DATE '2024-02-05'), (2, DATE '2024-01-15'), (3, DATE '2024-03-20'), (4, NULL)) AS t(id, first_scan)")
def a11(spark, d):
    x = spark.createDataFrame(_DATES, "id int, seen string")
    return x.groupBy("id").agg(F.min(loose_date(F.col("seen"))).alias("first_scan"))


#: Date layouts that are tried in turn.
DATE_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "dd.MM.yyyy", "MM/dd/yyyy", "yyyyMMdd"]


def loose_date(text):
    """The first layout that parses; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS])


@query("a12_mode_first", "SELECT source, lang AS top_lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS n FROM documents GROUP BY 1, 2) WHERE n = 1")
def a12(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return W.first_per(c, ["source"], [F.desc("n"), F.col("lang")]).select("source", F.col("lang").alias("top_lang"))


@query("a13_cost", "SELECT o_custkey, round(sum(o_totalprice) * 2.5 / 1000000, 3) AS cost FROM orders GROUP BY 1")
def a13(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice") * 2.5 / 1_000_000, 3).alias("cost"))


@query("a14_rates", "SELECT user_id, round(sum(value) / greatest(count(*), 1), 2) AS per_event, round(count(*) / greatest(sum(value), 0.1), 4) AS per_value FROM events GROUP BY 1")
def a14(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value") / F.greatest(F.count("*"), F.lit(1)), 2).alias("per_event"), F.round(F.count("*") / F.greatest(F.sum("value"), F.lit(0.1)), 4).alias("per_value"))


@query("a15_risk_summary", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'Accepted' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High' WHEN o_orderpriority = '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS risk, count(*) AS n FROM orders GROUP BY 1")
def a15(spark, d):
    p = F.col("o_orderpriority")
    risk = F.when(F.col("o_orderstatus") == "P", "Accepted").when(p.isin("1-URGENT", "2-HIGH"), "High").when(p == "3-MEDIUM", "Medium").otherwise("Low")
    return table(spark, d, "orders").groupBy(risk.alias("risk")).agg(F.count("*").alias("n"))


@query("a16_context_precision", "SELECT source, round(avg(CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'token') THEN 1.0 ELSE 0.0 END), 6) AS context_precision, max(CASE WHEN contains(text, 'MIT License') THEN 1 ELSE 0 END) AS recalled FROM documents GROUP BY 1")
def a16(spark, d):
    hit = F.exists(F.array(F.lit("license"), F.lit("token")), lambda k: F.contains(F.lower("text"), k))
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.avg(hit.cast("double")), 6).alias("context_precision"), F.max(F.contains(F.col("text"), F.lit("MIT License")).cast("int")).alias("recalled"))


@query("a17_requirement_coverage", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'A') AS supported, count(*) FILTER (WHERE l_returnflag = 'R') AS partial, count(*) FILTER (WHERE l_returnflag = 'N') AS not_supported FROM lineitem GROUP BY 1")
def a17(spark, d):
    f = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(f == "A").alias("supported"), F.count_if(f == "R").alias("partial"), F.count_if(f == "N").alias("not_supported"))


@query("a19_distinct_files", "SELECT DISTINCT source FROM documents WHERE text IS NOT NULL")
def a19(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("source").distinct()


@query("a20_wallet", "SELECT o_custkey, o_orderkey, round(greatest(0, 500000 - sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)), 2) AS balance FROM orders")
def a20(spark, d):
    x = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").alias("cost"))
    done = clamped_balance(x, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], F.col("cost"), F.lit(500000).cast("decimal(18,2)"), "balance")
    return done.select("o_custkey", "o_orderkey", F.col("balance").cast("double").alias("balance"))


#: Costs of events in whole numbers, those of small value being top-ups; the fold runs over all events of a type.
TOP_UPS_SQL = """
WITH s AS (SELECT event_type, event_id, sum(CAST(round(value * 100) AS BIGINT) - 5000) OVER w AS total FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
p AS (SELECT *, max(total) OVER (PARTITION BY event_type ORDER BY e.ts, e.event_id ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT s.*, events.ts FROM s JOIN events USING (event_id)) e)
SELECT event_id, CAST(20000 - total + greatest(0, peak - 20000) AS BIGINT) AS balance FROM p
"""


@query("a20_top_ups", TOP_UPS_SQL)
def a20b(spark, d):
    """A balance per event type that rises and falls: five keys hold all events."""
    cost = F.round(F.col("value") * 100).cast("long") - 5000
    x = table(spark, d, "events").select("event_type", "event_id", "ts", cost.alias("cost"))
    done = clamped_balance(x, "event_type", [F.col("ts"), F.col("event_id")], F.col("cost"), F.lit(20000).cast("long"), "balance")
    return done.select("event_id", "balance")


@query("a21_usage_log", "SELECT user_id, event_type, count(*) AS entries, round(sum(value), 4) AS used FROM events GROUP BY 1, 2")
def a21(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("entries"), F.round(F.sum("value"), 4).alias("used"))


@query("o1_newest_first", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def o1(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.lit(0).alias("all"))
    return running_sum(x, "all", [F.desc("o_orderdate"), F.col("o_orderkey")], F.lit(1), "place").drop("all")


@query("o2_page", "SELECT event_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'view') AS total, (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) FROM events WHERE event_type = 'view') AS total_pages FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def o2(spark, d):
    x = P.optional_filters(table(spark, d, "events"), event_type="view")
    total = x.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / 25))
    page = x.orderBy(F.desc("ts"), "event_id").offset(50).limit(25).select("event_id", "event_type")
    return page.join(F.broadcast(total), F.lit(True))


@query("o3_recent", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def o3(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id")


_RANK_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END"


def severity_rank(c):
    return F.when(c == "1-URGENT", 0).when(c == "2-HIGH", 1).when(c == "3-MEDIUM", 2).when(c == "4-NOT SPECIFIED", 3).otherwise(4)


@query("o4_severity_order", f"SELECT o_orderkey, {_RANK_SQL} AS severity, row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANK_SQL}, o_orderkey) AS place FROM orders")
def o4(spark, d):
    r = severity_rank(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", r.alias("severity"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(r, "o_orderkey")).cast("long").alias("place"))


@query("o5_detail_and_rest", "SELECT detail, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM (SELECT l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_shipdate, l_partkey, l_linenumber) <= 3 AS detail FROM lineitem) GROUP BY 1")
def o5(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_shipdate", "l_partkey", "l_linenumber")
    x = table(spark, d, "lineitem").select("l_extendedprice", (F.row_number().over(w) <= 3).alias("detail"))
    return x.groupBy("detail").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("o6_tool_then_severity", f"SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, {_RANK_SQL}, o_orderkey LIMIT 100")
def o6(spark, d):
    return table(spark, d, "orders").orderBy(F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), severity_rank(F.col("o_orderpriority")), "o_orderkey").limit(100).select("o_orderkey")


@query("o7_top_risk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 5")
def o7(spark, d):
    return table(spark, d, "orders").orderBy(F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("o9_latest_checkpoint", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1")
def o9(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("o10_running_first", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'click' THEN 0 ELSE 1 END, ts, event_id) AS place FROM events")
def o10(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.when(F.col("event_type") == "click", 0).otherwise(1), "ts", "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("o11_newest_sessions", "SELECT k, seen FROM (SELECT o_orderkey AS k, o_orderdate AS seen FROM orders UNION ALL SELECT event_id, ts FROM events) ORDER BY seen DESC, k LIMIT 12")
def o11(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("seen"))
    return a.unionByName(table(spark, d, "events").select(F.col("event_id").alias("k"), F.col("ts").alias("seen"))).orderBy(F.desc("seen"), "k").limit(12)


@query("w1_purge_old_sessions", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n > 5")
def w1(spark, d):
    return W.beyond(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 5).select("o_orderkey")


@query("w2_replace_keep_newest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 ORDER BY ts DESC, event_id DESC LIMIT 50")
def w2(spark, d):
    return W.replace_and_keep(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id")


@query("w3_first_occurrence", "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def w3(spark, d):
    return W.first_per(table(spark, d, "lineitem"), ["l_partkey"], [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("w4_token_budget", "SELECT doc_id FROM (SELECT doc_id, t, sum(t) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS r FROM (SELECT doc_id, source, length(text) // 4 AS t FROM documents)) WHERE r <= 8000 AND r - t < 5600")
def w4(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", T.token_estimate(F.col("text")).alias("tokens"))
    return W.budget(x, "source", [F.col("doc_id")], "tokens", F.lit(8000), F.lit(5600)).select("doc_id")


@query("w6_carry_header", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS header FROM events")
def w6(spark, d):
    x = table(spark, d, "events").withColumn("h", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return W.carry_forward(x, "user_id", "event_id", "h", "header").select("event_id", "header")


@query("w7_sliding_paragraphs", "SELECT conv_id, turn, string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS passage FROM conversations")
def w7(spark, d):
    return W.sliding(table(spark, d, "conversations"), "conv_id", "turn", "text", 3, "passage").select("conv_id", "turn", "passage")


@query("w10_normalise_by_best", "SELECT event_id, round(value / max(value) OVER (PARTITION BY event_type), 6) AS share FROM events")
def w10(spark, d):
    x = table(spark, d, "events")
    best = x.groupBy("event_type").agg(F.max("value").alias("best")).withColumnRenamed("event_type", "type")
    return x.join(best, F.col("event_type").eqNullSafe(F.col("type"))).select("event_id", F.round(F.col("value") / F.col("best"), 6).alias("share"))


@query("w11_attempts_in_span", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS attempts FROM events")
def w11(spark, d):
    # to the nearest second, halves to the even one, as the SQL's cast has it
    x = table(spark, d, "events").withColumn("s", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    return W.attempts_within(x, "user_id", F.col("s"), 3600, "attempts").select("event_id", "attempts")


@query("u1_union_findings", "SELECT o_orderkey, 'actionable' AS kind FROM orders WHERE o_orderpriority < '4' UNION ALL SELECT o_orderkey, 'info' FROM orders WHERE o_orderpriority >= '4'")
def u1(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderpriority < '4'").select("o_orderkey", F.lit("actionable").alias("kind")).unionByName(o.where("o_orderpriority >= '4'").select("o_orderkey", F.lit("info").alias("kind")))


@query("u2_ordered_file_union", "SELECT id, files FROM (VALUES (1, 'a, b, c, d'), (2, 'x')) AS t(id, files)")
def u2(spark, d):
    x = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c", "a"]), (1, 2, ["d", "b"]), (2, 0, ["x"]), (2, 1, [])], "id int, n int, files array<string>")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("n", "files"))), lambda r: r["files"])
    return x.groupBy("id").agg(F.array_join(F.array_distinct(F.flatten(lists)), ", ").alias("files"))


@query("u3_intersect_except", "SELECT l_partkey AS part, 'both' AS part_of FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT l_partkey, 'first' FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def u3(spark, d):
    x = table(spark, d, "lineitem")
    a, r = (x.where(F.col("l_returnflag") == k).select(F.col("l_partkey").alias("part")) for k in "AR")
    return a.intersect(r).withColumn("part_of", F.lit("both")).unionByName(a.subtract(r).withColumn("part_of", F.lit("first")))


@query("u4_missing_files", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def u4(spark, d):
    seen = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").subtract(seen)


@query("u5_synonyms", "SELECT keyword, syns FROM (VALUES ('access', 'access, entry, login'), ('backup', 'backup, recovery'), ('other', 'other')) AS t(keyword, syns)")
def u5(spark, d):
    words = spark.createDataFrame([("access",), ("backup",), ("other",)], "keyword string")
    more = spark.createDataFrame([("access", ["login", "entry"]), ("backup", ["recovery", "backup"])], "keyword string, more array<string>")
    out = F.array_sort(F.array_union(F.array("keyword"), F.coalesce("more", F.array().cast("array<string>"))))
    return words.join(F.broadcast(more), "keyword", "left").select("keyword", F.array_join(out, ", ").alias("syns"))


@query("u6_three_logs", "SELECT * FROM (SELECT 'order' AS log, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS at FROM orders ORDER BY o_orderkey DESC LIMIT 50) UNION ALL SELECT * FROM (SELECT 'event', event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') FROM events ORDER BY event_id DESC LIMIT 50) UNION ALL SELECT * FROM (SELECT 'document', doc_id, '' FROM documents ORDER BY doc_id DESC LIMIT 50)")
def u6(spark, d):
    def log(name, df, key, at):
        return df.orderBy(F.desc(key)).limit(50).select(F.lit(name).alias("log"), F.col(key).alias("id"), at.alias("at"))

    shown = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    both = log("order", table(spark, d, "orders"), "o_orderkey", shown("o_orderdate")).unionByName(log("event", table(spark, d, "events"), "event_id", shown("ts")))
    return both.unionByName(log("document", table(spark, d, "documents"), "doc_id", F.lit(""))).orderBy(F.desc("at"))


@query("u7_catalog_and_custom", "SELECT n_nationkey AS id, n_name AS name, false AS custom FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, true FROM region")
def u7(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(False).alias("custom"))
    return n.unionByName(table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"), F.lit(True).alias("custom")))
