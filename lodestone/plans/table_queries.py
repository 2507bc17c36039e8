"""Rules and text operators over whole tables, beside the literal rows that hold their rare words."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as T
from lodestone.operators import substrings as SUB
from lodestone.plans.fixtures import case_sql
from lodestone.plans.registry import query, table

_TEXT = "lower(text)"


@query("c1_order_severity", "SELECT o_orderkey, CASE WHEN contains(upper(o_orderpriority), 'CRIT') THEN 'CRITICAL' WHEN contains(upper(o_orderpriority), 'HIGH') THEN 'HIGH' WHEN contains(upper(o_orderpriority), 'MED') THEN 'MEDIUM' WHEN contains(upper(o_orderpriority), 'LOW') THEN 'LOW' ELSE 'INFO' END AS severity FROM orders")
def c1(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.severity(F.col("o_orderpriority")).alias("severity"))


@query("c5_document_control", f"SELECT doc_id, {case_sql(_TEXT, R.CONTROLS, R.CONTROL_DEFAULT)} AS control FROM documents")
def c5(spark, d):
    return table(spark, d, "documents").select("doc_id", R.control(F.col("text")).alias("control"))


@query("c6_document_crypto_control", f"SELECT doc_id, {case_sql(_TEXT, R.CRYPTO_CONTROLS, R.CRYPTO_CONTROL_DEFAULT)} AS control FROM documents")
def c6(spark, d):
    return table(spark, d, "documents").select("doc_id", R.crypto_control(F.col("text")).alias("control"))


@query("c8_document_impact", f"SELECT doc_id, {case_sql(_TEXT, R.INTEGRITY, 'NONE')} AS integrity, {case_sql(_TEXT, R.AVAILABILITY, 'NONE')} AS availability FROM documents")
def c8(spark, d):
    x = R.joined(F.col("text"))
    return table(spark, d, "documents").select("doc_id", R.classify(x, R.INTEGRITY, "NONE").alias("integrity"), R.classify(x, R.AVAILABILITY, "NONE").alias("availability"))


@query("c10_document_priority", f"SELECT doc_id, {case_sql(_TEXT, R.PRIORITIES, '')} AS priority FROM documents")
def c10(spark, d):
    return table(spark, d, "documents").select("doc_id", R.business_priority(F.col("text")).alias("priority"))


@query("c26_event_bands", "SELECT event_id, CASE WHEN value / 10 >= 9 THEN 'CRITICAL' WHEN value / 10 >= 7 THEN 'HIGH' WHEN value / 10 >= 4 THEN 'MEDIUM' WHEN value > 0 THEN 'LOW' ELSE 'INFO' END AS band FROM events")
def c26(spark, d):
    return table(spark, d, "events").select("event_id", R.score_band(F.col("value") / 10).alias("band"))


@query("t11_passages_grounded", "SELECT item_id, count(doc_id) AS documents FROM benchmark b LEFT JOIN documents d ON contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(substr(trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')), 1, 50))) GROUP BY 1")
def t11(spark, d):
    """The first fifty characters of each benchmark passage in whole documents."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    quotes = table(spark, d, "benchmark").select("item_id", F.trim(F.substring(clean("text"), 1, 50)).alias("quote"))
    docs = table(spark, d, "documents").select("doc_id", clean("text").alias("t"))
    hits = SUB.contained(docs, "doc_id", "t", quotes, "item_id", "quote").withColumnRenamed("needle", "item_id")
    return quotes.select("item_id").join(hits, "item_id", "left").groupBy("item_id").agg(F.count("id").alias("documents"))


@query("t21_document_ids", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\bVAPT-\d+\b|\b\d+\.\d+(?:\.\d+)?\b'), lambda x: upper(x)))), '|') AS ids FROM documents")
def t21(spark, d):
    ids = F.array_sort(F.array_distinct(F.transform(T.control_ids(F.col("text")), F.upper)))
    return table(spark, d, "documents").select("doc_id", F.array_join(ids, "|").alias("ids"))
