"""Readers, database scans, schema statements, headings, leaks and downgrades as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import context as K
from lodestone.operators import leaks as L
from lodestone.operators.staging import stage
from lodestone.plans.fixtures import Rows
from lodestone.plans.registry import query, table
from lodestone.plans.rule_queries import CONTENT, content_class
from lodestone.sources import files as S
from lodestone.sources import scanners as X
from lodestone.streaming import counters as C


@query("s8_text_files", "SELECT lang, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY 1")
def s8(spark, d):
    """Texts written as log files of a hundred documents, and read back whole."""
    home = C.new_folder(spark, "logs")
    table(spark, d, "documents").select("lang", "text").write.partitionBy("lang").option("maxRecordsPerFile", 100).text(home)
    # a lower-case name of the folder says which language a file has
    files = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\x00").text(home, wholetext=True)
    lang = F.regexp_extract("_metadata.file_path", "lang=([^/]*)/", 1)
    breaks = F.char_length("value") - F.char_length(F.translate("value", "\n", ""))
    return files.select(lang.alias("lang"), breaks.alias("b"), F.char_length("value").alias("c")).groupBy("lang").agg(F.sum(F.col("b").cast("long")).alias("n_lines"), F.sum(F.col("c").cast("long")).alias("n_chars"))


@query("s8_grepable_export", "SELECT 'host' || s_suppkey || ' (10.0.0.' || s_suppkey || ')' AS target, CAST(443 + s_nationkey AS VARCHAR) || '/tcp' AS port, 'open' AS state FROM supplier")
def s8b(spark, d):
    """One-line-a-host scanner output made from the suppliers."""
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("Host: 10.0.0."), key, F.lit(" (host"), key, F.lit(")\tPorts: "), (F.col("s_nationkey") + 443).cast("string"), F.lit("/open/tcp//https//nginx/\tIgnored State: closed (99)"))
    return X.nmap_grepable(s.select(F.lit("scan.gnmap").alias("file"), line.alias("content"))).select("target", "port", "state")


@query("s9_xml_lines", """
WITH c AS (SELECT c_custkey, 'customer [key="' || c_custkey || '"]' AS a, '  name: ' || c_name AS b, '  account [currency="USD"]: ' || CAST(c_nationkey AS VARCHAR) AS e FROM customer)
SELECT c_custkey, unnest([0, 1, 2]) AS place, unnest([a, b, e]) AS line FROM c""")
def s9(spark, d):
    """Customers as XML documents, read as lines."""
    c = table(spark, d, "customer")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    xml = F.concat(F.lit('<list xmlns="urn:x"><customer key="'), key, F.lit('"><name> '), F.col("c_name"), F.lit(' </name><empty/><account currency="USD">'), nation, F.lit("</account></customer></list>"))
    return c.select("c_custkey", F.posexplode(S.xml_lines(xml)).alias("place", "line"))


S11_SQL = r"""
WITH m AS (SELECT page_id AS id, regexp_replace(regexp_replace(html, '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<svg\b.*?</svg\s*>', ' ', 'gis'),
                  '<(/?)(h[1-6]|p|div|tr|li|pre|code)\b[^>]*>', chr(1) || '\1\2' || chr(2), 'gi') AS x FROM pages),
p AS (SELECT id, unnest(range(len(string_split(x, chr(1))))) AS place, unnest(string_split(x, chr(1))) AS piece FROM m),
t AS (SELECT id, place, CASE WHEN contains(piece, chr(2)) THEN lower(string_split(piece, chr(2))[1]) ELSE '' END AS tag,
             trim(regexp_replace(regexp_replace(CASE WHEN contains(piece, chr(2)) THEN substr(piece, strpos(piece, chr(2)) + 1) ELSE piece END, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS paragraph FROM p),
r AS (SELECT * FROM t WHERE paragraph <> '' AND (regexp_full_match(tag, 'h[1-6]') OR tag IN ('pre', 'code') OR len(string_split(paragraph, ' ')) >= 3))
SELECT id, place, coalesce(last_value(CASE WHEN regexp_full_match(tag, 'h[1-6]') THEN paragraph END IGNORE NULLS) OVER (PARTITION BY id ORDER BY place), 'HTML Content') AS section, paragraph FROM r
"""


@query("s11_html_paragraphs", S11_SQL)
def s11(spark, d):
    return S.html_paragraphs(table(spark, d, "pages"), "page_id", "html")


@query("s15_database_scan", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def s15(spark, d):
    """Customers in a relational database that is a set of SQLite files, one for each range of the key, in the shared folder; each file applies the filter."""
    files = stage(S.database_files(table(spark, d, "customer"), "customers", "c_custkey"), "database")
    return S.scan_databases(files, "SELECT c_custkey, c_name FROM customers WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'", "c_custkey bigint, c_name string")


#: The tables of findings and of chat messages (fixed values).
SCHEMA = {
    "findings": "id BIGINT, use_case_sl INT, use_case_name VARCHAR(300), severity VARCHAR(50), control VARCHAR(200), finding STRING, recommendation STRING, status VARCHAR(50) DEFAULT 'Open', comment STRING DEFAULT '', source_files STRING DEFAULT 'All uploaded documents', created_at TIMESTAMP",
    "messages": "id BIGINT, session_id VARCHAR(100), session_title VARCHAR(300), role VARCHAR(50), content STRING, created_at TIMESTAMP",
}


@query("s22_schema", "SELECT * FROM (VALUES ('findings', 1, 'Open', 'All uploaded documents'), ('findings', 2, 'Closed', 'a.pdf'), ('messages', 7, 'user', 'hello')) AS t(name, id, a, b)")
def s22(spark, d):
    """Tables made twice (the second time changes nothing), and rows that take their defaults."""
    mark = uuid.uuid4().hex
    tables = {f"{name}_{mark}": columns for name, columns in SCHEMA.items()}
    for _ in range(2):
        S.create_tables(spark, tables)
    spark.sql(f"INSERT INTO findings_{mark} (id, severity) VALUES (1, 'HIGH')")
    spark.sql(f"INSERT INTO findings_{mark} (id, status, source_files) VALUES (2, 'Closed', 'a.pdf')")
    spark.sql(f"INSERT INTO messages_{mark} (id, role, content) VALUES (7, 'user', 'hello')")
    f, m = spark.table(f"findings_{mark}"), spark.table(f"messages_{mark}")
    rows = f.select(F.lit("findings").alias("name"), "id", F.col("status").alias("a"), F.col("source_files").alias("b")).unionByName(m.select(F.lit("messages").alias("name"), "id", F.col("role").alias("a"), F.col("content").alias("b")))
    # three rows, so that the tables can go
    shown = spark.createDataFrame(rows.collect(), rows.schema)
    for name in tables:
        spark.sql(f"DROP TABLE {name}")
    return shown


HEADINGS = Rows(
    "h",
    "id int, content string, mark string",
    [
        (1, "Other block\n\nBanking App - External\n  Firewall Setup \n-----\nCertificate : RSA2048", "RSA2048"),
        (2, "Gateway\nHost: a.example\nCipher RSA2048", "RSA2048"),
        (3, "RSA2048 first", "RSA2048"),
        (4, "Title\n\n# comment\nplain RSA2048", "RSA2048"),
        (5, "One\nTwo\nThree RSA2048", "RSA2048"),
    ],
)


@query("v17_block_heading", "SELECT * FROM (VALUES (1, 'Banking App - External Firewall Setup'), (2, 'Gateway'), (3, ''), (4, ''), (5, 'One Two Three')) AS t(id, heading)")
def v17(spark, d):
    return HEADINGS.df(spark).select("id", K.block_heading(F.col("content"), F.position("mark", "content") - 1).alias("heading"))


@query("v17_document_headings", r"SELECT doc_id, CASE WHEN NOT contains(text, chr(10)) OR regexp_matches(string_split(text, chr(10))[1], '[:=]|^\s*(#|//|;|--|/\*|\*/|http|server|\{|\}|[-_=]{3,}\s*$)') THEN '' ELSE trim(string_split(text, chr(10))[1], ' ') END AS heading FROM documents")
def v17b(spark, d):
    """The heading of the first block of each document: its first line, seen from the start of the second; none without a second."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", K.block_heading(F.col("text"), F.position(F.lit("\n"), F.col("text"))).alias("heading"))


GROUNDED = Rows("g", "id int, status string, quote string, grounding string, note string", [(1, "COMPLIANT", "q", "NOT_GROUNDED", None), (2, "Partially_Compliant", "q", "NOT_GROUNDED", None), (3, "NON_COMPLIANT", "q", "NOT_GROUNDED", "n"), (4, "COMPLIANT", "q", "GROUNDED_WITH_OCR_WARNING", "old note"), (5, "COMPLIANT", "q", "GROUNDED_WITH_OCR_WARNING", None), (6, "COMPLIANT", "q", "GROUNDED", "n"), (7, None, None, "NOT_GROUNDED", None)])
OCR_NOTE = "Potential OCR distortion: verify the spelling in the source."


@query("c29_post_grounding", f"SELECT id, CASE WHEN grounding = 'NOT_GROUNDED' THEN 'NON_COMPLIANT' ELSE status END AS status, coalesce(grounding = 'GROUNDED_WITH_OCR_WARNING' OR (grounding = 'NOT_GROUNDED' AND upper(coalesce(status, '')) IN ('COMPLIANT', 'PARTIAL', 'PARTIALLY_COMPLIANT')), false) AS review, CASE WHEN grounding = 'NOT_GROUNDED' AND upper(coalesce(status, '')) NOT IN ('COMPLIANT', 'PARTIAL', 'PARTIALLY_COMPLIANT') THEN 'NOT_FOUND' ELSE quote END AS quote, CASE WHEN grounding = 'GROUNDED_WITH_OCR_WARNING' THEN concat_ws(' ', note, '{OCR_NOTE}') ELSE note END AS note FROM {GROUNDED.sql}")
def c29(spark, d):
    """Claims without ground are downgraded and reviewed; other findings without ground lose their quote; near matches are reviewed."""
    g = GROUNDED.df(spark)
    claim = F.upper(F.coalesce("status", F.lit(""))).isin("COMPLIANT", "PARTIAL", "PARTIALLY_COMPLIANT")
    lost, near = F.col("grounding") == "NOT_GROUNDED", F.col("grounding") == "GROUNDED_WITH_OCR_WARNING"
    return g.select(
        "id",
        F.when(lost, "NON_COMPLIANT").otherwise(F.col("status")).alias("status"),
        F.coalesce(near | (lost & claim), F.lit(False)).alias("review"),
        F.when(lost & ~claim, "NOT_FOUND").otherwise(F.col("quote")).alias("quote"),
        F.when(near & ~F.contains(F.coalesce("note", F.lit("")), F.lit(OCR_NOTE)), F.concat_ws(" ", "note", F.lit(OCR_NOTE))).otherwise(F.col("note")).alias("note"),
    )


@query("c33_three_way_class", "SELECT * FROM (VALUES (1, 'POLICY'), (2, 'OPERATIONAL'), (3, 'OPERATIONAL'), (4, 'OPERATIONAL'), (5, 'UNKNOWN'), (6, 'OPERATIONAL'), (7, 'UNKNOWN'), (8, 'OPERATIONAL'), (9, 'OPERATIONAL'), (10, 'UNKNOWN')) AS t(id, class)")
def c33(spark, d):
    kind, _ = content_class(F.col("content"), F.col("file"))
    three = F.when(kind.isin("POLICY", "PROCEDURE", "STANDARD"), "POLICY").when(kind == "UNKNOWN", "UNKNOWN").otherwise("OPERATIONAL")
    return CONTENT.df(spark).select("id", three.alias("class"))


@query("t13_prompt_leaks")
def t13(spark, d):
    """Lines of all documents as evidence, benchmark passages as hints."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return L.prompt_leaks(lines, table(spark, d, "benchmark"), ["doc_id", "place"], "line", "item_id", "text")
