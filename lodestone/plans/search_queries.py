"""Searches that need an index: approximate neighbours, many patterns at once, citations among many names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import matching as M
from lodestone.operators import patterns as A
from lodestone.operators import retrieval as R
from lodestone.operators import vector_index as X
from lodestone.operators.fuzzy import grounded_quotes
from lodestone.operators.replicas import Replica
from lodestone.plans.reader_queries import S11_SQL
from lodestone.plans.registry import query, table
from lodestone.sources.readers import read_any
from lodestone.streaming.counters import new_folder

#: Neighbours of a query, and candidates whose exact similarity is worked out.
K, REFINED = 20, 40


def _searched(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    index = X.VectorIndex(spark, new_folder(spark, "index"), X.fit(e, "vec_id", "embedding", k=K))
    index.add(e, "vec_id", "embedding")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return index.search(asked, e, "vec_id", "embedding", K, refine=REFINED), e, asked


@query("o8_vector_index")
def o8(spark, d):
    """The neighbours of every hundredth vector among all, by an index of all."""
    return _searched(spark, d)[0].select("query", "id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("o8_index_recall")
def o8b(spark, d):
    """For every hundredth vector, which part of its exact neighbours the index finds."""
    found, e, asked = _searched(spark, d)
    return X.recall(found, R.nearest(e, asked, K))


def _keywords(spark, d):
    """The distinct words of all part names, customer segments and benchmark passages, in lower case."""
    words = lambda t, c: table(spark, d, t).select(F.explode(F.split(F.lower(c), r"[^\p{L}\p{N}]+")).alias("keyword"))
    return words("part", "p_name").unionByName(words("customer", "c_mktsegment")).unionByName(words("benchmark", "text")).where(F.char_length("keyword") >= 4).distinct()


_KEYWORDS_SQL = r"k AS (SELECT DISTINCT keyword FROM (SELECT unnest(regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+')) AS keyword FROM (SELECT p_name AS x FROM part UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT text FROM benchmark)) WHERE length(keyword) >= 4)"


@query("f15_many_keywords", f"WITH {_KEYWORDS_SQL} SELECT keyword, count(doc_id) AS documents FROM k JOIN documents ON contains(lower(text), keyword) GROUP BY keyword")
def f15(spark, d):
    """In how many documents each of some thousand keywords occurs, in one pass over the texts."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    hits = A.occurrences(docs, "doc_id", "t", _keywords(spark, d), "keyword", distinct=True)
    return hits.groupBy(F.col("pattern").alias("keyword")).agg(F.count("*").alias("documents"))


@query("v9_longest_spans")
def v9(spark, d):
    """Of all places of the keywords in a document, those a reader from the left takes: how many, and how many characters they cover."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    kept = A.longest_spans(docs, "doc_id", "t", _keywords(spark, d), "keyword")
    return kept.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("covered"))


@query("v9_priority_spans")
def v9b(spark, d):
    """The same places where shorter keywords are rules of higher priority."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    rules = _keywords(spark, d).withColumn("priority", F.struct(F.char_length("keyword").alias("length"), "keyword"))
    kept = A.priority_spans(docs, "doc_id", "t", rules, "keyword", "priority")
    return kept.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("covered"))


@query(
    "j15_name_citations",
    "WITH c AS (SELECT DISTINCT p_brand AS cited FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size = 1), n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_brand || ' ' || p_name FROM part) "
    "SELECT cited, name FROM (SELECT cited, name, row_number() OVER (PARTITION BY cited ORDER BY lower(cited) = lower(name) DESC, length(name) DESC, name) AS i FROM c JOIN n ON contains(lower(cited), lower(name)) OR contains(lower(name), lower(cited)) WHERE cited <> '') WHERE i = 1",
)
def j15(spark, d):
    """Brands, first words and names of parts as citations; the names, with and without their brand, as the upload list."""
    p = table(spark, d, "part")
    cited = p.select(F.col("p_brand").alias("cited")).unionByName(p.select(F.get(F.split("p_name", " "), F.lit(0)).alias("cited"))).unionByName(p.where("p_size = 1").select(F.col("p_name").alias("cited")))
    names = p.select(F.col("p_name").alias("name")).unionByName(p.select(F.concat_ws(" ", "p_brand", "p_name").alias("name")))
    return M.containment(cited, "cited", names, "name").select("cited", "name")


#: What becomes of the orders: prices of some change, some go, some are new.
CHANGED_SQL = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 1500 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3000 <> 11
UNION ALL SELECT -o_orderkey, o_custkey, NULL FROM orders WHERE o_orderkey % 5000 = 3
"""


@query("s20_replica_difference", CHANGED_SQL)
def s20(spark, d):
    """A replica of all orders after changes in some ranges, which alone are written again."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    copy = Replica(spark, new_folder(spark, "replica"))
    copy.sync(o, "o_orderkey")
    price = F.when(F.col("o_orderkey") % 1500 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = o.where("o_orderkey % 5000 = 3").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit(None).cast("double").alias("o_totalprice"))
    copy.sync(o.where("o_orderkey % 3000 <> 11").withColumn("o_totalprice", price).unionByName(new), "o_orderkey")
    return copy.read()


@query("t24_fuzzy_passages")
def t24(spark, d):
    """Benchmark passages with typing errors, a letter in every nineteen: in how many whole documents they stand, and the best ratio."""
    quotes = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"(?s)(.{18}).", "$1#").alias("quote"))
    found = grounded_quotes(table(spark, d, "documents"), "doc_id", "text", quotes, "item_id", "quote")
    return found.groupBy(F.col("quote").alias("item_id")).agg(F.count("*").alias("documents"), F.round(F.max("ratio"), 6).alias("ratio"))


#: Records of five kinds of files: lines of documents, blocks of pages, suppliers as CSV, JSON and XML.
DISPATCH_SQL = f"""
WITH {S11_SQL.strip().removeprefix("WITH ").replace(")\nSELECT id, place, coalesce(", "),\nh AS (SELECT id, place, coalesce(", 1).rstrip()}),
l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT 'text' AS kind, count(*) AS records, CAST(sum(length(line)) AS BIGINT) AS chars FROM l WHERE trim(line, ' ') <> ''
UNION ALL SELECT 'html', count(*), CAST(sum(length(paragraph)) AS BIGINT) FROM h
UNION ALL SELECT kind, count(*), CAST(sum(length(s_name)) AS BIGINT) FROM supplier, (VALUES ('csv'), ('json'), ('xml')) AS k(kind) GROUP BY kind
"""


#: Rows of a file of ``s1_dispatch``; a task reads some files whole.
FILE_ROWS = 500


@query("s1_dispatch", DISPATCH_SQL)
def s1(spark, d):
    """Documents, pages and suppliers written as files of five kinds under one folder, and read in one scan by their content."""
    home = new_folder(spark, "files")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("value")).where("value IS NOT NULL")
    # a file begins with a heading, as its first lines decide its kind and documents are of any
    parts = max(1, -(-docs.count() // FILE_ROWS))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    heads = spark.range(parts).select(F.col("id").alias("part"), F.lit(0).alias("n"), F.lit("Documents of one part").alias("value"))
    lines = heads.unionByName(docs.select(part.alias("part"), F.lit(1).alias("n"), "value"))
    lines.repartition("part").sortWithinPartitions("part", "n").drop("n").write.partitionBy("part").text(f"{home}/a")
    page = F.concat(F.lit("<!DOCTYPE html>"), F.replace("html", F.lit("\n"), F.lit(" ")))
    table(spark, d, "pages").select(page.alias("html")).write.option("maxRecordsPerFile", FILE_ROWS).text(f"{home}/b")
    s = table(spark, d, "supplier")
    s.write.option("maxRecordsPerFile", FILE_ROWS).option("header", "true").csv(f"{home}/c")
    s.write.option("maxRecordsPerFile", FILE_ROWS).json(f"{home}/d")
    s.write.option("maxRecordsPerFile", FILE_ROWS).format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(f"{home}/e")
    rows = read_any(spark, home).where("error IS NULL AND NOT (kind = 'text' AND place = 0)")
    shown = F.when(F.col("kind").isin("csv", "json", "xml"), F.col("fields")["s_name"]).otherwise(F.col("text"))
    return rows.groupBy("kind").agg(F.count("*").alias("records"), F.sum(F.char_length(shown)).alias("chars"))
