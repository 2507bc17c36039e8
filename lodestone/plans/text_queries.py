"""Text, ranking and vector operators as queries over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import retrieval as R
from lodestone.operators import substrings as SUB
from lodestone.operators import windows as W
from lodestone.operators.staging import stage
from lodestone.plans.fixtures import Rows
from lodestone.plans.registry import query, table

TERMS = [("q1", "license", 2.0), ("q1", "public", 1.4), ("q1", "token", 1.0), ("q2", "thing", 1.0), ("q2", "than", 0.4), ("q2", "over", 2.6)]
_TERMS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in TERMS) + ") AS q(query, term, weight)"
_TOKENS = r"list_filter(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F]', 'Z', 'g'), '\b[a-zA-Z0-9_\-]{3,}\b'), lambda x: position('Z' IN x) = 0)"

BM25_SQL = f"""
WITH toks AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
flat AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM toks),
tf AS (SELECT doc_id, term, any_value(len) AS len, count(*) AS tf FROM flat GROUP BY 1, 2),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
idf AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term, n),
fixed AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf) ELSE idf END AS idf FROM idf)
SELECT query, doc_id AS chunk, round(sum(greatest(1, round_even(weight, 0)) * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS bm25
FROM tf JOIN fixed USING (term) JOIN {_TERMS_SQL} USING (term), stats GROUP BY 1, 2
"""


def _terms(spark):
    return spark.createDataFrame(TERMS, "query string, term string, weight double")


@query("r1_bm25", BM25_SQL)
def r1(spark, d):
    return R.bm25(table(spark, d, "documents"), _terms(spark), "doc_id").select("query", "chunk", F.round("bm25", 6).alias("bm25"))


@query("a18_corpus_stats", f"SELECT count(*) AS n, round(avg(len({_TOKENS})), 6) AS mean_length, CAST(sum(len({_TOKENS})) AS BIGINT) AS total FROM documents")
def a18(spark, d):
    n = F.size(T.ranking_tokens(F.col("text")))
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.sum(n.cast("long")).alias("total"))


@query("r2_term_counts", r"SELECT doc_id, len(regexp_extract_all(lower(text), '\blicense\b')) * 2.0::DOUBLE + len(regexp_extract_all(lower(text), '\btoken\b')) AS score FROM documents")
def r2(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", R.term_counts(x, [("license", 2.0), ("token", 1.0)]).alias("score"))


@query("r3_keyword_score", "SELECT doc_id, 3 * CAST(contains(lower(text), 'general public license') AS INT) + CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'token') AS INT) AS score, 3 * CAST(contains(lower(text), 'general public license') AS INT) + CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'token') AS INT) >= 3 AS in_scope FROM documents")
def r3(spark, d):
    x = F.lower("text")
    hit = lambda w: F.contains(x, F.lit(w)).cast("int")
    score = 3 * hit("general public license") + hit("license") + hit("token")
    return table(spark, d, "documents").select("doc_id", score.alias("score"), (score >= 3).alias("in_scope"))


_PROBES = "(SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id % 100 = 0)"
KNN_SQL = f"SELECT query, id, round(similarity, 5) AS similarity, rank FROM (SELECT query, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS similarity, row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings, {_PROBES}) WHERE rank <= 20"


@query("r5_nearest", KNN_SQL)
def r5(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return R.nearest(e, q, 20).select("query", "id", F.round("similarity", 5).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _hybrid(spark, d):
    """BM25 of the documents, with the cosine of the vector of the same number, where there is one, to vector 0."""
    scored = R.bm25(table(spark, d, "documents"), _terms(spark), "doc_id")
    e = table(spark, d, "embeddings")
    zero = e.where("vec_id = 0").select(F.lit("q1").alias("query"), F.col("embedding").alias("vector"))
    near = R.similarities(e, zero).withColumnRenamed("id", "chunk")
    # scores of the chunks that hold a term: read for the best, the mixture and the threshold
    return stage(R.hybrid(stage(scored.join(near, ["query", "chunk"], "left"), "scores"), "bm25", "similarity"), "hybrid")


@query(
    "r6_hybrid_retrieval",
    f"WITH b AS ({BM25_SQL.replace('round(sum(', '(sum(').replace(', 6) AS bm25', ') AS bm25')}), s AS (SELECT 'q1' AS query, vec_id AS chunk, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS sim FROM embeddings), "
    "h AS (SELECT query, chunk, CASE WHEN sim IS NULL THEN bm25 ELSE 0.4 * bm25 / max(bm25) OVER (PARTITION BY query) + 0.6 * greatest(0, sim) END AS hybrid FROM b LEFT JOIN s USING (query, chunk)), "
    "k AS (SELECT *, max(hybrid) OVER (PARTITION BY query) > 0.05 AS any_above, row_number() OVER (PARTITION BY query ORDER BY hybrid DESC, chunk) AS n FROM h) SELECT query, chunk, round(hybrid, 5) AS hybrid FROM k WHERE CASE WHEN any_above THEN hybrid > 0.05 ELSE n <= 20 END",
)
def r6(spark, d):
    return R.above_or_best(_hybrid(spark, d), "hybrid").select("query", "chunk", F.round("hybrid", 5).alias("hybrid"))


@query("f10_threshold_or_best", "SELECT event_id FROM (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n, max(value) OVER (PARTITION BY user_id) > 99.5 AS any_above FROM events) WHERE CASE WHEN any_above THEN value > 99.5 ELSE n <= 2 END")
def f10(spark, d):
    return R.above_or_best(table(spark, d, "events"), "value", 99.5, 2, "user_id", "event_id").select("event_id")


@query("r7_exact_dedup", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, trim(text, ' ') ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def r7(spark, d):
    return R.exact_dedup(table(spark, d, "documents"), "lang", F.col("text"), [F.col("doc_id")]).select("doc_id")


@query("r8_greedy_jaccard")
def r8(spark, d):
    """The 40 best candidates of each query, less those that repeat a better one."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), "text")
    best = W.first_per(_hybrid(spark, d), ["query"], [F.desc("hybrid"), F.col("chunk")], 40)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("hybrid"), "chunk")))
    return R.greedy_jaccard(ranked.join(docs, "chunk"), "query", "rank", "text").select("query", "rank", "chunk")


@query("r9_rerank_identity", "SELECT vec_id, round(0.3 * 0.5 + 0.7 * label / 10.0, 6) AS final FROM embeddings")
def r9(spark, d):
    e = table(spark, d, "embeddings").withColumn("hybrid", F.lit(0.5))
    return R.rerank(e, F.col("label") / 10.0).select("vec_id", F.round("final", 6).alias("final"))


@query("r12_roles", "SELECT doc_id, CASE WHEN source IN ('src1', 'src2') AND source IN ('src2', 'src3') THEN 'DUAL_ROLE_CONFLICT' WHEN source IN ('src1', 'src2') THEN 'POLICY' WHEN source IN ('src2', 'src3') THEN 'EVIDENCE' ELSE 'SHARED_CONTEXT' END AS role FROM documents")
def r12(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", R.roles(x, "source", ["src1", "src2"], ["src2", "src3"]).alias("role"))


@query("r13_context_budget", "SELECT doc_id FROM (SELECT doc_id, length(text) // 4 AS t, sum(length(text) // 4) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS r FROM documents) WHERE r <= 7192 AND r - t < 5034")
def r13(spark, d):
    return R.within_context(table(spark, d, "documents"), "lang", [F.col("doc_id")], "text", 8192, 1000).select("doc_id")


@query("r14_word_overlap", "SELECT doc_id, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'public') AS INT) + CAST(contains(lower(text), 'token') AS INT) AS hits FROM documents ORDER BY hits DESC, doc_id LIMIT 5")
def r14(spark, d):
    words = F.array(*[F.lit(w) for w in ("license", "public", "token")])
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower("text"), w)))
    return table(spark, d, "documents").select("doc_id", hits.alias("hits")).orderBy(F.desc("hits"), "doc_id").limit(5)


@query("t5_chunk_ids", "SELECT doc_id, substr(md5(source || '_' || doc_id || '_0_' || text), 1, 8) AS chunk_id FROM documents")
def t5(spark, d):
    return table(spark, d, "documents").select("doc_id", T.chunk_id(F.col("source"), F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_id"))


_SPACE = r"[ \t\n\x0b\f\r]+"


@query("t3_sentences", f"WITH p AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(text, '([.!?]){_SPACE}', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')) AS parts FROM documents), k AS (SELECT doc_id, text, list_filter(parts, lambda x: len(regexp_split_to_array(x, '{_SPACE}')) >= 4) AS kept FROM p), s AS (SELECT doc_id, CASE WHEN len(kept) > 0 THEN kept ELSE [text] END AS s FROM k) SELECT doc_id, unnest(range(len(s))) AS place, unnest(s) AS sentence FROM s")
def t3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))


@query("t4_paragraphs", r"WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS p FROM documents), q AS (SELECT doc_id, trim(p, chr(32)) AS p FROM p), l AS (SELECT doc_id, CASE WHEN length(p) > 800 THEN string_split(p, chr(10)) ELSE [p] END AS parts, length(p) > 800 AS cut FROM q WHERE len(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')) >= 8), x AS (SELECT doc_id, cut, unnest(parts) AS part FROM l) SELECT doc_id, count(*) AS n, CAST(sum(length(trim(part, chr(32)))) AS BIGINT) AS chars FROM x WHERE NOT cut OR len(list_filter(regexp_split_to_array(part, '\s+'), lambda w: w <> '')) >= 4 GROUP BY 1")
def t4(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.explode(T.paragraphs(F.col("text"))).alias("p"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("p").cast("long")).alias("chars"))


@query("t7_strip_markup", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<head\b.*?</head\s*>', ' ', 'gis'), '<meta\b[^>]*>', ' ', 'gis'), '<[^>]+>', ' ', 'gs'), '\s+', ' ', 'g'))) AS text_sha256 FROM pages")
def t7(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.strip_markup(F.col("html")), 256).alias("text_sha256"))


@query("t10_normalisers", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS bare FROM documents")
def t10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.alphanumeric(F.col("text"))).alias("bare"))


QUOTES = Rows("q", "id int, quote string, document string", [(1, "Backups are enabled", "all backups ARE enabled. yes"), (2, "\"Backups are enabled\"", "backups are enabled"), (3, "NOT_FOUND", "NOT_FOUND"), (4, None, "x"), (5, "nothing here", "other text"), (6, "   ", "abc")])


@query("t11_grounding", "SELECT * FROM (VALUES (1, 'GROUNDED'), (2, 'GROUNDED'), (3, 'NOT_GROUNDED'), (4, 'NOT_GROUNDED'), (5, 'NOT_GROUNDED'), (6, 'NOT_GROUNDED')) AS t(id, grounding)")
def t11(spark, d):
    return QUOTES.df(spark).select("id", T.grounded(F.col("quote"), F.col("document")).alias("grounding"))


GRADED = Rows("g", "id int, quote string, chunk string, document string", [(1, "access is  reviewed", "Access is reviewed monthly", "x"), (2, "logs are kept", "y", "The logs are\nkept for a year"), (3, "keys—rotated (yearly)", "y", "Keys: rotated yearly"), (4, "the admin account is reviewed by the board each year", "y", "The admin account is reviewed by the auditors"), (5, "nothing of this kind at all here", "y", "z"), (6, "", "y", "z")])


@query("t12_graded_grounding", "SELECT * FROM (VALUES (1, 'CHUNK'), (2, 'DOCUMENT'), (3, 'ALPHANUMERIC'), (4, 'PREFIX'), (5, 'NOT_GROUNDED'), (6, 'EMPTY')) AS t(id, grade)")
def t12(spark, d):
    return GRADED.df(spark).select("id", T.graded_grounding(F.col("quote"), F.col("chunk"), F.col("document")).alias("grade"))


@query("t13_hint_containment", "SELECT item_id, count(doc_id) AS leaks FROM benchmark LEFT JOIN documents ON contains(lower(documents.text), lower(benchmark.text)) GROUP BY 1")
def t13(spark, d):
    """Whole benchmark passages inside documents, of any length and with any borders."""
    b = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("passage"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    hits = SUB.contained(docs, "doc_id", "t", b, "item_id", "passage").withColumnRenamed("needle", "item_id")
    return b.select("item_id").join(hits, "item_id", "left").groupBy("item_id").agg(F.count("id").alias("leaks"))


CLAIMS = Rows("k", "id int, reasoning string, document string", [(1, "The system keeps daily logs for a year. Nobody ever mentioned quantum llamas here.", "Our system keeps daily logs for a year in storage."), (2, "Short one.", "x")])


@query("t14_unsupported_claims", "SELECT * FROM (VALUES (1, 1), (2, 0)) AS t(id, n)")
def t14(spark, d):
    return CLAIMS.df(spark).select("id", F.size(T.unsupported_claims(F.col("reasoning"), F.col("document"))).alias("n"))


@query("t16_keyword_generator", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))), '|') AS keywords FROM (SELECT p_partkey, string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM part)")
def t16(spark, d):
    w = F.split(T.alphanumeric(F.col("p_name")), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.concat(w, T.ngrams(w, 2)))), "|").alias("keywords"))


@query("t17_staleness", "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{p}')" for p in T.STALE) + " AS stale FROM documents")
def t17(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stale(F.col("text")).alias("stale"))


@query("t19_unsafe_text", r"SELECT doc_id, (length(text) > 5000 OR regexp_matches(text, '<[^>]+>') OR regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS unsafe FROM documents")
def t19(spark, d):
    return table(spark, d, "documents").select("doc_id", T.unsafe(F.col("text")).alias("unsafe"))


@query("t20_token_estimate", "SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def t20(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query("t21_control_ids", "SELECT * FROM (VALUES (1, 'VAPT-3|5.15'), (2, '8.2.1'), (3, '')) AS t(id, ids)")
def t21(spark, d):
    x = Rows("x", "id int, cell string", [(1, "vapt-3 and 5.15, VAPT-3"), (2, "see 8.2.1"), (3, "none")])
    return x.df(spark).select("id", F.array_join(T.control_ids(F.col("cell")), "|").alias("ids"))


@query("t22_citations", "SELECT * FROM (VALUES (1, 'a.pdf|b c.xlsx'), (2, ''), (3, 'notes.txt')) AS t(id, files)")
def t22(spark, d):
    x = Rows("x", "id int, cell string", [(1, "[POL] a.pdf; b c.xlsx"), (2, "see the annex"), (3, "free text\nnotes.txt [1]")])
    return x.df(spark).select("id", F.array_join(T.citations(F.col("cell")), "|").alias("files"))


@query("t23_duration_text", "SELECT * FROM (VALUES (1, '1h 2m 3.4s'), (2, '59.9s'), (3, '2m 0.0s'), (4, '1h 0m 1.0s')) AS t(id, took)")
def t23(spark, d):
    x = Rows("x", "id int, s double", [(1, 3723.4), (2, 59.9), (3, 120.0), (4, 3601.0)])
    return x.df(spark).select("id", T.duration_text(F.col("s")).alias("took"))


@query("t25_term_overlap", "SELECT doc_id, round((CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'public') AS INT) + CAST(contains(lower(text), 'general') AS INT)) / 3.0, 6) AS overlap FROM documents")
def t25(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.term_overlap(F.array(F.lit("license"), F.lit("public"), F.lit("general")), F.col("text")), 6).alias("overlap"))


@query("t27_injection_phrases", "SELECT doc_id, (contains(lower(text), 'system prompt') OR contains(lower(text), 'ignore previous instructions') OR contains(lower(text), 'ignore all previous') OR contains(lower(text), 'you are now') OR contains(lower(text), 'disregard the above') OR contains(lower(text), 'act as') OR contains(lower(text), 'override instructions')) AS suspicious FROM documents")
def t27(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.size(T.injection_phrases(F.col("text"))) > 0).alias("suspicious"))


@query("t28_weighted_keywords", "SELECT p_brand, word, max(weight) AS weight FROM (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS word, 1.0::DOUBLE AS weight FROM part UNION ALL SELECT p_brand, lower(p_brand), 2.0 FROM part UNION ALL SELECT p_brand, unnest(string_split(lower(p_type), ' ')), 1.5 FROM part) GROUP BY 1, 2")
def t28(spark, d):
    p = table(spark, d, "part")
    parts = [(F.split(F.lower("p_name"), " "), 1.0), (F.array(F.lower("p_brand")), 2.0), (F.split(F.lower("p_type"), " "), 1.5)]

    def weighted(words, weight):
        return F.transform(words, lambda x: F.struct(x.alias("word"), F.lit(weight).alias("weight")))

    words = F.flatten(F.array(*[weighted(a, w) for a, w in parts]))
    x = p.select("p_brand", F.explode(words).alias("w"))
    return x.groupBy("p_brand", F.col("w.word").alias("word")).agg(F.max("w.weight").alias("weight"))


@query("s6_row_windows", "WITH x AS (SELECT source, text AS line, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents), e AS (SELECT source, max(n) AS last FROM x GROUP BY 1), w AS (SELECT e.source, last, unnest(range(0, last // 12 + 1)) AS win FROM e) SELECT w.source, win AS window, md5(string_agg(line, chr(10) ORDER BY n)) AS content_md5 FROM w JOIN x ON w.source = x.source AND n BETWEEN win * 12 AND win * 12 + 14 WHERE win = 0 OR (win - 1) * 12 + 14 < last GROUP BY 1, 2")
def s6(spark, d):
    """Row windows of a CSV: 15 rows, 3 of them shared with the next window."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    x = table(spark, d, "documents").select("source", F.col("text").alias("line"), n.alias("n"))
    return W.row_windows(x, "source", "n", 15, 3, "line", "content").withColumn("content_md5", F.md5("content")).drop("content")


@query("t1_char_chunks")
def t1(spark, d):
    return W.chunk_documents(table(spark, d, "documents"), "doc_id", "text")


@query("t2_paragraph_chunks")
def t2(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return W.chunk_paragraphs(x, "doc_id", "lines")
