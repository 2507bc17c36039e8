"""Retrieval over chunks for many queries at once: BM25, vectors, the hybrid of both, deduplication, context budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators.staging import stage
from lodestone.operators.windows import budget, first_per

#: BM25 parameters (k1, b) and the share of the mean idf that replaces negative ones.
K1, B, EPSILON = 1.5, 0.75, 0.25


def bm25(chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(query, chunk, bm25) of the chunks that hold a term of the query; queries are (query, term, weight).

    A term counts max(1, round(weight)) times. Only postings of query terms are
    moved; corpus statistics are one row, and the terms' counts a stored table. Negative idfs become EPSILON times
    the mean idf of all terms.
    """
    tokens = chunks.select(F.col(id_col).alias("chunk"), F.coalesce(T.ranking_tokens(F.col(text_col)), F.array().cast("array<string>")).alias("tokens"))
    # in how many chunks each term is; the row without a term has the number of chunks and of tokens. Terms are counted before anything moves
    one = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("n")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("tokens").alias("n")))
    counted = stage(tokens.select(F.explode(F.concat(one, whole)).alias("t")).groupBy("t.term").agg(F.count("*").alias("df"), F.sum("t.n").alias("total")), "terms")
    stats = counted.where("term IS NULL").select(F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("mean"))
    df = counted.where("term IS NOT NULL").select("term", "df")
    # one row of statistics, so the join is a broadcast of one row
    idf = df.join(F.broadcast(stats), F.lit(True)).withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))
    wanted = queries.groupBy("query", "term").agg(F.sum(F.greatest(F.lit(1), F.bround("weight", 0))).alias("times"))
    known = idf.join(F.broadcast(wanted), "term").join(F.broadcast(mean), F.lit(True))
    known = known.withColumn("idf", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")))
    # of the chunks only terms of the stated queries go on
    flat = tokens.select("chunk", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    tf = flat.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").groupBy("chunk", "term", "len").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return tf.join(F.broadcast(known), "term").groupBy("query", "chunk").agg(F.sum(part).alias("bm25"))


def best_bm25(chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(query, chunk, bm25): of several forms of a query (query, form, term, weight) the best score of each chunk.

    A chunk without a term of one form scores 0 by it, which counts where the
    other form's score is negative.
    """
    scored = bm25(chunks, queries.select(F.struct("query", "form").alias("query"), "term", "weight"), id_col, text_col)
    forms = queries.groupBy("query").agg(F.count_distinct("form").alias("forms"))
    best = scored.groupBy(F.col("query.query").alias("query"), "chunk").agg(F.max("bm25").alias("bm25"), F.count("*").alias("n")).join(forms, "query")
    return best.select("query", "chunk", F.when(F.col("n") < F.col("forms"), F.greatest("bm25", F.lit(0.0))).otherwise(F.col("bm25")).alias("bm25"))


def top_of_dominant(df: DataFrame, kind: str, order: list[Column], limits: dict[str, int], default: int, least: int = 30, quick: bool = False) -> DataFrame:
    """The first k rows in ``order``: k is the limit of the most frequent ``kind`` (the first by name on ties), and ``least`` at least unless ``quick``."""
    counted = df.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(kind).asc_nulls_last()).limit(1).collect()
    k = limits.get(counted[0][0], default) if counted else default
    return df.orderBy(*order).limit(k if quick else max(k, least))


def chat_context(chunks: DataFrame, vectors: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(query, id, score, rank): each question's ``k`` chunks, by cosine where it has a vector, else by how many of its words of four letters or more the chunk contains.

    ``chunks`` are (id, text), ``vectors`` (id, vector), ``questions`` a stated
    set (query, text, vector); chunks without a vector take no part in the former.
    """
    known = vectors.where("vector IS NOT NULL").select("id", "vector")
    near = nearest(known, questions.where(F.size("vector") > 0), k, "id", "vector").select("query", "id", F.col("similarity").alias("score"))
    bare = questions.where(F.coalesce(F.size("vector"), F.lit(-1)) <= 0)
    words = bare.select("query", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.char_length(w) > 3).alias("words"))
    low = chunks.select("id", F.lower("text").alias("t")).join(F.broadcast(words), F.lit(True))
    counted = low.select("query", "id", F.size(F.filter("words", lambda w: F.contains(F.col("t"), w))).cast("double").alias("score"))
    best = [F.desc("score"), F.col("id")]
    kept = first_per(near.unionByName(counted), ["query"], best, k)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best)))


def term_counts(chunks: DataFrame, terms: list[tuple[str, float]], text_col: str = "text") -> Column:
    """Weighted count of whole-word terms, the scorer that needs no corpus statistics."""
    low = F.lower(F.col(text_col))
    return sum((F.regexp_count(low, F.lit(rf"\b\Q{t}\E\b")) * w for t, w in terms), F.lit(0.0))


def similarities(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query, id, similarity): exact cosine of every row and every query of a stated set, at most QUERIES; no shuffle."""
    q = queries.select(F.col("query"), F.col("vector").alias("__q"))
    if q.limit(QUERIES + 1).count() > QUERIES:
        raise ValueError(f"at most {QUERIES} queries are scored at once; pass them in blocks")
    return vectors.join(F.broadcast(q), F.lit(True)).select("query", F.col(id_col).alias("id"), V.cosine(F.col(vector_col), F.col("__q")).alias("similarity"))


def _matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors filled up with zeros to ``width``, and their sizes; a null one, one with a null in it and a longer one are 0."""
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(vectors).to_pylist()], np.int64)
    out = np.zeros((len(vectors), width), np.float64)
    if len(vectors) and (sizes == width).all() and not vectors.flatten().null_count:
        out[:] = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), width)
        return out, sizes
    for i, v in enumerate(vectors.to_pylist()):
        if v and None in v:
            sizes[i] = -2
        elif v and len(v) <= width:
            out[i, : len(v)] = v
    return out, sizes


def _best(held: pa.Table, k: int, asked: int) -> tuple[pa.Table, np.ndarray]:
    """The ``k`` best rows of each query by (similarity, id), and each query's least similarity that still counts."""
    order = pc.sort_indices(held, [("at", "ascending"), ("key", "descending"), ("id", "ascending")], null_placement="at_start")
    held = held.take(order)
    at = held["at"].to_numpy()
    first = np.searchsorted(at, np.arange(asked))
    place = np.arange(len(at)) - first[at]
    kept = held.filter(pa.array(place < k))
    least = np.full(asked, -np.inf)
    last = place == k - 1
    least[at[last]] = held["key"].to_numpy()[last]
    return kept, least


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query, id, similarity, rank): exact cosine, the ``k`` best for each query.

    A stated set of queries, at most QUERIES, against all rows. A task
    multiplies blocks of its rows with all queries, works out again what may be
    among the best, in one order of summing, and gives up ``k`` rows a query.
    """
    q = queries.select("query", "vector")
    asked = q.limit(QUERIES + 1).toArrow()
    if asked.num_rows > QUERIES:
        raise ValueError(f"at most {QUERIES} queries are scored at once; pass them in blocks")
    names, given = asked["query"].combine_chunks(), asked["vector"].combine_chunks()
    width = max(pc.max(pc.list_value_length(given)).as_py() or 1, 1)
    sent = vectors.sparkSession.sparkContext.broadcast((names, *_matrix(given, width)))
    kinds = q.schema["query"].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, y, wanted = sent.value
        long = np.sqrt((y * y).sum(axis=1))
        held, least, fresh = None, np.full(len(y), -np.inf), 0
        for whole in batches:
            for lo in range(0, whole.num_rows if len(y) else 0, ROWS):
                batch = whole.slice(lo, ROWS)
                x, sizes = _matrix(batch.column(1), width)
                scale = np.sqrt((x * x).sum(axis=1))[:, None] * long[None, :]
                with np.errstate(all="ignore"):
                    near = np.where(~(scale <= 0) & (sizes[:, None] == wanted[None, :]), (x @ y.T) / scale, 0.0)
                # no number is above all numbers, as in an ORDER BY
                near[np.isnan(near)] = np.inf
                bar = least
                if len(near) > k and np.isinf(least).any():
                    bar = np.maximum(least, np.partition(near, len(near) - k, axis=0)[len(near) - k])
                rows, at = np.nonzero(near >= bar[None, :] - 1e-9)
                exact = np.empty(len(rows))
                for i in range(0, len(rows), 16_384):
                    r, a = rows[i : i + 16_384], at[i : i + 16_384]
                    with np.errstate(all="ignore"):
                        exact[i : i + 16_384] = np.where(near[r, a] == 0.0, 0.0, (x[r] * y[a]).sum(axis=1) / scale[r, a])
                exact[np.isnan(exact)] = np.inf
                found = pa.table({"at": at, "key": exact, "id": batch.column(0).take(pa.array(rows))})
                held = found if held is None else pa.concat_tables([held, found])
                fresh += len(rows)
                if fresh > max(k * len(y), 100_000) or np.isinf(least).any():
                    held, least = _best(held, k, len(y))
                    held, fresh = held.combine_chunks(), 0
        if held is not None:
            held, _ = _best(held, k, len(y))
            for part in held.combine_chunks().to_batches(10_000):
                key = part.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([names.take(part.column(0)), part.column(2), pa.array(np.where(np.isinf(key), np.nan, key))], ["query", "id", "similarity"])

    scored = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"query {kinds[0]}, id {kinds[1]}, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Rows that are multiplied with all queries at once.
ROWS = 512
#: Queries that ``similarities`` and ``nearest`` take at once, which bounds what they broadcast.
QUERIES = 10_000


def hybrid(df: DataFrame, keyword: str, similarity: str, query: str = "query", keyword_share: float = 0.4) -> DataFrame:
    """``df`` with ``hybrid``: 0.4 of the keyword score over the query's best, 0.6 of the positive cosine; the raw keyword score without a vector.

    The best scores are an aggregate, one row a query, joined back; pass a stored frame if it is costly.
    """
    best = df.groupBy(query).agg(F.max(keyword).alias("__best")).withColumnRenamed(query, "__query")
    joined = df.join(best, F.col(query).eqNullSafe(F.col("__query")))
    scaled = F.when(F.col("__best") > 0, F.col(keyword) / F.col("__best")).otherwise(0.0)
    mixed = F.when(F.col(similarity).isNull(), F.col(keyword)).otherwise(keyword_share * scaled + (1 - keyword_share) * F.greatest(F.lit(0.0), F.col(similarity)))
    return joined.withColumn("hybrid", mixed).drop("__best", "__query")


def above_or_best(df: DataFrame, score: str, threshold: float = 0.05, fallback: int = 20, key: str = "query", tie: str = "chunk") -> DataFrame:
    """Rows above the threshold, or each key's best ``fallback`` where no row is; only rows of the latter keys are ranked."""
    above = df.where(F.col(score) > threshold)
    found = above.select(F.col(key).alias("__key")).distinct()
    rest = df.join(found, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    return above.unionByName(first_per(rest, [key], [F.desc(score), F.col(tie)], fallback))


def exact_dedup(df: DataFrame, key: str, content: str, order: list[Column]) -> DataFrame:
    """The first row of each trimmed content within a key; contents meet by their digest."""
    return first_per(df.withColumn("__c", F.sha2(F.trim(content), 256)), [key, "__c"], order).drop("__c")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def greedy_jaccard(df: DataFrame, key: str, rank: str, text: str, threshold: float = 0.97) -> DataFrame:
    """Rows in rank order that are less than ``threshold`` similar to every row kept before.

    For short ranked lists (a query's candidates): one fold over the key's sorted array.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\w+"), F.lit(0)))
    rows = df.withColumn("__w", words).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank, F.col("__w").alias("w")))).alias("rows"))
    none = F.array().cast(rows.schema["rows"].dataType)
    kept = F.aggregate("rows", none, lambda s, x: F.when(F.exists(s, lambda y: jaccard(x["w"], y["w"]) >= threshold), s).otherwise(F.concat(s, F.array(x))))
    best = rows.select(key, F.explode(kept).alias("k")).select(key, F.col(f"k.{rank}").alias(rank))
    return df.join(best, [key, rank])


def diversify(kept: DataFrame, scored: DataFrame, key: str, file: str, content: str, score: str, k: int, order: list[Column], least: float = 0.15) -> DataFrame:
    """The first ``k`` of each key's ranked list ``kept``, after absent files have been given a place.

    A file of ``scored`` that is not among the first max(k, 5) of ``kept`` gets
    its best row with a score above ``least`` whose content ``kept`` does not
    have yet. These rows go in after the first k, in order of file, and the
    list is cut to k: they show where a key has fewer than k rows of its own.
    ``order`` ranks both frames, which have the same columns.
    """
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    top = ranked.where(F.col("rank") <= max(k, 5)).select(key, file).distinct()
    bare = F.trim(F.col(content))
    known = kept.select(key, bare.alias("__c")).distinct()
    fresh = scored.where(F.col(score) > least).join(top, [key, file], "left_anti").withColumn("__c", bare).join(known, [key, "__c"], "left_anti").drop("__c")
    best = first_per(fresh, [key, file], order)
    sizes = ranked.groupBy(key).agg(F.count("*").alias("__n"))
    # only a key with rows of its own takes others in
    late = best.join(sizes, key).where(F.col("__n") < k).withColumn("rank", (F.col("__n") + F.row_number().over(Window.partitionBy(key).orderBy(file))).cast("int")).drop("__n")
    return ranked.where(F.col("rank") <= k).unionByName(late.where(F.col("rank") <= k))


def within_context(df: DataFrame, key: str, order: list[Column], text: str, context: int, overhead: int) -> DataFrame:
    """The ranked prefix that fits a context: hard limit max(5000, context - overhead), target 0.7 of it; four characters a token."""
    hard = max(5000, context - overhead)
    return budget(df.withColumn("tokens", T.token_estimate(F.col(text))), key, order, "tokens", F.lit(hard), F.lit(int(0.7 * hard)))


def rerank(df: DataFrame, model: Column | None = None, score: str = "hybrid", share: float = 0.3) -> DataFrame:
    """``df`` with ``final``: 0.3 of the hybrid score and 0.7 of a model's, or the hybrid score without a model."""
    return df.withColumn("final", F.col(score) if model is None else share * F.col(score) + (1 - share) * model)


def roles(df: DataFrame, file: str, policy_files: list[str], evidence_files: list[str]) -> Column:
    """POLICY, EVIDENCE, DUAL_ROLE_CONFLICT for files in both lists, SHARED_CONTEXT for files in none."""
    p = F.col(file).isin(policy_files) if policy_files else F.lit(False)
    e = F.col(file).isin(evidence_files) if evidence_files else F.lit(False)
    return F.when(p & e, "DUAL_ROLE_CONFLICT").when(p, "POLICY").when(e, "EVIDENCE").otherwise("SHARED_CONTEXT")
