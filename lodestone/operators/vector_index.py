"""Approximate nearest neighbours: an inverted file of coarse lists with product codes of the residuals.

``fit`` learns coarse centroids and one codebook for each part of a vector from
a bounded sample. ``VectorIndex.add`` puts every row into the list of its
nearest centroid and stores the codes of what is left over. ``search`` probes a
query's nearest lists, adds up table look-ups for their codes, and works out
the exact cosine of the best candidates. Lists and the queries that probe them
meet in blocks of bounded size, so neither a hot list nor a popular one comes
to one task whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import vectors as V
from lodestone.operators.windows import first_per

#: Rows that a model is fitted on, by the least hashes of their ids; they come to the driver.
SAMPLE = 65_536
#: Parts of a vector that have a code each, codes of a part, steps of k-means, and sampled rows that codebooks are made of.
PARTS, CODES, ROUNDS, BOOK_ROWS = 32, 256, 8, 16_384
#: Sampled rows that the number of probes is measured on, as queries against the rest of the sample.
PROBED = 200
#: Part of the sample's neighbours that a search's lists must see where the caller names no number of probes.
RECALL = 0.97
#: Lists of an index, about: this times the square root of its rows, LISTS at most.
DENSITY, LISTS = 1.0, 65_536
#: Rows of a list, and queries that probe it, that meet in one group.
ROWS, QUERIES = 16_384, 1_024


def _unit(rows: list, size: int) -> np.ndarray:
    """Vectors of length 1; a null, a vector of another size, and one without a length are 0."""
    out = np.zeros((len(rows), size), np.float64)
    for i, row in enumerate(rows):
        if row is not None and len(row) == size and None not in row:
            out[i] = row
    length = np.linalg.norm(out, axis=1, keepdims=True)
    ok = np.isfinite(length) & (length > 0)
    return np.where(ok, np.divide(out, length, where=ok, out=np.zeros_like(out)), 0.0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre that is nearest to each row, some thousand rows at a time."""
    norms = (centres**2).sum(axis=1)
    return np.concatenate([np.argmin(norms - 2 * x[lo : lo + 4096] @ centres.T, axis=1) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` centres (fewer of fewer rows); a centre that loses its rows takes the row that is farthest from its own."""
    x = x.astype(np.float32)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        there, first, n = np.unique(own[order], return_index=True, return_counts=True)
        moved = centres.copy()
        moved[there] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
        lost = np.setdiff1d(np.arange(len(centres)), there)
        if len(lost):
            moved[lost] = x[np.argsort(-((x - centres[own]) ** 2).sum(axis=1))[: len(lost)]]
        centres = moved
    return centres.astype(np.float64)


@dataclass
class Model:
    """Centroids (lists x size), for each part of a residual a codebook (parts x codes x size of a part), and the part of a sample's neighbours that 1, 2, ... probes see."""

    centroids: np.ndarray
    codebooks: np.ndarray
    seen: np.ndarray

    @property
    def size(self) -> int:
        return self.centroids.shape[1]

    def probes(self, recall: float) -> int:
        """The least number of probes that sees this part of the neighbours in the sample; all lists if none does."""
        enough = np.flatnonzero(self.seen >= recall)
        return int(enough[0]) + 1 if len(enough) else len(self.centroids)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Rows cut in parts, padded by zeros: (parts, rows, size of a part)."""
        n, _, width = self.codebooks.shape
        padded = np.zeros((len(x), n * width))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), n, width).transpose(1, 0, 2)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes) of unit vectors."""
        own = _nearest(x, self.centroids)
        left = self.parts(x - self.centroids[own])
        return own, np.stack([_nearest(p, book) for p, book in zip(left, self.codebooks, strict=True)], axis=1).astype(np.uint8)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts, codes): the part of a row's inner product with a residual that has the code."""
        return np.einsum("prw,pcw->rpc", self.parts(x), self.codebooks)


def _seen(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """For 1, 2, ... probes, the part of the ``k`` nearest sampled rows of some sampled rows that the probed lists have."""
    asked = x[:: max(1, len(x) // PROBED)]
    best = np.argsort(-(asked @ x.T), axis=1)[:, :k]
    rank = np.argsort(np.argsort((centroids**2).sum(axis=1) - 2 * asked @ centroids.T, axis=1, kind="stable"), axis=1)
    at = np.take_along_axis(rank, own[best], axis=1)
    return np.cumsum(np.bincount(at.ravel(), minlength=len(centroids))) / at.size


def fit(vectors: DataFrame, id_col: str, vector_col: str, rows: int | None = None, k: int = 20, parts: int = PARTS, seed: int = 1) -> Model:
    """A model of ``vectors`` by SAMPLE of their rows; ``rows`` is their number (counted where it isn't given), from which the number of lists follows.

    The vectors' size is that of the first sampled row which has a vector. How
    many probes see how many of the ``k`` nearest is measured inside the sample.
    A table without vectors has a model of one list.
    """
    rows = vectors.count() if rows is None else rows
    held = vectors.where(F.size(vector_col) > 0).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("i"), F.col(vector_col).alias("v")).orderBy("h", "i").limit(SAMPLE).select("v").collect()
    size = len(held[0]["v"]) if held else 1
    x = _unit([r["v"] for r in held], size)
    lists = max(1, min(LISTS, int(DENSITY * rows**0.5), len(x) // 8))
    if not len(x):
        return Model(np.zeros((1, size)), np.zeros((1, 1, size)), np.ones(1))
    centroids = _k_means(x, lists, seed)
    own = _nearest(x, centroids)
    width = -(-size // min(parts, size))
    bare = Model(centroids, np.zeros((-(-size // width), 1, width)), np.ones(1))
    books = [_k_means(p[:BOOK_ROWS], CODES, seed + i + 1) for i, p in enumerate(bare.parts(x - centroids[own]))]
    return Model(centroids, np.stack(books), _seen(x, own, centroids, k))


class VectorIndex:
    """An index stored at ``path``: rows (list, id, codes), a folder for each list's number modulo 256."""

    def __init__(self, spark: SparkSession, path: str, model: Model):
        self.spark, self.path, self.model = spark, path.rstrip("/"), model

    def save(self) -> None:
        """Store the model beside the rows."""
        rows = [(-1, 0, self.model.seen.tolist()), *[(0, i, c.tolist()) for i, c in enumerate(self.model.centroids)]]
        rows += [(p + 1, i, c.tolist()) for p, book in enumerate(self.model.codebooks) for i, c in enumerate(book)]
        self.spark.createDataFrame(rows, "part int, number int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = sorted(spark.read.parquet(f"{path.rstrip('/')}/model").collect())
        books: dict[int, list] = {}
        for part, _, vector in rows:
            books.setdefault(part, []).append(vector)
        seen, centroids = books.pop(-1)[0], books.pop(0)
        return cls(spark, path, Model(np.array(centroids), np.array([books[p] for p in sorted(books)]), np.array(seen)))

    def add(self, vectors: DataFrame, id_col: str, vector_col: str) -> None:
        """Store every row of ``vectors``: null vectors and those of another size as vectors without a length."""
        kind = vectors.schema[id_col].dataType.simpleString()
        model = self.spark.sparkContext.broadcast(self.model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, codes = model.value.codes(_unit(batch.column(1).to_pylist(), model.value.size))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "id", "codes"])

        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"list int, id {kind}, codes binary")
        # lists lie together in a few files; a hot list has many
        dealt = rows.withColumn("folder", F.pmod("list", F.lit(256))).repartitionByRange("folder", "list", F.xxhash64("id"))
        dealt.write.mode("append").partitionBy("folder").parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").select("list", "id", "codes")

    def candidates(self, queries: DataFrame, refine: int, probes: int) -> DataFrame:
        """(query, id, estimate, rank): each query's ``refine`` best rows by their codes, of the ``probes`` lists nearest to it; queries are (query, vector)."""
        kinds = queries.schema["query"].dataType.simpleString(), self.rows().schema["id"].dataType.simpleString()
        model = self.spark.sparkContext.broadcast(self.model)

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            n = min(probes, len(m.centroids))
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    x = _unit(part.column(1).to_pylist(), m.size)
                    near = np.argsort((m.centroids**2).sum(axis=1) - 2 * x @ m.centroids.T, axis=1, kind="stable")[:, :n]
                    flat = pa.array(np.repeat(x, n, axis=0).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(x)), n))), pa.array(near.ravel(), pa.int32()), flat], ["query", "list", "x"])

        def scored(mine: pa.Table, asked: pa.Table) -> pa.Table:
            out = []
            m = model.value
            if mine.num_rows and asked.num_rows:
                # of equal estimates the least ids count
                mine = mine.sort_by("id")
                codes = np.frombuffer(b"".join(mine.column("codes").to_pylist()), np.uint8).reshape(mine.num_rows, -1)
                x = np.array(asked.column("x").to_pylist())
                coarse = x @ m.centroids[mine.column("list")[0].as_py()]
                ids, names = mine.column("id").combine_chunks(), asked.column("query").combine_chunks()
                columns = np.arange(codes.shape[1])
                for q in range(len(x)):
                    estimate = coarse[q] + m.tables(x[q : q + 1])[0][columns, codes].sum(axis=1)
                    best = np.arange(len(estimate))
                    if len(estimate) > refine:
                        edge = np.partition(estimate, len(estimate) - refine)[len(estimate) - refine]
                        above = np.flatnonzero(estimate > edge)
                        best = np.concatenate((above, np.flatnonzero(estimate == edge)[: refine - len(above)]))
                    out.append(pa.RecordBatch.from_arrays([pa.array([names[q].as_py()] * len(best), names.type), ids.take(pa.array(best)), pa.array(estimate[best])], ["query", "id", "estimate"]))
            if not out:
                return pa.table({"query": asked.column("query").slice(0, 0), "id": mine.column("id").slice(0, 0), "estimate": pa.array([], pa.float64())})
            return pa.Table.from_batches(out)

        asked = queries.select("query", "vector").mapInArrow(probed, f"query {kinds[0]}, list int, x array<double>")
        held = self.rows().groupBy("list").agg(F.count("*").alias("n"))
        wanted = asked.groupBy("list").agg(F.count("*").alias("m"))
        # one row a list, LISTS at most
        sizes = F.broadcast(held.join(wanted, "list").select(F.col("list").alias("l"), F.ceil(F.col("n") / ROWS).alias("blocks"), F.ceil(F.col("m") / QUERIES).alias("chunks")))

        def dealt(df: DataFrame, key: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
            met = df.join(sizes, F.col("list") == F.col("l"))
            met = met.withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_n) - 1)))
            return met.drop("l", "blocks", "chunks")

        left = dealt(self.rows(), "id", "block", "blocks", "chunk", "chunks").groupBy("list", "block", "chunk")
        right = dealt(asked, "query", "chunk", "chunks", "block", "blocks").groupBy("list", "block", "chunk")
        found = left.cogroup(right).applyInArrow(scored, f"query {kinds[0]}, id {kinds[1]}, estimate double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("estimate"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= refine)

    def search(self, queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, k: int, probes: int | None = None, refine: int | None = None) -> DataFrame:
        """(query, id, similarity, rank): the ``k`` best by exact cosine of the ``refine`` candidates (2 k where it isn't given).

        Without ``probes`` there are so many that they see RECALL of a sample's neighbours. ``vectors`` are the indexed rows; only the candidates' vectors are joined.
        """
        near = self.candidates(queries, refine or 2 * k, probes or self.model.probes(RECALL)).select("query", "id")
        exact = near.join(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "id").join(queries.select("query", "vector"), "query")
        scored = exact.select("query", "id", V.cosine(F.col("v"), F.col("vector")).alias("similarity"))
        best: list[Column] = [F.desc("similarity"), F.col("id")]
        return first_per(scored, ["query"], best, k).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best)))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, hits, wanted, recall): which part of the exact neighbours (query, id) an approximate search has found."""
    wanted = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    counted = wanted.groupBy("query").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
    return counted.withColumn("recall", F.col("hits") / F.col("wanted"))
