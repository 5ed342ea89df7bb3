"""Exact top-k by inner product: branch and bound over dimension blocks in vertical layout.

Vectors are turned into integers. Every task packs its vectors into chunks stored dimension by dimension;
queries are packed into blocks. Each (query block, chunk) adds up scores one block of dimensions at a
time. After a block, what the remaining dimensions can still add is bounded by the product of the remaining
lengths (Cauchy-Schwarz): a candidate whose upper bound is below the query's k-th best lower bound is
dropped, and the survivors are moved together. The k best of each pair go on to a final top-k per query.
A stated query set in blocks against all rows is the work itself; only k rows per query and chunk leave a task.

Defined cases: NULL vectors, NULL ids, and vectors with a NULL or non-finite component take no part, nor do
vectors of another length than the query's; a component beyond the range of a long is held at its end;
rows that repeat the query's vec_id count as its own row; a repeated candidate row counts again, a repeated
query is asked once (its row with the smallest vector); ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import written
from .text import quoted

CHUNK = 8192
QUERIES = 256
DIMENSIONS = 8
_EXACT = float(1 << 53)


def _packed(size: int):
    """Chunks of at most ``size`` vectors of one length: ids, and components dimension by dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def chunk(rows):
            ids = np.array([i for i, _ in rows], np.int64)
            values = np.ascontiguousarray(np.array([v for _, v in rows], np.int64).T)
            return pa.RecordBatch.from_arrays([pa.array([values.shape[0]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["dims", "ids", "values"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)):
                rows = held.setdefault(len(v), [])
                rows.append((i, v))
                if len(rows) == size:
                    yield chunk(held.pop(len(v)))
        for rows in held.values():
            yield chunk(rows)

    return work


def _ordered(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= floor)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best_of(query: np.ndarray, own: int, ids: np.ndarray, values: np.ndarray, rest: np.ndarray, exact: bool, k: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a chunk for one query. ``values`` is dimensions x vectors, ``rest[b]`` the length of each
    vector from dimension block b on, ``first`` the scores after the first block (computed for all queries at once)."""
    alive = np.flatnonzero(ids != own)
    partial = first[alive]
    tail = np.sqrt(np.cumsum((query.astype(float) ** 2)[::-1])[::-1])
    for b in range(1, len(rest)):
        if exact and len(alive) > k:
            reach = tail[b * DIMENSIONS] * rest[b][alive]
            slack = 1e-9 * (np.abs(partial) + reach) + 1e-6
            floor = np.partition(partial - reach - slack, len(alive) - k)[len(alive) - k]
            good = partial + reach + slack >= floor
            if not good.all():
                alive, partial = alive[good], partial[good]
        part = values[b * DIMENSIONS : (b + 1) * DIMENSIONS]
        part = part if len(alive) == values.shape[1] else part[:, alive]
        partial = partial + query[b * DIMENSIONS : (b + 1) * DIMENSIONS] @ part
    top = _ordered(partial, ids[alive], k)
    return ids[alive][top], partial[top]


def _search(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, qi, qv, ci, cv in zip(*[batch.column(c).to_pylist() for c in ("dims", "query_ids", "query_values", "ids", "values")]):
                asked, ids = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                queries, values = np.frombuffer(qv, np.int64).reshape(dims, -1), np.frombuffer(cv, np.int64).reshape(dims, -1)
                lengths = values.astype(float) ** 2
                # doubles are exact while no sum can pass 2**53; otherwise 64-bit integers, without pruning
                exact = bool(dims) and math.sqrt(lengths.sum(0).max(initial=0)) * math.sqrt((queries.astype(float) ** 2).sum(0).max(initial=0)) < _EXACT / 4
                if exact:
                    queries, values = queries.astype(float), values.astype(float)
                starts = range(0, max(1, dims), DIMENSIONS)
                rest = [np.sqrt(lengths[b:].sum(0)) for b in starts]
                first = queries[:DIMENSIONS].T @ values[:DIMENSIONS]
                out = [best_of(queries[:, j], asked[j], ids, values, rest, exact, k, first[j]) for j in range(len(asked))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(asked, [len(i) for i, _ in out])), pa.array(np.concatenate([i for i, _ in out])),
                    pa.array(np.concatenate([s for _, s in out]).astype(np.int64)),
                ], names=["query_id", "vec_id", "score"])

    return work


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id and the vector of floor(scale * x), of rows that take part."""
    x = F.col(quoted(embedding)).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.col(quoted(vec_id)).isNotNull() & fine).select(
        F.col(quoted(vec_id)).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).cast("array<long>").alias("v")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k highest inner products among rows with another id."""
    chunks = written(integers(vectors, vec_id, embedding, scale).mapInArrow(_packed(CHUNK), "dims int, ids binary, values binary"))
    asked = integers(queries, vec_id, embedding, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = written(asked.mapInArrow(_packed(QUERIES), "dims int, query_ids binary, query_values binary".replace("query_", "")))
    blocks = blocks.select("dims", F.col("ids").alias("query_ids"), F.col("values").alias("query_values"))
    n = max(1, chunks.count())
    # few large rows: dealt out one by one, so that all cores take part
    pairs = chunks.repartition(min(n, 2000)).join(F.broadcast(blocks) if blocks.count() * QUERIES * 64 * 8 <= 8 << 20 else blocks, "dims")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: rows whose vec_id is divisible by 100 against all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
