"""Exact top-k search by inner product with pivot-table elimination.

Each vector's distances to `n_pivots` pivots are computed once and stored with it. By the triangle inequality the largest
difference of two rows of that table is a lower bound of their distance, which with the norms gives an upper bound of
their inner product. A query takes the candidates of a group in order of that bound and stops at the first bound below
its k-th best score so far. Pivots are chosen farthest-first from a bounded sample (any choice gives exact results), and
as they are rows themselves their scores start each query's threshold.

Queries are a table in the shared folder, in files of bounded blocks. A task holds a group of GROUP vectors and reads the
blocks past it; what it keeps of a query from group to group is its k-th best score (8 bytes), so a row leaves the task
only where it beats all earlier groups of the task.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id; rows
that share a query's vec_id are its own; shorter vectors count as padded with zeros; repeated vec_ids of candidates stay
separate rows, in no fixed order where score and vec_id tie; no queries or fewer candidates than k give what there is;
an empty table gives no rows; other columns are ignored. Components so large that floor(256 x) or a score doesn't fit 64
bits are an error, never a wrong score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table
from .storage import random_access

PIVOT_SAMPLE = 2048
#: Bytes of a block of queries, and vectors that a task compares with it at a time.
QUERY_BYTES, GROUP = 4 << 20, 1 << 16
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; rows that take no part are gone."""
    v = F.col(column)
    good = v.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**62, F.floor(x.cast("double") * scale).cast("long")).otherwise(F.raise_error(F.lit("a component of a vector doesn't fit 64 bits")).cast("long"))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of width, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n, flat = len(column), column.flatten().to_numpy(zero_copy_only=False)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width), np.int64)
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def farthest_first(sample: np.ndarray, n: int) -> list[int]:
    if not len(sample):
        return []
    x = sample.astype(np.float64)
    picked, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(n, len(x)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
    return picked


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """x in the number type in which sums of products of magnitudes up to `most` are exact."""
    bound = max(1, x.shape[1]) * most * most
    if bound >= 2**62:
        raise ValueError("scores of these vectors don't fit 64 bits")
    return x.astype(np.float64) if bound < 2**51 else x


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, from exact squares."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(square.astype(np.float64))


def search_group(q_ids: np.ndarray, q: np.ndarray, q_table: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, x_table: np.ndarray, k: int) -> list[np.ndarray]:
    """(query_id, vec_id, score) of the best k of a group for each query, but none that scores below the query's floor.

    floor is raised to the k-th best of the group. x_table has a row for each pivot.
    """
    norm_q, norm_x = (q * q).sum(1), (x * x).sum(1)
    slack = 1e-6 * (1.0 + max(float(np.abs(x_table).max(initial=0)), float(np.abs(q_table).max(initial=0))))
    gap, bound, out = np.empty(len(x), np.float32), np.empty(len(x), np.float32), []
    for i in range(len(q_ids)):
        bound[:] = 0
        for p in range(len(x_table)):
            np.subtract(x_table[p], q_table[i, p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(bound, gap, out=bound)
        loose = 1e-3 if x.dtype == np.float64 else 2.0**-48 * (float(norm_q[i]) + float(norm_x.max(initial=0)))  # of doubles that hold wide integers
        upper = (norm_q[i] + norm_x - np.maximum(bound.astype(np.float64) - slack, 0) ** 2) / 2 + loose
        todo = np.flatnonzero((upper >= floor[i]) & (ids != q_ids[i]))
        score, who, step = np.zeros(0, x.dtype), np.zeros(0, np.int64), 256
        while len(todo):
            if len(todo) > step:
                o = np.argpartition(-upper[todo], step)
                part, todo = todo[o[:step]], todo[o[step:]]
            else:
                part, todo = todo, todo[:0]
            score, who = np.concatenate((score, x[part] @ q[i])), np.concatenate((who, ids[part]))
            if len(score) > k:
                best = np.lexsort((who, -score))[:k]
                score, who = score[best], who[best]
            if len(score) == k:
                floor[i] = max(floor[i], score.min() if x.dtype == np.float64 else float(score.min()) - loose)
            todo, step = todo[upper[todo] >= floor[i]], step * 4
        fit = score >= floor[i]
        if fit.any():
            out.append(np.stack((np.full(int(fit.sum()), q_ids[i]), who[fit], score[fit].astype(np.int64))))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, n_pivots: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: (vec_id, v) as quantised() gives them."""
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    width, most = vectors.agg(F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not width:
        return nothing
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toArrow()
    s = matrix(sample["v"], width)
    picked = farthest_first(s, n_pivots)
    pivots, pivot_ids = exact(s[picked], most), np.array(sample["vec_id"].to_pylist(), np.int64)[picked]

    def add_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = distances(exact(matrix(b.column(1), width), most), pivots).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, t.shape[1], dtype=np.int32)), pa.array(t.ravel()))], ["vec_id", "v", "distances"])

    indexed = stage(vectors.mapInArrow(add_table, "vec_id long, v array<long>, distances array<float>"), "pivot-table")
    asked, each = stage(queries, "queries"), max(1, QUERY_BYTES // (8 * width))
    files = sorted(asked.inputFiles())
    if not files:
        return nothing

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for name in files:
            for b in pq.ParquetFile(random_access(name)).iter_batches(each, columns=["vec_id", "v"]):
                if b.num_rows:
                    wide = matrix(b.column(1), width)
                    q = exact(wide, max(most, int(np.abs(wide).max(initial=0))))
                    yield b.column(0).to_numpy(), q, distances(q, pivots).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: list[np.ndarray] = []

        def group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            x = exact(np.concatenate([matrix(b.column(1), width) for b in held]), most)
            t = np.ascontiguousarray(np.concatenate([b.column(2).flatten().to_numpy().reshape(-1, len(pivots)) for b in held]).T)
            for n, (q_ids, q, q_table) in enumerate(blocks()):
                if n == len(floors):
                    scores = np.where(pivot_ids[None] == q_ids[:, None], -np.inf, q @ pivots.T)
                    floors.append(np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf))
                rows = search_group(q_ids, q, q_table, floors[n], ids, x, t, k)
                if rows:
                    found = np.concatenate(rows, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) >= GROUP:
                yield from group(held)
                held = []
        if held:
            yield from group(held)

    found = stage(indexed.mapInArrow(run, FOUND), "found", narrow=True)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
