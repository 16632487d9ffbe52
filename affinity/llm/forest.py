"""Approximate nearest neighbours by a hash-prefix forest.

Vectors are dealt at random into blocks. In a block, each of ``TREES`` trees is a sorted array of hash
strings of ``BITS`` signs of random projections. A query descends each tree to its longest
matching prefix and ascends in all trees at once: a level takes in every vector that shares that many
bits with the query in some tree. It stops at the level where a vector as near as the worst of the
best found so far would have been missed with a probability of at most ``MISS``; at level 0 nothing is left.
"""

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.operators.skew import spread_join
from affinity.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 64
BITS = 24
MISS = 0.04
BLOCK_ROWS = 32768
QUERY_ROWS = 2048
_NEAR = 1e-9


class Forest:
    """The trees of one block of vectors, given as rows."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        hashes = self.hashes(self.units)
        self.order = np.argsort(hashes, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(hashes, self.order, axis=0).T)
        self.order = np.ascontiguousarray(self.order.T)

    @staticmethod
    def hashes(units: np.ndarray) -> np.ndarray:
        """One column of hash strings for each tree."""
        rng = np.random.default_rng(units.shape[1])
        bit = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        return np.stack([
            (units @ rng.standard_normal((units.shape[1], BITS)) > 0) @ bit for _ in range(TREES)], axis=1)

    def search(self, queries: np.ndarray, k: int):
        """For each query row, numbers of the candidates that can be among its best ``k``, ties included."""
        units = queries / np.linalg.norm(queries, axis=1)[:, None]
        hashes = self.hashes(units)
        n, first = len(self.vectors), min(BITS, max(1, math.ceil(math.log2(len(self.vectors)))))
        low = np.empty((first + 1, len(queries), TREES), np.int64)
        high = np.empty_like(low)
        for level in range(first + 1):
            shift = BITS - level
            start = hashes >> shift << shift
            for t in range(TREES):
                low[level, :, t] = np.searchsorted(self.sorted[t], start[:, t])
                high[level, :, t] = np.searchsorted(self.sorted[t], start[:, t] + (1 << shift))
        for q, unit in enumerate(units):
            seen = np.zeros(n, bool)
            found, scores = np.empty(0, np.int64), np.empty(0)
            for level in range(first, -1, -1):
                fresh = np.zeros(n, bool)
                for t in range(TREES if level else 1):
                    a, b = low[level, q, t], high[level, q, t]
                    if level == first:
                        fresh[self.order[t, a:b]] = True
                    else:
                        fresh[self.order[t, a:low[level + 1, q, t]]] = True
                        fresh[self.order[t, high[level + 1, q, t]:b]] = True
                rows = np.nonzero(fresh & ~seen)[0]
                seen[rows] = True
                found = np.concatenate([found, rows])
                scores = np.concatenate([scores, self.units[rows] @ unit])
                if len(scores) > k:
                    edge = np.partition(scores, len(scores) - k)[len(scores) - k] - _NEAR
                    found, scores = found[scores >= edge], scores[scores >= edge]
                if len(scores) >= k:
                    same = 1 - math.acos(min(1.0, max(-1.0, scores.min()))) / math.pi
                    if (1 - same ** level) ** TREES <= MISS:
                        break
            yield found


def _rows(cell) -> tuple[np.ndarray, np.ndarray]:
    rows = cell.values
    vectors = rows.field("vector")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return rows.field("key"), flat.reshape(len(rows), -1)


def _searcher(k: int):
    def search(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                _, vectors = _rows(batch.column(0)[n])
                ids = batch.column(0)[n].values.field("ids")
                keys, queries = _rows(batch.column(1)[n])
                forest = Forest(vectors)
                keys = keys.to_numpy()
                lengths = np.linalg.norm(vectors, axis=1)
                for key, query, rows in zip(keys, queries, forest.search(queries, k + 1)):
                    # Summed in one fixed order, so that equal vectors score exactly equal.
                    scores = (vectors[rows] * query).sum(axis=1) / (lengths[rows] * np.sqrt((query * query).sum()))
                    near = [(i, s) for r, s in zip(rows, scores) for i in ids[r].as_py() if i != key]
                    near = sorted(near, key=lambda x: (-x[1], x[0]))[:k]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key] * len(near), pa.int64()), pa.array([i for i, _ in near], pa.int64()),
                        pa.array([float(s) for _, s in near], pa.float64())], names=["query_id", "vec_id", "score"])
    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): ``k`` nearest vectors found for each query, by cosine.

    Both sides are (vec_id, embedding). A row's own id is not its neighbour. Ties go to the smaller id; fewer
    than ``k`` candidates are all returned. Equal vectors are indexed once with their ``k + 1`` smallest ids,
    more of which can never be returned. Every block of queries meets every block of vectors, and ``k``
    rows per query and block leave it.

    Null, zero, empty and non-finite vectors, rows with a null id, and queries whose length differs from
    all vectors take no part: each length of vectors is searched by itself. Of rows that repeat an
    id with different vectors, each is a candidate and each is a query; an id is returned once, by its best
    score. Other columns are ignored; empty tables give no rows.
    """
    finite = (
        "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) "
        "and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")

    def usable(df: DataFrame) -> DataFrame:
        return df.select(
            F.col("vec_id").cast("bigint").alias("vec_id"),
            F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding")).filter(finite)

    w = Window.partitionBy("embedding").orderBy("vec_id")
    smallest = usable(vectors).distinct().withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k + 1)
    distinct = written(
        smallest.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("width", F.size("embedding")).withColumn("place", F.xxhash64("embedding")), "vectors")
    asked = written(usable(queries).distinct().withColumn("width", F.size("embedding")), "queries")
    n_blocks = max(1, math.ceil(distinct.count() / BLOCK_ROWS))
    n_parts = max(1, math.ceil(asked.count() / QUERY_ROWS))

    index = (
        distinct.withColumn("block", F.pmod("place", F.lit(n_blocks)).cast("int"))
        .groupBy("width", "block").agg(F.collect_list(F.struct(
            F.lit(0).cast("bigint").alias("key"), F.col("embedding").alias("vector"), "ids")).alias("vectors"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))))
    wanted = (
        asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_parts)).cast("int"))
        .groupBy("width", "part").agg(F.collect_list(F.struct(
            F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))).alias("queries"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
    met = spread_join(index, wanted, ["width", "block", "part"]).select("vectors", "queries")
    found = met.mapInArrow(_searcher(k), "query_id bigint, vec_id bigint, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
