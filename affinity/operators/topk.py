"""Highest scalar products between two vector tables, computed in blocks."""

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.functions.arrays import magnitude
from affinity.operators.skew import spread_join
from affinity.session import written

# Tasks carry this module's functions with them, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CHUNK = 1024  # blocks, or left rows, of a chunk
_SCORES = 1 << 24  # products held at once: fewer left rows for larger right blocks
# A left vector is copied for each right block it must meet, so blocks grow with the table, to a bound.
_BLOCK_ROWS, _MOST_ROWS, _BLOCKS = 1 << 14, 1 << 17, 8
_PIVOTS = 256


def _unpack(cell: pa.Scalar):
    rows = cell.values
    vectors = rows.field("features")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def best_of_block(left_ids, left, right_ids, right, k: int, exclude_self: bool, floor=None):
    """Row numbers and scores of the best ``k`` right rows of each left row, ties by id.

    The matrix product only preselects. Candidates within rounding distance of the
    k-th score are summed again in column order, so equal vectors score exactly equal.
    Where a row's ``floor`` is known, a score its best ``k`` do not fall below, that preselects instead.
    """
    floor = np.full(len(left_ids), -np.inf) if floor is None else floor
    by_id = np.argsort(right_ids, kind="stable")
    right_ids, right = right_ids[by_id], right[by_id]
    same = np.full(len(left_ids), -1)
    if exclude_self and len(right_ids):
        at = np.minimum(np.searchsorted(right_ids, left_ids), len(right_ids) - 1)
        same = np.where(right_ids[at] == left_ids, at, -1)
    reach = np.abs(right).max(initial=0.0) * right.shape[1]
    step = max(1, min(_CHUNK, _SCORES // max(1, len(right))))
    for start in range(0, len(left), step):
        part = left[start:start + step]
        scores = part @ right.T
        own = same[start:start + step]
        mine = np.nonzero(own >= 0)[0]
        scores[mine, own[mine]] = -np.inf
        edge = floor[start:start + step].copy()
        free = np.isneginf(edge)
        if scores.shape[1] > k and free.any():
            edge[free] = np.partition(scores[free], scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        edge = edge - 1e-12 * reach * np.abs(part).max(axis=1, initial=0.0)
        i, j = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
        exact = np.zeros(len(i))
        for f in range(right.shape[1]):
            exact += part[i, f] * right[j, f]
        order = np.lexsort((j, -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        yield i[keep] + start, by_id[j[keep]], exact[keep]


def _scorer(k: int, exclude_self: bool, schema: pa.Schema):
    def score(batches):
        for batch in batches:
            lefts, rights = batch.column("left_rows"), batch.column("right_rows")
            for n in range(batch.num_rows):
                left_ids, left = _unpack(lefts[n])
                right_ids, right = _unpack(rights[n])
                known = lefts.type.value_type.get_field_index("floor") >= 0
                floor = lefts[n].values.field("floor").to_numpy(zero_copy_only=False) if known else None
                for i, j, s in best_of_block(left_ids, left, right_ids, right, k, exclude_self, floor):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(left_ids[i], type=schema.field(0).type),
                        pa.array(right_ids[j], type=schema.field(1).type),
                        pa.array(s, type=pa.float64()),
                    ], schema=schema)
    return score


def _arrow_type(kind: T.DataType) -> pa.DataType:
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    if kind.simpleString() not in types:
        raise ValueError(f"ids must be string, int or bigint, got {kind.simpleString()}")
    return types[kind.simpleString()]


def _packed(df: DataFrame, blocks: int, name: str) -> DataFrame:
    """One row per block, its vectors in one array. Ids are hashed, so blocks are even."""
    placed = df.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(name),
        F.struct("id", "features").alias("row"))
    return placed.repartition(blocks, name).groupBy(name).agg(F.collect_list("row").alias(f"{name}_rows"))


def unit_rows(df: DataFrame) -> DataFrame:
    """Vectors scaled to length one; zero vectors drop out."""
    norm = magnitude(F.col("features"))
    return (
        df.withColumn("_norm", norm).filter("_norm > 0")
        .withColumn("features", F.transform("features", lambda v: v / F.col("_norm"))).drop("_norm")
    )


def _nearest_pivot(pivots: np.ndarray):
    """Adds to (id, features) the number of the nearest pivot and the vector's length."""
    def place(batches):
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            far = (pivots * pivots).sum(axis=1)[None, :] - 2 * (vectors @ pivots.T)
            at, length = np.argmin(far, axis=1), np.sqrt((vectors * vectors).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at, pa.int32()), pa.array(length, pa.float64())],
                names=["id", "features", "pivot", "length"])
    return place


def _placed(df: DataFrame, pivots: np.ndarray, blocks: int, name: str) -> DataFrame:
    """(block, id, features): about as many rows in each block, near one pivot and of similar length.

    Rows go by pivot, falling length and id to ranges, so a crowded pivot or many copies still make even blocks.
    """
    fields = T.StructType([*df.schema, T.StructField("pivot", T.IntegerType()), T.StructField("length", T.DoubleType())])
    near = df.mapInArrow(_nearest_pivot(pivots), fields)
    ranged = near.repartitionByRange(blocks, F.col("pivot"), F.desc("length"), F.col("id"))
    return written(ranged.select(
        F.concat_ws("/", F.spark_partition_id(), "pivot").alias("block"), "id", "features"), name)


def _summaries(batches):
    """Center, radius, greatest length and number of each block's vectors."""
    for batch in batches:
        out = [[], [], [], []]
        for n in range(batch.num_rows):
            vectors = _unpack(batch.column(1)[n])[1]
            center = vectors.mean(axis=0)
            out[0].append(center)
            out[1].append(float(np.sqrt(((vectors - center) ** 2).sum(axis=1)).max()))
            out[2].append(float(np.sqrt((vectors ** 2).sum(axis=1)).max()))
            out[3].append(len(vectors))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0], pa.list_(pa.float64())), pa.array(out[1], pa.float64()),
             pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())],
            names=["block", "center", "radius", "longest", "rows"])


def reach(left: np.ndarray, centers: np.ndarray, radii: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """No product of a left row with a vector of a block is greater: by the block's ball, and by its lengths."""
    length = np.sqrt((left * left).sum(axis=1))[:, None]
    best = np.minimum(left @ centers.T + length * radii, length * longest)
    return best + 1e-9 * length * longest  # rounding


def _router(k: int, first: bool, schema: pa.Schema):
    """Which right blocks a left row must meet: of a chunk those whose centers score best, with more than ``k``
    rows together, then all others that can reach its k-th score."""
    def route(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                rows = batch.column(0)[n].values
                left = rows.field("features").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                blocks = batch.column(1)[n].values
                centers = blocks.field("center").flatten().to_numpy().reshape(len(blocks), -1)
                most = reach(left, centers, blocks.field("radius").to_numpy(), blocks.field("longest").to_numpy())
                leading = np.zeros(most.shape, bool)
                order = np.argsort(-(left @ centers.T), axis=1, kind="stable")
                size = blocks.field("rows").to_numpy()[order]
                np.put_along_axis(leading, order, np.cumsum(size, axis=1) - size <= k, axis=1)
                floor = rows.field("floor").to_numpy(zero_copy_only=False)
                wanted = leading if first else ~leading & (most >= floor[:, None])
                names = blocks.field("block")
                for b in np.nonzero(wanted.any(axis=0))[0].tolist():
                    some = rows.take(pa.array(np.nonzero(wanted[:, b])[0]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([names[b].as_py()], pa.string()),
                        pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some).cast(schema.field(1).type)],
                        schema=schema)
    return route


def _pruned(left: DataFrame, right: DataFrame, k: int, scorer, scored: T.StructType, n_lb: int, n_rb: int) -> DataFrame:
    """The best ``k`` of each left row, from only the right blocks that can hold one of them.

    Each left row first meets the blocks whose centers score best, which give it a k-th score; a table of these thresholds
    then says which other blocks it must meet. The rest cannot reach it.
    """
    pivots = right.orderBy(F.xxhash64("id"), "id").limit(min(_PIVOTS, 4 * n_rb)).select("features").collect()
    pivots = np.array([r.features for r in pivots], float)
    row_type = left.schema["id"].dataType
    rights = _placed(right, pivots, n_rb, "right").groupBy("block").agg(
        F.collect_list(F.struct("id", "features")).alias("right_rows"))
    rights = written(rights, "right-blocks")
    chunks = max(1, math.ceil(rights.count() / _CHUNK))
    bounds = written(rights.mapInArrow(
        _summaries, "block string, center array<double>, radius double, longest double, rows bigint").groupBy(
        F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("block", "center", "radius", "longest", "rows"))).alias("blocks")), "bounds")
    lefts = _placed(left, pivots, n_lb, "left")
    copies = max(1, math.ceil(4 * left.sparkSession.sparkContext.defaultParallelism / n_rb))
    copied = rights.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    packed = f"block string, left_rows array<struct<id:{row_type.simpleString()},features:array<double>,floor:double>>"
    arrow = pa.schema([("block", pa.string()), ("left_rows", pa.list_(pa.struct([
        ("id", _arrow_type(row_type)), ("features", pa.list_(pa.float64())), ("floor", pa.float64())])))])

    def met(rows: DataFrame, first: bool) -> DataFrame:
        packs = rows.groupBy("block").agg(F.collect_list(F.struct("id", "features", "floor")).alias("left_rows"))
        packs = packs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        routes = spread_join(packs, bounds, ["chunk"]).select("left_rows", "blocks").mapInArrow(
            _router(k, first, arrow), packed)
        # Few large right blocks still make several tasks for each slot: copies of a block share its left rows.
        placed = routes.withColumn("copy", F.pmod(F.xxhash64(F.col("left_rows")[0]["id"]), F.lit(copies)).cast("int"))
        pairs = spread_join(placed, copied, ["block", "copy"]).select("left_rows", "right_rows")
        found = pairs.mapInArrow(scorer, scored)
        return written(found.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank"), "found")

    once = met(lefts.withColumn("floor", F.lit(float("-inf"))), True)
    floors = once.groupBy("id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k)
    raised = spread_join(lefts, floors.drop("n"), ["id"], "left").select(
        "block", "id", "features", F.coalesce("kth", F.lit(float("-inf"))).alias("floor"))
    both = once.unionByName(met(raised, False))
    return both.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")


def top_k_scores(
    left: DataFrame, right: DataFrame, k: int, exclude_self: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """(id, other, score): for each left vector the ``k`` right ones of highest product.

    Both sides are (id, features), ids unique. Vectors are packed into blocks of at
    most about ``block_rows``, by default an eighth of the right ones within bounds; one matrix product scores a pair of blocks inside its task,
    and only ``k`` rows per left vector leave it. A single right block is
    broadcast by the planner if small enough. Several are blocks of near vectors of similar length, and
    those that cannot hold one of a left vector's best are skipped, by their balls and by their lengths.
    Vectors are stored once. Ties go to the smaller id. Exact. A null vector, or one with a null or
    non-finite cell, takes no part on either side.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    as_double = F.col("features").cast("array<double>").alias("features")
    whole = "forall(features, x -> x is not null and abs(x) < double('infinity'))"
    left = written(left.select("id", as_double).filter(whole), "left")
    right = written(right.select("id", as_double).filter(whole), "right")
    slots = left.sparkSession.sparkContext.defaultParallelism
    n_left, n_right = left.count(), right.count()
    block_rows = block_rows or min(_MOST_ROWS, max(_BLOCK_ROWS, math.ceil(n_right / _BLOCKS)))
    left_rows = min(block_rows, _BLOCK_ROWS, max(128, math.ceil(n_left / (2 * slots))))
    n_lb = max(1, math.ceil(n_left / left_rows))
    n_rb = max(1, math.ceil(n_right / block_rows))
    left_type, right_type = left.schema["id"].dataType, right.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", left_type), T.StructField("other", right_type),
        T.StructField("score", T.DoubleType())])
    arrow = pa.schema([
        ("id", _arrow_type(left_type)), ("other", _arrow_type(right_type)), ("score", pa.float64())])
    scorer = _scorer(k, exclude_self, arrow)
    if n_rb > 1:
        return _pruned(left, right, k, scorer, schema, n_lb, n_rb)
    lefts = _packed(left, n_lb, "left").select("left_rows", F.lit(0).alias("right"))
    pairs = lefts.join(_packed(right, 1, "right"), "right").select("left_rows", "right_rows")
    return pairs.mapInArrow(scorer, schema)
