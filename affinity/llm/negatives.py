"""Hard negatives: integer inner products searched through STR-packed R-trees.

Vectors of one length and label are packed into tiles of at most about ``TILE_ROWS``, by sorting along the
coordinates of greatest variance and cutting into slabs. A tile is an R-tree: leaves of ``LEAF_ROWS``
vectors, nodes of ``NODE_LEAVES`` leaves, each with the box that bounds it. Box and query give an interval
of inner products, coordinate by coordinate. A queue takes boxes best first and drops those outside
all score windows of the query, or strictly below the k-th score found. The boxes of whole tiles are
a table that tells which tiles a query must visit: first the best one, then what its scores leave over.
"""

import heapq
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

TILE_ROWS = 8192
LEAF_ROWS = 32
NODE_LEAVES = 16
PACK_ROWS = 256
CHUNK_TILES = 1024
_AXES = 3
_SLABS = 32
#: No product of two vectors within this bound, nor 100 times it, leaves 64 bits.
_LIMIT = 2.0 ** 56

_WINDOW = "struct<key:bigint,low:bigint,high:bigint,floor:bigint>"
_QUERY = f"struct<anchor:bigint,label:bigint,q:array<bigint>,windows:array<{_WINDOW}>>"
_ROUTES = f"tile string, queries array<{_QUERY}>"
_FOUND = "anchor bigint, key bigint, vec_id bigint, score bigint"
_LEAST, _MOST = -(1 << 62), 1 << 62


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q, dims): each component x as floor(256 * x), one row for each id.

    Out: null ids and labels, null and empty vectors, null and non-finite components, and vectors with components
    so great that a product could leave 64 bits. Rows that repeat an id count once, by the least label and vector.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = ("vec_id is not null and label is not null and size(x) > 0 and forall(x, v -> v is not null and "
              f"abs(v) < double('infinity')) and size(x) * pow(256 * array_max(transform(x, v -> abs(v))) + 1, 2) < {_LIMIT}D")
    usable = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("x")
    ).filter(finite).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * 256)).alias("q"))
    return usable.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select(
        "vec_id", "r.label", "r.q", F.size("r.q").alias("dims"))


def leaf_order(rows: np.ndarray, leaf: int = LEAF_ROWS) -> np.ndarray:
    """Sort-tile-recursive order: runs of ``leaf`` rows are the leaves."""
    axes = np.argsort(-rows.var(axis=0), kind="stable")[:_AXES]

    def tiled(at: np.ndarray, level: int):
        pages = math.ceil(len(at) / leaf)
        if pages <= 1:
            return [at]
        at = at[np.argsort(rows[at, axes[level]], kind="stable")]
        left = len(axes) - level
        if left == 1:
            return [at]
        size = leaf * math.ceil(pages / math.ceil(pages ** (1 / left)))
        return [part for n in range(0, len(at), size) for part in tiled(at[n:n + size], level + 1)]

    return np.concatenate(tiled(np.arange(len(rows)), 0))


class RTree:
    """Leaves and nodes with boxes over rows that lie in leaf order."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.reach = ids, int(np.abs(rows).max(initial=0))
        self.raw = rows.astype(np.int64)
        starts = np.arange(0, len(rows), LEAF_ROWS)
        low, high = np.minimum.reduceat(self.raw, starts), np.maximum.reduceat(self.raw, starts)
        self.starts = np.append(starts, len(rows))
        nodes = np.arange(0, len(starts), NODE_LEAVES)
        self.first = np.append(nodes, len(starts))
        self.boxes = np.concatenate([low, np.minimum.reduceat(low, nodes)]), np.concatenate(
            [high, np.maximum.reduceat(high, nodes)])
        self.leaves = len(starts)
        self.fast = self.raw.astype(np.float64), *(b.astype(np.float64) for b in self.boxes)

    def of_type(self, queries: np.ndarray):
        """Rows and boxes as doubles where all sums stay exact, else as integers."""
        exact = self.raw.shape[1] * self.reach * int(np.abs(queries).max(initial=0)) < 1 << 53
        return (*self.fast, queries.astype(np.float64)) if exact else (self.raw, *self.boxes, queries)


def bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray):
    """Least and greatest inner product of each query with each box."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


class Best:
    """The best ``k`` rows of each score window of one query; ties go to the smaller id."""

    def __init__(self, low, high, floor, k: int):
        self.low, self.high, self.k = low, high, k
        self.kth = np.maximum(floor, low)
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(low)

    def wants(self, least, most):
        """Whether a box of these bounds can hold a row for a window."""
        return ((np.asarray(most)[..., None] >= self.kth) & (np.asarray(least)[..., None] <= self.high)).any(axis=-1)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for w in range(len(self.low)):
            fits = (scores >= self.kth[w]) & (scores <= self.high[w])
            if not fits.any():
                continue
            i = np.concatenate([self.kept[w][0], ids[fits]])
            s = np.concatenate([self.kept[w][1], scores[fits]])
            best = np.lexsort((i, -s))[:self.k]
            self.kept[w] = i[best], s[best]
            if len(best) == self.k:
                self.kth[w] = max(self.kth[w], int(s[best[-1]]))


def search_tree(tree: RTree, query: np.ndarray, least, most, rows: np.ndarray, own: int, best: Best) -> int:
    """Fills ``best`` with a best-first walk of the tree; returns how many leaves it read.

    ``least`` and ``most`` bound the products of ``query`` with all leaves, then all nodes.
    """
    top, read = int(best.high.max()), 0
    queue = [(-min(most[tree.leaves + n], top), tree.leaves + n) for n in np.nonzero(
        best.wants(least[tree.leaves:], most[tree.leaves:]))[0].tolist()]
    heapq.heapify(queue)
    while queue:
        taken = []
        while queue and len(taken) < 8:
            box = heapq.heappop(queue)[1]
            if not best.wants(least[box], most[box]):
                continue
            if box < tree.leaves:
                taken.append(box)
                continue
            a, b = tree.first[box - tree.leaves:box - tree.leaves + 2]
            for leaf in (np.nonzero(best.wants(least[a:b], most[a:b]))[0] + a).tolist():
                heapq.heappush(queue, (-min(most[leaf], top), leaf))
        if taken:
            read += len(taken)
            at = np.concatenate([np.arange(tree.starts[t], tree.starts[t + 1]) for t in taken])
            at = at[tree.ids[at] != own]
            best.add(tree.ids[at], (rows[at] @ query).astype(np.int64))
    return read


def _queries(cell):
    """Struct array of a pack of queries, its vectors, labels, and windows with their owners' ends."""
    packed = cell.values
    flat = packed.field("q").flatten().to_numpy()
    windows = packed.field("windows")
    ends = np.cumsum([0, *windows.value_lengths().to_pylist()])
    parts = {n: windows.flatten().field(n).to_numpy() for n in ("key", "low", "high", "floor")}
    return packed, flat.reshape(len(packed), -1), packed.field("label").to_numpy(), ends, parts


def _box_rows(values, name: str) -> np.ndarray:
    return values.field(name).flatten().to_numpy().reshape(len(values), -1)


def _router(same: bool, k: int, first: bool):
    """Which tiles a query must visit: the best of each chunk of tiles, or after that all others still wanted."""
    def route(batches):
        schema = None
        for batch in batches:
            for n in range(batch.num_rows):
                packed, q, labels, ends, windows = _queries(batch.column(0)[n])
                boxes = batch.column(1)[n].values
                low, high = _box_rows(boxes, "low"), _box_rows(boxes, "high")
                reach = max(int(np.abs(low).max()), int(np.abs(high).max())) * int(np.abs(q).max(initial=0))
                if q.shape[1] * reach < 1 << 53:
                    low, high, q = low.astype(np.float64), high.astype(np.float64), q.astype(np.float64)
                least, most = bounds(low, high, q)
                mine = labels[:, None] == boxes.field("label").to_numpy()[None, :]
                allowed = mine if same else ~mine
                wanted = np.zeros_like(allowed)
                for i in range(len(q)):
                    w = slice(ends[i], ends[i + 1])
                    if ends[i] == ends[i + 1] or not allowed[i].any():
                        continue
                    reached = np.where(allowed[i], np.minimum(most[i], windows["high"][w].max()), -np.inf)
                    best = Best(windows["low"][w], windows["high"][w], windows["floor"][w], k)
                    fits = best.wants(least[i], most[i]) & allowed[i]
                    leading = np.arange(len(low)) == int(np.argmax(reached))
                    wanted[i] = fits & (leading if first else ~leading)
                names = boxes.field("tile")
                for t in np.nonzero(wanted.any(axis=0))[0].tolist():
                    some = packed.take(pa.array(np.nonzero(wanted[:, t])[0]))
                    out = pa.RecordBatch.from_arrays([
                        pa.array([names[t].as_py()], pa.string()),
                        pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)], names=["tile", "queries"])
                    yield out
    return route


def _visitor(k: int):
    def visit(batches):
        for batch in batches:
            trees = {}
            for n in range(batch.num_rows):
                packed, q, _, ends, windows = _queries(batch.column(0)[n])
                name = batch.column(1)[n].as_py()
                if name not in trees:
                    ids = np.frombuffer(batch.column(2)[n].as_py(), np.int64)
                    rows = np.frombuffer(batch.column(3)[n].as_py(), np.int64).reshape(len(ids), -1)
                    trees = {name: RTree(ids, rows)}
                tree = trees[name]
                rows, low, high, q = tree.of_type(q)
                least, most = bounds(low, high, q)
                anchors = packed.field("anchor").to_numpy()
                out = [[], [], [], []]
                for i, anchor in enumerate(anchors.tolist()):
                    w = slice(ends[i], ends[i + 1])
                    best = Best(windows["low"][w], windows["high"][w], windows["floor"][w], k)
                    search_tree(tree, q[i], least[i], most[i], rows, anchor, best)
                    for key, (ids, scores) in zip(windows["key"][w].tolist(), best.kept):
                        for column, values in zip(out, ([anchor] * len(ids), [key] * len(ids), ids.tolist(), scores.tolist())):
                            column += values
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, pa.int64()) for column in out], names=["anchor", "key", "vec_id", "score"])
    return visit


def _tile(batches):
    for batch in batches:
        for n in range(batch.num_rows):
            members = batch.column(3)[n].values
            ids = members.field("vec_id").to_numpy()
            rows = members.field("q").flatten().to_numpy().reshape(len(ids), -1)
            first = np.argsort(ids)  # the order of collected rows must not matter
            ids, rows = ids[first], rows[first]
            order = leaf_order(rows)
            ids, rows = ids[order], np.ascontiguousarray(rows[order])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(n, 1), batch.column(1).slice(n, 1), batch.column(2).slice(n, 1),
                pa.array([ids.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary()),
                pa.array([rows.min(axis=0)], pa.list_(pa.int64())), pa.array([rows.max(axis=0)], pa.list_(pa.int64()))],
                names=["dims", "label", "tile", "ids", "vectors", "low", "high"])


def _moments(batches):
    for batch in batches:
        sums = {}
        for dims, q in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = np.asarray(q.values.to_numpy(), np.float64)
            held = sums.setdefault(dims, [0, np.zeros(dims), np.zeros(dims)])
            held[0] += 1
            held[1] += v
            held[2] += v * v
        yield pa.RecordBatch.from_arrays([
            pa.array(sums.keys(), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()),
            pa.array([s[1] for s in sums.values()], pa.list_(pa.float64())),
            pa.array([s[2] for s in sums.values()], pa.list_(pa.float64()))], names=["dims", "n", "total", "squares"])


def _axes(points: DataFrame) -> DataFrame:
    """(dims, axes): the coordinates of greatest variance over all vectors of a length."""
    parts = points.select("dims", "q").mapInArrow(
        _moments, "dims int, n bigint, total array<double>, squares array<double>")
    cells = parts.select("dims", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("axis", "m"))
    spread = cells.groupBy("dims", "axis").agg(
        (F.sum("m.squares") / F.sum("n") - F.pow(F.sum("m.total") / F.sum("n"), 2)).alias("variance"))
    return spread.groupBy("dims").agg(F.slice(F.transform(F.reverse(F.array_sort(F.collect_list(
        F.struct("variance", "axis")))), lambda a: a["axis"]), 1, _AXES).alias("axes"))


def packed_tiles(points: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(dims, label, tile, ids, vectors, low, high): points in tiles of one length and label.

    A group of more than ``tile_rows`` is cut into slabs along one coordinate after the other, at quantiles of all
    its rows. Equal coordinates can leave a tile too full; such a one is cut by a hash of the id.
    """
    group = ["dims", "label"]
    sizes = written(points.groupBy(*group).agg(F.count("*").alias("n")), "sizes")
    placed = points.withColumn("path", F.lit(0).cast("bigint"))
    if not sizes.filter(F.col("n") > tile_rows).isEmpty():
        slabs = F.least(F.ceil(F.pow(F.col("n") / tile_rows, F.lit(1 / _AXES))), F.lit(_SLABS))
        plan = sizes.filter(F.col("n") > tile_rows).join(written(_axes(points), "axes"), "dims").select(
            *group, "axes", slabs.alias("slabs"))
        placed = spread_join(placed, plan, group, "left")
        grid = ", ".join(f"{i / _SLABS}D" for i in range(1, _SLABS))
        for level in range(_AXES):
            placed = placed.withColumn("at", F.get("q", F.get("axes", F.lit(level))))
            cuts = written(placed.filter("at is not null").groupBy(*group, "path").agg(
                F.expr(f"percentile_approx(at, array({grid}), 10000)").alias("cuts")), "cuts")
            slab = F.floor(F.size(F.filter("cuts", lambda c: c <= F.col("at"))) * F.col("slabs") / _SLABS)
            placed = spread_join(placed, cuts, [*group, "path"], "left").withColumn(
                "path", F.col("path") * _SLABS + F.coalesce(slab, F.lit(0)).cast("bigint")).drop("cuts")
        placed = written(placed.select(*points.columns, "path"), "placed")
    full = written(placed.groupBy(*group, "path").agg(
        F.ceil(F.count("*") / tile_rows).alias("pieces")), "tiles")
    piece = F.pmod(F.xxhash64("vec_id"), F.col("pieces"))
    tiles = spread_join(placed, full, [*group, "path"]).withColumn(
        "tile", F.concat_ws("/", "dims", "label", "path", piece))
    return written(
        tiles.groupBy("dims", "label", "tile").agg(F.collect_list(F.struct("vec_id", "q")).alias("members"))
        .mapInArrow(_tile, "dims int, label bigint, tile string, ids binary, vectors binary, "
                           "low array<bigint>, high array<bigint>"), "packed")


def search(queries: DataFrame, tiles: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, key, vec_id, score): the best ``k`` rows of each window of each query.

    ``queries`` is (anchor, label, q, dims, windows), ``tiles`` of ``packed_tiles``. Rows of the query's own label, or
    of all others, are looked through; the query's own id is left out. Exact: tiles that are
    not visited have no product in a window, or only ones below the k-th found in the first visit.
    """
    n_chunks = max(1, math.ceil(tiles.count() / CHUNK_TILES))
    chunks = tiles.withColumn("chunk", F.pmod(F.xxhash64("tile"), F.lit(n_chunks)).cast("int")).groupBy(
        "dims", "chunk").agg(F.array_sort(F.collect_list(F.struct("tile", "label", "low", "high"))).alias("boxes"))
    chunks = written(chunks, "boxes")
    best = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "vec_id")

    def visit(asked: DataFrame, first: bool) -> DataFrame:
        n_parts = max(1, math.ceil(asked.count() / PACK_ROWS))
        packs = asked.groupBy("dims", F.pmod(F.xxhash64("anchor"), F.lit(n_parts)).alias("part")).agg(
            F.collect_list(F.struct("anchor", "label", "q", "windows")).alias("queries"))
        packs = packs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
        routes = spread_join(packs, chunks, ["dims", "chunk"]).select("queries", "boxes").mapInArrow(
            _router(same, k, first), _ROUTES)
        met = spread_join(written(routes, "routes"), tiles.select("tile", "ids", "vectors"), ["tile"])
        found = met.select("queries", "tile", "ids", "vectors").mapInArrow(_visitor(k), _FOUND)
        return written(found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n"), "found")

    once = visit(queries, True)
    floors = once.groupBy("anchor", "key").agg(F.count("*").alias("n"), F.min("score").alias("kth")).filter(
        F.col("n") == k).select("anchor", "key", "kth")
    opened = queries.select("anchor", "label", "q", "dims", F.explode("windows").alias("w")).withColumn("key", F.col("w.key"))
    raised = spread_join(opened, floors, ["anchor", "key"], "left").groupBy("anchor").agg(
        F.first("label").alias("label"), F.first("q").alias("q"), F.first("dims").alias("dims"),
        F.collect_list(F.struct("key", "w.low", "w.high", F.coalesce("kth", "w.floor").alias("floor"))).alias("windows"))
    more = visit(written(raised, "queries"), False)
    return once.union(more).withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def _share(percent: int, up: bool) -> str:
    part = f"{percent} * score"
    return f"{part} div 100 + if({part} % 100 > 0, 1, 0)" if up else f"{part} div 100 - if({part} % 100 < 0, 1, 0)"


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` is (vec_id, label, embedding), ``anchors`` (vec_id). Components become floor(256 * x); a score is the
    integer inner product. An anchor's positives are its ``positives`` best rows of its label; for each, the ``negatives``
    best rows of other labels between ``low`` and ``high`` percent of the positive's score are returned.
    Ties go to the smaller id. All comparisons are of integers, and exact.

    What takes no part is said at ``quantised``; vectors of different lengths are not compared. Anchors that take no
    part, or have no positives, and positives without negatives give no rows. Other columns are ignored, and
    empty tables give no rows.
    """
    points = written(quantised(vectors), "points")
    tiles = packed_tiles(points, tile_rows)
    asked = points.join(anchors.select(F.col("vec_id").cast("bigint").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = written(asked.select(F.col("vec_id").alias("anchor"), "label", "q", "dims"), "anchors")
    whole = F.array(F.struct(
        F.lit(0).cast("bigint").alias("key"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"),
        F.lit(_LEAST).alias("floor")))
    best = written(search(asked.withColumn("windows", whole), tiles, positives, True), "positives")
    between = best.select("anchor", F.struct(
        F.col("vec_id").alias("key"), F.expr(_share(low, True)).alias("low"), F.expr(_share(high, False)).alias("high"),
        F.lit(_LEAST).alias("floor")).alias("w")).filter("w.low <= w.high")
    wanted = spread_join(asked, between.groupBy("anchor").agg(F.collect_list("w").alias("windows")), ["anchor"])
    found = search(written(wanted, "queries"), tiles, negatives, False)
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).withColumnsRenamed(
        {"vec_id": "negative_id", "score": "negative_score"})
    chosen = best.select("anchor", F.col("vec_id").alias("key"), F.col("score").alias("positive_score"))
    return spread_join(ranked, chosen, ["anchor", "key"]).select(
        F.col("anchor").alias("anchor_id"), F.col("key").alias("positive_id"), "rank", "negative_id",
        "positive_score", "negative_score")
