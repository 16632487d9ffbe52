"""N-gram Jaccard join on a count-vector R-tree.

Shingles are hashed into groups, and a text's counts per group are a point. Two sets share at most the sum of the
smaller counts, so for a similarity of 0.9 their points differ by at most (|A| + |B|) / 19 in all coordinates
together. The tree has two parts. At its root the coordinates are dealt out to more subspaces than
that distance can touch, by size levels; two points within it coincide in one subspace at least, so
the points that coincide in a subspace are a cell, and unrelated texts, whose boxes would overlap nearly everywhere,
do not meet. Below a cell points are sort-tile-packed into boxes. The sum of the smaller of a
point's counts and a box's greatest counts bounds every overlap in it, and pairs that survive are
decided on whole shingle sets. Nothing is missed: all bounds hold for any texts.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.graph import components
from affinity.llm.negatives import leaf_order
from affinity.llm.text import WordHashes, checked_broadcast, mixed, shingle_set, words_of
from affinity.operators.skew import spread_join
from affinity.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 3
GROUPS = 512
FINE = 64  # groups of one subspace at the root
LEAF = 16
BLOCK_SHINGLES = 1 << 16
BLOCK_POINTS = 4096
_GROWTH = 1.3
_SALT = np.uint64(0xA24BAED4963EE407)


def _level_starts() -> np.ndarray:
    starts = [1, 10]  # sets of up to nine are only like equal ones
    while starts[-1] < 1 << 44:
        starts.append(max(starts[-1] + 1, int(starts[-1] * _GROWTH)))
    return np.array(starts)


STARTS = _level_starts()


def subspaces(level: int) -> tuple[int, int]:
    """Number of subspaces for pairs whose larger set is of the level, and how many a text may leave out.

    ``apart`` changes touch as many subspaces at most; ``2 * spare + 1`` more are equal, and as each text
    leaves out ``spare``, the emptiest ones, a common one stays.
    """
    apart = 2 * (int(STARTS[level + 1]) - 1) // 19
    spare = apart // 12
    return apart + 1 + 2 * spare, spare


def cells(shingles: np.ndarray, level: int) -> np.ndarray:
    """Names of the cells of a set: hashes of its counts in each subspace of the level."""
    n, spare = subspaces(level)
    x = mixed(shingles ^ _SALT)
    place = (x % np.uint64(n)).astype(np.int64)
    mass = np.bincount(place, minlength=n)
    order = np.argsort(place, kind="stable")
    sums = np.zeros(n, np.uint64)
    fine = mixed((x >> np.uint64(40)) % np.uint64(FINE) + np.uint64(1))
    held = np.nonzero(mass)[0]
    sums[held] = np.add.reduceat(fine[order], (np.cumsum(mass) - mass)[held])
    names = mixed(sums + mixed(np.arange(n, dtype=np.uint64) + np.uint64(level << 32)))
    return names[np.argsort(mass, kind="stable")[spare:]].view(np.int64)


def all_cells(shingles: np.ndarray) -> np.ndarray:
    """Cells at the set's own level, and at the next if a set of that is large enough to be like it."""
    level = int(np.searchsorted(STARTS, len(shingles), "right")) - 1
    found = [cells(shingles, level)] if level else []
    if 10 * len(shingles) >= 9 * STARTS[level + 1]:
        found.append(cells(shingles, level + 1))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def counts(shingles: np.ndarray) -> np.ndarray:
    """The point of a set."""
    return np.bincount((mixed(shingles + _SALT) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)


def _small(point: np.ndarray) -> bytes:
    return point.astype(np.min_scalar_type(int(point.max(initial=0)))).tobytes()


def _point(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // GROUPS}").astype(np.int64)


def similar(shared, a, b):
    """Whether sets of sizes ``a`` and ``b`` that share so many, or at most so many, are linked."""
    return 19 * shared >= 9 * (a + b)


def _print(found: np.ndarray) -> bytes | None:
    top = mixed(found * np.uint64(0xD6E8FEB86659FD93))
    return np.array([found.sum(), np.bitwise_xor.reduce(top)]).tobytes() if len(found) else None


def _sketches(batches):
    hashes = WordHashes()
    for batch in batches:
        sizes, prints, names = [], [], []
        for text in batch.column(1).to_pylist():
            found = shingle_set(hashes.of(words_of(text)), WORDS)
            sizes.append(len(found))
            prints.append(_print(found))
            names.append(all_cells(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
             pa.array(names, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "cells"])


def _sets(batches):
    hashes = WordHashes()
    for batch in batches:
        found = [shingle_set(hashes.of(words_of(text)), WORDS) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(f) for f in found], pa.int64()),
             pa.array([_print(f) for f in found], pa.binary()),
             pa.array([_small(counts(f)) for f in found], pa.binary()),
             pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))],
            names=["rep", "size", "print", "point", "shingles"])


def _unpacked(cell):
    rows = cell.values
    lists = rows.field("shingles")
    flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
    return (rows.field("rep").to_numpy(), rows.field("component").to_numpy(),
            [flat[a:b].view(np.uint64) for a, b in zip(ends, ends[1:])])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


class CountTree:
    """Points in sort-tile-packed leaves, each with its greatest counts and its sizes."""

    def __init__(self, points: np.ndarray):
        self.order = leaf_order(points, LEAF)
        self.points = points[self.order]
        self.sizes = self.points.sum(axis=1)
        self.starts = np.arange(0, len(points), LEAF)
        self.most = np.maximum.reduceat(self.points, self.starts)
        self.small = np.minimum.reduceat(self.sizes, self.starts)
        self.large = np.maximum.reduceat(self.sizes, self.starts)

    def near(self, point: np.ndarray) -> np.ndarray:
        """Numbers of the points whose counts allow a link."""
        size = point.sum()
        leaves = np.nonzero(
            similar(np.minimum(point, self.most).sum(axis=1), size, self.small) & (10 * self.large >= 9 * size))[0]
        if not len(leaves):
            return leaves
        at = (self.starts[leaves][:, None] + np.arange(LEAF)).ravel()
        at = at[at < len(self.sizes)]
        return self.order[at[similar(np.minimum(point, self.points[at]).sum(axis=1), size, self.sizes[at])]]


def block_links(ids, own, left: list, others, theirs, right: list):
    """Links between sets of different components, no more than join what can be joined."""
    tree, joined = CountTree(np.array([counts(s) for s in right])), {}

    def top(c):
        while c in joined:
            c = joined[c]
        return c

    for i, found in enumerate(left):
        for j in tree.near(counts(found)).tolist():
            a, b = top(int(own[i])), top(int(theirs[j]))
            if a != b and similar(_shared(found, right[j]), len(found), len(right[j])):
                joined[a] = b
                yield int(ids[i]), int(others[j])


def _links_of_blocks(batches):
    for batch in batches:
        for n in range(batch.num_rows):
            found = list(block_links(*_unpacked(batch.column(0)[n]), *_unpacked(batch.column(1)[n])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[side] for p in found], pa.int64()) for side in (0, 1)], names=["a", "b"])


def near_members(own, left: np.ndarray, theirs, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which points of both sides have a point of another component near them."""
    tree = CountTree(right)
    mine, others = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for i, point in enumerate(left):
        at = tree.near(point)
        at = at[theirs[at] != own[i]]
        mine[i], others[at] = len(at) > 0, True
    return mine, others


def _near_of_blocks(batches):
    for batch in batches:
        for n in range(batch.num_rows):
            sides = [batch.column(c)[n].values for c in (1, 2)]
            points = [np.array([_point(p) for p in s.field("point").to_pylist()]) for s in sides]
            owners = [s.field("component").to_numpy() for s in sides]
            marks = near_members(owners[0], points[0], owners[1], points[1])
            reps = np.unique(np.concatenate([s.field("rep").to_numpy()[m] for s, m in zip(sides, marks)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[n].as_py()] * len(reps), pa.int64()), pa.array(reps, pa.int64())],
                names=["group", "rep"])


def _blocks_met(held: DataFrame, weight: str, bound: int, *fields: str) -> DataFrame:
    """(group, part_rows, block_rows): blocks of a group's strays beside blocks of all its members.

    ``held`` is (group, rep, component, stray, fields). Blocks are as many as the group's weight needs, so none is
    heavier than ``bound`` by much but for one heavy row.
    """
    load = F.expr(weight)
    sums = held.groupBy("group").agg(
        F.ceil(F.sum(load) / bound).cast("int").alias("blocks"),
        F.ceil(F.sum(F.when(F.col("stray"), load)) / bound).cast("int").alias("parts"))
    placed = spread_join(held, written(sums, "blocks"), ["group"])
    row = F.collect_list(F.struct("rep", "component", *fields))

    def dealt(rows: DataFrame, mine: str, other: str, names: tuple[str, str]) -> DataFrame:
        place = F.pmod(F.xxhash64("rep"), F.col(mine)).cast("int")
        packs = rows.groupBy("group", place.alias(names[0]), F.col(other).alias("n")).agg(row.alias(f"{names[0]}_rows"))
        return packs.withColumn(names[1], F.explode(F.expr("sequence(0, n - 1)"))).drop("n")

    return spread_join(
        dealt(placed.filter("stray"), "parts", "blocks", ("part", "block")),
        dealt(placed, "blocks", "parts", ("block", "part")), ["group", "part", "block"]
    ).select("group", "part_rows", "block_rows")


def _compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets of different components among the members (group, rep, component, stray)."""
    held = written(spread_join(members, sets.select("rep", "size", "shingles"), ["rep"]), "held")
    return _blocks_met(held, "size", BLOCK_SHINGLES, "shingles").select("part_rows", "block_rows").mapInArrow(
        _links_of_blocks, "a bigint, b bigint")


def _families(near: DataFrame) -> DataFrame:
    """(group, rep): members near each other in any cell, directly or through others, as one group each."""
    least = near.groupBy("group").agg(F.min("rep").alias("a"))
    ties = spread_join(near, least, ["group"]).filter("a < rep").select("a", F.col("rep").alias("b")).distinct()
    return components(ties).select(F.col("component").alias("group"), F.col("node").alias("rep"))


def _with_strays(members: DataFrame) -> DataFrame:
    """(group, rep, component, stray): all but a group's largest component are strays; groups of one component go."""
    sizes = members.groupBy("group", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("group").agg(
        F.count("*").alias("several"), F.max(F.struct("n", "component"))["component"].alias("main")).filter("several > 1")
    return spread_join(members, largest, ["group"]).select(
        "group", "rep", "component", (F.col("component") != F.col("main")).alias("stray"))


def _strays(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(group, rep, component, stray) of what may be linked in cells that hold several components.

    All but a cell's largest component are strays. Of cells with the same members one stays. Their
    points are compared through the boxes, and members without a point of another component near them go; what
    is left meets in families, each text in one, so a whole set is carried once.
    """
    parts = placed.groupBy("group", "component").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"))
    mixed_cells = parts.groupBy("group").agg(
        F.count("*").alias("several"), F.max(F.struct("n", "component"))["component"].alias("main"),
        F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("several > 1")
    once = mixed_cells.groupBy("n", "x", "y").agg(F.min(F.struct("group", "main")).alias("c")).select("c.*")
    strays = written(spread_join(placed, once, ["group"]).select(
        "group", "rep", "component", (F.col("component") != F.col("main")).alias("stray")), "strays")
    held = written(spread_join(strays, sets.select("rep", "point"), ["rep"]), "points")
    near = _blocks_met(held, "1", BLOCK_POINTS, "point").mapInArrow(_near_of_blocks, "group bigint, rep bigint")
    owners = strays.select("rep", "component").distinct()
    return _with_strays(spread_join(_families(written(near.distinct(), "near")), owners, ["rep"]))


def ngram_join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text), linked at a 3-word similarity of 0.9.

    Documents with equal sets are one class, whose smallest id stands for it. The classes of a cell are first compared
    with the smallest one; then, in cells where several components are left, all others with each
    other. No link between components is lost, and none of the pairs inside a component is listed.

    Null and empty texts have no shingles and are their own component. Texts of fewer than three words
    are one shingle. Rows with a null id take no part; a repeated id counts once, by its text of most shingles.
    Other columns are ignored. An empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    source = source.filter("doc_id is not null")
    sketches = written(
        source.mapInArrow(_sketches, "doc_id bigint, n_shingles bigint, print binary, cells array<bigint>")
        .groupBy("doc_id").agg(F.max(F.struct("n_shingles", "print", "cells")).alias("s"))
        .select("doc_id", "s.*"), "sketches")
    classes = written(
        sketches.filter("print is not null").groupBy("print").agg(
            F.min("doc_id").alias("rep"), F.any_value("cells").alias("cells"),
            F.any_value("n_shingles").alias("size")), "classes")

    found = classes.select("rep", "size", F.explode("cells").alias("group"))
    shared = found.groupBy("group").agg(F.min(F.struct("rep", "size")).alias("first"), F.max("rep").alias("last"))
    shared = shared.filter("first.rep < last").select(
        "group", F.col("first.rep").alias("center"), F.col("first.size").alias("other"))
    members = written(spread_join(found, shared, ["group"]), "cells")
    reps = written(members.select(F.col("rep").alias("doc_id")).distinct(), "reps")
    sets = written(
        source.join(checked_broadcast(reps), "doc_id", "left_semi")
        .mapInArrow(_sets, "rep bigint, size bigint, print binary, point binary, shingles array<bigint>")
        .groupBy("rep").agg(F.max(F.struct("size", "print", "point", "shingles")).alias("s")).select("rep", "s.*"), "sets")

    first = members.filter("center < rep and least(size, other) * 10 >= greatest(size, other) * 9").select(
        F.col("center").alias("group"), "rep").distinct()
    stars = first.select("group", "rep", F.col("rep").alias("component"), F.lit(False).alias("stray")).union(
        first.select("group", F.col("group").alias("rep"), F.col("group").alias("component"), F.lit(True)).distinct())
    links = written(_compared(stars, sets), "links")
    joined = components(links)
    placed = spread_join(members.select("group", "rep"), joined.toDF("rep", "component"), ["rep"], "left").select(
        "group", "rep", F.coalesce("component", "rep").alias("component"))
    more = written(_compared(written(_strays(placed, sets), "near"), sets), "links")
    if not more.isEmpty():
        joined = components(links.union(more))

    named = spread_join(classes.select("print", "rep"), joined.toDF("rep", "component"), ["rep"], "left").select(
        "print", F.coalesce("component", "rep").alias("component"))
    return spread_join(sketches, named, ["print"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
