"""Near duplicates by circulant MinHash: banded candidates, exact Jaccard, components.

Two fixed permutations of ``POSITIONS`` positions make all coordinates: the first scatters a hashed
shingle, the second, shifted circularly by 0 .. ``COORDINATES`` - 1, ranks it. Bands of ``ROWS``
coordinates propose pairs; shingle sets of whole texts decide. A pair at similarity 0.75 shares no
band with probability (1 - 0.75^4)^32 = 5e-6, less above.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.graph import components
from affinity.llm.text import WordHashes, checked_broadcast, mixed, shingle_set, words_of
from affinity.operators.skew import spread_join
from affinity.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POSITIONS = 1 << 20
COORDINATES = 128
ROWS = 4
BANDS = COORDINATES // ROWS
_AT_ONCE = 2048
BLOCK_SETS = 512


class Circulant:
    """All coordinates of a set from two permutations."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(POSITIONS).astype(np.int32)
        ranks = rng.permutation(POSITIONS).astype(np.int32)
        ring = np.concatenate([ranks, ranks[:COORDINATES - 1]])
        self.shifted = np.lib.stride_tricks.sliding_window_view(ring, COORDINATES)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.scatter[(shingles % np.uint64(POSITIONS)).astype(np.int64)]
        best = np.full(COORDINATES, POSITIONS, np.int32)
        for start in range(0, len(at), _AT_ONCE):
            np.minimum(best, self.shifted[at[start:start + _AT_ONCE]].min(axis=0), out=best)
        return best

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        keys = self.signature(shingles).reshape(BANDS, ROWS).astype(np.uint64)
        total = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40)
        for r in range(ROWS):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + keys[:, r])
        return total.view(np.int64)


def _sketches(batches):
    hashes, circulant = WordHashes(), Circulant()
    for batch in batches:
        sizes, prints, bands = [], [], []
        for text in batch.column(1).to_pylist():
            found = shingle_set(hashes.of(words_of(text)))
            sizes.append(len(found))
            if len(found):
                top = mixed(found * np.uint64(0xD6E8FEB86659FD93))
                prints.append(np.array([found.sum(), np.bitwise_xor.reduce(top)]).tobytes())
                bands.append(circulant.bands(found))
            else:
                prints.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()),
             pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "print", "bands"])


def _similar(batches):
    hashes = WordHashes()
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        keep = []
        last_text, last_set = None, None
        for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if left != last_text:
                last_text, last_set = left, shingle_set(hashes.of(words_of(left)))
            other = shingle_set(hashes.of(words_of(right)))
            both = len(np.intersect1d(last_set, other, assume_unique=True))
            keep.append(100 * both >= 75 * (len(last_set) + len(other) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole texts have a similarity of 0.75 or more."""
    left = spread_join(pairs, texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), ["a"])
    both = spread_join(left, texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), ["b"])
    return both.select("a", "b", "left", "right").mapInArrow(_similar, "a bigint, b bigint")


def _sets(batches):
    hashes = WordHashes()
    for batch in batches:
        found = [shingle_set(hashes.of(words_of(text))).view(np.int64) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["rep", "shingles"])


def shared_counts(strays: list[np.ndarray], members: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each stray's set with each member's, by an inverted index."""
    owners = np.repeat(np.arange(len(members)), [len(m) for m in members])
    values = np.concatenate(members)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    counts = np.zeros((len(strays), len(members)), np.int64)
    for n, stray in enumerate(strays):
        low, high = np.searchsorted(values, stray), np.searchsorted(values, stray, "right")
        width = high - low
        at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
        counts[n] = np.bincount(owners[at], minlength=len(members))
    return counts


def _unpacked(cell):
    rows = cell.values
    lists = rows.field("shingles")
    flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
    return (rows.field("rep").to_numpy(), rows.field("component").to_numpy(),
            [flat[a:b] for a, b in zip(ends, ends[1:])])


def _links_of_blocks(batches):
    for batch in batches:
        for n in range(batch.num_rows):
            ids, own, strays = _unpacked(batch.column(0)[n])
            others, theirs, members = _unpacked(batch.column(1)[n])
            sizes = np.array([len(m) for m in members])
            a, b = [], []
            for i, counts in enumerate(shared_counts(strays, members)):
                near = 100 * counts >= 75 * (sizes + len(strays[i]) - counts)
                at = np.nonzero(near & (theirs != own[i]))[0]
                _, first = np.unique(theirs[at], return_index=True)  # one link to a component joins it
                a += [ids[i]] * len(first)
                b += others[at[first]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _stray_links(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different components that meet in a bucket.

    ``placed`` (band, rep, component) holds the buckets. Buckets with several components tie
    these into families; all but a family's largest component are its strays. Blocks
    of strays meet blocks of the family, and each task counts shared shingles for a pair of blocks.
    """
    mixed_bands = placed.groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").drop("high")
    ties = written(
        spread_join(placed, mixed_bands, ["band"]).select("rep", "component", "low").distinct(), "ties")
    families = components(ties.filter("low < component").select(
        F.col("low").alias("a"), F.col("component").alias("b")).distinct())
    members = written(
        spread_join(ties.select("rep", "component").distinct(), families.toDF("component", "family"), ["component"]),
        "members")
    parts = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    largest = parts.groupBy("family").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"), F.sum("n").alias("size"),
        F.max("n").alias("most"))
    # In a family of two, and in one component, nothing is left to compare.
    largest = written(largest.filter("size > 2 and size > most").withColumn(
        "blocks", F.ceil(F.col("size") / BLOCK_SETS).cast("int")).withColumn(
        "parts", F.ceil((F.col("size") - F.col("most")) / BLOCK_SETS).cast("int")), "families")
    members = spread_join(members, largest, ["family"])
    sets = texts.select(F.col("doc_id").alias("rep"), "text").mapInArrow(_sets, "rep bigint, shingles array<bigint>")
    held = written(spread_join(sets, members, ["rep"]), "sets")
    row = F.struct("rep", "component", "shingles")
    strays = (
        held.filter("component <> main").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
        .groupBy("family", "part").agg(F.collect_list(row).alias("strays"), F.first("blocks").alias("blocks"))
        .withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))))
    blocks = (
        held.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        .groupBy("family", "block").agg(F.collect_list(row).alias("members"), F.first("parts").alias("parts"))
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))))
    met = spread_join(
        strays.select("family", F.col("part").cast("int"), "block", "strays"),
        blocks.select("family", "part", F.col("block").cast("int"), "members"), ["family", "part", "block"])
    return met.select("strays", "members").mapInArrow(_links_of_blocks, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text).

    Documents with equal shingle sets are one class, whose smallest id stands for it, so copies cost
    one row each. In a bucket each class is first compared with the smallest one only. Where a bucket
    then still holds several components, shared shingles are counted block by block, so all
    links between components that the banding proposes are found without a row for each pair.

    Null and empty texts have no shingles and are their own component. Texts of fewer than five words
    are one shingle. Rows with a null id take no part; a repeated id counts once, by its larger text.
    Other columns are ignored. An empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"))
    sketches = written(
        source.filter("doc_id is not null").mapInArrow(
            _sketches, "doc_id bigint, n_shingles bigint, print binary, bands array<bigint>")
        .groupBy("doc_id").agg(F.max(F.struct("n_shingles", "print", "bands")).alias("s"))
        .select("doc_id", "s.*"), "sketches")
    classes = written(
        sketches.filter("print is not null").groupBy("print").agg(
            F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"),
            F.any_value("n_shingles").alias("size")), "classes")

    buckets = classes.select("rep", "size", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min(F.struct("rep", "size")).alias("first"), F.max("rep").alias("last"))
    shared = shared.filter("first.rep < last").select(
        "band", F.col("first.rep").alias("center"), F.col("first.size").alias("other"))
    members = written(spread_join(buckets, shared, ["band"]), "buckets")
    ids = checked_broadcast(written(members.select(F.col("rep").alias("doc_id")).distinct(), "ids"))
    texts = written(source.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.max_by("text", F.length("text")).alias("text")), "texts")
    pairs = members.filter("center < rep and least(size, other) * 100 >= greatest(size, other) * 75").select(
        F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    links = written(_linked(pairs, texts), "links")
    joined = components(links)
    placed = spread_join(members, joined.toDF("rep", "component"), ["rep"], "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("component"))
    more = written(_stray_links(placed, texts), "links")
    if not more.isEmpty():
        joined = components(links.union(more))

    found = spread_join(classes.select("print", "rep"), joined.toDF("rep", "component"), ["rep"], "left").select(
        "print", F.coalesce("component", "rep").alias("component"))
    return spread_join(sketches, found, ["print"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"))
