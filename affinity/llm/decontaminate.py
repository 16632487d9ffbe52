"""Benchmark decontamination by spaced seeds. DataFrame and SQL functions only.

A seed is the hash of the words that a fixed mask keeps out of some words in a row, so changed words at the
positions it ignores do not matter. However the words that may differ lie in a window, some seed of its masks
has none of them. Seeds of benchmark items meet seeds of documents in an equi join; each hit names an
alignment (document position minus item position), on which the words of both are compared one by one.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.text import checked_broadcast, without_ids
from affinity.operators.skew import spread_join
from affinity.session import written

# Kept positions of the masks for windows of so many words, that is items of ``WINDOW`` words or
# more, and shorter ones. For each way to change the words that ``SHARE`` lets differ, one is free of them.
MASKS = {
    13: [(0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 1, 6, 8, 9)],
    12: [(0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 1, 3, 7, 8), (0, 1, 4, 6, 7)],
    11: [(0, 1, 2, 5, 6), (0, 1, 3, 5, 6)],
    10: [(0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7)],
    9: [(0, 1, 2, 4), (0, 3, 4, 5)],
    8: [(0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 5, 6)],
    7: [(0, 1, 3, 4)],
    6: [(0, 1, 2, 3), (0, 1, 3, 4)],
    5: [(0, 1, 2), (0, 1, 3)],
    4: [(0, 1, 2), (0, 1, 3), (0, 2, 3)],
    3: [(0, 1, 2)],
    2: [(0, 1)],
    1: [(0,)],
}
WINDOW = 13
SHARE = 0.75


def word_hashes(text: Column) -> Column:
    """Hashes of lower-cased words; signs and marks between words do not count."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed_rows(df: DataFrame, keep: list[str], masks: list[tuple]) -> DataFrame:
    """(keep, seed, at): a seed of each mask at each position of the word hashes ``h``."""
    def of_mask(mask: tuple) -> Column:
        def seed(at):
            kept = F.xxhash64(F.lit(sum(1 << k for k in mask)), *[F.get("h", at + k) for k in mask])
            return F.when(at + mask[-1] < F.size("h"), kept)
        return F.transform(F.sequence(F.lit(0), F.size("h") - 1), seed)

    # One pass over the texts: the masks' seeds stand one after the other.
    some = df.filter(F.size("h") > 0).withColumn("places", F.size("h"))
    each = some.select(*keep, "places", F.posexplode(F.concat(*[of_mask(m) for m in masks])).alias("at", "seed"))
    return each.filter("seed is not null").select(*keep, "seed", (F.col("at") % F.col("places")).alias("at"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words, n_equal): one row for each document (doc_id, text)
    and item (item_id, text) that overlap.

    They overlap where, on one alignment, some ``WINDOW`` words in a row of the item (all of a shorter one)
    have at least ``SHARE`` equal words. The row gives the best window: where it starts in both, its length
    and its equal words; ties go to the earliest in the document, then in the item.

    Null or empty texts overlap nothing. Rows with null ids take no part; rows that repeat an id each count
    as texts of that id. Other columns are ignored. Empty tables give no rows.
    """
    items = written(
        benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), word_hashes(F.col("text")).alias("b"))
        .filter("item_id is not null").filter(F.size("b") > 0).distinct()
        .withColumn("copy", F.xxhash64("b")), "items")
    length = F.least(F.size("b"), F.lit(WINDOW))
    # At most WINDOW values; documents need the masks of these alone.
    lengths = sorted(r.n for r in items.select(length.alias("n")).distinct().collect()) or [WINDOW]
    seeds = [_seed_rows(items.filter(length == n).withColumnRenamed("b", "h"), ["item_id", "copy"], MASKS[n])
             for n in lengths]
    wanted = checked_broadcast(written(
        reduce(DataFrame.unionByName, seeds).withColumnRenamed("at", "item_at"), "item-seeds"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null")
    hashed = texts.select("doc_id", word_hashes(F.col("text")).alias("h"))
    hits = (
        _seed_rows(hashed, ["doc_id"], sorted({m for n in lengths for m in MASKS[n]})).join(wanted, "seed")
        .select("doc_id", "item_id", "copy", (F.col("at") - F.col("item_at")).alias("shift")))
    hits = written(hits.distinct(), "alignments")
    found = checked_broadcast(written(hits.select("doc_id").distinct(), "hit-documents"))
    bodies = written(
        texts.join(found, "doc_id", "left_semi").select("doc_id", word_hashes(F.col("text")).alias("h")), "hit-words")
    pairs = spread_join(
        spread_join(hits, bodies, ["doc_id"]), items, ["item_id", "copy"])
    equal = F.transform("b", lambda w, at: F.when(
        (at + F.col("shift") >= 0) & (F.get("h", F.col("shift") + at) == w), 1).otherwise(0))
    width = F.least(F.size("b"), F.lit(WINDOW))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("b") - F.col("width")),
        lambda at: F.struct(
            F.aggregate(F.slice("equal", at + 1, F.col("width")), F.lit(0), lambda a, x: a + x).alias("n_equal"),
            (-at).alias("order")))
    best = (
        pairs.select("doc_id", "item_id", "shift", "b", equal.alias("equal"), width.alias("width"))
        .select("doc_id", "item_id", "shift", "width", F.array_max(windows).alias("w"))
        .filter(F.col("w.n_equal") >= SHARE * F.col("width")))
    rows = best.select(
        "doc_id", "item_id",
        F.struct(
            F.col("w.n_equal").alias("n_equal"), (F.col("w.order") - F.col("shift")).alias("doc_order"),
            F.col("w.order").alias("order"), F.col("width").alias("n_words")).alias("w"))
    return rows.groupBy("doc_id", "item_id").agg(F.max("w").alias("w")).select(
        "doc_id", "item_id", (-F.col("w.doc_order")).cast("bigint").alias("doc_word"),
        (-F.col("w.order")).cast("bigint").alias("item_word"), F.col("w.n_words").cast("bigint").alias("n_words"),
        F.col("w.n_equal").cast("bigint").alias("n_equal"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item, with all their columns; rows with a null id stay."""
    return without_ids(docs, contaminated(docs, benchmark), "contaminated")
