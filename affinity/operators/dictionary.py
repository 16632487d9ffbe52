"""Dense term indexes and the column layout built from them."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.schemas import BLOCKS, DAYS, HOURS
from affinity.session import written

_ROW_BITS = 33  # monotonically_increasing_id keeps the row position in its lower 33 bits


def dense_index(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """Number the rows of ``df`` 0..n-1 in the order of ``order`` without one global sort.

    One range shuffle puts the rows in order across partitions; each row keeps its
    partition and position, written once to the shared folder. Offsets come from one
    count per partition; that list, as long as the number of partitions, is all the
    driver sees and what gets broadcast.
    """
    place = F.monotonically_increasing_id()
    placed = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place),
        "index",
    )
    part = F.shiftright("_place", _ROW_BITS)
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, before = [], 0
    for c in sorted(counts, key=lambda c: c.part):
        offsets.append((c.part, before))
        before += c.n
    table = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .select(*df.columns, (F.col("_offset") + row).cast("int").alias(out))
    )


def distinct_terms(df: DataFrame, col: str) -> DataFrame:
    """A1: the distinct non-null values of a column, deduplicated before the shuffle."""
    return df.select(F.col(col).cast("string").alias("term")).filter("term is not null").distinct()


def build_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(term, idx), dense from 0 in term order."""
    return dense_index(distinct_terms(df, col), ["term"])


def build_dictionaries(df: DataFrame, cols: list[str]) -> list[DataFrame]:
    """S7 for several columns in one pass over ``df`` and one range shuffle."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("n"), F.col(c).cast("string").alias("term"))
        for i, c in enumerate(cols)])
    terms = df.select(F.inline(cells)).filter("term is not null").distinct()
    indexed = dense_index(terms, ["n", "term"])
    first = {r.n: r.first for r in indexed.groupBy("n").agg(F.min("idx").alias("first")).collect()}
    return [
        indexed.filter(F.col("n") == i).select("term", (F.col("idx") - first.get(i, 0)).alias("idx"))
        for i in range(len(cols))]


def encode(df: DataFrame, dictionary: DataFrame, col: str, out: str) -> DataFrame:
    """Replace-or-add the index of a term; rows with an unknown term drop out.

    Left without a hint: adaptive execution broadcasts a dictionary it measures as
    small and splits the partitions of a hot term otherwise.
    """
    d = dictionary.select(F.col("term").alias("_term"), F.col("idx").alias(out))
    return df.join(d, F.col(col).cast("string") == F.col("_term")).drop("_term")


def decode(df: DataFrame, dictionary: DataFrame, col: str, out: str) -> DataFrame:
    """Index back to its term."""
    d = dictionary.select(F.col("idx").alias("_idx"), F.col("term").alias(out))
    return df.join(d, F.col(col) == F.col("_idx")).drop("_idx")


def feature_layout(users: DataFrame, items: DataFrame, events: DataFrame) -> DataFrame:
    """(col, block, term) for the blocks of a feature vector, in vector order.

    The three arguments are dictionaries; their sizes give the block offsets.
    """
    spark = users.sparkSession
    named = [d.select(F.lit(n).alias("n")) for n, d in enumerate((users, items, events))]
    sizes = {r.n: r["count"] for r in reduce(DataFrame.union, named).groupBy("n").count().collect()}
    n_users, n_items, n_events = (sizes.get(n, 0) for n in range(3))
    days = spark.range(DAYS).select(F.col("id").cast("string").alias("term"), F.col("id").alias("idx"))
    hours = spark.range(HOURS).select(F.col("id").cast("string").alias("term"), F.col("id").alias("idx"))
    parts = {
        "user": (users, n_users), "item": (items, n_items), "rated": (items, n_items),
        "day": (days, DAYS), "hour": (hours, HOURS), "event": (events, n_events),
        "related": (items, n_items),
    }
    layout, offset = None, 0
    for block in BLOCKS:
        terms, width = parts[block]
        rows = terms.select(
            (F.col("idx") + offset).cast("int").alias("col"), F.lit(block).alias("block"), "term")
        layout = rows if layout is None else layout.unionByName(rows)
        offset += width
    return layout


def block_of(layout: DataFrame, block: str) -> DataFrame:
    """The terms of one block: (term, col)."""
    return layout.filter(F.col("block") == block).select("term", "col")
