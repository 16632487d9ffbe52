"""Joins and windows that stay exact and balanced when one group holds much of the table."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.session import written

TASK_ROWS = 1 << 12  # of smaller pieces, a task holds several


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which adaptive execution can split a hot key.

    It splits only partitions that were exchanged for the join itself. A side already
    partitioned by the keys, as after an aggregate, would be joined as it lies, hot
    partition and all. A bit of the keys' hash as one more equal key makes both sides move; a whole hash would be
    most of a narrow row.
    """
    place = F.xxhash64(*keys).bitwiseAND(1)
    joined = left.withColumn("_place", place).join(
        right.withColumn("_place", place), [*keys, "_place"], how)
    return joined.drop("_place")


def hot_groups(df: DataFrame, keys: list[str], rows_per_chunk: int) -> DataFrame:
    """(keys, pieces) of the groups above ``rows_per_chunk`` rows, written once.

    Counts combine before the shuffle. The result has at most ``rows / rows_per_chunk``
    rows; whether a join on it broadcasts is left to the planner, which knows its size.
    """
    hot = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_chunk)
        .select(*keys, F.ceil(F.col("_n") / rows_per_chunk).cast("int").alias("_pieces"))
    )
    return written(hot, "hot-groups")


def hot_chunks(
    df: DataFrame, keys: list[str], order: list[str], value: str, hot: DataFrame, rows_per_chunk: int = TASK_ROWS,
) -> DataFrame:
    """The rows of hot groups with ``_tie`` and ``_chunk``: pieces of range partitions of keys and order.

    The whole order and a hash of order and value place a row, so rows that share the first order column,
    or all of them, still spread; only rows equal in the value too stay together. Pieces of fewer than
    ``TASK_ROWS`` rows do not get a partition each: a partition takes about that many rows and is cut along its
    order, so the number of tasks follows the rows, not the pieces. The table is written, which fixes the chunks.
    """
    pieces = hot.agg(F.sum("_pieces")).first()[0]
    several = rows_per_chunk < TASK_ROWS
    parts = -(-int(pieces) * rows_per_chunk // TASK_ROWS) if several else int(pieces)
    placed = df.join(hot.select(*keys), keys, "left_semi").withColumn("_tie", F.xxhash64(value, *order))
    placed = placed.repartitionByRange(max(2, parts), *keys, *order, "_tie")
    if several:
        # The id numbers the rows of a partition as they are sorted, below the partition's own number.
        chunk = F.expr(f"(_row >> 33 << 33) + (_row & {(1 << 33) - 1}) div {rows_per_chunk}")
        placed = placed.sortWithinPartitions(*keys, *order, "_tie").withColumn(
            "_row", F.monotonically_increasing_id()).withColumn("_chunk", chunk).drop("_row")
    else:
        placed = placed.withColumn("_chunk", F.spark_partition_id())
    return written(placed, "hot-rows")


def lag_in_groups(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
    rows_per_chunk: int = 50_000_000,
) -> DataFrame:
    """``lag(value) over (partition by keys order by order)`` that splits hot groups.

    Ordinary groups take the plain window. A hot group is cut along its whole order into
    pieces of about ``rows_per_chunk`` rows, each windowed by its own task; the first
    row of a piece then takes the last value of the piece before it. That carry table
    has one row per piece of a hot group, about ``rows / rows_per_chunk``.
    """
    plain = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    hot = hot_groups(df, keys, rows_per_chunk)
    if hot.isEmpty():
        return df.withColumn(out, plain)
    cold = df.join(hot.select(*keys), keys, "left_anti").select(*df.columns, plain.alias(out))
    chunked = hot_chunks(df, keys, order, value, hot, rows_per_chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order, "_tie")
    local = (
        chunked.withColumn(out, F.lag(value).over(w))
        .withColumn("_head", F.row_number().over(w) == 1)
    )
    tails = chunked.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(value), F.struct(*order, "_tie")).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carry = tails.select(
        *keys, "_chunk", F.lag("_tail").over(across)[value].alias("_carry")
    ).filter(F.col("_carry").isNotNull())
    same = reduce(
        lambda a, b: a & b, [F.col(f"l.{c}") == F.col(f"c.{c}") for c in [*keys, "_chunk"]]
    ) & F.col("l._head")
    joined = local.alias("l").join(carry.alias("c"), same, "left")
    return cold.unionByName(joined.select(
        *[F.col(f"l.{c}") for c in df.columns],
        F.coalesce(F.col(f"l.{out}"), F.col("c._carry")).alias(out),
    ))
