"""Feature points in long, sparse and dense form, and their filters."""

from collections.abc import Mapping
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.functions.arrays import one_hot_position
from affinity.operators.dictionary import block_of
from affinity.operators.skew import spread_join
from affinity.schemas import BLOCKS, CONTEXT_COLS, DAYS, HOURS
from affinity.session import written
from affinity.validation import check_columns

# The single-valued blocks and the columns they come from.
SINGLE_BLOCKS = {
    "user": "user", "item": "item", "day": "dayOfweek", "hour": "hourOfday",
    "event": "event", "related": "related",
}


def block_widths(layout: DataFrame) -> dict[str, int]:
    """A3: number of columns per block; at most seven rows reach the driver."""
    return {r.block: r.n for r in layout.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}


def encode_context(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """Add the feature column of each single-valued block: user_col, item_col, ...

    Rows with an unknown user, item or context term drop out; a missing related item
    stays, with a null column.
    """
    out = rows
    for block, source in SINGLE_BLOCKS.items():
        terms = block_of(layout, block).select(
            F.col("term").alias("_term"), F.col("col").alias(f"{block}_col"))
        how = "left" if block == "related" else "inner"
        out = out.join(terms, F.col(source).cast("string") == F.col("_term"), how).drop("_term")
    return out.filter("related is null or related_col is not null")


def _rated_cols(rated: DataFrame, layout: DataFrame) -> DataFrame:
    terms = block_of(layout, "rated").withColumnRenamed("term", "item")
    return rated.join(terms, "item").select("site", "user", "col", "value")


def assemble_features(
    rows: DataFrame, layout: DataFrame, rated: DataFrame, row_id: str = "event_id"
) -> DataFrame:
    """F4 in long form: (row_id, col, val), only the cells that are not zero.

    Every row repeats its user's rated cells, as the feature vector does; scoring by
    ``score_context`` sums them once per user instead.
    """
    coded = encode_context(rows, layout)
    cells = F.array(*[
        F.struct(F.col(f"{b}_col").alias("col"), F.lit(1.0).alias("val")) for b in SINGLE_BLOCKS])
    single = coded.select(F.col(row_id).alias("row_id"), F.inline(cells)).filter("col is not null")
    multi = (
        spread_join(
            coded.select("site", "user", F.col(row_id).alias("row_id")),
            _rated_cols(rated, layout), ["site", "user"])
        .select("row_id", "col", F.col("value").alias("val"))
    )
    return single.unionByName(multi)


def _rated_arrays(layout: DataFrame, rated: DataFrame) -> DataFrame:
    """(site, user, rated): each user's rated columns and values, sorted by column.

    One array per user, as long as the number of items the user rated.
    """
    return (
        _rated_cols(rated, layout).groupBy("site", "user")
        .agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("rated"))
    )


def sparse_points(
    rows: DataFrame, layout: DataFrame, rated: DataFrame, width: int, row_id: str = "event_id"
) -> DataFrame:
    """F4 as ``pyspark.ml`` sparse vectors: (row_id, target, features).

    Blocks follow each other in column order, so concatenating them keeps the indices
    sorted. The vector is read from its own JSON form, which stays in the JVM.
    """
    coded = spread_join(
        encode_context(rows, layout), _rated_arrays(layout, rated), ["site", "user"], "left")
    cells = F.coalesce(F.col("rated"), F.array().cast("array<struct<col:int,value:double>>"))
    return coded.select(
        F.col(row_id).alias("row_id"), F.col("score").alias("target"),
        _vector(cells["col"], cells["value"], width).alias("features"))


def _vector(rated: Column, values: Column, width: int) -> Column:
    """The sparse vector of a row of ``encode_context`` and its user's rated columns and values."""
    one = F.lit(1.0)
    related = F.when(F.col("related_col").isNotNull(), F.array("related_col")).otherwise(
        F.array().cast("array<int>"))
    indices = F.concat(F.array("user_col", "item_col"), rated, F.array("day_col", "hour_col", "event_col"), related)
    values = F.concat(
        F.array(one, one), values, F.array(one, one, one), F.transform(related, lambda _: F.lit(1.0)))
    vector = F.struct(
        F.lit(0).alias("type"), F.lit(width).alias("size"),
        indices.alias("indices"), values.alias("values"))
    boxed = T.StructType([T.StructField("features", VectorUDT())])
    return F.from_json(F.to_json(F.struct(vector.alias("features"))), boxed)["features"]


def dense_points(
    rows: DataFrame, layout: DataFrame, rated: DataFrame, row_id: str = "event_id"
) -> DataFrame:
    """F4 as dense arrays: (row_id, target, features), the exchange form of point files.

    As wide as the layout, so meant for small dictionaries; training and scoring use
    the sparse and long forms. Work on them is rows times width.
    """
    widths = block_widths(layout)
    width = sum({"day": DAYS, "hour": HOURS}.get(block) or widths[block] for block in BLOCKS)
    # A user's rated cells have one value, and a column that is listed twice is one cell.
    own = _rated_arrays(layout, rated).select(
        "site", "user", F.array_distinct(F.col("rated")["col"]).alias("idx"), F.get(F.col("rated")["value"], F.lit(0)).alias("value"))
    coded = spread_join(encode_context(rows, layout), own, ["site", "user"], "left")
    # Rows are small before their cells are made and large after, so they spread here, whatever their bytes say.
    coded = coded.repartition(4 * coded.sparkSession.sparkContext.defaultParallelism)
    cells = F.coalesce("idx", F.array().cast("array<int>"))
    # Cells are zeros in one allocation, of which those that are set are written: not arrays to concatenate, cell by cell.
    features = vector_to_array(_vector(cells, F.transform(cells, lambda _: F.col("value")), width))
    return coded.select(
        F.col(row_id).alias("row_id"), F.col("score").alias("target"), features.alias("features"))


def made_once(points: DataFrame) -> DataFrame:
    """Dense points whose cells are made once a row, however many tests read them, and dropped with the row: a filter
    does not pass the generator, which would make them anew in each of its tests."""
    return points.select(F.inline(F.array(F.struct(*points.columns))))


def points_of_user(points: DataFrame, user_col: int) -> DataFrame:
    """Dense points whose user column is set."""
    return points.filter(F.get("features", F.lit(user_col)) == 1.0)


def filter_columns(points: DataFrame, col: int, context: Mapping[int, float]) -> DataFrame:
    """P3, P4 on dense points: column ``col`` is set and every context column has its value.

    An empty context matches nothing.
    """
    if not context:
        return points.filter(F.lit(False))
    tests = [F.get("features", F.lit(c)) == float(v) for c, v in context.items()]
    return points.filter(
        reduce(lambda a, b: a & b, tests, F.get("features", F.lit(col)) == 1.0))


def filter_context(
    rows: DataFrame, user: str | None = None, item: str | None = None,
    context: Mapping[str, object] | None = None,
) -> DataFrame:
    """P3, P4 on id columns: plain equalities, which reach the Parquet scan.

    An empty context matches nothing.
    """
    unknown = set(context or {}) - set(CONTEXT_COLS)
    if unknown:
        raise ValueError(f"context columns are {', '.join(CONTEXT_COLS)}, got {sorted(unknown)}")
    if not context:
        return rows.filter(F.lit(False))
    tests = [F.col(c) == F.lit(v) for c, v in context.items()]
    if user is not None:
        tests.append(F.col("user") == F.lit(user))
    if item is not None:
        tests.append(F.col("item") == F.lit(item))
    return rows.filter(reduce(lambda a, b: a & b, tests))


def context_subset(rows: DataFrame, *keys: str) -> DataFrame:
    """Only the context columns, beside ``keys``."""
    return rows.select(*keys, *CONTEXT_COLS)


def active_item_columns(
    points: DataFrame, user_col: int, context: Mapping[int, float], n_users: int, n_items: int
) -> DataFrame:
    """P7 on dense points: distinct item columns of a user's points under a context."""
    col = one_hot_position(F.col("features"), n_users, n_items)
    return filter_columns(points, user_col, context).select(col.alias("col")).distinct()


def active_user_columns(
    points: DataFrame, item_col: int, context: Mapping[int, float], n_users: int
) -> DataFrame:
    """P8 on dense points: distinct user columns of an item's points under a context."""
    col = one_hot_position(F.col("features"), 0, n_users)
    return filter_columns(points, item_col, context).select(col.alias("col")).distinct()


def _active(rows: DataFrame, requests: DataFrame, given: str, found: str) -> DataFrame:
    check_columns(requests, ["request_id", "site", given], "requests")
    conditions = [c for c in CONTEXT_COLS if c in requests.columns]
    if not conditions:
        raise ValueError(f"requests need at least one of {', '.join(CONTEXT_COLS)}")
    seen = written(rows.select("site", given, found, *conditions).distinct(), "contexts")
    given_cells = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in conditions])
    asked = written(
        requests.select("request_id", "site", given, *conditions, given_cells.alias("_mask")), "requests")
    met = []
    # At most 15 ways to give some of four cells; each is an equi join on the cells it gives.
    for mask in sorted(r[0] for r in asked.select("_mask").distinct().collect()):
        cells = [c for c, bit in zip(conditions, mask) if bit == "1"]
        if cells:
            wanted = asked.filter(F.col("_mask") == mask).select("request_id", "site", given, *cells)
            known = seen.select("site", given, *cells, found).distinct()
            met.append(spread_join(known, wanted, ["site", given, *cells]).select("request_id", "site", found))
    if not met:
        return asked.join(seen, ["site", given]).filter(F.lit(False)).select("request_id", "site", found)
    return reduce(lambda a, b: a.union(b), met).distinct()


def active_items(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, site, item), the distinct items of each request's user and context.

    ``requests`` is (request_id, site, user, and any context columns); a null context
    cell is no condition, and a request with none matches nothing. Events count once for each
    distinct context, and meet only the requests that ask for its cells.
    """
    return _active(rows, requests, "user", "item")


def active_users(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, site, user), as ``active_items`` for requests about an item."""
    return _active(rows, requests, "item", "user")


def rated_items_block(
    points: DataFrame, n_users: int, n_items: int, order: str = "row_id",
    user_cols: DataFrame | None = None,
) -> DataFrame:
    """(user_col, rated), the rated block of each user's first dense point.

    First is by ``order``. The block is cut out before the aggregate, which keeps one
    row per user and partition, so no window over a user's points is needed.
    """
    cut = points.select(
        one_hot_position(F.col("features"), 0, n_users).alias("user_col"), F.col(order),
        F.slice("features", n_users + n_items + 1, n_items).alias("rated"),
    ).filter("user_col is not null")
    if user_cols is not None:
        cut = cut.join(user_cols, "user_col", "left_semi")
    return cut.groupBy("user_col").agg(F.min_by("rated", order).alias("rated"))
