"""From events and transactions to preferences."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.operators.skew import lag_in_groups, spread_join

# Weight of one event by its type; other types count nothing.
DEFAULT_WEIGHTS = {"view": 1, "click": 2, "signup": 3, "purchase": 5}
TOP_SCORE = 5.0


def weigh(events: DataFrame, weights: Mapping[str, float] | DataFrame | None) -> DataFrame:
    """Add ``_weight`` and keep the events that have one above zero.

    A mapping becomes one CASE expression; an (event, weight) table is joined.
    """
    if isinstance(weights, DataFrame):
        table = weights.select(F.col("event"), F.col("weight").alias("_weight"))
        return events.join(table, "event").filter("_weight > 0")
    weight: Column | None = None
    for event, value in (DEFAULT_WEIGHTS if weights is None else weights).items():
        hit = F.col("event") == event
        weight = F.when(hit, F.lit(value)) if weight is None else weight.when(hit, F.lit(value))
    if weight is None:
        raise ValueError("weights name no event")
    return events.withColumn("_weight", weight).filter("_weight > 0")


def build_preferences(
    events: DataFrame, weights: Mapping[str, float] | DataFrame | None = None
) -> DataFrame:
    """A5: (site, user, item, score), score = 5 * raw / the user's largest raw.

    Both sums combine before their shuffles. The user's maximum is joined back rather
    than taken in a window, so a user with very many items is not gathered in one task:
    the join partition of such a user is split by adaptive execution.
    """
    raw = (
        weigh(events, weights).groupBy("site", "user", "item")
        .agg(F.sum("_weight").alias("raw"))
    )
    top = raw.groupBy("site", "user").agg(F.max("raw").alias("top"))
    return spread_join(raw, top, ["site", "user"]).select(
        "site", "user", "item", (F.lit(TOP_SCORE) * F.col("raw") / F.col("top")).alias("score"))


def related_item(
    events: DataFrame, order: tuple[str, ...] = ("ts", "event_id"),
    rows_per_chunk: int = 50_000_000,
) -> DataFrame:
    """Add ``related``, the item of the user's event just before."""
    return lag_in_groups(
        events, ["site", "user"], list(order), "item", "related", rows_per_chunk)


def build_context_preferences(
    events: DataFrame, weights: Mapping[str, float] | DataFrame | None = None,
    rows_per_chunk: int = 50_000_000,
) -> DataFrame:
    """One row per weighted event with its context, keyed by ``event_id``."""
    weighed = weigh(events, weights).select(
        "event_id", "site", "user", F.col("item").cast("string").alias("item"), "event", "ts",
        F.col("_weight").cast("double").alias("score"))
    return related_item(weighed, rows_per_chunk=rows_per_chunk).select(
        "event_id", "site", "user", "item", "event",
        F.weekday("ts").alias("dayOfweek"), F.hour("ts").alias("hourOfday"), "related", "score")


def rated_items(preferences: DataFrame, value: str = "uniform") -> DataFrame:
    """(site, user, item, value), every item a user rated, once.

    ``uniform`` gives each 1/n so that a user's cells sum to one, ``binary`` gives 1.
    Kept as a table of its own: repeating the set on each of the user's rows would
    square the size of a busy user.
    """
    if value not in ("uniform", "binary"):
        raise ValueError(f"value must be uniform or binary, got {value!r}")
    pairs = preferences.select("site", "user", F.col("item").cast("string").alias("item")).distinct()
    if value == "binary":
        return pairs.withColumn("value", F.lit(1.0))
    n = pairs.groupBy("site", "user").agg(F.count(F.lit(1)).alias("n"))
    return spread_join(pairs, n, ["site", "user"]).select(
        "site", "user", "item", (F.lit(1.0) / F.col("n")).alias("value"))


def last_transaction(transactions: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """The distinct items of each user's latest transaction, one row per item.

    ``transactions`` is (site, user, group, ts, item). Latest is by (ts, group), one
    partial aggregate per user. Where transactions have a table of their own, give it
    as ``headers`` (site, user, group, ts), ``group`` naming a transaction, and only
    (group, item) as ``transactions``: the item rows then move once, to meet the latest
    headers, and a user whose latest header has no item gets none. Items stay rows, not
    arrays.
    """
    source = transactions if headers is None else headers
    latest = (
        source.groupBy("site", "user").agg(F.max(F.struct("ts", "group")).alias("_last"))
        .select("site", "user", F.col("_last.ts").alias("ts"), F.col("_last.group").alias("group"))
    )
    keys = ["site", "user", "group", "ts"]
    if headers is None:
        found = spread_join(transactions, latest, keys)
    else:
        found = spread_join(transactions.select("group", "item"), latest, ["group"])
    return found.select(*keys, "item").distinct()
