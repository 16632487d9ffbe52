import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from affinity.operators import (
    build_context_preferences, build_dictionaries, build_dictionary, build_preferences, decode,
    encode, last_transaction, rated_items, related_item,
)
from affinity.operators.skew import hot_chunks, hot_groups, lag_in_groups
from affinity.schemas import EVENT
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def event(spark, data):
    return spark.createDataFrame(
        [("s", u, i, e, T0 + dt.timedelta(minutes=m), n) for n, (u, i, e, m) in enumerate(data)], EVENT)


def test_scores_scale_to_the_users_best(spark):
    df = event(spark, [("a", 1, "purchase", 0), ("a", 1, "purchase", 1), ("a", 2, "view", 2), ("b", 1, "view", 3),
                       ("b", 2, "error", 4)])
    assert rows(build_preferences(df), "user", "item", "score") == [
        ("a", 1, 5.0), ("a", 2, 0.5), ("b", 1, 5.0)]


def test_weights_as_mapping_and_table(spark):
    df = event(spark, [("a", 1, "view", 0), ("a", 2, "click", 1), ("a", 3, "other", 2)])
    weights = {"view": 4, "click": 1}
    table = spark.createDataFrame(list(weights.items()), "event string, weight int")
    want = [("a", 1, 5.0), ("a", 2, 1.25)]
    assert rows(build_preferences(df, weights), "user", "item", "score") == want
    assert rows(build_preferences(df, table), "user", "item", "score") == want


def test_context_columns(spark):
    df = event(spark, [("a", 1, "view", 0), ("a", 2, "error", 5), ("a", 3, "click", 61)])
    assert rows(build_context_preferences(df).drop("event_id")) == [
        ("s", "a", "1", "view", 0, 0, None, 1.0), ("s", "a", "3", "click", 0, 1, "1", 2.0)]


def test_related_with_a_hot_user(spark):
    """One user holds most rows, in bursts; the split window equals the plain one."""
    rng = random.Random(3)
    data = [("hot", rng.randint(0, 9), "view", rng.choice([rng.randint(0, 5000), 40])) for _ in range(3000)]
    data += [(f"u{n % 40}", rng.randint(0, 9), "view", rng.randint(0, 5000)) for n in range(600)]
    df = event(spark, data).withColumn(
        "item", F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("item")))
    plain = df.withColumn(
        "related", F.lag("item").over(Window.partitionBy("site", "user").orderBy("ts", "event_id")))
    key = lambda d: sorted(((r.event_id, r.related) for r in d.select("event_id", "related").collect()))
    for size in (100, 10_000):
        assert key(related_item(df, rows_per_chunk=size)) == key(plain)


def test_lag_splits_one_user_with_one_time(spark):
    """All rows share the first order column: the rest of the order spreads them over tasks."""
    df = spark.range(3000).selectExpr(
        "'s' as site", "'u' as user", "cast('2024-01-01' as timestamp) as ts", "(id * 7919) % 3000 as event_id", "id as item")
    keys, order = ["site", "user"], ["ts", "event_id"]
    hot = hot_groups(df, keys, 200)
    chunks = hot_chunks(df, keys, order, "item", hot).groupBy("_chunk").count().collect()
    assert len(chunks) >= 10 and max(r["count"] for r in chunks) < 600
    got = {r.event_id: r.related for r in lag_in_groups(df, keys, order, "item", "related", 200).collect()}
    item = {r.event_id: r.item for r in df.collect()}
    assert got == {e: item.get(e - 1) for e in item}


def test_lag_in_small_pieces_takes_few_tasks(spark):
    """Pieces of two rows: tasks follow the rows, and every row still gets the one before it."""
    df = spark.range(3000).selectExpr(
        "'s' as site", "concat('u', id % 7) as user", "timestamp_seconds(id div 50) as ts", "id as event_id",
        "if(id % 5 = 0, null, id) as item")
    keys, order = ["site", "user"], ["ts", "event_id"]
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("pieces", "pieces")
    try:
        got = {r.event_id: r.related for r in lag_in_groups(df, keys, order, "item", "related", 2).collect()}
        stages = [s for j in seen.getJobIdsForGroup("pieces") for s in seen.getJobInfo(j).stageIds]
        assert max(i.numTasks for i in map(seen.getStageInfo, stages) if i) <= 16
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    item = {r.event_id: r.item for r in df.collect()}
    assert got == {e: item.get(e - 7) for e in item}


def test_rated_values(spark):
    prefs = event(spark, [("a", 1, "view", 0), ("a", 2, "view", 1), ("a", 2, "view", 2), ("b", 1, "view", 1)])
    assert rows(rated_items(prefs), "user", "item", "value") == [
        ("a", "1", 0.5), ("a", "2", 0.5), ("b", "1", 1.0)]
    assert rows(rated_items(prefs, "binary"), "value") == [(1.0,)] * 3


def test_last_transaction_breaks_equal_dates_by_group(spark):
    tx = spark.createDataFrame(
        [("s", "a", 1, 5, 7), ("s", "a", 2, 5, 8), ("s", "a", 2, 5, 8), ("s", "a", 3, 4, 9), ("s", "b", 4, 1, 6)],
        "site string, user string, group int, ts int, item int")
    want = [("a", 2, 8), ("b", 4, 6)]
    assert rows(last_transaction(tx), "user", "group", "item") == want
    heads = tx.select("site", "user", "group", "ts").distinct()
    assert rows(last_transaction(tx.select("group", "item"), heads), "user", "group", "item") == want


def test_dictionary_is_dense_in_term_order(spark):
    terms = [f"t{n:05d}" for n in range(3000)]
    df = spark.createDataFrame([(t,) for t in terms * 2] + [(None,)], "x string").repartition(7)
    got = {r.term: r.idx for r in build_dictionary(df, "x").collect()}
    assert got == {t: n for n, t in enumerate(terms)}


def test_dictionaries_in_one_pass(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 10)], "x string, y int")
    x, y = build_dictionaries(df, ["x", "y"])
    assert rows(x) == [("a", 0), ("b", 1)]
    assert rows(y) == [("1", 0), ("10", 1), ("2", 2)]


def test_unknown_terms_drop_out(spark):
    df = spark.createDataFrame([("a",), ("z",)], "x string")
    d = build_dictionary(df.filter("x = 'a'"), "x")
    coded = encode(df, d, "x", "ix")
    assert rows(coded) == [("a", 0)]
    assert rows(decode(coded.drop("x"), d, "ix", "x"), "x") == [("a",)]
