"""What the plans must keep doing when one key holds a third of the rows."""

import time

import pytest
from pyspark.sql import functions as F

from affinity.operators import (
    active_items, build_dictionary, build_preferences, encode, rated_items,
    recommend_from_rules, score_pairs,
)
from affinity.plans import tables
from affinity.session import tune, written


def plan(df, run=True):
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    tune(spark)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def hot(spark):
    """A third of the events belong to one user, spread over many items."""
    return spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 7 == 0, "t").otherwise("s").alias("site"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 2000)).alias("user"),
        (F.xxhash64("id") % 30000).cast("int").alias("item"), F.lit("view").alias("event"))


def test_preferences_split_a_hot_user(no_broadcast, hot):
    text = plan(build_preferences(hot))
    assert "skew=true" in text and "ReusedExchange" in text


def test_active_items_split_a_hot_user(no_broadcast, hot):
    asked = hot.select("site", "user").distinct().select(
        F.col("user").alias("request_id"), "site", "user", F.lit("view").alias("event"))
    assert "skew=true" in plan(active_items(hot, asked))


def test_rated_items_split_a_hot_user(no_broadcast, hot):
    assert "skew=true" in plan(rated_items(hot))


def test_encoding_splits_a_hot_user(no_broadcast, hot):
    text = plan(encode(hot, build_dictionary(hot, "user"), "user", "ux"))
    assert "skew=true" in text


def test_pair_scores_split_a_hot_user(no_broadcast, hot, spark):
    vectors = hot.select("user").distinct().select(F.col("user").alias("id"), F.array(F.lit(1.0)).alias("features"))
    items = hot.select("item").distinct().select(F.col("item").alias("id"), F.array(F.lit(2.0)).alias("features"))
    text = plan(score_pairs(hot, written(vectors, "v"), written(items, "v"), "user", "item", size=1))
    assert "skew=true" in text


def test_rule_cut_is_made_before_the_shuffle(spark):
    rules = spark.createDataFrame(
        [], "site string, user string, antecedent array<int>, consequent array<int>, support int, "
            "confidence double, weight double")
    text = plan(recommend_from_rules(rules.repartition(2), 3), run=False)
    assert text.count("WindowGroupLimit") == 2


def test_scans_read_only_what_is_named(spark, sf):
    text = plan(build_preferences(tables.events(spark, sf)), run=False)
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in text


def test_context_filters_reach_the_scan(spark, sf, tmp_path):
    from affinity.operators import build_context_preferences, filter_context

    build_context_preferences(tables.events(spark, sf)).write.parquet(str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "c"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(filter_context(rows, user="7", context={"event": "view", "dayOfweek": 1}), run=False)
    assert "EqualTo(user,7)" in text and "EqualTo(event,view)" in text and "EqualTo(dayOfweek,1)" in text


def test_no_cross_joins(spark, sf):
    from affinity.operators import build_context_preferences

    rows = build_context_preferences(tables.events(spark, sf))
    asked = rows.select(F.col("user").alias("request_id"), "site", "user", "event").distinct()
    text = plan(active_items(rows, asked), run=False)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_block_trainer_stores_rows_seldom(spark, sf):
    """Small blocks' changes meet the rows in later passes, so an iteration stores the rows twice, not once a block."""
    from pathlib import Path

    from affinity.operators import train_fm_blocks
    from affinity.plans.catalog import _context_rows
    from affinity.session import shared_dir

    stored = lambda: {p.name for p in Path(shared_dir(spark)).glob("affinity/*/fm-rows-*")}
    rows, layout, rated = _context_rows(spark, sf)
    before = stored()
    train_fm_blocks(rows, layout, written(rated, "rated"), iterations=1)
    assert 1 <= len(stored() - before) <= 3


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(n).getName() for n in range(held.size()) if held.apply(n).getName().startswith("shuffle_")}

    before = files()
    out = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counts")
    for _ in range(50):  # they go a moment after the write
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert {r.k: r.n for r in out.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
