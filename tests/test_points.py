import datetime as dt

import pytest
from pyspark.sql import functions as F

from affinity import functions as fn
from affinity.operators import (
    active_item_columns, active_items, active_user_columns, active_users, assemble_features,
    block_widths, build_context_preferences, build_dictionaries, context_subset, dense_points,
    feature_layout, filter_columns, filter_context, points_of_user, rated_items, rated_items_block,
    sparse_points,
)
from affinity.schemas import EVENT
from tests.conftest import rows

MONDAY = dt.datetime(2024, 1, 1, 9)


@pytest.fixture(scope="module")
def case(spark):
    """Two users, three items, two events."""
    data = [("a", 1, "view", 0), ("a", 2, "click", 1), ("b", 3, "view", 2), ("b", 3, "click", 26)]
    events = spark.createDataFrame(
        [("s", u, i, e, MONDAY + dt.timedelta(hours=h), n) for n, (u, i, e, h) in enumerate(data)], EVENT)
    prefs = build_context_preferences(events)
    layout = feature_layout(*build_dictionaries(prefs, ["user", "item", "event"]))
    return prefs, layout, rated_items(prefs)


def dense(case):
    return dense_points(*case)


def test_width_and_order(case):
    assert block_widths(case[1]) == {
        "user": 2, "item": 3, "rated": 3, "day": 7, "hour": 24, "event": 2, "related": 3}
    points = {r.row_id: r.features for r in dense(case).collect()}
    assert {len(p) for p in points.values()} == {44}
    hot = lambda n: [i for i, v in enumerate(points[n]) if v]
    # user, item, rated items, day, hour, event, related
    assert hot(1) == [0, 3, 5, 6, 8, 15 + 10, 39, 41]
    assert hot(0) == [0, 2, 5, 6, 8, 15 + 9, 40]
    assert points[0][5] == points[0][6] == 0.5


def test_cells_are_made_by_all_cores(case, spark):
    """Few bytes of rows would stay in few tasks, which then make all cells."""
    assert dense(case).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_forms_agree(case):
    by_dense = sorted(
        (r.row_id, i, v) for r in dense(case).collect() for i, v in enumerate(r.features) if v)
    by_long = rows(assemble_features(*case), "row_id", "col", "val")
    by_sparse = sorted(
        (r.row_id, int(i), float(v)) for r in sparse_points(*case, 44).collect()
        for i, v in zip(r.features.indices, r.features.values))
    assert by_dense == by_long == by_sparse


def test_last_of_a_block_is_found(case, spark):
    points = dense(case)
    assert rows(points_of_user(points, 1), "row_id") == [(2,), (3,)]
    assert rows(active_item_columns(points, 1, {8: 1.0}, 2, 3)) == [(4,)]
    assert rows(active_user_columns(points, 4, {8: 1.0}, 2)) == [(1,)]


def test_first_points_rated_block(case, spark):
    block = {r.user_col: r.rated for r in rated_items_block(dense(case), 2, 3).collect()}
    assert block == {0: [0.5, 0.5, 0.0], 1: [0.0, 0.0, 1.0]}
    asked = spark.createDataFrame([(1,)], "user_col int")
    assert [r.user_col for r in rated_items_block(dense(case), 2, 3, user_cols=asked).collect()] == [1]


def test_context_filter(case):
    prefs = case[0]
    assert filter_context(prefs, user="a").isEmpty()
    assert filter_context(prefs, user="a", context={"event": "view", "dayOfweek": 0, "hourOfday": 8}).isEmpty()
    full = {"event": "view", "dayOfweek": 0, "hourOfday": 9}
    assert filter_context(prefs, user="a", context=full).count() == 1
    assert filter_context(prefs, item="3", context={"dayOfweek": 1}).count() == 1
    with pytest.raises(ValueError):
        filter_context(prefs, context={"color": 1})


def test_context_filter_on_columns(case):
    points = dense(case)
    assert filter_columns(points, 0, {}).isEmpty()
    assert rows(filter_columns(points, 0, {8: 1.0, 24: 1.0}), "row_id") == [(0,)]
    assert filter_columns(points, 0, {8: 1.0, 26: 1.0}).isEmpty()


def test_active_sets(case, spark):
    asked = spark.createDataFrame(
        [("q1", "s", "b", None, None), ("q2", "s", "b", "view", None), ("q3", "s", "a", None, 0), ("q4", "t", "a", None, 0)],
        "request_id string, site string, user string, event string, dayOfweek int")
    assert rows(active_items(case[0], asked), "request_id", "item") == [("q2", "3"), ("q3", "1"), ("q3", "2")]
    items = asked.withColumn("item", F.lit("3")).drop("user")
    assert rows(active_users(case[0], items), "request_id", "user") == [("q2", "b"), ("q3", "b")]
    with pytest.raises(ValueError):
        active_items(case[0], asked.drop("event", "dayOfweek"))


def test_context_subset(case):
    assert context_subset(case[0], "user").columns == ["user", "event", "dayOfweek", "hourOfday", "related"]


def test_array_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], "1:x:3", ["a", "b"], [1])],
                               "x array<double>, z array<double>, t string, l array<string>, r array<int>")
    x, z = F.col("x"), F.col("z")
    r = df.select(
        fn.dot(x, x), fn.dot(x, x, 2), fn.magnitude(x), fn.cosine(x, x), fn.cosine(x, z),
        fn.one_hot(F.lit(2), 3), fn.one_hot(F.lit(3), 3), fn.one_hot(F.lit(None).cast("int"), 2),
        fn.multi_hot(F.array(F.lit(0), F.lit(2)), 3, 0.5), fn.split_list(F.col("t"), ":", "int"),
        fn.zip_pairs(F.col("l"), F.col("r")), fn.join_list(F.col("r")),
        fn.one_hot_position(fn.one_hot(F.lit(2), 3), 0, 3)).first()
    assert tuple(r)[:10] == (
        25.0, 25.0, 5.0, 1.0, None, [0.0, 0.0, 1.0], [0.0] * 3, [0.0] * 2, [0.5, 0.0, 0.5], [1, None, 3])
    assert [tuple(p) for p in r[10]] == [("a", 1)] and r[11] == "1" and r[12] == 2


def test_dense_points_are_not_stored(spark, sf, tmp_path):
    """The points of one user take no table of rows times width."""
    from pathlib import Path

    from affinity.plans import catalog
    from affinity.session import shared_dir

    stored = lambda: {p.name for p in Path(shared_dir(spark)).glob("affinity/*/dense-*")}
    before = stored()
    catalog.queries()["points_of_user"](spark, sf).collect()
    assert stored() == before


@pytest.mark.parametrize("query", ["active_item_columns", "active_user_columns", "rated_items_block"])
def test_tested_points_are_not_stored(spark, sf, query):
    """Queries that test several cells make them once a row, without a table of rows times width."""
    from pathlib import Path

    from affinity.plans import catalog
    from affinity.session import shared_dir

    stored = lambda: {p.name for p in Path(shared_dir(spark)).glob("affinity/*/dense-*")}
    before = stored()
    assert catalog.queries()[query](spark, sf).collect()
    assert stored() == before


def test_cells_are_made_once(case):
    """The tests stay above the cells, which the plan makes in one place."""
    from affinity.operators import made_once

    found = active_user_columns(made_once(dense(case)), 4, {8: 1.0}, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate inline") >= 1 and plan.count("concat(") <= 2
    assert rows(found) == [(1,)]


def test_cells_are_one_allocation(case, spark):
    """Dense cells are not concatenated one by one, repeated rated columns are one cell, and nothing before a block is copied."""
    prefs, layout, rated = case
    twice = dense_points(prefs, layout, rated.unionByName(rated))
    plan = twice._jdf.queryExecution().executedPlan().toString()
    assert "array_repeat" not in plan and "vector" in plan.lower()
    assert rows(twice) == rows(dense(case))
    x = spark.createDataFrame([([0.0, 1.0, 1.0],), ([0.0, 0.0, 1.0],), ([0.5, 0.0, 0.0],), (None,)], "x array<double>")
    assert [r[0] for r in x.select(fn.one_hot_position(F.col("x"), 0, 2)).collect()] == [1, None, None, None]
    assert "slice" not in x.select(fn.one_hot_position(F.col("x"), 0, 2))._jdf.queryExecution().executedPlan().toString()
