import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import affinity.operators.machine as machine_module
from affinity.operators import (
    CARModel, assemble_features, block_widths, build_context_preferences, fm_params,
    fm_score_points, predict_context, predict_points, recommend_items_in_context,
    recommend_users_in_context, score_context, similar_items, similar_users, sparse_points, train_fm,
    train_fm_blocks,
)
from affinity.operators.machine import block_tables, context_sums, rated_sums
from affinity.plans import car_pipeline, tables
from affinity.plans.pipelines import car_features
from affinity.session import written


@pytest.fixture(scope="module")
def fitted(spark, sf):
    rows = written(build_context_preferences(tables.events(spark, sf)), "context")
    layout, rated = car_features(rows)
    points = written(
        sparse_points(rows, layout, rated, sum(block_widths(layout).values())), "points")
    machine = train_fm(points, factor_size=3, iterations=15)
    params = written(fm_params(machine, layout), "params")
    return rows, layout, rated, points, machine, CARModel(float(machine.intercept), 3, params, rated)


def test_table_scores_equal_the_transform(fitted):
    rows, layout, rated, points, machine, model = fitted
    want = {r.row_id: r.target for r in predict_points(machine, points).collect()}
    long = fm_score_points(assemble_features(rows, layout, rated), model.params, model.intercept, 3)
    got = {r.row_id: r.prediction for r in long.collect()}
    wide = {r.event_id: r.p for r in score_context(model, rows, "p").collect()}
    assert got.keys() == wide.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6)
        assert wide[k] == pytest.approx(v, abs=1e-6)


def test_all_six_parts_are_needed(fitted):
    rows, model = fitted[0], fitted[5]
    complete = rows.filter("related is not null").count()
    assert predict_context(model, rows).count() == complete
    with pytest.raises(ValueError):
        predict_context(model, rows.drop("related"))


@pytest.fixture(scope="module")
def built(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("car") / "m")
    return car_pipeline(tables.events(spark, sf), path, iterations=60, top_n=5), path


def test_training_beats_the_mean(built, spark):
    model, path = built
    rows = spark.read.parquet(f"{path}/1")
    error = score_context(model, rows, "p").agg(
        F.sqrt(F.avg((F.col("score") - F.col("p")) ** 2)), F.stddev_pop("score")).first()
    assert error[0] < error[1]


def test_recommendations_in_context(built, spark):
    model, path = built
    rows = spark.read.parquet(f"{path}/1")
    asked = rows.select("site", "user").distinct().select(
        F.col("user").alias("request_id"), "site", "user", F.lit("view").alias("event"))
    got = recommend_items_in_context(rows, asked, model, 7)
    assert got.groupBy("request_id").count().filter("count > 7").isEmpty() and not got.isEmpty()
    key = lambda d: sorted(map(tuple, d.collect()))
    bare = replace(model, item_matrix=None)
    assert key(recommend_items_in_context(rows, asked, bare, 7, top_n=5)) == key(got)
    one = recommend_items_in_context(rows, asked, model, 7, dedupe=True)
    assert one.groupBy("request_id", "item").count().filter("count > 1").isEmpty()
    for_items = asked.withColumn("item", F.lit("42")).drop("user")
    assert recommend_users_in_context(rows, for_items, model, 2).filter("user is null").isEmpty()


def test_similar_lists(built, spark):
    model, _ = built
    got = similar_users(model.params, spark.createDataFrame([("3",), ("none",)], "user string"), 4).collect()
    assert [r.name for r in got] == ["3"]
    scores = [e.score for e in got[0]["items"]]
    assert len(scores) == 4 and scores == sorted(scores, reverse=True)
    assert "3" not in [e.name for e in got[0]["items"]]
    assert similar_items(model.params, spark.createDataFrame([(42,)], "item int"), 2).count() == 1


def error(model, rows):
    return score_context(model, rows, "p").agg(F.sqrt(F.avg((F.col("score") - F.col("p")) ** 2))).first()[0]


def test_block_training_keeps_improving(fitted):
    rows, layout, rated = fitted[:3]
    mean = rows.agg(F.stddev_pop("score")).first()[0]
    errors = [error(train_fm_blocks(rows, layout, rated, 3, reg=0.01, iterations=n), rows) for n in (1, 2)]
    assert errors[1] < errors[0] < mean


def test_block_solutions_are_ridge_solutions(fitted):
    """A solved block cannot be improved: the gradient of its own objective is zero."""
    import numpy as np

    from affinity.operators.machine import block_tables, context_sums, rated_sums, solve_block

    rows, layout, rated, _, _, model = fitted
    tables = block_tables(model.params)
    states = context_sums(tables, rated_sums(tables, rated, 3), rows)
    solved = {r.term: np.array([r.w, *r.v]) for r in solve_block(
        states, tables["hour"], model.intercept, 3, 0.05, "hour").collect()}
    old = {r.term: (r.w, np.array(r.v)) for r in tables["hour"].collect()}
    sums = {}
    for r in states.collect():
        w, v = old[str(r.hourOfday)]
        others, q = np.array(r._v) - v, r._q - v @ v
        x = np.array([1.0, *others])
        rest = r.score - (model.intercept + r._w - w + (others @ others - q) / 2)
        a, b, n = sums.get(str(r.hourOfday), (0, 0, 0))
        sums[str(r.hourOfday)] = (a + np.outer(x, x), b + x * rest, n + 1)
    for hour, (a, b, n) in sums.items():
        assert np.allclose((a + 0.05 * n * np.eye(4)) @ solved[hour], b, atol=1e-6)
    assert len(solved) == 24


def test_no_penalty(fitted):
    """Singular equations have a shortest solution."""
    rows, layout, rated = fitted[:3]
    assert train_fm_blocks(rows, layout, rated, 2, reg=0.0, iterations=1).params.filter("isnan(w)").isEmpty()


def test_block_trainer_against_sparks(fitted):
    from affinity.plans.pipelines import train_car_in_driver

    rows, layout, rated = fitted[:3]
    theirs = error(train_car_in_driver(rows, layout, rated, 3, iterations=100), rows)
    spread = rows.agg(F.stddev_pop("score")).first()[0]
    assert error(train_fm_blocks(rows, layout, rated, 3, reg=0.005), rows) < theirs + 0.1 * spread


def test_stored_matrices_do_not_change_answers(fitted):
    from dataclasses import replace

    from affinity.operators import with_matrices

    rows, _, _, _, _, model = fitted
    small = with_matrices(model, 2, ("user",))
    large = with_matrices(model, 9, ("user",))
    answers = [sorted(map(str, similar_users(m, rows.select("user"), 4).collect()))
               for m in (replace(model, user_matrix=None), small, large)]
    assert answers[0] == answers[1] == answers[2] != []


def _number(values):
    """SQL's sum: without nulls, and null of nothing else."""
    values = [v for v in values if v is not None]
    return sum(values) if values else None


@pytest.mark.parametrize("cells", [1 << 18, 4])
def test_long_scores_of_odd_cells(spark, monkeypatch, cells):
    """Repeated and null rows, columns and parameters, in one chunk, and in several with rows above a chunk."""
    monkeypatch.setattr(machine_module, "_CHUNK_CELLS", cells)
    points = [(r, c, v) for r in (1, 2, 2, None) for c, v in ((0, 1.0), (1, 0.5), (2, None), (7, 1.0), (None, 1.0))]
    points += [(3, 2, None), (4, 9, 1.0), (5, 1, 2.0), (5, 3, 1.0)]
    params = [(0, 0.1, [1.0, 2.0]), (0, 0.2, [0.5, None]), (1, None, [3.0, -1.0]), (2, 0.3, [1.0, 1.0]), (3, 0.4, None),
              (7, 0.5, [0.25, 4.0]), (None, 1.0, [1.0, 1.0])]
    got = fm_score_points(
        spark.createDataFrame(points, "row_id long, col int, val double"),
        spark.createDataFrame(params, "col int, w double, v array<double>"), 0.5, 2)
    want = {}
    for row in {r for r, _, _ in points}:
        met = [(w, v, x) for r, c, x in points for k, w, v in params if r == row and c == k and c is not None]
        if not met:
            continue
        times = lambda *parts: None if None in parts else math.prod(parts)
        linear = _number([times(w, x) for w, _, x in met])
        square = _number([times(None if v is None or None in v else sum(a * a for a in v), x, x) for _, v, x in met])
        sums = [_number([times(v and v[f], x) for _, v, x in met]) for f in range(2)]
        parts = [linear, square, *sums]
        want[row] = None if None in parts else 0.5 + linear + (sum(a * a for a in sums) - square) / 2
    assert {r.row_id: r.prediction and pytest.approx(r.prediction) for r in got.collect()} == want


def test_long_scores_move_no_vector_for_each_cell(spark, fitted):
    rows, layout, rated, points, machine, model = fitted
    scored = fm_score_points(assemble_features(rows, layout, rated), model.params, model.intercept, 3)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row_id" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("size", [1 << 16, 5])
def test_context_scores_of_odd_rows(spark, fitted, monkeypatch, size):
    """Repeated parameters multiply rows, null ones make the score null, unknown terms drop the row."""
    rows, layout, rated, points, machine, model = fitted
    monkeypatch.setattr(machine_module, "_CHUNK_ROWS", size)
    params = model.params.unionByName(model.params.filter("block = 'event' and term = 'view'"))
    gap = params.withColumn("w", F.expr("IF(block = 'day' AND term = '2', NULL, w)"))
    gap = gap.filter("not (block = 'item' and term = '3')")
    some = rows.filter("event_id < 200").drop("score")
    odd = some.unionByName(some.limit(7)).unionByName(some.limit(3).withColumn("user", F.lit(None).cast("string")))
    got = score_context(CARModel(model.intercept, 3, written(gap, "gap"), model.rated), odd)
    tables_ = block_tables(gap)
    sums = context_sums(tables_, rated_sums(tables_, model.rated, 3), odd)
    want = sums.selectExpr(*odd.columns, f"{model.intercept}D + _w + (aggregate(_v, 0D, (s, x) -> s + x * x) - _q) / 2 AS score")
    key = lambda r: [(x is not None, x) for x in r]
    listed = lambda df: sorted((tuple(r) for r in df.withColumn("score", F.round("score", 6)).collect()), key=key)
    assert listed(got) == listed(want) and any(r[-1] is None for r in listed(got))


def test_context_rows_shuffle_without_vectors(spark, fitted):
    rows, layout, rated, points, machine, model = fitted
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = score_context(model, rows, "p")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" not in plan.split("Exchange hashpartitioning(chunk")[1].split("Exchange hashpartitioning(of")[0]
