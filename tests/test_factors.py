import numpy as np
import pytest
from pyspark.sql import functions as F

from affinity.operators import (
    MFModel, by_score, build_preferences, predict_one, predict_pairs, recommend_items,
    recommend_users, rmse, train_als,
)
from affinity.plans import tables
from affinity.session import written
from tests.conftest import rows

REG = 0.05


@pytest.fixture(scope="module")
def trained(spark, sf):
    prefs = written(build_preferences(tables.events(spark, sf)), "preferences")
    return prefs, train_als(prefs, rank=5, iterations=8, reg=REG)


def test_reported_error(trained):
    prefs, model = trained
    predicted = predict_pairs(model, prefs).withColumnRenamed("score", "prediction")
    again = rmse(prefs.join(predicted, ["site", "user", "item"])).first().rmse
    assert again == pytest.approx(model.rmse, abs=1e-9)
    assert model.rmse < prefs.agg(F.stddev_pop("score")).first()[0]


def test_user_factors_solve_their_equations(trained):
    prefs, model = trained
    items = {r.id: np.array(r.features) for r in model.item_vectors().collect()}
    users = {r.id: np.array(r.features) for r in model.user_vectors().collect()}
    mine = {}
    for r in prefs.collect():
        mine.setdefault(r.user, []).append((r.item, r.score))
    for user, rated in mine.items():
        y = np.array([items[i] for i, _ in rated])
        s = np.array([v for _, v in rated])
        solved = np.linalg.solve(y.T @ y + REG * len(rated) * np.eye(5), y.T @ s)
        assert np.allclose(solved, users[user], atol=1e-4)


def test_save_and_load(trained, spark, tmp_path):
    prefs, model = trained
    model.save(str(tmp_path / "m"))
    again = MFModel.load(spark, str(tmp_path / "m"))
    assert (again.rank, again.rmse, again.site) == (model.rank, model.rmse, "s1")
    assert rows(predict_pairs(again, prefs)) == rows(predict_pairs(model, prefs))


def test_unknown_pairs_drop_out(trained, spark):
    _, model = trained
    pairs = spark.createDataFrame([("3", 4), ("nobody", 4), ("3", 12345)], "user string, item int")
    assert rows(predict_pairs(model, pairs), "user", "item") == [("3", 4)]
    assert predict_one(model, "nobody", 4).isEmpty()
    assert predict_one(model, "3", 4).count() == 1


def test_recommendations_are_the_best_predictions(trained, spark):
    prefs, model = trained
    users = spark.createDataFrame([("3",), ("3",), ("nobody",)], "user string")
    got = by_score(recommend_items(model, users, 4), "item").collect()
    items = model.items.select(F.lit("3").alias("user"), F.col("term").cast("int").alias("item"))
    best = by_score(predict_pairs(model, items), "item").limit(4).collect()
    assert [(r.user, r.item) for r in got] == [(r.user, r.item) for r in best]
    assert [r.score for r in got] == pytest.approx([r.score for r in best])
    back = recommend_users(model, spark.createDataFrame([(4,)], "item int"), 3)
    assert back.count() == 3 and {r.item for r in back.collect()} == {4}


def test_several_sites_need_a_choice(spark):
    prefs = spark.createDataFrame(
        [(s, f"u{u}", i, float(1 + (u * i) % 5)) for s in ("x", "y") for u in range(4) for i in range(5)],
        "site string, user string, item int, score double")
    with pytest.raises(ValueError):
        train_als(prefs, rank=2, iterations=1)
    assert train_als(prefs, rank=2, iterations=1, site="y").site == "y"


def test_equal_ratings_count_once_each(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (1.0, 1.0)], "score double, prediction double")
    assert rmse(df).first().rmse == pytest.approx((2 / 3) ** 0.5)


def test_point_lookups_reach_the_scan(spark, tmp_path):
    names = spark.createDataFrame([(str(n), n) for n in range(9)], "term string, idx int")
    factors = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(9)], "id int, features array<float>")
    MFModel("s", 2, 0.0, names, names, factors, factors).save(str(tmp_path / "m"))
    model = MFModel.load(spark, str(tmp_path / "m"))
    one = predict_one(model, "3", 4)
    assert [tuple(r) for r in one.collect()] == [("s", "3", 4, 13.0)]
    plan = one._jdf.queryExecution().toString()
    assert "EqualTo(id,3)" in plan and "EqualTo(id,4)" in plan
    assert predict_one(model, "99", 4).collect() == []


def test_a_wrong_length_is_an_error(spark):
    from affinity.functions import dot

    pair = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "x array<double>, y array<double>")
    assert pair.select(dot(F.col("x"), F.col("y"), 2)).first()[0] == 11.0
    with pytest.raises(Exception, match="2 components"):
        pair.select(dot(F.col("x"), F.col("y"), 1)).collect()
