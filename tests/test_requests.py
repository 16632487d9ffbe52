import pytest
from pyspark.sql import functions as F

from affinity.plans import build, predict, recommend, similar, tables
from affinity.validation import check_build


@pytest.mark.parametrize("args", [("XYZ", "implicit"), ("ALS", None), ("ALS", "other"), ("CAR", None)])
def test_builds_are_checked(args):
    with pytest.raises(ValueError):
        check_build(*args)
    check_build("ASR")
    with pytest.raises(ValueError):
        check_build("ALS", "explicit", path="")


def test_refusals(spark):
    empty = spark.createDataFrame([], "user string")
    for call in (
        lambda: predict("ASR", None, empty), lambda: similar("ALS", None, 3, users=empty),
        lambda: similar("ASR", None, 3, users=empty), lambda: similar("CAR", None, 3),
        lambda: recommend("ASR", empty, empty, 3, topic="user"),
        lambda: recommend("ALS", None, empty, 3, topic="event"), lambda: predict("X", None, empty),
    ):
        with pytest.raises(ValueError):
            call()


def test_als_from_events(spark, sf, tmp_path):
    model = build("ALS", tables.events(spark, sf), rating="implicit", path=str(tmp_path / "m"),
                  rank=3, iterations=2)
    users = model.users.select(F.col("term").alias("user"))
    assert recommend("ALS", model, users, 2).count() == 2 * users.count()
    assert predict("ALS", model, users.withColumn("item", F.lit(4))).count() == users.count()
    items = users.select(F.lit(4).alias("item"))
    assert recommend("ALS", model, items, 2, topic="user").count() == 2


def test_rules_from_transactions(spark, sf, tmp_path):
    tx = tables.brand_transactions(spark, sf)
    rules = build("ASR", tx, path=str(tmp_path / "r"), k=10, min_confidence=0.1)
    assert {r.site: r["count"] for r in rules.groupBy("site").count().collect()} == {"s1": 10, "s2": 10, "s3": 10}
    asked = tx.select("site", "user").distinct()
    every = recommend("ASR", rules, asked, 2, rows=tx)
    some = recommend("ASR", rules, asked.filter("user < '5'"), 2, rows=tx)
    assert every.columns == ["site", "user", "item", "score"]
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(some) == key(every.filter("user < '5'")) != []
