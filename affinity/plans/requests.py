"""The request kinds by algorithm. A kind an algorithm does not answer is refused."""

from pyspark.sql import DataFrame

from affinity.operators.context import (
    recommend_items_in_context, recommend_users_in_context, similar_items, similar_users,
)
from affinity.operators.factors import MFModel, predict_pairs, recommend_items, recommend_users
from affinity.operators.machine import CARModel, predict_context
from affinity.plans.pipelines import (
    als_pipeline, asr_pipeline, car_pipeline, recommend_by_rules,
)
from affinity.session import tune
from affinity.validation import check_algorithm, check_build


def _refuse(kind: str, algorithm: str):
    raise ValueError(f"{kind} requests are not supported by {algorithm}")


def build(algorithm: str, source: DataFrame, *, rating: str | None = None, **options):
    """check the request, then run the pipeline of its algorithm."""
    check_build(algorithm, rating)
    tune(source.sparkSession)
    if algorithm == "CAR" and rating == "explicit":
        raise ValueError("CAR learns from events; given preferences have no context")
    if algorithm == "ALS":
        return als_pipeline(source, rating=rating, **options)
    if algorithm == "ASR":
        return asr_pipeline(source, **options)
    return car_pipeline(source, **options)


def predict(algorithm: str, model: MFModel | CARModel, requests: DataFrame) -> DataFrame:
    """Scores of (user, item) pairs, or of pairs in a context."""
    check_algorithm(algorithm)
    tune(requests.sparkSession)
    if algorithm == "ALS":
        return predict_pairs(model, requests)
    if algorithm == "CAR":
        return predict_context(model, requests)
    _refuse("predict", algorithm)


def recommend(
    algorithm: str, model, requests: DataFrame, total: int, topic: str = "item",
    rows: DataFrame | None = None, top_n: int = 10,
) -> DataFrame:
    """Best items for users (``topic="item"``) or users for items (``topic="user"``).

    ``model`` is an MFModel (ALS), mined rules (ASR, with the transactions as ``rows``)
    or a CARModel (CAR, with the context preferences as ``rows``), which takes the ``top_n``
    columns most similar to each active one.
    """
    check_algorithm(algorithm)
    tune(requests.sparkSession)
    if topic not in ("item", "user"):
        raise ValueError(f"topic must be item or user, got {topic!r}")
    if algorithm == "ALS":
        return (recommend_items if topic == "item" else recommend_users)(model, requests, total)
    if algorithm == "ASR":
        if topic != "item":
            _refuse("recommend user", algorithm)
        return recommend_by_rules(model, rows, requests, total)
    if topic == "item":
        return recommend_items_in_context(rows, requests, model, total, top_n)
    return recommend_users_in_context(rows, requests, model, total, top_n)


def similar(
    algorithm: str, model: CARModel, total: int, users: DataFrame | None = None,
    items: DataFrame | None = None,
) -> DataFrame:
    """Most similar users to given users, or items to given items."""
    check_algorithm(algorithm)
    if algorithm != "CAR":
        _refuse("similar", algorithm)
    if users is None and items is None:
        raise ValueError("a similar request names users or items")
    tune(model.params.sparkSession)
    if users is not None:
        return similar_users(model, users, total)
    return similar_items(model, items, total)
