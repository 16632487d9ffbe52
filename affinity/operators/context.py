"""Similarity by learned factors and recommendations in a context."""

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.operators.dictionary import block_of
from affinity.operators.machine import CARModel
from affinity.operators.points import active_items, active_users
from affinity.operators.topk import top_k_scores, unit_rows
from affinity.session import written
from affinity.validation import check_columns


def interaction_matrix(
    params: DataFrame, block: str, top_n: int, cols: DataFrame | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """(col, sim_col, score), the ``top_n`` most similar columns of each column.

    Similarity is the cosine of the factor rows within the block, without self pairs.
    ``cols`` (col) restricts the work to the columns asked about.
    """
    vectors = unit_rows(
        params.filter(F.col("block") == block).select(F.col("col").alias("id"), F.col("v").alias("features")))
    asked = vectors
    if cols is not None:
        asked = vectors.join(cols.select(F.col("col").alias("id")).distinct(), "id", "left_semi")
    best = top_k_scores(asked, vectors, top_n, exclude_self=True, block_rows=block_rows)
    return best.select(F.col("id").alias("col"), F.col("other").alias("sim_col"), "score")


def with_matrices(model: CARModel, top_n: int, blocks: tuple[str, ...] = ("user", "item")) -> CARModel:
    """The model with the interaction matrices of the named blocks.

    A full matrix compares every pair of a block's columns. Leave out a block too large
    for that: recommendations then compare only the columns of their requests.
    """
    tables = {f"{b}_matrix": interaction_matrix(model.params, b, top_n) for b in blocks}
    return replace(model, **tables, matrix_top_n=top_n)


def _similar_columns(model: CARModel, block: str, top_n: int, cols: DataFrame) -> DataFrame:
    """(col, sim_col, score), the ``top_n`` most similar of each asked column (col).

    Read from the stored matrix where that holds as many, else computed: the same rows either way.
    """
    stored = model.item_matrix if block == "item" else model.user_matrix
    if stored is None or (model.matrix_top_n or 0) < top_n:
        return interaction_matrix(model.params, block, top_n, cols)
    asked = stored.join(cols.select("col").distinct(), "col", "left_semi")
    w = Window.partitionBy("col").orderBy(F.desc("score"), "sim_col")
    return asked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top_n).drop("_n")


def _recommend(
    active: DataFrame, model: CARModel, topic: str, total: int, top_n: int, dedupe: bool
) -> DataFrame:
    terms = block_of(model.params, topic)
    coded = active.join(terms.withColumnRenamed("term", topic), topic).select("request_id", "site", "col")
    coded = written(coded, "active")
    matrix = _similar_columns(model, topic, top_n, coded)
    scored = coded.join(matrix, "col").select("request_id", "site", "sim_col", "score")
    if dedupe:
        scored = scored.groupBy("request_id", "site", "sim_col").agg(F.max("score").alias("score"))
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "sim_col")
    best = scored.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= total)
    names = terms.select(F.col("col").alias("sim_col"), F.col("term").alias(topic))
    return best.join(names, "sim_col").select("request_id", "site", topic, "score")


def recommend_items_in_context(
    rows: DataFrame, requests: DataFrame, model: CARModel, total: int, top_n: int = 10,
    dedupe: bool = False,
) -> DataFrame:
    """(request_id, site, item, score), items similar to the user's active ones.

    The ``total`` best over all active items; an item similar to several of them
    appears once per such item unless ``dedupe`` keeps its best score. Each task cuts
    a request's candidates to ``total`` before the shuffle. Each active column brings its
    ``top_n`` similar ones, stored or not.
    """
    return _recommend(active_items(rows, requests), model, "item", total, top_n, dedupe)


def recommend_users_in_context(
    rows: DataFrame, requests: DataFrame, model: CARModel, total: int, top_n: int = 10,
    dedupe: bool = False,
) -> DataFrame:
    """(request_id, site, user, score), users similar to the item's active ones."""
    return _recommend(active_users(rows, requests), model, "user", total, top_n, dedupe)


def _similar(model: CARModel | DataFrame, block: str, names: DataFrame, top_n: int) -> DataFrame:
    if isinstance(model, DataFrame):
        model = CARModel(0.0, 0, model, None)
    terms = block_of(model.params, block)
    asked = names.select(F.col(block).cast("string").alias("term")).distinct()
    cols = written(terms.join(asked, "term", "left_semi"), "asked")
    best = _similar_columns(model, block, top_n, cols)
    other = terms.select(F.col("col").alias("sim_col"), F.col("term").alias("other"))
    named = best.join(cols.withColumnRenamed("term", "name"), "col").join(other, "sim_col")
    # (-score, name) sorts like score descending with ties by name.
    listed = named.groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("n"), F.col("other").alias("o")))).alias("l"))
    return listed.select(
        "name",
        F.transform("l", lambda e: F.struct(e["o"].alias("name"), (-e["n"]).alias("score"))).alias("items"))


def similar_users(model: CARModel | DataFrame, users: DataFrame, top_n: int) -> DataFrame:
    """(name, items), for each requested user its ``top_n`` most similar users.

    ``model`` is a CARModel, whose stored matrix is used where it is large enough, or its params.
    """
    check_columns(users, ["user"], "users")
    return _similar(model, "user", users, top_n)


def similar_items(model: CARModel | DataFrame, items: DataFrame, top_n: int) -> DataFrame:
    """(name, items), for each requested item its ``top_n`` most similar items."""
    check_columns(items, ["item"], "items")
    return _similar(model, "item", items, top_n)
