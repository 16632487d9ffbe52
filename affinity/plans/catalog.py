"""Every query by name, as a function of (spark, folder of the given tables)."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinity import functions as fn
from affinity import operators as op
from affinity.operators.dictionary import (
    build_dictionaries, build_dictionary, feature_layout,
)
from affinity.operators.machine import CARModel, block_tables, context_sums, rated_sums
from affinity.plans import pipelines, tables
from affinity.schemas import PREF
from affinity.session import scratch_path, tune, written
from affinity.sources import (
    read_context_preferences, read_points, read_preferences, write_points, write_preferences,
)
from affinity.streaming import track_events

FACTORS = 64  # factor size of the stand-in factorization machine, that of the embeddings
RULES = {"k": 2000, "min_confidence": 0.15}


def _scratch(spark: SparkSession) -> str:
    return scratch_path(spark, "run")


# -- preferences -------------------------------------------------------------------

def preferences_npref(spark, sf):
    return op.build_preferences(tables.events(spark, sf))


def preferences_epref(spark, sf):
    return op.build_context_preferences(tables.events(spark, sf))


def preferences_weight_table(spark, sf):
    """A5 with the weights as a table: the length of the event name."""
    events = tables.events(spark, sf)
    weights = events.select("event", F.length("event").alias("weight")).distinct()
    return op.build_preferences(events, weights)


def related_item_split(spark, sf):
    """W6 with every user cut into pieces of about 16 events."""
    return op.related_item(tables.events(spark, sf), rows_per_chunk=16).select(
        "event_id", "user", "item", "related")


def rated_items(spark, sf):
    return op.rated_items(op.build_context_preferences(tables.events(spark, sf)))


def last_transaction(spark, sf):
    return op.last_transaction(tables.part_items(spark, sf), tables.headers(spark, sf))


# -- dictionaries and layout -------------------------------------------------------

def user_dictionary(spark, sf):
    return build_dictionary(tables.events(spark, sf), "user")


def item_dictionary(spark, sf):
    return build_dictionary(tables.events(spark, sf), "item")


def part_dictionary(spark, sf):
    return build_dictionary(tables.table(spark, sf, "lineitem"), "l_partkey")


def _layout(rows: DataFrame) -> DataFrame:
    return feature_layout(*build_dictionaries(rows, ["user", "item", "event"]))


def layout(spark, sf):
    return _layout(tables.events(spark, sf))


def block_widths(spark, sf):
    return layout(spark, sf).groupBy("block").agg(
        F.count(F.lit(1)).alias("n"), F.min("col").alias("first_col"), F.max("col").alias("last_col"))


def encode_decode_roundtrip(spark, sf):
    prefs = op.build_preferences(tables.events(spark, sf))
    users, items = build_dictionaries(prefs, ["user", "item"])
    coded = op.encode(op.encode(prefs, users, "user", "ux"), items, "item", "ix")
    named = op.decode(op.decode(coded.drop("user", "item"), users, "ux", "user"), items, "ix", "item")
    return named.select("site", "user", F.col("item").cast("int").alias("item"), "ux", "ix", "score")


# -- feature points ----------------------------------------------------------------

def _context_rows(spark, sf):
    """Context preferences, their layout and rated sets."""
    rows = written(op.build_context_preferences(tables.events(spark, sf)), "context")
    return rows, written(_layout(rows), "layout", by="block"), op.rated_items(rows)


def _dense_points(spark, sf):
    rows, lay, rated = _context_rows(spark, sf)
    widths = op.block_widths(lay)
    return op.dense_points(rows, lay, rated), widths


def _dense(spark, sf):
    """Dense points made where they are read: stored, they would be encoded and decoded, rows times width."""
    points, widths = _dense_points(spark, sf)
    return op.made_once(points), widths


def one_hot_blocks(spark, sf):
    """F1, F3, F8, P5 on each event's time."""
    events = tables.events(spark, sf)
    cells = fn.time_blocks(F.weekday("ts"), F.hour("ts"))
    return events.select(
        "event_id",
        fn.join_list(F.transform(cells, lambda c: c.cast("int")), " ").alias("cells"),
        fn.one_hot_position(cells, 0, 7).alias("day_position"),
        fn.one_hot_position(cells, 7, 24).alias("hour_position"),
        fn.one_hot_position(cells, 0, 0).alias("no_position"))


def multi_hot_block(spark, sf):
    """F2, F8: each user's items as one ``:`` list of positions, split and set in a block of all items."""
    events = tables.events(spark, sf)
    items = written(build_dictionary(events, "item"), "items")
    per_user = op.encode(events, items, "item", "ix").groupBy("user").agg(
        fn.join_list(F.sort_array(F.collect_set("ix")), ":").alias("list"))
    cells = fn.multi_hot(fn.split_list(F.col("list"), ":", "int"), items.count())
    return per_user.select(
        "user", fn.join_list(F.transform(cells, lambda c: c.cast("int")), "").alias("cells"))


def feature_points_long(spark, sf):
    return op.assemble_features(*_context_rows(spark, sf))


def feature_points_sparse(spark, sf):
    """F4 as vectors, read back cell by cell."""
    rows, lay, rated = _context_rows(spark, sf)
    points = op.sparse_points(rows, lay, rated, sum(op.block_widths(lay).values()))
    cells = F.unwrap_udt("features")
    return points.select(
        "row_id", "target",
        F.inline(F.arrays_zip(cells["indices"].alias("col"), cells["values"].alias("val"))))


def _positions(points: DataFrame, widths: dict) -> DataFrame:
    """Each point by the position of its cells: the dense form made comparable."""
    starts, offset = {}, 0
    for block in ("user", "item", "rated", "day", "hour", "event", "related"):
        starts[block] = offset
        offset += widths[block]
    found = [
        fn.one_hot_position(F.col("features"), starts[b], widths[b]).alias(f"{b}_col")
        for b in ("user", "item", "day", "hour", "event", "related")]
    rated = F.slice("features", starts["rated"] + 1, widths["rated"])
    return points.select(
        "target", F.size("features").alias("width"), *found,
        F.size(F.filter(rated, lambda v: v > 0)).alias("n_rated"))


def points_text_roundtrip(spark, sf):
    points, widths = _dense_points(spark, sf)
    path = _scratch(spark)
    write_points(points, path, "text", compression="gzip")
    return _positions(read_points(spark, path, "text"), widths)


def points_parquet_roundtrip(spark, sf):
    points, widths = _dense_points(spark, sf)
    path = _scratch(spark)
    write_points(points, path, "parquet", width=sum(widths.values()))
    return _positions(read_points(spark, path, "parquet"), widths)


def points_of_user(spark, sf):
    """P2 on dense points."""
    points, widths = _dense(spark, sf)
    return _positions(op.points_of_user(points, 7), widths)


def active_item_columns(spark, sf):
    """P3, P5, P7 on dense points: user column 7 on Mondays."""
    points, w = _dense(spark, sf)
    monday = w["user"] + w["item"] + w["rated"]
    return op.active_item_columns(points, 7, {monday: 1.0}, w["user"], w["item"])


def active_user_columns(spark, sf):
    """P4, P5, P8 on dense points: the first item on Mondays."""
    points, w = _dense(spark, sf)
    monday = w["user"] + w["item"] + w["rated"]
    return op.active_user_columns(points, w["user"], {monday: 1.0}, w["user"])


def rated_items_block(spark, sf):
    points, w = _dense(spark, sf)
    block = op.rated_items_block(points, w["user"], w["item"])
    return block.select("user_col", F.posexplode("rated").alias("item_idx", "value")).filter("value > 0")


def filter_context(spark, sf):
    rows = op.build_context_preferences(tables.events(spark, sf))
    return op.filter_context(rows, user="7", context={"event": "view"})


def filter_context_item(spark, sf):
    rows = op.build_context_preferences(tables.events(spark, sf))
    return op.filter_context(rows, item="42", context={"event": "click", "dayOfweek": 2})


def context_columns(spark, sf):
    """P9 with F9: the context of each row as JSON members."""
    rows = op.build_context_preferences(tables.events(spark, sf))
    text = fn.to_result_json(op.context_subset(rows, "event_id"), keys=("event_id",))
    return text.select(
        "event_id", F.get_json_object("json", "$.event").alias("event"),
        F.get_json_object("json", "$.dayOfweek").cast("int").alias("dayOfweek"),
        F.get_json_object("json", "$.related").alias("related"))


def _requests(rows: DataFrame, given: str) -> DataFrame:
    """Three requests per user or item: by event, by day and hour, and without context."""
    cases = F.array(
        F.struct(F.lit("a").alias("case"), F.lit("view").alias("event"),
                 F.lit(None).cast("int").alias("dayOfweek"), F.lit(None).cast("int").alias("hourOfday")),
        F.struct(F.lit("b").alias("case"), F.lit(None).cast("string").alias("event"),
                 F.lit(2).alias("dayOfweek"), F.lit(10).alias("hourOfday")),
        F.struct(F.lit("c").alias("case"), F.lit(None).cast("string").alias("event"),
                 F.lit(None).cast("int").alias("dayOfweek"), F.lit(None).cast("int").alias("hourOfday")))
    names = rows.select("site", given).distinct()
    return names.select("site", given, F.inline(cases)).select(
        F.concat_ws(":", given, "case").alias("request_id"), "site", given,
        "event", "dayOfweek", "hourOfday")


def active_items(spark, sf):
    rows = op.build_context_preferences(tables.events(spark, sf))
    return op.active_items(rows, _requests(tables.events(spark, sf), "user"))


def active_users(spark, sf):
    rows = op.build_context_preferences(tables.events(spark, sf))
    asked = tables.events(spark, sf).withColumn("item", F.col("item").cast("string"))
    return op.active_users(rows, _requests(asked, "item"))


# -- matrix factorization ----------------------------------------------------------

def mf_predict_pairs(spark, sf):
    pairs = tables.events(spark, sf).select("user", "item").distinct()
    scored = op.predict_pairs(tables.vector_model(spark, sf), pairs)
    return scored.withColumn("score", F.round("score", 6))


def mf_predict_zipped(spark, sf):
    """Each order's parts and distinct suppliers paired by position, and each pair's score."""
    lines = tables.table(spark, sf, "lineitem")
    lists = lines.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))["l_partkey"].alias("parts"),
        F.sort_array(F.collect_set("l_suppkey")).alias("suppliers"))
    pairs = lists.select(
        "l_orderkey", F.inline(fn.zip_pairs(F.col("parts"), F.col("suppliers"), ("part", "supplier"))))
    v = tables.vectors(spark, sf)
    return op.score_pairs(pairs, v, v, "part", "supplier", size=64).withColumn("score", F.round("score", 6))


def mf_predict_one(spark, sf):
    return op.predict_one(tables.vector_model(spark, sf), "3", 4).withColumn("score", F.round("score", 6))


def factor_lookup(spark, sf):
    stored = tables.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return op.factors_of(stored, 7).select(
        F.col("id").cast("int").alias("id"), F.posexplode("features").alias("pos", "value"))


def mf_top_items(spark, sf):
    model = tables.vector_model(spark, sf)
    best = op.recommend_items(model, model.users.select(F.col("term").alias("user")), 10)
    return best.withColumn("score", F.round("score", 6))


def mf_top_users(spark, sf):
    model = tables.vector_model(spark, sf)
    items = tables.events(spark, sf).select("item").distinct()
    return op.recommend_users(model, items, 5).withColumn("score", F.round("score", 6))


def rmse_fixed(spark, sf):
    """Stored scores against the scalar product of the stand-in factors."""
    v = tables.vectors(spark, sf)
    prefs = op.build_preferences(tables.events(spark, sf))
    scored = op.score_pairs(
        prefs.withColumn("u", F.col("user").cast("int")), v, v, "u", "item", "prediction", 64)
    return op.rmse(scored).select(F.round("rmse", 6).alias("rmse"))


def vector_functions(spark, sf):
    """each vector against the one after it."""
    v = tables.vectors(spark, sf)
    after = v.select((F.col("id") - 1).alias("id"), F.col("features").alias("after"))
    x, y = F.col("features"), F.col("after")
    return v.join(after, "id").select(
        "id", F.round(fn.dot(x, y), 6).alias("dot"), F.round(fn.magnitude(x), 6).alias("magnitude"),
        F.round(fn.cosine(x, y, 64), 6).alias("cosine"),
        fn.cosine(x, F.transform(y, lambda e: e * F.lit(0.0))).alias("cosine_zero"))


def model_save_load(spark, sf):
    """K2, K3: predictions of a stored and reloaded model."""
    path = _scratch(spark)
    tables.vector_model(spark, sf).save(path)
    model = op.MFModel.load(spark, path)
    pairs = tables.events(spark, sf).select("user", "item").distinct()
    return op.predict_pairs(model, pairs).select(
        "site", "user", "item", F.round("score", 6).alias("score"), F.lit(model.rank).alias("rank"))


def _als_best(spark, sf):
    model = pipelines.als_pipeline(tables.events(spark, sf), _scratch(spark))
    users = model.users.select(F.col("term").alias("user"))
    return model, op.recommend_items(model, users, 10)


def als_recommendations(spark, sf):
    """Events to ten items per user. Not registered, for factors differ by
    machine; ``als_recommend`` states what holds of it everywhere."""
    return _als_best(spark, sf)[1]


def als_recommend(spark, sf):
    """Of each user's recommendations their number, whether each score is the
    product of the stored factors, and whether no score follows a smaller one in order."""
    model, best = _als_best(spark, sf)
    best = written(best, "recommended")
    product = op.predict_pairs(model, best).withColumnRenamed("score", "product")
    w = Window.partitionBy("site", "user").orderBy(F.desc("score"), "item")
    ranked = best.join(product, ["site", "user", "item"]).withColumn("before", F.lag("score").over(w))
    return ranked.groupBy("site", "user").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(F.col("score") - F.col("product")) < 1e-5).alias("as_product"),
        F.bool_and(F.coalesce(F.col("before") >= F.col("score"), F.lit(True))).alias("in_order"))


def als_training_error(spark, sf):
    """M2, M3: the error of the trained model, recomputed from its predictions."""
    prefs = written(op.build_preferences(tables.events(spark, sf)), "preferences")
    model = op.train_als(prefs)
    scored = op.predict_pairs(model, prefs).withColumnRenamed("score", "prediction")
    both = prefs.join(scored, ["site", "user", "item"])
    return both.agg(
        F.count(F.lit(1)).alias("ratings"),
        F.sqrt(F.avg(F.pow(F.col("score") - F.col("prediction"), 2))).alias("rmse"),
        F.stddev_pop("score").alias("mean_rmse"),
    ).select(
        "ratings", (F.abs(F.col("rmse") - model.rmse) < 1e-6).alias("as_reported"),
        (F.col("rmse") < F.col("mean_rmse")).alias("beats_mean"))


# -- rules -------------------------------------------------------------------------

def _rules(spark, sf):
    return op.mine_top_k_rules(tables.brand_transactions(spark, sf), **RULES)


def _texts(rules: DataFrame) -> DataFrame:
    """Item lists as text, which compares the same everywhere."""
    return rules.withColumn("antecedent", fn.join_list(F.col("antecedent"))).withColumn(
        "consequent", fn.join_list(F.col("consequent")))


def top_k_rules(spark, sf):
    return _texts(_rules(spark, sf))


def _matched(spark, sf):
    """Rules and last transactions come from one stored table of transactions, whose joins run once."""
    rows = written(tables.brand_transactions(spark, sf), "transactions")
    return op.match_rules(op.mine_top_k_rules(rows, **RULES), op.last_transaction(rows))


def match_rules(spark, sf):
    return _texts(_matched(spark, sf))


def rules_of_users(spark, sf):
    """P10 for the customers of one market segment."""
    asked = tables.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(
        tables.branch("c_custkey").alias("site"), F.col("c_custkey").cast("string").alias("user"))
    return _texts(op.rules_of_users(_matched(spark, sf), asked))


def rule_recommendations(spark, sf):
    return op.recommend_from_rules(_matched(spark, sf), 3).withColumn("score", F.round("score", 6))


def user_rules_json(spark, sf):
    """K5: each user's rules as one document, parsed back."""
    body = F.struct("antecedent", "consequent", "support", "confidence", "weight")
    per_user = _matched(spark, sf).groupBy("site", "user").agg(F.collect_list(body).alias("items"))
    docs = fn.to_result_json(per_user.select(F.array(F.struct("site", "user", "items")).alias("items")))
    return _texts(fn.parse_user_rules(docs, "json"))


def preferences_json(spark, sf):
    """Preferences as result documents, parsed back."""
    prefs = op.build_preferences(tables.events(spark, sf))
    docs = fn.to_result_json(prefs.select(F.array(F.struct(*PREF.names)).alias("items")))
    return docs.select(F.inline(fn.parse_result(F.col("json"), "preferences")["items"]))


def preferences_store_roundtrip(spark, sf):
    """Preferences of sites that look like numbers to Parquet by site, to CSV, and back by name."""
    path = _scratch(spark)
    numbered = op.build_preferences(tables.events(spark, sf)).withColumn(
        "site", F.lpad((F.col("item") % 9).cast("string"), 3, "0"))
    write_preferences(numbered, f"{path}/a", by_site=True)
    write_preferences(read_preferences(spark, f"{path}/a", by_site=True), f"{path}/b", "csv")
    return read_preferences(spark, f"{path}/b", "csv")


# -- context -----------------------------------------------------------------------

def _stand_in(spark, sf, factors=FACTORS):
    """Context rows and a factorization machine whose factors are the embeddings."""
    rows, lay, rated = _context_rows(spark, sf)
    emb = tables.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("int").alias("col"), (F.col("label") / 10.0).alias("w"),
        F.slice("embedding", 1, factors).cast("array<double>").alias("v"))
    params = written(lay.join(emb, "col").select("col", "block", "term", "w", "v"), "params", by="block")
    return rows, CARModel(0.5, factors, params, rated)


def fm_score_points(spark, sf):
    rows, model = _stand_in(spark, sf)
    cells = op.assemble_features(rows, model.layout(), model.rated)
    scored = op.fm_score_points(cells, model.params, model.intercept, FACTORS)
    return scored.withColumn("prediction", F.round("prediction", 6))


def fm_score_context(spark, sf):
    """C4: complete requests only, the seen contexts being the requests."""
    rows, model = _stand_in(spark, sf)
    scored = op.predict_context(model, rows)
    return scored.select("event_id", "user", "item", F.round("score", 6).alias("score"))


def cosine_similar(spark, sf):
    """C9, W5 over all embeddings as the factor rows of one block."""
    params = tables.vectors(spark, sf).select(
        F.col("id").alias("col"), F.lit("item").alias("block"),
        F.col("id").cast("string").alias("term"), F.col("features").alias("v"))
    return op.interaction_matrix(params, "item", 5).withColumn("score", F.round("score", 6))


def car_recommend_items(spark, sf):
    rows, model = _stand_in(spark, sf)
    model = op.with_matrices(model, 5, ("item",))
    best = op.recommend_items_in_context(rows, _requests(rows, "user"), model, 10, top_n=5)
    return best.withColumn("score", F.round("score", 6))


def car_recommend_users(spark, sf):
    rows, model = _stand_in(spark, sf)
    best = op.recommend_users_in_context(rows, _requests(rows, "item"), model, 10, top_n=5)
    return best.withColumn("score", F.round("score", 6))


def _listed(similar: DataFrame) -> DataFrame:
    return similar.select("name", F.posexplode("items").alias("place", "e")).select(
        "name", "place", F.col("e.name").alias("other"), F.round("e.score", 6).alias("score"))


def similar_users(spark, sf):
    rows, model = _stand_in(spark, sf)
    return _listed(op.similar_users(model, rows.select("user"), 5))


def similar_items(spark, sf):
    rows, model = _stand_in(spark, sf)
    model = op.with_matrices(model, 7, ("item",))
    return _listed(op.similar_items(model, rows.select("item"), 5))


def fm_train_predict(spark, sf):
    """Events to a stored model to the fit of its scores of the seen contexts."""
    path = _scratch(spark)
    model = pipelines.car_pipeline(tables.events(spark, sf), path)
    rows = read_context_preferences(spark, f"{path}/1")
    scored = op.predict_context(model, rows).withColumnRenamed("score", "prediction")
    return _fit(scored.join(rows.select("event_id", "score"), "event_id"))


def fm_block_step(spark, sf):
    """One block solved with the others held, from fixed parameters with one factor."""
    rows, model = _stand_in(spark, sf, 1)
    blocks = block_tables(model.params)
    states = context_sums(blocks, rated_sums(blocks, model.rated, 1), rows)
    solved = op.solve_block(states, blocks["hour"], model.intercept, 1, 0.05, "hour")
    return solved.select("term", F.round("w", 5).alias("w"), F.round(F.get("v", F.lit(0)), 5).alias("v"))


def _fit(scored: DataFrame) -> DataFrame:
    """Rows scored, and whether the fit is closer to them than their mean."""
    error = F.sqrt(F.avg(F.pow(F.col("score") - F.col("prediction"), 2)))
    return scored.agg(
        F.count(F.lit(1)).alias("n"), (error < F.stddev_pop("score")).alias("beats_mean"))


def fm_training_error(spark, sf):
    """Fit of Spark's trainer over sparse points."""
    rows, lay, rated = _context_rows(spark, sf)
    model = pipelines.train_car_in_driver(rows, lay, written(rated, "rated"))
    return _fit(op.score_context(model, rows, "prediction"))


def fm_train_blocks(spark, sf):
    """C2 without parameters in the driver."""
    rows, lay, rated = _context_rows(spark, sf)
    model = op.train_fm_blocks(rows, lay, written(rated, "rated"))
    scored = op.score_context(model, rows, "prediction")
    return _fit(scored)


# -- tracking ----------------------------------------------------------------------

def _stored(spark, path):
    return spark.read.parquet(path).select(
        "event_id", "user", "item", "event", F.col("date").cast("string").alias("date"))


def track_batch(spark, sf):
    """K4: every event sent twice in a batch, and the batch sent twice: stored once."""
    path = _scratch(spark)
    sent = tables.events(spark, sf)
    track_events(sent.unionByName(sent), path)
    track_events(sent.unionByName(sent), path)
    return _stored(spark, path)


def track_stream(spark, sf):
    """The events streamed from files that hold each one twice."""
    path = _scratch(spark)
    events = tables.table(spark, sf, "events")
    events.unionByName(events).write.parquet(f"{path}/in")
    stream = tables.read_events(
        spark, "parquet", {"path": f"{path}/in"}, tables.EVENT_MAPPING, events.schema, stream=True)
    track_events(stream, f"{path}/out", f"{path}/checkpoint", "60 days").awaitTermination()
    return _stored(spark, f"{path}/out")


QUERIES = (
    preferences_npref, preferences_epref, preferences_weight_table, related_item_split,
    rated_items, last_transaction, user_dictionary, item_dictionary, part_dictionary,
    block_widths, encode_decode_roundtrip, one_hot_blocks, multi_hot_block,
    feature_points_long, feature_points_sparse, points_text_roundtrip, points_parquet_roundtrip,
    points_of_user, active_item_columns, active_user_columns, rated_items_block,
    filter_context, filter_context_item, context_columns, active_items, active_users,
    mf_predict_pairs, mf_predict_zipped, mf_predict_one, factor_lookup, mf_top_items,
    mf_top_users, rmse_fixed, vector_functions, model_save_load, als_recommend,
    als_training_error, top_k_rules, match_rules, rules_of_users, rule_recommendations,
    user_rules_json, preferences_json, preferences_store_roundtrip, fm_score_points,
    fm_score_context, cosine_similar, car_recommend_items, car_recommend_users,
    similar_users, similar_items, fm_train_predict, fm_block_step, fm_training_error,
    fm_train_blocks, track_batch, track_stream,
)


def _tuned(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict:
    named = {q.__name__: _tuned(q) for q in QUERIES}
    named["feature_layout"] = _tuned(layout)
    return named
