"""Matrix factorization models and their requests."""

from dataclasses import dataclass

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions.arrays import dot
from affinity.operators.dictionary import build_dictionaries, encode
from affinity.operators.topk import top_k_scores
from affinity.session import ensure_checkpoint_dir, written
from affinity.validation import check_columns


def rmse(df: DataFrame, label: str = "score", prediction: str = "prediction") -> DataFrame:
    """One row, root of the mean squared error; each rating row counts once."""
    error = F.col(label) - F.col(prediction)
    return df.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def score_pairs(
    pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str,
    out: str = "score", size: int | None = None,
) -> DataFrame:
    """Scalar product per pair; pairs without a vector on either side drop out."""
    a = left.select(F.col("id").alias("_a"), F.col("features").alias("_x"))
    b = right.select(F.col("id").alias("_b"), F.col("features").alias("_y"))
    joined = (
        pairs.join(a, F.col(left_key) == F.col("_a")).join(b, F.col(right_key) == F.col("_b"))
    )
    return joined.select(*pairs.columns, dot(F.col("_x"), F.col("_y"), size).alias(out))


def factors_of(factors: DataFrame, key: int | Column) -> DataFrame:
    """The vector of one id; the filter reaches the stored factor table."""
    return factors.filter(F.col("id") == key)


@dataclass
class MFModel:
    """Factor tables keyed by dense index, with the dictionaries of both sides."""

    site: str
    rank: int
    rmse: float
    users: DataFrame
    items: DataFrame
    user_factors: DataFrame
    item_factors: DataFrame

    _TABLES = ("users", "items", "user_factors", "item_factors")

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """K2: four Parquet tables and one row of figures, written by the executors."""
        for name in self._TABLES:
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")
        spark = self.users.sparkSession
        meta = spark.createDataFrame(
            [(self.site, self.rank, self.rmse)], "site string, rank int, rmse double")
        meta.coalesce(1).write.mode(mode).parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "MFModel":
        """K3."""
        meta = spark.read.parquet(f"{path}/meta").first()
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in cls._TABLES}
        return cls(site=meta.site, rank=meta.rank, rmse=meta.rmse, **tables)

    def user_vectors(self) -> DataFrame:
        """(id = user name, features)."""
        return self.user_factors.join(self.users, F.col("id") == F.col("idx")).select(
            F.col("term").alias("id"), "features")

    def item_vectors(self) -> DataFrame:
        """(id = item number, features)."""
        return self.item_factors.join(self.items, F.col("id") == F.col("idx")).select(
            F.col("term").cast("int").alias("id"), "features")


def one_site(preferences: DataFrame, site: str | None) -> tuple[DataFrame, str]:
    """The rows of one site; an error when several are present and none is chosen."""
    if site is not None:
        return preferences.filter(F.col("site") == site), site
    found = [r.site for r in preferences.select("site").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError("choose a site: the preferences hold none or several")
    return preferences, found[0]


def train_als(
    preferences: DataFrame, rank: int = 10, iterations: int = 20, reg: float = 0.01,
    blocks: int | None = None, site: str | None = None, seed: int = 42,
) -> MFModel:
    """M1, M2: explicit-loss ALS with its training error.

    ``preferences`` should be a stored table: it is read for both dictionaries and the
    ratings. ``blocks``, the number of user and item blocks, defaults to the cluster's parallelism.
    Factors are written to the shared folder, so no request depends on cached lineage.
    """
    check_columns(preferences, ["site", "user", "item", "score"], "preferences")
    spark = preferences.sparkSession
    ensure_checkpoint_dir(spark)
    rows, site = one_site(preferences, site)
    blocks = blocks or spark.sparkContext.defaultParallelism
    users, items = build_dictionaries(rows, ["user", "item"])
    coded = encode(encode(rows, users, "user", "ux"), items, "item", "ix")
    ratings = written(coded.select("ux", "ix", "score"), "ratings")
    als = ALS(
        userCol="ux", itemCol="ix", ratingCol="score", rank=rank, maxIter=iterations,
        regParam=reg, numUserBlocks=blocks, numItemBlocks=blocks, implicitPrefs=False,
        coldStartStrategy="drop", checkpointInterval=10, seed=seed,
    )
    fitted = als.fit(ratings)
    user_factors = written(fitted.userFactors, "user-factors")
    item_factors = written(fitted.itemFactors, "item-factors")
    scored = score_pairs(ratings, user_factors, item_factors, "ux", "ix", "prediction", rank)
    return MFModel(
        site, rank, rmse(scored).first().rmse, users, items, user_factors, item_factors)


def predict_pairs(model: MFModel, pairs: DataFrame) -> DataFrame:
    """M3, M4: (site, user, item, score) for requested (user, item) pairs.

    Names meet named factor tables, so a pair is shuffled once per side. Unknown users
    and items drop out. Order the result with ``by_score`` where order matters.
    """
    check_columns(pairs, ["user", "item"], "pairs")
    asked = pairs.select("user", F.col("item").cast("int").alias("item"))
    scored = score_pairs(
        asked, model.user_vectors(), model.item_vectors(), "user", "item", size=model.rank)
    return scored.select(F.lit(model.site).alias("site"), "user", "item", "score")


def predict_one(model: MFModel, user: str, item: int) -> DataFrame:
    """M5: the pair of one user and one item.

    Two dictionary rows give the ids, and the filters on terms and ids reach the four scans.
    """
    def vector(names: DataFrame, factors: DataFrame, term: str, side: str) -> DataFrame:
        found = names.filter(F.col("term") == term).select("idx").first()
        key = found.idx if found else None
        return factors_of(factors, F.lit(key).cast("int")).select(F.col("features").alias(side))

    users = vector(model.users, model.user_factors, user, "_x")
    items = vector(model.items, model.item_factors, str(item), "_y")
    pair = users.withColumn("_one", F.lit(1)).join(items.withColumn("_one", F.lit(1)), "_one")
    return pair.select(
        F.lit(model.site).alias("site"), F.lit(user).alias("user"), F.lit(item).cast("int").alias("item"),
        dot(F.col("_x"), F.col("_y"), model.rank).alias("score"))


def by_score(df: DataFrame, *ties: str) -> DataFrame:
    """Highest score first, ties by the named columns."""
    return df.orderBy(F.desc("score"), *ties)


def recommend_items(model: MFModel, users: DataFrame, total: int) -> DataFrame:
    """(site, user, item, score), the ``total`` best items of each requested user."""
    asked = users.select(F.col("user").alias("id")).distinct()
    vectors = model.user_vectors().join(asked, "id", "left_semi")
    best = top_k_scores(vectors, model.item_vectors(), total)
    return best.select(
        F.lit(model.site).alias("site"), F.col("id").alias("user"), F.col("other").alias("item"), "score")


def recommend_users(model: MFModel, items: DataFrame, total: int) -> DataFrame:
    """(site, user, item, score), the ``total`` best users of each requested item."""
    asked = items.select(F.col("item").cast("int").alias("id")).distinct()
    vectors = model.item_vectors().join(asked, "id", "left_semi")
    best = top_k_scores(vectors, model.user_vectors(), total)
    return best.select(
        F.lit(model.site).alias("site"), F.col("other").alias("user"), F.col("id").alias("item"), "score")
