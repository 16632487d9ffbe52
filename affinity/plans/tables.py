"""The given tables seen as events, transactions and factor vectors."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.operators.factors import MFModel
from affinity.sources.readers import read_events

SITE = "s1"

EVENT_MAPPING = {
    "site": f"'{SITE}'",
    "user": "cast(user_id as string)",
    "item": "cast(get_json_object(props, '$.k') as int)",
    "event": "event_type",
    "ts": "ts",
    "event_id": "event_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_events(
        spark, "parquet", {"path": f"{sf_dir}/events.parquet"}, EVENT_MAPPING)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transaction headers: (site, user, group, ts)."""
    return table(spark, sf_dir, "orders").select(
        F.lit(SITE).alias("site"), F.col("o_custkey").cast("string").alias("user"),
        F.col("o_orderkey").alias("group"), F.col("o_orderdate").alias("ts"))


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ordered part: (group, item)."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group"), F.col("l_partkey").cast("int").alias("item"))


def branch(customer: str) -> Column:
    """One of three sites, by the customer's number."""
    return F.concat(F.lit("s"), (F.col(customer) % 3 + 1).cast("string"))


def brand_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ordered brand and supplier nation with its header: (site, user, group, ts, item)."""
    brands = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("brand"))
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group"), "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("group"), branch("o_custkey").alias("site"),
        F.col("o_custkey").cast("string").alias("user"), F.col("o_orderdate").alias("ts"))
    item = (F.col("brand") * 100 + F.col("s_nationkey")).cast("int").alias("item")
    return lines.join(brands, "l_partkey").join(nations, "l_suppkey").join(orders, "group").select(
        "site", "user", "group", "ts", item)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as stand-in factors: (id, features)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("features"))


def vector_model(spark: SparkSession, sf_dir: str) -> MFModel:
    """A factor model over the embeddings, the same vectors for users and items."""
    factors = vectors(spark, sf_dir)
    names = factors.select(F.col("id").cast("string").alias("term"), F.col("id").alias("idx"))
    return MFModel(SITE, 64, 0.0, names, names, factors, factors)
