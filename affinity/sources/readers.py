"""Scans. Schemas are explicit: nothing is inferred, and filters reach the file scan."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinity.functions.arrays import split_list
from affinity.schemas import CONTEXT_PREF, EVENT_ID, POINT, PREF
from affinity.validation import SINKS, SOURCES, one_of


# The folders of preferences stored by site.
SITE_FOLDER, SITE_MARK = "by_site", "site-"
# A missing value in CSV differs from an empty text.
FORMAT_OPTIONS = {"csv": {"header": "true", "nullValue": "\\N"}, "parquet": {}}


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    one_of("fmt", fmt, SINKS)
    return spark.read.schema(schema).options(**FORMAT_OPTIONS[fmt]).format(fmt).load(path)


def read_preferences(
    spark: SparkSession, path: str, fmt: str = "parquet", by_site: bool = False
) -> DataFrame:
    """Preferences from Parquet or CSV, ``by_site`` if they were written so.

    A site is text whatever it looks like: its folder has a mark before it, so no type is
    inferred and an empty site is not a missing one. A filter on the site reads its folder only.
    """
    if not by_site:
        return _read(spark, path, PREF, fmt)
    inside = T.StructType([f for f in PREF if f.name != "site"] + [T.StructField(SITE_FOLDER, T.StringType())])
    site = F.substring(SITE_FOLDER, len(SITE_MARK) + 1, 1 << 30)
    return _read(spark, path, inside, fmt).withColumn("site", site).select(*PREF.names)


def read_context_preferences(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Context preferences from Parquet or CSV, with the id of the event behind each."""
    return _read(spark, path, T.StructType([EVENT_ID, *CONTEXT_PREF]), fmt)


def parse_points(lines: DataFrame, col: str = "value") -> DataFrame:
    """``target,f1 f2 ...`` to (target, features)."""
    parts = F.split(F.col(col), ",", 2)
    return lines.select(
        F.get(parts, F.lit(0)).try_cast("double").alias("target"),
        split_list(F.get(parts, F.lit(1)), " ", "double").alias("features"),
    )


def read_points(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Feature points from delimited text or from Parquet."""
    one_of("fmt", fmt, SOURCES)
    if fmt == "text":
        return parse_points(spark.read.text(path))
    return spark.read.schema(POINT).parquet(path)


def map_columns(df: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """Rename and derive columns: name to SQL expression or Column."""
    return df.select(*[
        (e if isinstance(e, Column) else F.expr(e)).alias(name) for name, e in mapping.items()
    ])


def read_events(
    spark: SparkSession,
    fmt: str,
    options: Mapping[str, str] | None = None,
    mapping: Mapping[str, str | Column] | None = None,
    schema=None,
    stream: bool = False,
) -> DataFrame:
    """Events from any Spark data source (files, ``jdbc``, a store's own connector).

    ``mapping`` gives site, user, item, event, ts, event_id as expressions over the
    stored columns; the scan then reads only what they name.
    """
    reader = (spark.readStream if stream else spark.read).format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    stored = reader.options(**(options or {})).load()
    return map_columns(stored, mapping) if mapping else stored
