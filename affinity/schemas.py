"""Schemas of the public tables. Every reader binds columns by name."""

from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("item", T.IntegerType()),
    T.StructField("event", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("event_id", T.LongType()),
])

PREF = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("item", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])

CONTEXT_PREF = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("dayOfweek", T.IntegerType()),
    T.StructField("hourOfday", T.IntegerType()),
    T.StructField("related", T.StringType()),
    T.StructField("score", T.DoubleType()),
])

EVENT_ID = T.StructField("event_id", T.LongType())

POINT = T.StructType([
    T.StructField("target", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
])

PARAMS = T.StructType([
    T.StructField("col", T.IntegerType()),
    T.StructField("block", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("w", T.DoubleType()),
    T.StructField("v", T.ArrayType(T.DoubleType())),
])

RATED = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

MATRIX = T.StructType([
    T.StructField("col", T.IntegerType()),
    T.StructField("sim_col", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])

LAYOUT = T.StructType([
    T.StructField("col", T.IntegerType()),
    T.StructField("block", T.StringType()),
    T.StructField("term", T.StringType()),
])

_RULE_FIELDS = [
    T.StructField("antecedent", T.ArrayType(T.IntegerType())),
    T.StructField("consequent", T.ArrayType(T.IntegerType())),
    T.StructField("support", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
]
RULE = T.StructType(_RULE_FIELDS)

SITE_RULE = T.StructType([T.StructField("site", T.StringType()), *_RULE_FIELDS])

WEIGHTED_RULE = T.StructType(_RULE_FIELDS + [T.StructField("weight", T.DoubleType())])

USER_RULES = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("items", T.ArrayType(WEIGHTED_RULE)),
])

SIMILAR_COLUMNS = T.StructType([
    T.StructField("col", T.IntegerType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("col", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]))),
])

SIMILAR_FIELDS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]))),
])

# The context part of a request, in the order of the feature vector.
CONTEXT_COLS = ("event", "dayOfweek", "hourOfday", "related")

# Block order of a feature vector.
BLOCKS = ("user", "item", "rated", "day", "hour", "event", "related")
DAYS, HOURS = 7, 24
