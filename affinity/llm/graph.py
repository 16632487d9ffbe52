"""Connected components by minimum labels, as tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.operators.skew import spread_join
from affinity.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges (a, b).

    Each round gives a node the least of its own label, its label's label and its neighbours' labels, so
    distances halve. Only tables of edges and labels exist, written once a round; the driver
    learns whether a label changed. No edges: no rows. A self loop gives a node of its own.
    """
    both = written(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .filter("node is not null and other is not null").distinct(), "edges")
    labels = written(
        both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    while True:
        near = spread_join(both, labels.toDF("other", "near"), ["other"]).select("node", "near")
        above = spread_join(labels, labels.toDF("component", "near"), ["component"]).select("node", "near")
        least = near.union(above).groupBy("node").agg(F.min("near").alias("near"))
        moved = written(labels.join(least, "node").select(
            "node", F.least("component", "near").alias("component"),
            (F.col("near") < F.col("component")).alias("moved")), "labels")
        labels = moved.select("node", "component")
        if moved.filter("moved").isEmpty():
            return labels
