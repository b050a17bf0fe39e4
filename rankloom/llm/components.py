"""Connected components of an edge table by least labels with pointer jumping; every step is a join, written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node that its component holds.

    The rounds needed grow with the logarithm of the longest chain of links. Joins have one row a node on one
    side, so a node with very many links is only a skewed probe side. No edges: no rows.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        less = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        now = written(less.join(jump, "via").select("node", "old", F.least("via", "far").alias("label")), "labels")
        if now.filter("label != old").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")
