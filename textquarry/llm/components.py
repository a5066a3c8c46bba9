"""Connected components of an edge table by hooking to the smallest neighbour and jumping to roots.

Every step is a partial aggregation or a join that deals hot keys over slices; edges between finished components vanish,
so the tables shrink each round, and each round is staged in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for every node with an edge to another node, the smallest node it is connected with.

    Self-loops and nulls are ignored; repeated edges count once; an empty table gives no rows.
    """
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stage(given.union(given.select("b", "a")).distinct(), "edges", narrow=True)
    labels = None
    while True:
        parents = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("parent")), "parents", narrow=True)
        if parents.isEmpty():
            break
        for _ in range(2):
            up = parents.select(F.col("a").alias("parent"), F.col("parent").alias("_up"))
            parents = stage(salted_join(parents, up, "parent", ["a"], "left").select("a", F.coalesce("_up", "parent").alias("parent")), "parents", narrow=True)
        if labels is None:
            labels = parents.select(F.col("a").alias("node"), F.col("parent").alias("label"))
        else:
            up = parents.select(F.col("a").alias("label"), F.col("parent").alias("_up"))
            labels = stage(salted_join(labels, up, "label", ["node"], "left").select("node", F.coalesce("_up", "label").alias("label")), "labels", narrow=True)
        left = salted_join(both, parents.select("a", F.col("parent").alias("_a")), "a", ["b"], "left").select(F.coalesce("_a", "a").alias("_a"), "b")
        right = salted_join(stage(left, "edges", narrow=True), parents.select(F.col("a").alias("b"), F.col("parent").alias("_b")), "b", ["_a"], "left")
        both = stage(right.select(F.col("_a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct(), "edges", narrow=True)
    return labels if labels is not None else given.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
