"""Connected components of an edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a long, b long); root is the component's smallest node.

    Each round points every node to its smallest neighbour and rewrites the edges between
    what is pointed to; edges that become loops go. A star takes one round, a path a
    logarithmic number. Each round is written to the shared folder, so lost executors cost
    no more than a round.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = cut(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("root", F.col("node")))
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("child"), F.least("a", "b").alias("parent")))
        names = cut(names.join(parent, F.col("root") == F.col("child"), "left").select("node", F.coalesce("parent", "root").alias("root")))
        other = parent.toDF("child2", "parent2")
        left = cut(
            left.join(parent, F.col("a") == F.col("child"))
            .join(other, F.col("b") == F.col("child2"))
            .where("parent <> parent2")
            .select(F.least("parent", "parent2").alias("a"), F.greatest("parent", "parent2").alias("b"))
            .distinct()
        )
    return names
