"""Connected components by star contraction: only groupings and joins, a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from risemeter.llm.tables import saved


def _hung_up(edges: DataFrame, key: str, value: str) -> DataFrame:
    """(node, neighbour, least): every edge with the smallest node that its ``key`` sees, itself included.

    The minimum is combined before the shuffle; the join back meets one row per key, so AQE can split a node with very many edges.
    """
    least = edges.groupBy(F.col(key).alias("node")).agg(F.min(value).alias("seen")).select("node", F.least("node", "seen").alias("least"))
    return edges.select(F.col(key).alias("node"), F.col(value).alias("neighbour")).join(least, "node")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b): the root is the smallest node reachable."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        large = _hung_up(both, "child", "parent").where("neighbour > node").select(F.col("neighbour").alias("child"), F.col("least").alias("parent"))
        small = _hung_up(large.where("child <> parent").distinct(), "child", "parent")
        pulled = small.where("neighbour <> least").select(F.col("neighbour").alias("child"), F.col("least").alias("parent"))
        kept = small.select(F.col("node").alias("child"), F.col("least").alias("parent"))
        edges = saved(pulled.unionByName(kept).distinct(), "stars")
        twice = edges.groupBy("child").count().where("count > 1").select("child")
        chained = edges.select("child").join(edges.select(F.col("parent").alias("child")), "child", "left_semi")
        if not twice.unionByName(chained).limit(1).count():
            break
    roots = edges.select(F.col("parent").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(roots)
