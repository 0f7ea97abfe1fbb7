"""Connected components of an edge table by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers twice, and contracts the
    edges to what they point at; a star is done in one round and a path of n nodes in about log n rounds.
    What each round leaves is written to the shared folder, so lost executors cost one round at most.
    """
    edges = edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct()
    edges = written(edges, "edges")
    labels = written(edges.select("a").union(edges.select("b")).distinct().selectExpr("a node", "a component"), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.selectExpr("b", "a"))
        point = both.groupBy("a").agg(F.min("b").alias("to")).selectExpr("a node", "least(a, `to`) to")
        point = written(point, "pointers")
        for _ in range(2):
            point = point.alias("x").join(point.selectExpr("node next", "to after"), F.col("x.to") == F.col("next"), "left").selectExpr("node", "coalesce(after, to) to")
        point = written(point, "pointers")
        labels = written(labels.join(point.selectExpr("node component", "to"), "component", "left").selectExpr("node", "coalesce(to, component) component"), "labels")
        edges = edges.join(point.selectExpr("node a", "to ta"), "a").join(point.selectExpr("node b", "to tb"), "b")
        edges = written(edges.where("ta <> tb").selectExpr("least(ta, tb) a", "greatest(ta, tb) b").distinct(), "edges")
    return labels
