"""Graphs as edge tables: components, neighbourhoods, communities, conflict resolution, balanced packing."""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.cluster import written


def ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge (a, b, ...) in both directions."""
    swapped = edges.select(*[F.col({"a": "b", "b": "a"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(swapped)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers twice, and contracts the edges to
    what they point at; a star is done in one round and a path of n nodes in about log n rounds. What each round
    leaves is written to the shared folder, so lost executors cost one round at most. Files of numbers look small to
    Spark; the hints keep tables of nodes from being sent through the driver.
    """
    labels = written(edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("component")), "labels")
    edges = written(edges.where("a <> b").select(*ordered_pair("a", "b")).distinct(), "edges")
    while not edges.isEmpty():
        both = symmetric(edges)
        point = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("node"), F.least("a", "to").alias("to"))
        point = written(point, "pointers")
        for _ in range(2):
            point = point.join(point.selectExpr("node to", "to after").hint("merge"), "to", "left").select("node", F.coalesce("after", "to").alias("to"))
        point = written(point, "pointers")
        labels = written(labels.join(point.selectExpr("node component", "to").hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        edges = edges.join(point.selectExpr("node a", "to ta").hint("merge"), "a").join(point.selectExpr("node b", "to tb").hint("merge"), "b")
        edges = written(edges.where("ta <> tb").select(*ordered_pair("ta", "tb")).distinct(), "edges")
    return labels


def with_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """All nodes with their component; those without an edge are one of their own."""
    found = components(edges).withColumnRenamed("node", node)
    return nodes.join(found, node, "left").withColumn("component", F.coalesce("component", node))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within ``hops`` + 1 steps of ``start`` (node), with the first step that reaches them."""
    both = symmetric(edges.select("a", "b")).distinct()
    seen = written(start.select("node").distinct().withColumn("hop", F.lit(0)), "hops")
    front = seen
    for hop in range(1, hops + 2):
        front = front.join(both.withColumnRenamed("a", "node"), "node").select(F.col("b").alias("node")).distinct()
        front = written(front.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "hops")
        seen = seen.unionByName(front)
    return seen


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label) by label propagation: each round the heaviest label around, the smallest of equals."""
    both = written(symmetric(edges.select("a", "b", "weight")), "edges")
    labels = written(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.max("w").alias("w"))
        labels = written(votes.join(best, ["a", "w"]).groupBy("a").agg(F.min("label").alias("label")).withColumnRenamed("a", "node"), "labels")
    return labels


def resolved(positive: DataFrame, negative: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, group): components of ``positive`` (a, b, score), parted so that no group holds a pair of ``negative``.

    Only components that hold such a pair are worked on. There the edges join groups from the highest score down, the
    smallest pair first, unless that would bring a negative pair together. ``labels``: (node, component).
    """
    at_a, at_b = labels.selectExpr("node a", "component"), labels.selectExpr("node b", "component cb")
    inside = positive.join(at_a, "a").select("component", "a", "b", "score")
    apart = negative.join(at_a, "a").join(at_b, "b").where("component = cb").select("component", "a", "b", F.lit(None).cast("double").alias("score"))
    bad = apart.select("component").distinct()
    work = inside.join(bad, "component", "left_semi").unionByName(apart)

    def part(group: pd.DataFrame) -> pd.DataFrame:
        foes: dict = {}
        for r in group[group.score.isna()].itertuples():
            foes.setdefault(r.a, set()).add(r.b)
            foes.setdefault(r.b, set()).add(r.a)
        edges = group[group.score.notna()].sort_values(["score", "a", "b"], ascending=[False, True, True])
        nodes = sorted(set(group.a) | set(group.b))
        head = {n: n for n in nodes}
        members, enemies = {n: {n} for n in nodes}, {n: set(foes.get(n, ())) for n in nodes}
        for r in edges.itertuples():
            x, y = sorted((head[r.a], head[r.b]))
            if x == y or members[x] & enemies[y]:
                continue
            for n in members[y]:
                head[n] = x
            members[x] |= members.pop(y)
            enemies[x] |= enemies.pop(y)
        return pd.DataFrame({"node": nodes, "group": [head[n] for n in nodes]})

    kind = labels.schema["node"].dataType.simpleString()
    parted = work.groupBy("component").applyInPandas(part, f"node {kind}, group {kind}")
    whole = labels.join(bad, "component", "left_anti").selectExpr("node", "component group")
    return whole.unionByName(parted)


def conflicts(positive_labels: DataFrame, negative: DataFrame) -> DataFrame:
    """(component, conflicts): how many negative pairs each component holds."""
    at_a, at_b = positive_labels.selectExpr("node a", "component"), positive_labels.selectExpr("node b", "component cb")
    pairs = negative.select(*ordered_pair("a", "b")).distinct().join(at_a, "a").join(at_b, "b").where("component = cb")
    return pairs.groupBy("component").agg(F.count("*").alias("conflicts"))


def collapsed(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Contract ``nodes`` (node, label, size) by ``groups`` (node, group): summed size, labels, label of the largest."""
    held = nodes.join(groups, "node")
    return held.groupBy("group").agg(
        F.sum("size").alias("size"),
        F.array_join(F.array_sort(F.collect_list("label")), "|").alias("labels"),
        F.max(F.struct("size", "label"))["label"].alias("main"),
        F.min("node").alias("first"),
    )


def balanced(sizes: DataFrame, parts: int, buckets: int = 1024) -> DataFrame:
    """(item, part): items packed onto parts of about equal total size, largest first onto the lightest.

    Items are grouped by hash into ``buckets`` whose totals the driver packs; so the driver's part is bounded.
    """
    hashed = sizes.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)).cast("int"))
    totals = hashed.groupBy("bucket").agg(F.sum("size").alias("size")).collect()
    heap = [(0, p) for p in range(parts)]
    where = {}
    for r in sorted(totals, key=lambda r: (-r["size"], r.bucket)):
        held, p = heapq.heappop(heap)
        where[r.bucket] = p
        heapq.heappush(heap, (held + r["size"], p))
    if not where:
        return sizes.select("item", F.lit(0).alias("part"))
    pick = F.create_map(*[F.lit(x) for pair in where.items() for x in pair])
    return hashed.select("item", F.element_at(pick, F.col("bucket")).alias("part"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def top_neighbours(nodes: DataFrame, edges: DataFrame, n: int, k: int) -> DataFrame:
    """(node, neighbour, rank): the ``n`` largest nodes (node, size) and up to ``k`` neighbours each, smallest first."""
    top = nodes.orderBy(F.desc("size"), "node").limit(n)
    around = symmetric(edges.select("a", "b")).join(top.select(F.col("node").alias("a")), "a").join(nodes.selectExpr("node b", "size"), "b")
    w = Window.partitionBy("a").orderBy("size", "b")
    return around.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).selectExpr("a node", "b neighbour", "rank")
