"""Affiliation graphs: who moved between which employers or occupations, and which edges mean something."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kindred.operators.graph import ordered_pair, symmetric


def transitions(members: DataFrame, person: str, when: str, what: str, order: str = "id") -> DataFrame:
    """(person, a, b): consecutive affiliations of a person's timeline, empty ones left out."""
    w = Window.partitionBy(person).orderBy(when, order)
    held = members.where(F.coalesce(what, F.lit("")) != "")
    return held.select(person, F.col(what).alias("a"), F.lead(what).over(w).alias("b")).where("b is not null")


def transition_edges(members: DataFrame, person: str, when: str, what: str, order: str = "id", doubled: bool = True) -> DataFrame:
    """(a, b, weight) with a < b. Each transition counts in both directions, so weights are doubled unless told not to."""
    moves = transitions(members, person, when, what, order).where("a <> b")
    return moves.groupBy(*ordered_pair("a", "b")).agg((F.count("*") * (2 if doubled else 1)).alias("weight"))


def directed_edges(members: DataFrame, person: str, when: str, what: str, order: str = "id") -> DataFrame:
    """(a, b, weight): transitions as they went, those to itself as well."""
    return transitions(members, person, when, what, order).groupBy("a", "b").agg(F.count("*").alias("weight"))


def cooccurrence(members: DataFrame, person: str, what: str) -> DataFrame:
    """(a, b, weight): for each ordered pair of a person's affiliations, how often the person has the first."""
    counts = members.where(F.coalesce(what, F.lit("")) != "").groupBy(person, F.col(what).alias("v")).agg(F.count("*").alias("n"))
    pairs = counts.withColumnRenamed("v", "a").join(counts.select(person, F.col("v").alias("b")), person).where("a <> b")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("weight"))


def migrations(members: DataFrame, person: str, what: str) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, weight) over the sets of values of persons, itself included, and nodes (node, score)."""
    held = members.where(F.coalesce(what, F.lit("")) != "").select(person, F.col(what).alias("a")).distinct()
    sizes = held.groupBy(person).agg((F.count("*") - 1).alias("others"))
    edges = held.join(held.withColumnRenamed("a", "b"), person).groupBy("a", "b").agg(F.count("*").alias("weight"))
    nodes = held.join(sizes, person).groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("score"))
    return edges, nodes


def cooccurrence_sets(members: DataFrame, person: str, what: str, single: Column) -> DataFrame:
    """One line for each person with several single-word affiliations."""
    held = members.where((F.col(what) != "") & single).groupBy(person).agg(F.array_sort(F.collect_set(what)).alias("s")).where(F.size("s") > 1)
    return held.select(person, F.array_join("s", "|").alias("line"))


def nodes(members: DataFrame, what: str, committees: DataFrame) -> DataFrame:
    """(node, score, size, dem, rep, oth): records of an affiliation, its size in a plot, dollars by party."""
    party = committees.select("CMTE_ID", F.col("CMTE_PTY_AFFILIATION").alias("party"))
    held = members.where(F.coalesce(what, F.lit("")) != "").join(party, "CMTE_ID", "left")

    def dollars(test: Column) -> Column:
        return F.round(F.coalesce(F.sum(F.when(test, F.col("TRANSACTION_AMT"))), F.lit(0.0)), 2)

    known = F.col("party").isNotNull()
    return held.groupBy(F.col(what).alias("node")).agg(
        F.count("*").alias("score"), F.sqrt(F.count("*")).alias("size"), dollars(F.col("party") == "DEM").alias("dem"), dollars(F.col("party") == "REP").alias("rep"),
        dollars(known & ~F.col("party").isin("DEM", "REP")).alias("oth"),
    )


def combined(edges: DataFrame) -> DataFrame:
    """The national graph: weights of the states' edges summed for each pair."""
    return edges.groupBy(*ordered_pair("a", "b")).agg(F.sum("weight").alias("weight"))


def strength(edges: DataFrame) -> DataFrame:
    """(node, strength): the weight at each node."""
    return symmetric(edges.select("a", "b", "weight")).groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("strength"))


def log_tail(w: float, n: float, p: float) -> float:
    """log of P[X >= w] for X ~ Bin(n, p); terms are summed from the largest on until they no longer count."""
    if not (w > 0 and n > 0 and 0 < p < 1) or w > n:
        return math.nan
    start = int(max(w, min(n, math.floor((n + 1) * p))))
    head = math.lgamma(n + 1)

    def term(k: float) -> float:
        return head - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)

    top = term(start)
    total = 0.0
    for steps in (range(start, int(n) + 1), range(start - 1, int(w) - 1, -1)):
        for k in steps:
            x = math.exp(term(k) - top)
            total += x
            if x < 1e-18:
                break
    return top + math.log(total)


@F.pandas_udf(DoubleType())
def tail_significance(w: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    held: dict[tuple[float, float, float], float] = {}
    out = np.empty(len(w))
    for i, key in enumerate(zip(w, n, p, strict=True)):
        if key not in held:
            held[key] = -log_tail(*key)
        out[i] = held[key]
    return pd.Series(out)


def significance(edges: DataFrame) -> DataFrame:
    """Edges with -log of the chance of their weight or more, given the strengths of their ends.

    The chance of one unit is ku * kv / (2 q * q), q being half of all strengths. Where it is not defined the
    edge gets the highest significance. Distinct (weight, ku, kv) are computed once.
    """
    k = strength(edges)
    q = k.agg((F.sum("strength") / 2).alias("q"))
    held = edges.join(k.selectExpr("node a", "strength ku"), "a").join(k.selectExpr("node b", "strength kv"), "b")
    cases = held.select("weight", F.least("ku", "kv").alias("k1"), F.greatest("ku", "kv").alias("k2")).distinct()
    cases = cases.join(F.broadcast(q)).withColumn("p", F.col("k1") * F.col("k2") / F.col("q") / F.col("q") / 2)
    cases = cases.withColumn("s", F.nanvl(tail_significance(F.col("weight").cast("double"), F.col("q").cast("double"), "p"), F.lit(None).cast("double")))
    most = cases.agg(F.max("s").alias("most"))
    cases = cases.join(F.broadcast(most)).select("weight", "k1", "k2", F.coalesce("s", "most").alias("significance"))
    found = held.withColumns({"k1": F.least("ku", "kv"), "k2": F.greatest("ku", "kv")}).join(cases, ["weight", "k1", "k2"])
    return found.select("a", "b", "weight", "significance")


def directed_significance(edges: DataFrame) -> DataFrame:
    """The same for directed edges: the chance of one unit is k_out * k_in / (q * q), q being all weight."""
    out = edges.groupBy("a").agg(F.sum("weight").alias("ku"))
    into = edges.groupBy("b").agg(F.sum("weight").alias("kv"))
    q = edges.agg(F.sum("weight").alias("q"))
    held = edges.join(out, "a").join(into, "b").join(F.broadcast(q)).withColumn("p", F.col("ku") * F.col("kv") / F.col("q") / F.col("q"))
    s = tail_significance(F.col("weight").cast("double"), F.col("q").cast("double"), "p")
    return held.select("a", "b", "weight", F.nanvl(s, F.lit(None).cast("double")).alias("significance"))


def pruned_percent(edges: DataFrame, value: str, percent: int) -> DataFrame:
    """The top ``percent`` of the edges by a value, ties included; 0 keeps all."""
    n = edges.count()
    skip = n - n * percent // 100
    if not percent or not n or skip >= n:
        return edges
    least = edges.select(value).orderBy(value).offset(skip).limit(1)
    return edges.join(F.broadcast(least.withColumnRenamed(value, "_least"))).where(F.col(value) >= F.col("_least")).drop("_least")


def pruned_count(edges: DataFrame, value: str, remove: int) -> DataFrame:
    """All but the ``remove`` smallest edges by a value, then by a and b."""
    gone = edges.select("a", "b", value).orderBy(value, "a", "b").limit(remove)
    return edges.join(gone.select("a", "b"), ["a", "b"], "left_anti")
