"""Identities: from matching records to persons, from persons to linked identities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.graph import components, conflicts, resolved, symmetric

c = F.col


def stage1(records: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, component) of all records, by the matches (a, b)."""
    labels = components(matches).select(c("node").alias("id"), "component")
    return records.select("id").join(labels.hint("merge"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def split_on_middle(members: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, component, spawn): components with several middle initials are parted by them.

    A record without a middle name goes to the initial with the highest mean verdict towards it, the smallest of
    equals. ``members``: id, component, middle_name; ``verdicts``: a, b, verdict (missing pairs count as 0). Tables of
    records are merged, not sent through the driver, however small their files are.
    """
    initial = F.substring("middle_name", 1, 1)
    held = members.withColumn("initial", F.when(c("middle_name") != "", initial))
    several = held.groupBy("component").agg(F.count_distinct("initial").alias("k")).where("k > 1").select("component")
    parted = held.join(several.hint("merge"), "component", "left_semi")
    decided = parted.where("initial is not null")
    sizes = decided.groupBy("component", "initial").agg(F.count("*").alias("size"))
    open_ = parted.where("initial is null").select(c("id").alias("a"), "component")
    votes = symmetric(verdicts.where("verdict <> 0").select("a", "b", "verdict")).join(open_.select("a").hint("merge"), "a").join(decided.select(c("id").alias("b"), "component", "initial").hint("merge"), "b")
    sums = votes.groupBy("a", "component", "initial").agg(F.sum("verdict").alias("total"))
    options = open_.join(sizes.hint("merge"), "component").join(sums.hint("merge"), ["a", "component", "initial"], "left").withColumn("mean", F.coalesce("total", F.lit(0)) / c("size"))
    best = options.groupBy("a").agg(F.min(F.struct((-c("mean")).alias("m"), "initial"))["initial"].alias("chosen"))
    out = held.join(best.withColumnRenamed("a", "id").hint("merge"), "id", "left").join(several.withColumn("parted", F.lit(True)).hint("merge"), "component", "left")
    return out.select("id", "component", F.when(c("parted"), F.coalesce("initial", "chosen")).otherwise("").alias("spawn"))


def labelled(members: DataFrame, group: list[str]) -> DataFrame:
    """(id, identity): STATE-n, groups of a state numbered from 0 by their smallest last name, then id."""
    heads = members.groupBy("STATE", *group).agg(F.min("last_name").alias("first_last"), F.min("id").alias("first_id"))
    w = Window.partitionBy("STATE").orderBy("first_last", "first_id")
    named = heads.withColumn("identity", F.concat_ws("-", "STATE", (F.row_number().over(w) - 1).cast("string")))
    return members.join(named.select("STATE", *group, "identity").hint("merge"), ["STATE", *group]).select("id", "identity")


def compatibility(pairs: DataFrame, verdicts: DataFrame, members: DataFrame) -> DataFrame:
    """(p, q, compatibility): mean verdict over all record pairs of two persons, those not compared counting 0."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    a, b = members.selectExpr("id a", "component p"), members.selectExpr("id b", "component q")
    sums = symmetric(verdicts.select("a", "b", "verdict")).join(a, "a").join(b, "b").groupBy("p", "q").agg(F.sum("verdict").alias("total"))
    held = pairs.join(sums, ["p", "q"], "left").join(sizes.selectExpr("component p", "n n1"), "p").join(sizes.selectExpr("component q", "n n2"), "q")
    return held.select("p", "q", (F.coalesce("total", F.lit(0)) / (c("n1") * c("n2"))).alias("compatibility"))


def merged(members: DataFrame, pairs: DataFrame, verdicts: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, component): persons whose compatibility is above ``least`` become one."""
    close = compatibility(pairs, verdicts, members).where(c("compatibility") > least)
    labels = components(close.selectExpr("p a", "q b")).withColumnRenamed("component", "into")
    held = members.join(labels.withColumnRenamed("node", "component"), "component", "left")
    return held.select("id", F.coalesce("into", "component").alias("component"))


def full_adjacency(identities: DataFrame) -> DataFrame:
    """(a, b): all ordered pairs of different records of an identity. Grows with the square of an identity's size."""
    return identities.selectExpr("identity", "id a").join(identities.selectExpr("identity", "id b"), "identity").where("a <> b").select("a", "b")


def related_list(adjacency: DataFrame) -> DataFrame:
    return adjacency.groupBy("identity1").agg(F.array_sort(F.collect_set("identity2")).alias("related"))


def cross(pairs: DataFrame, members: DataFrame, fields: list[str]) -> DataFrame:
    """(identity1, identity2, fields of both): record pairs of identity pairs, equal records of an identity once."""
    distinct = members.select("identity", *fields).distinct()
    for side in "12":
        pairs = pairs.join(distinct.select(c("identity").alias(f"identity{side}"), *[c(f).alias(f + side) for f in fields]), f"identity{side}")
    return pairs


def person_comparison(codes: DataFrame) -> DataFrame:
    """Best codes of identity pairs (identity1, identity2, n, o, e, osig, esig, f_with, f_without per record pair).

    Pairs whose best name code is below 3, or whose occupation and employer codes are all below 2, go. A conflict
    in any record pair makes the name code -1; the frequencies are those of the best name code.
    """
    best = codes.groupBy("identity1", "identity2").agg(
        F.max(F.struct("n", "f_with", "f_without")).alias("name"), F.min("n").alias("worst"),
        F.max(F.struct("o", F.coalesce("osig", F.lit(-1.0)).alias("sig"))).alias("occ"), F.max(F.struct("e", F.coalesce("esig", F.lit(-1.0)).alias("sig"))).alias("emp"),
    )
    held = best.where((c("name.n") >= 3) & ((c("occ.o") >= 2) | (c("emp.e") >= 2)))
    return held.select("identity1", "identity2", F.when(c("worst") < 0, -1).otherwise(c("name.n")).alias("n"), "name.f_with", "name.f_without", c("occ.o").alias("o"), c("occ.sig").alias("osig"), c("emp.e").alias("e"), c("emp.sig").alias("esig"))


def verdict(pairs: DataFrame, calibrated: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Add the verdict of identity pairs.

    ``calibrated``: (key, f1, f2), the accepted frequencies for name code 4 by o_4, e_4, ... e_2; ``thresholds``:
    (key, most) for name code 3. Occupation goes before employer at each level, levels go from 4 to 2.
    """
    keys = [f"{f}_{k}" for k in (4, 3, 2) for f in "oe"]
    allowed = calibrated.groupBy("f1", "f2").agg(F.collect_set("key").alias("allowed"))
    limit = thresholds.groupBy().pivot("key", keys).agg(F.first("most"))
    f1, f2 = F.coalesce("f_with", F.lit(0)), F.coalesce("f_without", F.lit(0))
    held = pairs.withColumns({"f1": f1, "f2": f2}).join(allowed, ["f1", "f2"], "left").join(F.broadcast(limit))
    four, three = F.lit(0), F.lit(0)
    for key in reversed(keys):
        field, level = key[0], int(key[2])
        fits = c(field) == level
        four = F.when(fits & F.coalesce(F.array_contains("allowed", key), F.lit(False)), 3 * level).otherwise(four)
        three = F.when(fits & F.coalesce(c("f2") < c(key), F.lit(False)), 2 * level).otherwise(three)
    exact = (c("e") == 4) & (c("o") >= 3) | (c("o") == 4) & (c("e") >= 3)
    found = (
        F.when(c("n").between(0, 2) | (c("o") < 2) & (c("e") < 2), 0).when(c("n") == -1, F.when(exact, 1).otherwise(-1)).when(c("n") == 4, four).when(c("n") == 3, three).otherwise(0)
    )
    return held.withColumn("verdict", found).drop("f1", "f2", "allowed", *keys)


def adjacency(pairs: DataFrame) -> DataFrame:
    """(identity1, identity2, verdict) with the smaller identity first; of repeated pairs the highest verdict."""
    return pairs.groupBy(F.least("identity1", "identity2").alias("identity1"), F.greatest("identity1", "identity2").alias("identity2")).agg(F.max("verdict").alias("verdict"))


def reachable(adjacency_: DataFrame) -> DataFrame:
    """(node, component) over verdicts of 1 or more."""
    return components(adjacency_.where("verdict >= 1").selectExpr("identity1 a", "identity2 b"))


def super_identities(adjacency_: DataFrame) -> DataFrame:
    """(component, members, conflicts)."""
    labels = reachable(adjacency_)
    bad = conflicts(labels, adjacency_.where("verdict = -1").selectExpr("identity1 a", "identity2 b"))
    groups = labels.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members"))
    return groups.join(bad, "component", "left").select("component", "members", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def linked(adjacency_: DataFrame) -> DataFrame:
    """(identity, super): linked identities without a conflict inside."""
    good = adjacency_.where("verdict >= 1").selectExpr("identity1 a", "identity2 b", "cast(verdict as double) score")
    bad = adjacency_.where("verdict = -1").selectExpr("identity1 a", "identity2 b")
    return resolved(good, bad, reachable(adjacency_)).selectExpr("node identity", "`group` super")


def linked_pairs(links: DataFrame) -> DataFrame:
    """(identity1, identity2): all ordered pairs within a super identity."""
    return links.selectExpr("super", "identity identity1").join(links.selectExpr("super", "identity identity2"), "super").where("identity1 <> identity2").select("identity1", "identity2")


def compound(links: DataFrame) -> DataFrame:
    """(identity, compound): the sorted members of the super identity, joined by |."""
    groups = links.groupBy("super").agg(F.array_join(F.array_sort(F.collect_set("identity")), "|").alias("compound"))
    return links.join(groups, "super").select("identity", "compound")


def bootstrap_split(identities: DataFrame, share: int = 8) -> DataFrame:
    """(id, identity): identities of several records, by a coin of ``share`` sixteenths, cut into halves |1 and |2."""
    coin = F.conv(F.substring(F.md5(c("identity").cast("binary")), 1, 1), 16, 10).cast("int") < share
    w = Window.partitionBy("identity")
    held = identities.withColumns({"k": F.row_number().over(w.orderBy("id")), "n": F.count("*").over(w)})
    half = F.when(c("k") <= F.floor(c("n") / 2), "|1").otherwise("|2")
    return held.select("id", F.when(coin & (c("n") > 1), F.concat("identity", half)).otherwise(c("identity")).alias("identity"))


def split_matches(pairs: DataFrame) -> DataFrame:
    """Pairs of identities with their roots, and whether both are halves of one."""
    def root(x: str) -> Column:
        return F.regexp_extract(x, r"^(.*)\|([12])", 1)

    both = (root("identity1") != "") & (root("identity2") != "")
    return pairs.select("identity1", "identity2", (both & (root("identity1") == root("identity2"))).alias("recovered"))


def histogram2d(points: DataFrame) -> DataFrame:
    """(f1, f2, n) of frequencies below 1199 and 99."""
    return points.where("f1 is not null and f2 is not null and f1 between 0 and 1198 and f2 between 0 and 98").groupBy("f1", "f2").agg(F.count("*").alias("n"))


def mass_threshold(counts: DataFrame, percent: float) -> DataFrame:
    """The count at which the ascending cumulative sum passes 100 - ``percent`` of all: (threshold)."""
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    sizes = counts.groupBy("n").agg(F.sum("n").alias("m"))
    total = sizes.agg(F.sum("m").alias("all"))
    held = sizes.withColumn("cum", F.sum("m").over(w)).join(F.broadcast(total)).where(c("cum") > c("all") * (1 - percent / 100))
    return held.agg(F.min("n").alias("threshold"))


def percentile_bin(counts: DataFrame, value: str, percent: float) -> DataFrame:
    """The first value at which the cumulative count is above ``percent`` of all: (threshold)."""
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.agg(F.sum("n").alias("all"))
    held = counts.withColumn("cum", F.sum("n").over(w)).join(F.broadcast(total)).where(c("cum") > c("all") * percent / 100)
    return held.agg(F.min(value).alias("threshold"))


def blurred_region(counts: list[tuple[int, int, int]], threshold: float, sigma: float = 1.5, shape: tuple[int, int] = (1199, 99)) -> list[tuple[int, int]]:
    """Cells (f1, f2) of the blurred histogram above a threshold; the grid is of fixed size, so this is driver work."""
    grid = np.zeros(shape)
    for f1, f2, n in counts:
        grid[f1, f2] = n
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(grid, pad, mode="symmetric")
        grid = sum(k * np.take(wide, range(i, i + shape[axis]), axis=axis) for i, k in enumerate(kernel))
    return [(int(a), int(b)) for a, b in zip(*np.where(grid > threshold), strict=True)]


def related_of(adjacency_: DataFrame, wanted: DataFrame) -> DataFrame:
    """(identity, related, verdict): the identities that were compared with the wanted ones (identity)."""
    both = adjacency_.union(adjacency_.select("identity2", "identity1", "verdict"))
    return both.join(wanted.selectExpr("identity identity1"), "identity1", "left_semi").selectExpr("identity1 identity", "identity2 related", "verdict")


def linked_of(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """(identity, linked): the identities of the same super identity as the wanted ones, by ``links`` (identity, super)."""
    mine = links.join(wanted, "identity", "left_semi")
    return mine.join(links.selectExpr("super", "identity linked"), "super").where("identity <> linked").select("identity", "linked")
