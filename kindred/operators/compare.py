"""Record comparators over tables of pairs.

A table of pairs has the fields of both records with the suffixes 1 and 2 (last1, last2, middle1, ...) and the results
of lookups: ``variant``, ``known1``, ``known2``, ``last_freq1``, ``last_freq2``, ``first_freq1``, ``first_freq2``,
``employer_sig``, ``occupation_sig`` (significance of the affiliation edge, null where there is none).
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.cluster import written
from kindred.functions.text import bad_employer, bad_occupation, sorted_distance, tokens_permuted, within
from kindred.operators.tokens import FIRST, LAST, RARE, with_frequency

#: Names that cannot be one person's.
CONFLICT = -1000
EMPLOYER_TOLERANCE, OCCUPATION_TOLERANCE = 0.3, 0.2
c = F.col


def pairs_of(records: DataFrame, pairs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Pairs (a, b) with the ``fields`` (name here: column) of both records."""
    for side, key in (("1", "a"), ("2", "b")):
        pairs = pairs.join(records.select(F.col("id").alias(key), *[F.col(v).alias(k + side) for k, v in fields.items()]), key)
    return pairs


FIELDS = {"last": "last_name", "middle": "middle_name", "first": "first_name", "employer": "EMPLOYER", "occupation": "OCCUPATION", "address": "address", "zip": "zip", "city": "CITY", "state": "STATE"}


def with_lookups(pairs: DataFrame, counts: DataFrame, variants: DataFrame, known: DataFrame, employer_edges: DataFrame, occupation_edges: DataFrame) -> DataFrame:
    """Add the results of all lookups."""
    for side in "12":
        pairs = with_frequency(pairs, counts, LAST, f"last{side}", f"last_freq{side}")
        pairs = with_frequency(pairs, counts, FIRST, f"first{side}", f"first_freq{side}")
        pairs = pairs.join(known.distinct().select(c("name").alias(f"first{side}"), F.lit(True).alias(f"known{side}")), f"first{side}", "left")
        pairs = pairs.withColumn(f"known{side}", F.coalesce(f"known{side}", F.lit(False)))
    both = variants.select(c("name").alias("first1"), c("variant").alias("first2")).union(variants.select("variant", "name")).distinct()
    pairs = pairs.join(both.withColumn("variant", F.lit(True)), ["first1", "first2"], "left").withColumn("variant", F.coalesce("variant", F.lit(False)))
    for field, edges in (("employer", employer_edges), ("occupation", occupation_edges)):
        held = edges.select(c("a").alias("_a"), c("b").alias("_b"), c("significance").alias(f"{field}_sig"))
        low, high = F.least(f"{field}1", f"{field}2"), F.greatest(f"{field}1", f"{field}2")
        pairs = pairs.join(held, (low == c("_a")) & (high == c("_b")), "left").drop("_a", "_b")
    return pairs


def _strict_names() -> Column:
    middle = (c("middle1") == "") & (c("middle2") == "") | (c("middle1") != "") & ((c("middle2") == "") | (c("middle1") == c("middle2")))
    last = (c("last1") != "") & (c("last2") != "") & (sorted_distance(c("last1"), c("last2")) <= 2)

    def spaced(s: str) -> Column:
        return F.array_join(F.split(s, ""), " ")

    first = (F.levenshtein(spaced("first1"), spaced("first2")) <= 1) | c("variant")
    return middle & last & first


def strict_address() -> Column:
    """Same address, names that agree but for a letter or a variant; the second may lack the middle name."""
    return (c("address1") != "") & (c("address2") != "") & (c("address1") == c("address2")) & _strict_names()


def strict_affiliation() -> Column:
    """The same with employer and occupation for the address."""
    same = (c("employer1") == c("employer2")) & (c("occupation1") == c("occupation2"))
    return same & (c("employer1") != "") & (c("occupation1") != "") & _strict_names()


def zip_code() -> Column:
    return F.when((c("zip1") == "") | (c("zip2") == ""), 1).when(F.substring("zip1", 1, 5) == F.substring("zip2", 1, 5), 2).otherwise(0)


def _affiliation(own: str, other: str, bad, tolerance: float, permuted: bool) -> Column:
    x, y, ox, oy = c(f"{own}1"), c(f"{own}2"), c(f"{other}1"), c(f"{other}2")
    close = within(x, y, tolerance)
    if permuted:
        close = close | tokens_permuted(x, y)
    crossed = (x == oy) | (y == ox) | (oy != "") & within(x, oy, tolerance) | (ox != "") & within(y, ox, tolerance)
    return (
        F.when(bad(x) & bad(y) & (x == y), 2).when(bad(x) | bad(y), 1).when(x == y, 4).when(c(f"{own}_sig").isNotNull(), 3).when(close | crossed, 3).otherwise(0)
    )


def occupations() -> Column:
    """0 different, 1 unknown, 2 equal but of little meaning, 3 near or linked, 4 equal."""
    return _affiliation("occupation", "employer", bad_occupation, OCCUPATION_TOLERANCE, False)


def employers() -> Column:
    return _affiliation("employer", "occupation", bad_employer, EMPLOYER_TOLERANCE, True)


def names(strict: bool = False) -> Column:
    """-1000 conflict, 0 different, 1 unknown, 2 similar, 3 equal, 4 equal with the middle name.

    ``strict`` follows the published code, in which two equal full middle names don't raise a 3 to a 4.
    """
    m1, m2, f1, f2 = c("middle1"), c("middle2"), c("first1"), c("first2")
    both = (m1 != "") & (m2 != "")
    full = (F.length(m1) > 1) & (F.length(m2) > 1)
    conflict = both & ((F.substring(m1, 1, 1) != F.substring(m2, 1, 1)) | full & (m1 != m2))
    agree = both & ~full if strict else both
    best = F.when(agree, 4).otherwise(3)
    d = F.levenshtein("last1", "last2")
    rare_last = (c("last_freq1") <= RARE) | (c("last_freq2") <= RARE)
    rare_first = (c("first_freq1") <= RARE) | (c("first_freq2") <= RARE)
    so_far = F.when((d == 0) | rare_last, best).otherwise(2)
    initial = (F.length(f1) == 1) | (F.length(f2) == 1)
    return (
        F.when(conflict, CONFLICT)
        .when((c("last1") == "") | (c("last2") == ""), 1)
        .when(d >= 3, 0)
        .when(f1 == f2, so_far)
        .when(c("variant"), best)
        .when(c("known1") & c("known2"), 0)
        .when(initial & ((f1 == "") | (f2 == "")), so_far)
        .when(initial, F.when(F.substring(f1, 1, 1) == F.substring(f2, 1, 1), 2).otherwise(0))
        .when(F.levenshtein(f1, f2) < 2, F.when(rare_first, so_far).otherwise(2))
        .otherwise(0)
    )


def verdicts(n: Column, e: Column, o: Column, method: str | None = None) -> dict[str, Column]:
    """The verdict of each context by the three codes. Methods: None, "national", "1" to "8"."""
    number = int(method) if method and method.isdigit() else 0
    any3, both3 = (e >= 3) | (o >= 3), (e >= 3) & (o >= 3)
    half = (e == 2) & (o >= 3) | (o == 2) & (e >= 3)
    out = {
        "addressY": (n >= 2) & ((e >= 2) | (o >= 2)),
        "addressN_zipY": (n >= 3) & (both3 if 1 <= number <= 4 else any3),
        "addressN_zipN": (n >= 3) & ((e >= 4) & (o >= 4) if number in (1, 2, 5, 6) else both3),
        "addressNA_zipY": (n >= 3) & ((e >= 1) | (o >= 1)),
        "addressNA_zipN": (n >= 3) & both3,
        "cityN": (n >= 3) & (both3 if number else both3 | (o == 4) | (e == 4)),
        "stateN": (n >= 3) & any3,
    }
    if number:
        out["addressNA_zipY"] = (n >= 3) & (any3 if number % 2 else (e >= 2) | (o >= 1))
    if method == "national":
        out["addressN_zipY"] = (n == 3) & any3 | (n == 4) & ((e >= 2) | (o >= 2))
        out["addressNA_zipN"] = (n == 3) & both3 | (n == 4) & ((e >= 2) | (o >= 2))
        out["cityN"] = (n >= 3) & (both3 | (o == 4) | (e == 4) | half)
        out["stateN"] = (n == 4) & half | (n >= 3) & both3
    return out


def context(strict: bool = False) -> Column:
    """Which rule a pair falls under, by state, city, zip and address.

    ``strict`` follows the published code, in which different addresses always take the rule for equal zips.
    """
    equal_zip = zip_code() == 2
    different = F.lit("addressN_zipY") if strict else F.when(equal_zip, "addressN_zipY").otherwise("addressN_zipN")
    present = (c("address1") != "") & (c("address2") != "")
    near = F.when(present & (c("address1") == c("address2")), "addressY").when(present, different).when(equal_zip, "addressNA_zipY").otherwise("addressNA_zipN")
    return F.when(c("state1") != c("state2"), "stateN").when((c("city1") == c("city2")) | equal_zip, near).otherwise("cityN")


def compared(pairs: DataFrame, method: str | None = None, strict: bool = False) -> DataFrame:
    """Pairs with the codes n, e, o, the context and the verdict: 1 match, 0 none, -1000 conflict."""
    return judged(pairs.withColumns({"n": names(strict), "e": employers(), "o": occupations(), "context": context(strict)}), method)


def judged(held: DataFrame, method: str | None = None) -> DataFrame:
    """Add the verdict by n, e, o and context."""
    rule = F.lit(False)
    for name, test in verdicts(c("n"), c("e"), c("o"), method).items():
        rule = F.when(c("context") == name, test).otherwise(rule)
    clash = (c("n") == CONFLICT) & (c("context") != "addressY")
    return held.withColumn("verdict", F.when(clash, CONFLICT).when(rule, 1).otherwise(0))


NAME, WORK, PLACE = ("last", "middle", "first"), ("employer", "occupation"), ("address", "zip", "city", "state")


def keyed(records: DataFrame) -> DataFrame:
    """(id, name, work, place): for each of the three groups of fields the smallest id among the records that agree in it."""
    out = records.select("id", *[c(v).alias(k) for k, v in FIELDS.items()])
    for key, own in (("name", NAME), ("work", WORK), ("place", PLACE)):
        heads = out.groupBy(*own).agg(F.min("id").alias(f"{key}_key")).select(*[c(f).alias(f"_{f}") for f in own], f"{key}_key")
        same = reduce(and_, [c(f).eqNullSafe(c(f"_{f}")) for f in own])
        out = out.join(heads, same).drop(*own, *[f"_{f}" for f in own])
    return out.select("id", *[c(f"{key}_key").alias(key) for key in ("name", "work", "place")])


def compared_by_values(records: DataFrame, pairs: DataFrame, counts: DataFrame, variants: DataFrame, known: DataFrame, employer_edges: DataFrame, occupation_edges: DataFrame) -> DataFrame:
    """(a, b, n, e, o, context, verdict) of the pairs (a, b); the same as ``compared`` over ``with_lookups``.

    Pairs carry three numbers for each record instead of all fields. A code is made once for two names, two
    affiliations or two places, however many pairs have them.
    """
    keys = written(keyed(records), "keys")
    met = pairs.select("a", "b")
    for side, key in (("1", "a"), ("2", "b")):
        met = met.join(keys.select(c("id").alias(key), *[c(k).alias(k + side) for k in ("name", "work", "place")]).hint("merge"), key)
    met = written(met, "met")
    values = records.select("id", *[c(v).alias(k) for k, v in FIELDS.items()])

    def coded(key: str, own: tuple[str, ...], codes: dict[str, Column]) -> DataFrame:
        held = met.select(f"{key}1", f"{key}2").distinct()
        for side in "12":
            held = held.join(values.select(c("id").alias(key + side), *[c(f).alias(f + side) for f in own]).hint("merge"), key + side)
        if own != PLACE:
            held = held.withColumns({f + side: F.lit("") for f in (*NAME, *WORK) if f not in own for side in "12"})
            held = with_lookups(held, counts, variants, known, employer_edges, occupation_edges)
        return written(held.select(f"{key}1", f"{key}2", *[v.alias(k) for k, v in codes.items()]), "codes")

    found = met
    for key, own, codes in (("name", NAME, {"n": names()}), ("work", WORK, {"e": employers(), "o": occupations()}), ("place", PLACE, {"context": context()})):
        found = found.join(coded(key, own, codes), [f"{key}1", f"{key}2"])
    return judged(found.select("a", "b", "n", "e", "o", "context"))


def frequency_pair(pairs: DataFrame, person_counts: DataFrame) -> DataFrame:
    """Add f_with and f_without: how many persons have the full name with and without the middle name."""
    def either(field: str) -> Column:
        return F.when(c(f"{field}1") != "", c(f"{field}1")).otherwise(c(f"{field}2"))

    from kindred.operators.tokens import FULL

    held = pairs.withColumns({"_with": F.when(either("middle") != "", F.concat_ws("|", either("last"), either("middle"), either("first"))), "_without": F.concat_ws("|", either("last"), F.lit(""), either("first"))})
    held = with_frequency(held, person_counts, FULL, "_with", "f_with")
    return with_frequency(held, person_counts, FULL, "_without", "f_without").drop("_with", "_without")


def by_mode(pairs: DataFrame, mode: str) -> DataFrame:
    """Pairs with the verdict of a mode: strict_address, strict_affiliation, thorough, national, or 1 to 8."""
    strict = {"strict_address": strict_address, "strict_affiliation": strict_affiliation}
    if mode in strict:
        return pairs.withColumn("verdict", strict[mode]().cast("int"))
    if mode not in ("thorough", "national", *"12345678"):
        raise ValueError(f"no mode {mode}")
    return compared(pairs, None if mode == "thorough" else mode)
