"""Examples with known results, and brute force where SQL can't say it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kindred.functions import address
from kindred.functions import text as T
from kindred.operators import affiliation, graph, identity
from kindred.streaming import incremental

NAMES = {
    "SMITH, JOHN A": ("SMITH", "A", "JOHN"), "SMITH, JOHN ALAN": ("SMITH", "ALAN", "JOHN"), "SMITH, J ALAN": ("SMITH", "J", "ALAN"), "SMITH, A B": ("SMITH", "A", "B"),
    "SMITH, A B JOHN MARTINEZ": ("SMITH", "A", "MARTINEZ"), "SMITH, JOHN A B": ("SMITH", "A", "JOHN"), "SMITH, MR. JOHN A. JR": ("SMITH", "A", "JOHN"),
    "ACME CORP PAC": ("ACME", "", "CORP PAC"), "SMITH,JOHN,A": ("SMITH", "A", "JOHN"), "SMITH, ": ("SMITH", "", ""),
}


def test_split_name(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", T.split_name(F.col("n")).alias("s"))
    assert {r.n: tuple(r.s) for r in df.collect()} == NAMES


def test_bad_affiliations(spark):
    bad = {"": (True, True), "NA": (True, True), "SELFRIDGES": (True, True), "OCEO INC": (True, False), "DOCTOR": (False, False), "NBA": (False, True), "ENGINEER": (False, False), "TEACHER": (True, False), "HANNA": (False, True)}
    df = spark.createDataFrame([(n,) for n in bad], "n string").select("n", T.bad_employer(F.col("n")).alias("e"), T.bad_occupation(F.col("n")).alias("o"))
    assert {r.n: (r.e, r.o) for r in df.collect()} == bad


def test_significance(spark):
    edges = spark.createDataFrame([("A", "B", 6), ("A", "C", 2), ("B", "C", 2), ("C", "D", 8)], "a string, b string, weight long")
    got = {(r.a, r.b): r.significance for r in affiliation.significance(edges).collect()}
    assert got == pytest.approx({("A", "B"): 5.110099, ("A", "C"): 0.261930, ("B", "C"): 0.261930, ("C", "D"): 5.988170}, abs=1e-6)
    tail = sum(math.comb(30, k) * 0.2**k * 0.8 ** (30 - k) for k in range(11, 31))
    assert affiliation.log_tail(11, 30, 0.2) == pytest.approx(math.log(tail))


ADDRESSES = {
    "123 N Main St": ("123", "N.", "Main", "St.", None), "45 West Oak Avenue Apt 7": ("45", "W.", "Oak", "Ave.", "Apt 7"), "9 Old Mill Road": ("9", None, "Old Mill", "Rd.", None),
    "12-3 Elm St #4": ("12", None, "Elm", "St.", "#4"), "": (None, None, None, None, None),
}


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string").select("a", address.parsed_address("a").alias("p"))
    assert {r.a: (r.p.house, r.p.prefix, r.p.street, r.p.suffix, r.p.apartment) for r in df.collect()} == ADDRESSES
    lines = spark.createDataFrame([("45 West Oak Avenue Apt 7",), ("PO BOX 12",), ("",), (None,)], "a string").select(address.street_line_or_box(F.col("a")).alias("l"))
    assert [r.l for r in lines.collect()] == ["45 W. OAK AVE.", "PO BOX 12", "", None]


def test_zip_state_and_city(spark, tmp_path):
    df = spark.createDataFrame([("10 Main St, Seattle, WA 98101",)], "a string")
    p = df.select(address.parsed_address("a", cities=["seattle"]).alias("p")).first().p
    assert (p.zip, p.state, p.city, p.suffix, p.street, p.house) == ("98101", "WA", "Seattle", "St.", "Main", "10")
    p = df.select(address.parsed_address("a").alias("p")).first().p  # a city that isn't known is a street without a suffix
    assert (p.zip, p.state, p.city, p.suffix, p.street, p.house, p.apartment) == ("98101", "WA", None, None, "Seattle", "10", "Main")
    (tmp_path / "s.csv").write_text("STRAVENUE,STRA\nbroken\n")
    df = spark.createDataFrame([("7 South Palm Stravenue",)], "a string")
    line = address.street_line("a", suffixes=address.read_suffixes(str(tmp_path / "s.csv")))
    assert df.select(line.alias("l")).first().l == "7 S. PALM STRA."


def greedy(positive, negative):
    group = {n: {n} for e in [*positive, *negative] for n in e[:2]}
    for a, b, _ in sorted(positive, key=lambda e: (-e[2], e[0], e[1])):
        x, y = group[a], group[b]
        if x is not y and not any((p in x and q in y) or (p in y and q in x) for p, q in negative):
            x |= y
            for n in y:
                group[n] = x
    return {n: min(g) for n, g in group.items()}


def test_conflicts_are_resolved_greedily(spark):
    rng = random.Random(6)
    positive = sorted({(f"n{min(p):02}", f"n{max(p):02}") for p in (rng.sample(range(40), 2) for _ in range(60))})
    positive = [(a, b, float(rng.choice([1, 4, 6, 12]))) for a, b in positive]
    negative = [(a, b) for a, b in sorted({(f"n{min(p):02}", f"n{max(p):02}") for p in (rng.sample(range(40), 2) for _ in range(15))}) if (a, b) not in {e[:2] for e in positive}]
    adjacency = spark.createDataFrame([(a, b, int(s)) for a, b, s in positive] + [(a, b, -1) for a, b in negative], "identity1 string, identity2 string, verdict int")
    got = {r.identity: r["super"] for r in identity.linked(adjacency).collect()}
    want = greedy(positive, negative)
    linked = {n for e in positive for n in e[:2]}
    assert got == {n: want[n] for n in linked}


def test_components_without_edges(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert graph.components(empty).count() == 0
    assert [tuple(r) for r in graph.with_components(spark.range(2).selectExpr("id node"), empty).orderBy("node").collect()] == [(0, 0), (1, 1)]


def test_stream_assigns_identities_once(spark, tmp_path):
    rows = [[(1, "x", "SMITH"), (2, "x", "LEE"), (3, "x", "SMITH")], [(4, "x", "SMITH"), (5, "y", "SMITH"), (6, "y", "SMITH")]]
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, "id long, block string, name_key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, block string, name_key string").parquet(str(tmp_path / "in"))
        incremental.start(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.id: r.identity for r in spark.read.parquet(str(tmp_path / "out" / "assigned")).collect()}
    assert got == {1: "N-1", 3: "N-1", 2: "N-2", 4: "N-1", 5: "N-5", 6: "N-5"}
    assert incremental.read_store(spark, str(tmp_path / "out")).count() == 3


def test_merged_persons(spark):
    members = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "r")], "id long, component string")
    verdicts = spark.createDataFrame([(1, 3, 1), (2, 3, 1), (1, 4, 1)], "a long, b long, verdict int")
    pairs = spark.createDataFrame([("p", "q"), ("p", "r")], "p string, q string")
    assert {(r.p, r.q): r.compatibility for r in identity.compatibility(pairs, verdicts, members).collect()} == {("p", "q"): 1.0, ("p", "r"): 0.5}
    assert {r.id: r.component for r in identity.merged(members, pairs, verdicts).collect()} == {1: "p", 2: "p", 3: "p", 4: "r"}


def test_split_on_middle_names(spark):
    members = spark.createDataFrame([(1, 1, "A"), (2, 1, "BEN"), (3, 1, ""), (4, 1, ""), (5, 5, "C"), (6, 5, "")], "id long, component long, middle_name string")
    verdicts = spark.createDataFrame([(2, 3, 1), (1, 2, -1000)], "a long, b long, verdict int")
    got = {r.id: r.spawn for r in identity.split_on_middle(members, verdicts).collect()}
    assert got == {1: "A", 2: "B", 3: "B", 4: "A", 5: "", 6: ""}
