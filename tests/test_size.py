"""Queries whose work has to stay near the size of their input or of their result."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from kindred.operators import affiliation, compare, identity, lsh, tokens
from kindred.plans import graph_queries
from kindred.sources import bridge


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_products_sign_a_token_once(spark):
    rows = [(i, [f"w{i % 3}", f"v{i % 2}"]) for i in range(40)]
    found = lsh.inner_products(spark.createDataFrame(rows, "id long, tokens array<string>"), 60)
    text = plan(found)
    assert text.index("Generate posexplode") < text.index("Aggregate")  # probes are listed after the sums, not before
    words = sorted({t for _, ts in rows for t in ts})
    signs = spark.createDataFrame([(t, k) for t in words for k in range(60)], "t string, k long").select("t", "k", lsh.sign(F.col("k"), F.col("t")).alias("s"))
    one = {(r.t, r.k): r.s for r in signs.collect()}
    assert {(r.id, r.k): r.s for r in found.collect()} == {(i, k): sum(one[t, k] for t in ts) for i, ts in rows for k in range(60)}


BITS, ROUNDS, NEAR = 12, 5, 3


@pytest.fixture(scope="module")
def rows(spark):
    """Records of which every third has one hash, with ids that don't fit four bytes and far more rows than a group of neighbours."""
    each = [(i * 10**9 - 7, "a" if i % 4 else None, f"n{i * 31 % 17}", f"p{i * 7919 % 23}", "0" * BITS if i % 3 == 0 else f"{i * 2654435761 % 4096:012b}") for i in range(300)]
    return spark.createDataFrame(each, "id long, STATE string, NAME string, identity string, hash string").repartition(5).cache()


def near(rows, by, order, n):
    groups = {}
    for r in sorted(rows, key=lambda r: (order(r), r.id)):
        groups.setdefault(by(r), []).append(r)
    return [(g[i], g[j]) for g in groups.values() for i in range(len(g)) for j in range(i + 1, min(len(g), i + n + 1))]


def met(rows, by):
    orders = [lsh.permutation(BITS, r) for r in range(ROUNDS)]
    return [p for order in orders for p in near(rows, by, lambda r, order=order: "".join(r.hash[k - 1] for k in order), NEAR)]


@pytest.mark.parametrize("least", [1, 2])
def test_identities_are_counted_without_pairs_of_records(rows, least):
    found = lsh.identity_neighbours(rows, BITS, ROUNDS, NEAR, rows.select("id", "identity"), least)
    want = Counter(tuple(sorted((x.identity, y.identity))) for x, y in met(rows.collect(), lambda r: 0) if x.identity != y.identity)
    assert {(r.identity1, r.identity2): r["count"] for r in found.collect()} == {k: n for k, n in want.items() if n > least}
    assert "a#" not in plan(found) and "b#" not in plan(found)


@pytest.mark.parametrize("block", [1 << 18, 40, 2])
def test_packed_runs_are_in_order_across_their_bounds(rows, block):
    held = rows.selectExpr("id", "hash", "id * 3 number")
    found = [(memoryview(bytes(r.own)).cast("q").tolist(), r.next or []) for r in lsh._packed_runs(held, BITS, ROUNDS, NEAR, block).collect()]
    assert len(found) == ROUNDS if block > 300 else len(found) > 3 * ROUNDS
    got = Counter((own[i], x) for own, ahead in found for i in range(len(own)) for x in (own + ahead)[i + 1 : i + NEAR + 1])
    want = Counter()
    for order in [lsh.permutation(BITS, r) for r in range(ROUNDS)]:
        want += Counter((x.number, y.number) for x, y in near(held.collect(), lambda r: 0, lambda r, order=order: "".join(r.hash[k - 1] for k in order), NEAR))
    assert got == want


def test_most_frequent_identities_are_chosen_before_names(rows):
    """Only each bucket's first pairs leave it, and the most frequent of all are among them."""
    args = rows, BITS, ROUNDS, NEAR, rows.select("id", "identity")
    every = lsh.identity_neighbours(*args).collect()
    few = lsh.identity_neighbours(*args, most=7)
    assert few.count() == 7 < len(every)
    want = sorted(every, key=lambda r: (-r["count"], r.identity1, r.identity2))[:7]
    assert lsh.top_pairs(few, 7).collect() == want


def test_hashes_make_no_row_for_a_token(spark):
    rows = [(i, [f"w{i % 3}", f"v\u00e9{i % 5}"][: i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    found = lsh.hashes(df, 60)
    assert "Generate" not in plan(found)
    sums = {(r.id, r.k): r.s for r in lsh.inner_products(df, 60).collect()}
    assert {r.id: r.hash for r in found.collect()} == {i: "".join("1" if sums[i, k] > 0 else "0" for k in range(60)) for i, t in rows if t}


@pytest.mark.parametrize("least", [0, 1])
def test_candidates_travel_packed(rows, least):
    found = lsh.candidate_pairs(rows, BITS, ROUNDS, NEAR, ["STATE"], least)
    want = Counter(tuple(sorted((x.id, y.id))) for x, y in met(rows.collect(), lambda r: r.STATE))
    assert {(r.a, r.b): r["count"] for r in found.collect()} == {k: n for k, n in want.items() if n > least}
    assert "FlatMapGroupsInArrow" in plan(found) and "Aggregate" not in plan(found)


def test_all_candidates_hold_each_pair_once(rows):
    found = [(r.a, r.b) for r in lsh.all_candidates(rows, BITS, ROUNDS, NEAR, rows, 4, ["STATE"]).collect()]
    held = rows.collect()
    want = {tuple(sorted((x.id, y.id))) for x, y in met(held, lambda r: r.STATE) + near(held, lambda r: r.STATE, lambda r: r.NAME, 4)}
    want |= {(r.a, r.b) for r in lsh.hash_runs(rows, "hash", ["STATE"]).collect()}
    assert len(found) == len(set(found)) and set(found) == want


def test_tables_of_records_are_not_broadcast(spark):
    """Parquet files of numbers are far smaller than their rows in the driver's memory."""
    members = lsh.written(spark.range(1000).selectExpr("id", "id div 4 component", "element_at(array('A', 'B', ''), int(id % 3) + 1) middle_name", "'S' STATE", "concat('L', id) last_name"), "members")
    verdicts = lsh.written(spark.range(999).selectExpr("id a", "id + 1 b", "int(id % 2) verdict"), "verdicts")
    split = identity.split_on_middle(members.select("id", "component", "middle_name"), verdicts)
    label = identity.labelled(split.join(members.select("id", "STATE", "last_name").hint("merge"), "id"), ["component", "spawn"])
    for df in (split, label):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert split.count() == label.count() == 1000


def test_codes_by_values_are_those_of_pairs(spark, sf_dir):
    m = lsh.written(graph_queries.members(spark, sf_dir), "members")
    m = lsh.written(m.withColumn("EMPLOYER", F.when(F.col("id") % 13 != 0, F.col("EMPLOYER"))), "members")
    pairs = lsh.written(lsh.neighbours(m, ["NAME"], 3, ["STATE"]).select("a", "b"), "pairs")
    e, o = (affiliation.transition_edges(m, "identity", "TRANSACTION_DT", f).withColumn("significance", F.lit(1.0)) for f in ("EMPLOYER", "OCCUPATION"))
    look = tokens.token_counts(m, tokens.name_tokens()), bridge.variants(spark), bridge.known_names(spark), e, o
    columns = ["a", "b", "n", "e", "o", "context", "verdict"]
    found = compare.compared_by_values(m, pairs, *look).select(columns)
    want = compare.compared(compare.with_lookups(compare.pairs_of(m, pairs, compare.FIELDS), *look)).select(columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))


def wanted_candidates(rows):
    held = rows.collect()
    want = {tuple(sorted((x.id, y.id))) for x, y in met(held, lambda r: r.STATE) + near(held, lambda r: r.STATE, lambda r: r.NAME, 4)}
    return want | {(r.a, r.b) for r in lsh.hash_runs(rows, "hash", ["STATE"]).collect()}


@pytest.mark.parametrize("task", [1 << 27, 700])
def test_candidates_of_a_group_are_neither_stored_nor_counted(rows, monkeypatch, task):
    monkeypatch.setattr(lsh, "TASK", task)
    for name in ("_packets", "_counted"):
        monkeypatch.setattr(lsh, name, lambda *_: pytest.fail("pairs travel"))
    found = [(r.a, r.b) for r in lsh.all_candidates(rows, BITS, ROUNDS, NEAR, rows, 4, ["STATE"]).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted_candidates(rows)


def test_candidates_of_a_group_too_large_for_a_task(rows, monkeypatch):
    monkeypatch.setattr(lsh, "GROUP", 10)
    found = [(r.a, r.b) for r in lsh.all_candidates(rows, BITS, ROUNDS, NEAR, rows, 4, ["STATE"]).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted_candidates(rows)


def test_candidates_with_repeated_ids_and_rows_without_hash_or_name(rows, monkeypatch):
    monkeypatch.setattr(lsh, "PACKET", 200)
    twice = rows.union(rows.where("id % 7 = 0")).withColumn("NAME", F.expr("if(id % 5 = 0, null, NAME)"))
    found = [(r.a, r.b) for r in lsh.all_candidates(twice, BITS, ROUNDS, NEAR, twice, 4, ["STATE"]).collect()]
    assert len(found) == len(set(found))
    none_first = lambda r: (r.NAME is not None, r.NAME or "")
    held = twice.collect()
    want = {tuple(sorted((x.id, y.id))) for x, y in met(held, lambda r: r.STATE) + near(held, lambda r: r.STATE, none_first, 4)}
    want |= {(r.a, r.b) for r in lsh.hash_runs(twice, "hash", ["STATE"]).collect()}
    assert set(found) == {p for p in want if p[0] != p[1]}
    hashless = lsh.all_candidates(rows.where("id % 2 = 0"), BITS, ROUNDS, NEAR, rows, 4, ["STATE"]).collect()
    few = [r for r in rows.collect() if r.id % 2 == 0]
    want = {tuple(sorted((x.id, y.id))) for x, y in met(few, lambda r: r.STATE) + near(rows.collect(), lambda r: r.STATE, lambda r: r.NAME, 4)}
    want |= {(r.a, r.b) for r in lsh.hash_runs(rows.where("id % 2 = 0"), "hash", ["STATE"]).collect()}
    assert len(hashless) == len({(r.a, r.b) for r in hashless}) and {(r.a, r.b) for r in hashless} == want
