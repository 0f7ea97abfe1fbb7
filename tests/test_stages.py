"""Both stages on a small fixture, against all pairs of records."""

from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.operators import affiliation, compare, identity, lsh, stages
from kindred.operators import tokens as K
from kindred.plans.graph_queries import members
from kindred.sources.bridge import known_names, variants

FIXTURE = stages.Search(rounds=3, national_rounds=5, national_near=4)


@pytest.fixture(scope="module")
def lookups(spark):
    return stages.Lookups(variants(spark), known_names(spark))


@pytest.fixture(scope="module")
def records(spark, sf_dir):
    """Up to 50 records of each of three states: in name order every one meets every other."""
    m = members(spark, sf_dir).drop("identity").where("STATE in ('NATION_1', 'NATION_2', 'NATION_3')")
    m = m.withColumn("k", F.row_number().over(Window.partitionBy("STATE").orderBy("id"))).where("k <= 50").drop("k")
    return spark.createDataFrame(m.collect(), m.schema)


def looked_up(records, pairs, person, percent, lookups):
    e, o = stages.affiliation_edges(records, person, percent)
    held = compare.pairs_of(records, pairs, compare.FIELDS)
    return compare.with_lookups(held, K.token_counts(records, K.name_tokens()), lookups.variants, lookups.known, e, o)


@pytest.fixture(scope="module")
def first(records, lookups):
    return stages.stage1(records, lookups, FIXTURE)


def test_stage1_is_that_of_all_pairs(records, lookups, first):
    people = stages.strict_people(records, lookups)
    pairs = records.selectExpr("id a", "STATE s").join(records.selectExpr("id b", "STATE t")).where("a < b and s = t").select("a", "b")
    found = compare.compared(looked_up(people, pairs, "person", FIXTURE.prune1, lookups)).select("a", "b", "verdict").collect()
    assert {(r.a, r.b): r.verdict for r in first[1].collect()} == {(r.a, r.b): r.verdict for r in found}
    rows = {r.id: r for r in records.collect()}
    head = {i: i for i in rows}
    for _ in rows:
        for r in found:
            if r.verdict == 1:
                head[r.a] = head[r.b] = min(head[r.a], head[r.b])
    verdict = {frozenset((r.a, r.b)): r.verdict for r in found}
    groups = defaultdict(set)
    for i, h in head.items():
        groups[h].add(i)
    want = set()
    for group in groups.values():
        initials = defaultdict(set)
        for i in group:
            if rows[i].middle_name:
                initials[rows[i].middle_name[0]].add(i)
        if len(initials) < 2:
            want.add(frozenset(group))
            continue
        parts = {k: set(v) for k, v in initials.items()}
        for i in group:
            if not rows[i].middle_name:
                parts[min(initials, key=lambda k: (-sum(verdict.get(frozenset((i, j)), 0) for j in initials[k]) / len(initials[k]), k))].add(i)
        want |= {frozenset(p) for p in parts.values()}
    got = defaultdict(set)
    for r in first[0].collect():
        got[r.identity].add(r.id)
        assert r.identity.startswith(rows[r.id].STATE + "-")
    assert {frozenset(g) for g in got.values()} == want


def test_only_pairs_that_names_pass_are_joined_with_records(records, lookups, first, monkeypatch):
    seen = []
    whole = compare.compared_by_values
    monkeypatch.setattr(compare, "compared_by_values", lambda records, pairs, *more: seen.append(pairs.count()) or whole(records, pairs, *more))
    found = {(r.a, r.b) for r in stages.matches(records, lookups, FIXTURE).collect()}
    every = first[1].collect()
    assert found == {(r.a, r.b) for r in every if r.verdict == 1} and found
    assert seen == [sum(r.n >= 2 for r in every)] and seen[0] < len(every)
    assert {(r.id, r.identity) for r in stages.identities(records, lookups, FIXTURE).collect()} == {(r.id, r.identity) for r in first[0].collect()}


def test_stage2_codes_are_those_of_all_record_pairs(spark, records, lookups, first):
    held = records.join(first[0], "id")
    near = lsh.candidate_pairs(stages.hashed(records, FIXTURE), FIXTURE.bits, FIXTURE.national_rounds, FIXTURE.national_near, [])
    of = {r.id: r.identity for r in first[0].collect()}
    met = defaultdict(int)
    for r in near.collect():
        if of[r.a] != of[r.b]:
            met[tuple(sorted((of[r.a], of[r.b])))] += r["count"]
    pairs = stages.national_pairs(held, stages.hashed(records, FIXTURE), FIXTURE)
    assert {(r.identity1, r.identity2): r["count"] for r in pairs.collect()} == {k: n for k, n in met.items() if n > 1}
    ids = held.select("id", "identity")
    each = pairs.join(ids.selectExpr("id a", "identity identity1"), "identity1").join(ids.selectExpr("id b", "identity identity2"), "identity2")
    codes = compare.frequency_pair(looked_up(held, each.select("a", "b", "identity1", "identity2"), "identity", FIXTURE.prune2, lookups), K.person_tokens(held))
    codes = codes.select("identity1", "identity2", compare.names().alias("n"), compare.occupations().alias("o"), compare.employers().alias("e"), "f_with", "f_without", F.col("occupation_sig").alias("osig"), F.col("employer_sig").alias("esig"))
    keys = ["identity1", "identity2", "n", "o", "e", "f_with", "f_without"]
    want = sorted(str(tuple(r)) for r in identity.person_comparison(codes).select(*keys).collect())
    got = sorted(str(tuple(r)) for r in stages.person_codes(pairs, held, lookups, FIXTURE).select(*keys).collect())
    assert got == want and want
    found = stages.stage2(held, lookups, FIXTURE).collect()
    assert sorted(str(tuple(r[k] for k in keys)) for r in found) == want
    assert {r.verdict for r in found} <= {-1, 0, 1, 4, 6, 8, 9, 12}


def test_calibration_accepts_the_frequencies_of_right_matches(spark):
    rows = [(4, 4, 0, x, y) for x in range(20) for y in range(20) for _ in range(1 + (x + y) % 3)] + [(4, 4, 0, 700, 90)] + [(3, 0, 3, 0, k % 20) for k in range(200)]
    accepted, most = stages.calibration(spark.createDataFrame(rows, "n int, o int, e int, f_with long, f_without long"), FIXTURE)
    sets = defaultdict(set)
    for r in accepted.collect():
        sets[r.key].add((r.f1, r.f2))
    assert (12, 13) in sets["o_4"] and (700, 90) not in sets["o_4"]
    assert {r.key: r.most for r in most.collect()} == {"e_3": 19}


def test_halves_find_each_other(records, lookups, first):
    held = records.join(first[0], "id")
    r = stages.recovery(held, lookups, FIXTURE).first()
    assert 0 <= r.recovered <= r.halves and r.halves > 0


def test_numbers_and_neighbours_within_groups(spark):
    rows = [(i, "a" if i % 3 else "b", i * 7919 % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, g string, o int").repartition(7)
    want = defaultdict(list)
    for i, g, o in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[g].append(i)
    got = {(r.g, r.id): r._i for r in lsh.numbered(df, ["o"], ["g"]).collect()}
    assert got == {(g, i): k for g, ids in want.items() for k, i in enumerate(ids)}
    pairs = {(r.g, r.a, r.b) for r in lsh.neighbours(df, ["o"], 3, ["g"], block=16).collect()}
    assert pairs == {(g, *sorted((ids[k], ids[k + d]))) for g, ids in want.items() for k in range(len(ids)) for d in (1, 2, 3) if k + d < len(ids)}
    assert affiliation.pruned_percent(spark.createDataFrame([(i, float(i)) for i in range(40)], "a int, s double"), "s", 5).count() == 2
