"""Stage 1 within a task, against the tables of its pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import identity, lsh, stages, within
from tests.test_stages import FIXTURE, lookups, records  # noqa: F401


@pytest.fixture(scope="module")
def holes(records):  # noqa: F811
    """The records with missing and empty fields, and more middle initials."""
    out = records.withColumn("middle_name", F.expr("case id % 5 when 0 then '' when 1 then 'B' when 2 then 'Çelik' else middle_name end"))
    for k, (field, value) in enumerate([("EMPLOYER", None), ("CITY", None), ("CITY", ""), ("address", None), ("zip", None), ("zip", "")]):
        out = out.withColumn(field, F.when(F.col("id") % 11 != k, F.col(field)).otherwise(F.lit(value)))
    return lsh.written(out, "holes")


@pytest.fixture(scope="module")
def wanted(holes, lookups):  # noqa: F811
    return {(r.id, r.identity) for r in stages._parted(holes, stages.matches(holes, lookups, FIXTURE)).collect()}


@pytest.mark.parametrize("cells", [1 << 26, 1])
def test_identities_store_no_pairs(holes, lookups, wanted, monkeypatch, cells):  # noqa: F811
    monkeypatch.setattr(stages, "matches", lambda *_: pytest.fail("pairs are tables"))
    monkeypatch.setattr(within, "CELLS", cells)
    monkeypatch.setattr(within, "LINKS", 50)
    assert {(r.id, r.identity) for r in stages.identities(holes, lookups, FIXTURE).collect()} == wanted


def test_identities_of_a_state_too_large_for_a_task(holes, lookups, wanted, monkeypatch):  # noqa: F811
    monkeypatch.setattr(lsh, "GROUP", 10)
    assert {(r.id, r.identity) for r in stages.identities(holes, lookups, FIXTURE).collect()} == wanted


def test_votes_are_those_of_tables(spark):
    """A record without an initial goes to the one with the highest mean, the smallest of equals."""
    draw = np.random.default_rng(3)
    initial = np.where(draw.random(200) < 0.5, 0, draw.integers(65, 70, 200))
    x, y = draw.integers(0, 200, 260), draw.integers(0, 200, 260)
    x, y = x[x < y], y[x < y]
    x, y = np.unique(np.stack([x, y]), axis=1)
    links, votes = within.Links(200), within.Votes(initial)
    for k in range(0, len(x), 7):
        links.add(x[k : k + 7], y[k : k + 7])
        votes.add(x[k : k + 7], y[k : k + 7])
    label = links.settle()
    matches = spark.createDataFrame([(int(a), int(b), 1) for a, b in zip(x, y)], "a long, b long, verdict int")
    held = spark.createDataFrame([(i, chr(v) if v else "") for i, v in enumerate(initial.tolist())], "id long, middle_name string")
    members = identity.stage1(held, matches).join(held, "id")
    want = {r.id: (r.component, r.spawn) for r in identity.split_on_middle(members, matches).collect()}
    assert {i: (int(label[i]), chr(s) if s else "") for i, s in enumerate(votes.spawn(label))} == want
    assert len({s for _, s in want.values()}) > 3


def test_national_pairs_carry_numbers(records, lookups, monkeypatch):  # noqa: F811
    """Neither names of identities nor names of people are written for pairs of the second stage."""
    seen = {}
    whole = stages.written
    monkeypatch.setattr(stages, "written", lambda df, purpose: seen.setdefault(purpose, []).append(dict(df.dtypes)) or whole(df, purpose))
    held = records.withColumn("identity", F.concat_ws("-", "STATE", (F.col("id") % 40).cast("string")))
    found = stages.stage2(held, lookups, FIXTURE).collect()
    assert all(r.identity1 < r.identity2 and r.identity1.startswith("NATION_") for r in found)
    assert [set(t.values()) for k in ("national", "names", "work") for t in seen[k]] == [{"bigint"}] * 6
