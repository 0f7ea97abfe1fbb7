"""Queries that SQL is too slow for, or can't express, against brute force over whole tables."""

import math
import os
from collections import defaultdict

import duckdb
import pytest

from kindred.plans import catalog

TABLES = "nation customer orders lineitem".split()

@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def test_components_of_all_orders(spark, duck, sf_dir):
    around = defaultdict(set)
    for a, b in duck.execute("select distinct l_partkey, l_suppkey from lineitem where l_partkey<>l_suppkey").fetchall():
        around[a].add(b)
        around[b].add(a)
    want = {}
    for start in sorted(around):
        front = [] if start in want else [start]
        while front:
            node = front.pop()
            if node not in want:
                want[node] = start
                front += around[node]
    assert {r.node: r.component for r in catalog.queries()["components"](spark, sf_dir).collect()} == want
    parts = catalog.queries()["balance_partitions"](spark, sf_dir).collect()
    assert sum(r.size for r in parts) == len(want)
    assert sum(r.n_items for r in parts) == len(set(want.values()))


def test_accepted_pairs_of_frequencies(spark, duck, sf_dir):
    """A cell is accepted where its blurred count is above the count below which a twentieth of all points lie."""
    cells = {}
    for f1, f2 in duck.execute("select l_orderkey % 30, l_linenumber * 3 + cast(l_quantity as int) from lineitem").fetchall():
        cells[f1, f2] = cells.get((f1, f2), 0) + 1
    cells = {k: n for k, n in cells.items() if 0 <= k[0] <= 1198 and 0 <= k[1] <= 98}
    held, threshold = 0, None
    for n in sorted(set(cells.values())):
        held += sum(m for m in cells.values() if m == n)
        if held > 0.05 * sum(cells.values()):
            threshold = n
            break
    weights = [math.exp(-0.5 * (k / 1.5) ** 2) for k in range(-6, 7)]
    weights = [w / sum(weights) for w in weights]

    def at(i, size):
        return -i - 1 if i < 0 else 2 * size - 1 - i if i >= size else i

    want = set()
    for f1 in range(60):
        for f2 in range(99):
            total = sum(wa * wb * cells.get((at(f1 + a, 1199), at(f2 + b, 99)), 0) for a, wa in zip(range(-6, 7), weights) for b, wb in zip(range(-6, 7), weights))
            if total > threshold:
                want.add((f1, f2))
    got = {(r.f1, r.f2) for r in catalog.queries()["calibrate2d"](spark, sf_dir).collect()}
    assert want and got == want
