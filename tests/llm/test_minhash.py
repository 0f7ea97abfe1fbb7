import random
import re
from collections import defaultdict

import numpy as np

from kindred.llm.components import components
from kindred.llm.minhash import Match, bitmap, keep_one, near_duplicates, upper

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(data):
    sets = [(i, shingles(t)) for i, t in data]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].add(k)
    for k, (i, s) in enumerate(sets):
        for o in set().union(*(where[x] for x in s)) if s else ():
            j, t = sets[o]
            if 100 * len(s & t) >= 85 * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def check(spark, data, match=None):
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, match).collect()}
    want = brute(data)
    assert got == want
    assert sorted(r.doc_id for r in keep_one(df, match).collect()) == sorted(i for i in want if want[i][2])


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_documents_match_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_groups_chains_and_common_passages(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, passage = words(300), words(60)
    texts = [edited(rng, base, rng.randrange(9)) for _ in range(60)] + [" ".join(base)] * 5
    chain = words(200)
    for _ in range(12):
        chain = edited(rng, chain, 2).split()
        texts.append(" ".join(chain))
    texts += [" ".join(words(40) + passage) for _ in range(60)]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts, 10)), Match(block=8))


def test_edge_cases(spark):
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(25000))
    check(spark, [(1, None), (2, ""), (3, " \n"), (9, "One two"), (4, "one TWO"), (5, "one two three four five"), (6, "one two three four five"), (7, long), (8, long + " end")])


def test_missing_and_repeated_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (None, "lonely text", 2), (5, "a b c", 3), (5, "a b c", 4)], "doc_id long, text string, class_id int")
    got = sorted(str((r.doc_id, r.component_id, r.kept)) for r in near_duplicates(df).collect())
    assert got == ["(5, 5, True)", "(5, 5, True)", "(None, 5, False)", "(None, None, True)"]
    assert sorted(r.class_id for r in keep_one(df).collect()) == [1, 2, 3, 4]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).count() == 0
    assert keep_one(df).count() == 0


def test_bitmaps_never_bound_a_common_part_too_low():
    rng = np.random.default_rng(2)
    match = Match(bits_most=1 << 10)
    for _ in range(50):
        pool = rng.integers(0, 1 << 63, 400, np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        bound = upper(len(a), bitmap(a, match), np.array([len(b)]), bitmap(b, match)[None])
        assert len(np.intersect1d(a, b)) <= bound[0] <= min(len(a), len(b))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_repeated_ids_with_unlike_texts(spark):
    """A doc_id is one node of the graph, but no text goes unless one that is linked with it stays."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c, d = (words(80) for _ in range(4))
    near = edited(rng, b, 1)
    data = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, None), (9, "".split()), (9, c), (11, d), (4, c), (8, near.split()), (2, d), (2, words(50)), (11, words(9))]
    data = [(i, None if t is None else " ".join(t)) for i, t in data]
    df = spark.createDataFrame([(*x, "h", "group") for x in data], "doc_id long, text string, h string, gone string")
    sets = [(i, shingles(t)) for i, t in data]
    alike = lambda s, t: bool(s) and 100 * len(s & t) >= 85 * len(s | t)
    edges = [(i, j) for i, s in sets for j, t in sets if i == j or alike(s, t)]
    head = {i: i for i, _ in data}
    for _ in data:
        for i, j in edges:
            head[i] = head[j] = min(head[i], head[j])
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == sorted((i, len(s), head[i], head[i] == i) for i, s in sets)
    kept = keep_one(df)
    assert kept.columns == df.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    assert set(kept) <= set(data)
    for i, t in set(data) - set(kept):
        assert any(alike(shingles(t), shingles(u)) for _, u in kept)
    assert {i for i, t in kept if t and alike(shingles(t), frozenset(shingles(" ".join(a))))} == {3}
    assert {i for i, t in kept if t and alike(shingles(t), frozenset(shingles(" ".join(b))))} == {5}
