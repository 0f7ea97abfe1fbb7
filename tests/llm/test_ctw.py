import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kindred.llm.ctw import Tree, log_gamma, scored
from kindred.llm.tables import HashTable, Remembered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def learned(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def plain(text):
    return " ".join(words(text)[:-1]).encode()


def choices(byte):
    node = 1
    for k in range(7, -1, -1):
        bit = byte >> k & 1
        yield node, bit
        node = 2 * node + bit


def brute(data, depth):
    """Context-tree weighting by dictionaries and recursion."""
    seen, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    unigrams = Counter()
    for i, t in data:
        if learned(i):
            unigrams.update(words(t))
            raw = b"\0" * depth + plain(t) + b"\0"
            for at in range(depth, len(raw)):
                for node, bit in choices(raw[at]):
                    for d in range(depth + 1):
                        seen[raw[at - d : at], node][bit] += 1
                        if d:
                            children[raw[at - d + 1 : at], node].add(raw[at - d : at])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    known = {}

    def weighted(s, node):
        if (s, node) not in known:
            own = kt(*seen[s, node])
            known[s, node] = own if len(s) == depth else np.logaddexp(own, sum(weighted(c, node) for c in children[s, node])) - math.log(2)
        return known[s, node]

    def p(past, node, bit, d):
        s = past[len(past) - d :]
        n = seen[s, node]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        longer = past[len(past) - d - 1 :]
        if d == depth or (longer, node) not in seen:
            return own
        w = math.exp(kt(*n) - math.log(2) - weighted(s, node))
        return w * own + (1 - w) * p(past, node, bit, d + 1)

    N, V = sum(unigrams.values()), len(unigrams)
    out = []
    for i, t in data:
        raw, score = b"\0" * depth + plain(t) + b"\0", 0.0
        for at in range(depth, len(raw)):
            for node, bit in choices(raw[at]):
                score += math.log10(p(raw[at - depth : at], node, bit, 0) if (b"", node) in seen else 0.5)
        w = words(t)
        base = sum(math.log10((unigrams[x] + 1) / (N + V + 1)) for x in w)
        out.append((i, not learned(i), len(w), sum(unigrams[x] > 0 for x in w), N, base, score))
    return out


def check(spark, data, tree):
    df = spark.createDataFrame([(*x, 0) for x in data], "doc_id long, text string, score int")
    got = sorted(scored(df, tree).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.score))
    want = sorted(brute(data, tree.depth), key=lambda r: (str(r[0]), r[2], r[6]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    for r, w in zip(got, want, strict=True):
        assert r.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(w[6], rel=1e-5, abs=1e-5)


def texts():
    rng = random.Random(8)
    stems = ["the", "cat", "Sat", "öl", "ing", "er", "qu", "\U0001f600"]
    return [(i, " ".join("".join(rng.choices(stems, k=rng.randrange(1, 4))) for _ in range(rng.randrange(40)))) for i in range(60)]


def test_scores_match_dictionaries(spark):
    data = [*texts(), (100, None), (101, ""), (7, "again"), (7, "again"), (None, "no id"), (102, "zz \x00 nul")]
    check(spark, data, Tree(depth=3, buckets=5))
    check(spark, data, Tree(depth=2, buckets=3, bucket_rows=300, gather=50))


def test_scores_of_the_registered_depth_with_parted_buckets(spark):
    data = [*texts()[:30], (100, None), (7, "again"), (7, "again")]
    check(spark, data, Tree(depth=Tree().depth, buckets=4, bucket_rows=5, gather=60))
    check(spark, data, Tree(depth=Tree().depth))


def test_empty_and_held_out_tables(spark):
    assert scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = next(i for i in range(100) if not learned(i))
    check(spark, [(only, "some text")], Tree(depth=3))


def test_held_out_texts_are_coded_better_than_by_words(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = [r for r in scored(df).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10, 1e3, 1e9])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_hash_tables():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 62, 5000, np.uint64))
    table = HashTable(keys[::2], np.arange(len(keys[::2]), dtype=float))
    got = table.get(keys, -1.0)
    assert (got[::2] == np.arange(len(got[::2]))).all() and (got[1::2] == -1).all()
    kept = Remembered(lambda k: np.stack([k % np.uint64(97), k % np.uint64(89)], 1).astype(np.float32), 2, 6)
    for _ in range(5):
        some = rng.choice(keys, 300)
        assert (kept.get(some) == np.stack([some % np.uint64(97), some % np.uint64(89)], 1)).all()
