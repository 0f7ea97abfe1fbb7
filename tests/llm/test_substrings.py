import random
import re
from collections import Counter

import numpy as np

from kindred.llm.fmindex import FMIndex
from kindred.llm.substrings import Repeats, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(data):
    first = {}
    for i, t in data:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            win = tuple(w[k : k + 13])
            if i is not None:
                first[win] = min(first.get(win, i), i)
    out = []
    for i, t in data:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def check(spark, data, spec=None):
    df = spark.createDataFrame([(*x, "z") for x in data], "doc_id long, text string, key string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in without_repeats(df, spec).collect())
    assert got == brute(data)


def test_documents_match_brute_force(spark, sf_dir):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sum(n for (_, _, n, _), _ in brute(data).items())
    check(spark, data)
    check(spark, data, Repeats(bucket_bytes=20000, group_bytes=3000))


def test_passages_copies_and_periodic_texts(spark):
    rng = random.Random(4)
    make = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    passage = make(60)
    texts = [make(20) + passage[a : a + 30] + make(20) for a in range(0, 30, 3)] + [passage] * 4
    texts += [["a"] * n for n in (5, 12, 13, 14, 40, 100)] + [["a", "b"] * 30, ["b", "a"] * 30, passage + passage]
    texts += [make(12), make(13)]
    data = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(data)
    check(spark, data, Repeats(bucket_bytes=2000, group_bytes=900))


def test_edge_cases(spark):
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(25000))
    data = [(None, long), (1, None), (2, ""), (3, " \n"), (7, long), (7, long), (9, long + " end"), (7, "one two"), (-4, "Ä ß\t" * 20), (None, "Ä ß " * 20), (5, "Ä ß " * 20)]
    check(spark, data)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_matching_statistics_match_brute_force():
    rng = np.random.default_rng(0)
    for depth in (4, 8, 32) * 15:
        sizes, alphabet = rng.integers(1, 30, rng.integers(1, 8)), rng.integers(2, 6)
        words = rng.integers(0, alphabet, sizes.sum()).astype(np.uint64) * np.uint64(7)
        owners = rng.integers(0, 9, len(sizes))
        index = FMIndex(words, sizes, owners, depth)
        asked = rng.integers(1, 20, rng.integers(1, 5))
        stream = rng.integers(0, alphabet + 1, asked.sum()).astype(np.uint64) * np.uint64(7)
        length, row = index.matching(stream, asked)
        least = {}
        for s, o in zip(np.split(words, np.cumsum(sizes)[:-1]), owners):
            for i in range(len(s)):
                for k in range(i + 1, min(len(s), i + depth - 1) + 1):
                    least[tuple(s[i:k])] = min(least.get(tuple(s[i:k]), 99), o)
        at = 0
        for s in np.split(stream, np.cumsum(asked)[:-1]):
            for i in range(len(s)):
                n = 0
                while n < depth - 1 and i + n < len(s) and tuple(s[i : i + n + 1]) in least:
                    n += 1
                assert length[at] == n
                for k in range(1, min(n, 3) + 1):
                    starts, owner = index.least_owner(k)
                    assert owner[np.searchsorted(starts, row[at], "right") - 1] == least[tuple(s[i : i + k])]
                at += 1
