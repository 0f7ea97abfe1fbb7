import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kindred.llm.language import KneserNey, Training, grams, identified


def brute(texts, order):
    """Probability function of an interpolated Kneser-Ney model, by dictionaries."""
    counts = Counter(k for t in texts for k in grams(t, order).tolist())
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(k & ((1 << 16 * n) - 1) for k in levels[n + 1])
    size = len({k & 0xFFFF for k in counts}) + 1
    discount, total, types = {}, {}, {}
    for n, c in levels.items():
        one, two = (sum(v == x for v in c.values()) for x in (1, 2))
        discount[n] = one / (one + 2 * two) if one and two else 0.5
        total[n], types[n] = Counter(), Counter()
        for k, v in c.items():
            total[n][k >> 16] += v
            types[n][k >> 16] += 1

    def p(key, n):
        if n == 0:
            return 1 / size
        key &= (1 << 16 * n) - 1
        lower = p(key, n - 1)
        if key >> 16 not in total[n]:
            return lower
        t = total[n][key >> 16]
        return max(levels[n][key] - discount[n], 0) / t * (key in levels[n]) + discount[n] * types[n][key >> 16] / t * lower

    return lambda key: p(key, order)


def test_models_match_dictionaries():
    texts = ["abra cadabra", "the cat sat on the mat", "Äß 12"]
    keys, counts = np.unique(np.concatenate([grams(t, 4) for t in texts]), return_counts=True)
    model, p = KneserNey(keys, counts, 4), brute(texts, 4)
    asked = np.unique(np.concatenate([grams(t, 4) for t in [*texts, "that bat", "zzz \U0001f600"]]))
    assert np.allclose(2 ** model.log2(asked), [p(int(k)) for k in asked])


def test_held_out_accuracy_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in df.collect()}
    got = identified(df).collect()
    assert {r.doc_id for r in got} == set(rows) and len(got) == len(rows)
    right = []
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.held_out and r.lang_pred != "und":
            right.append(r.lang_pred == rows[r.doc_id].lang)
    assert sum(right) / len(right) > 0.97
    again = identified(df.repartition(5)).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(r.doc_id, r.lang_pred) for r in again}


def test_edge_cases(spark):
    data = [(i, "the cat sat on the mat and the dog " * 3 if i % 2 else "der hund und die katze im haus " * 3, "en" if i % 2 else "de") for i in range(40)]
    data += [(100, None, "en"), (101, "", "de"), (102, "12 !?", "en"), (103, "the dog", None), (103, "die katze", None), (None, "the mat", "de"), (104, "the cat " * 20000, "en")]
    got = defaultdict(list)
    for r in identified(spark.createDataFrame([(*x, "s") for x in data], "doc_id long, text string, lang string, score string")).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert [got[i] for i in (100, 101, 102)] == [[("und", 0.0)]] * 3
    assert sorted(x for x, _ in got[103]) == ["de", "en"]
    assert got[None][0][0] == got[104][0][0] == "en"


def test_empty_and_unlabelled_tables(spark):
    schema = "doc_id long, text string, lang string"
    assert identified(spark.createDataFrame([], schema)).count() == 0
    got = identified(spark.createDataFrame([(1, "some text", None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", pytest.approx(0))]
    assert Training().held_out == 1
