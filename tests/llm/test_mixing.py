import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kindred.llm.mixing import Mix, cut, mixed, permuted, plan, take, water_fill
from kindred.llm.text import word_count, word_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in range(3):
            got = permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == list(range(n))
    assert permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 9, np.uint64)).tolist() != list(range(1000))


def test_water_fill():
    assert water_fill([100, 100, 100], [5, 2, 1], 1.5, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert water_fill([0, 10], [5, 2], 1.5, 2) == [0.0, 15.0]
    assert water_fill([0], [1], 1.5, 2) == [0.0]
    assert water_fill([], [], 1.5, 2) == []


def check(spark, data, mix=None):
    df = spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, source string, size int")
    mix = mix or Mix()
    got = mixed(df, mix).collect()
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, water_fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)))
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in data)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - targets[s]) <= 2 * mix.block_words
    again = mixed(df.repartition(7), mix).collect()
    assert Counter(again) == Counter(got)
    return df, got


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = [(r.doc_id, r.text, r.source) for r in df.collect()]
    frame, got = check(spark, data)
    texts = {r.doc_id: r.text for r in take(frame).collect()}
    assert {r.doc_id: r.taken for r in got if r.taken} == {i: len(WORD.findall(t)) for i, t in texts.items()}


def test_edge_cases(spark):
    data = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (3, "x y z", None), (None, "w " * 5000, "b"), (4, "é ß", ""), (5, "q " * 700, "B")]
    check(spark, data, Mix(block_words=4, shard_slots=16))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixed(df).count() == 0
    assert take(df).count() == 0


def test_slots_fill_shards_and_blocks_evenly(spark, sf_dir):
    p = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Mix(block_words=16, shard_slots=100))
    slots = p.slots().collect()
    assert Counter(Counter(r.shard for r in slots).values()).most_common(1)[0][0] == 100
    uses = defaultdict(Counter)
    for r in slots:
        uses[r.s][r.block] += 1
    for s, c in uses.items():
        n = -(-p.sizes[s] // 16)
        assert max(c.values()) <= 2
        assert max(c.values()) - min(c.get(b, 0) for b in range(n)) <= 1


def test_cut_keeps_the_text_between_words():
    parts = [{"word_from": 0, "n_words": 2, "uses": 2}, {"word_from": 2, "n_words": 1, "uses": 1}, {"word_from": 4, "n_words": 1, "uses": 1}]
    assert cut("a\n b  c d é".encode(), parts) == "a\n b  c\né\na\n b"


def test_words_of_a_text_are_found_stretch_by_stretch():
    for text in (b"", b" ", b"a", b" a", b"ab cd ", b"\t\n\x0b\x0c\r x\x1fy \x85z", ("wort " * 300_000).encode(), b"x" * (1 << 20) + b" y", b"x" * (1 << 20), b" " * (1 << 20) + b"end"):
        words = text.split()
        assert word_count(text) == len(words)
        picked = sorted({0, len(words) // 2, max(0, len(words) - 1)}) if words else []
        begin, end = word_spans(text, picked, picked)
        assert [text[a:b] for a, b in zip(begin, end)] == [words[i] for i in picked]


def test_take_passes_on_columns_of_any_name_and_very_long_texts(spark):
    names = ["_key", "_parts", "_id", "_source", "_h", "parts", "h", "s", "start", "Source_", "uses"]
    data = [(1, "a b c " * 400_000, "x"), (2, None, "x"), (3, "", None), (4, "q r " * 500, None), (4, "q r " * 500, None), (4, "other " * 300, None), (None, "n o " * 300, "y")]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    df = spark.createDataFrame([(*x, len(x[1] or ""), *range(len(names))) for x in data], schema)
    got = take(df).collect()
    assert take(df).schema == df.schema
    for r in got:
        assert r[4:] == tuple(range(len(names)))
        assert r.n_chars == len(r.text)
    sizes = Counter()
    for i, t, s in set(data):
        sizes[s] += len(WORD.findall(t or ""))
    targets = dict(zip(["x", "y", None], water_fill([sizes[s] for s in ("x", "y", None)], [5, 2, 1], 1.5, 2)))
    taken = Counter()
    for r in {(r.doc_id, r.text, r.source) for r in got}:
        taken[r[2]] += len(WORD.findall(r[1]))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 2 * Mix().block_words


def test_draws_go_down_a_tree_of_shards(spark, sf_dir):
    """The same number of slots in every shard, and every slot of a source once, however deep the tree is."""
    p = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Mix(block_words=16, shard_slots=20, fan=3))
    shards = p.shards().collect()
    assert sorted(r.first for r in shards) == list(range(len(shards)))
    sizes = Counter(sum(r.n) for r in shards)
    assert sizes[20] >= len(shards) - 1
    slots = p.slots().collect()
    assert len(slots) == sum(sum(r.n) for r in shards)
    for s in range(len(p.sizes)):
        mine = sorted(r.slot for r in slots if r.s == s)
        assert mine == list(range(len(mine)))
        assert abs(len(mine) * 16 - p.targets[s]) <= 2 * 16
