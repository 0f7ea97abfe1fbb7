import heapq
import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kindred.llm.huffman import Code, code_lengths, pack, unpack
from kindred.llm.text import shared_dir
from kindred.llm.tokenids import Output, WordIds, read_ids, write_ids, written_ids


def plain_huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=3, max_size=200))
def test_lengths_are_optimal_where_the_limit_is_loose(counts):
    counts = np.array(counts)
    lengths = code_lengths(counts).astype(int)
    assert ((lengths > 0) == (counts > 0)).all()
    if (counts > 0).sum() > 1:
        assert (lengths * counts).sum() == plain_huffman_cost(counts.tolist())


def test_lengths_keep_the_limit():
    counts = np.array([int(1.6**k) + 1 for k in range(60)])
    lengths = code_lengths(counts)
    assert lengths.max() <= 16
    assert sum(2.0 ** -int(x) for x in lengths) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=40), min_size=1, max_size=8), st.integers(1, 9))
def test_chunks_round_trip(docs, block):
    counts = np.bincount(np.concatenate(docs), minlength=301)
    code = Code(code_lengths(counts))
    held = [(None if k == 1 else k, np.array(d)) for k, d in enumerate(docs)]
    ids, sizes, flat, before = unpack(code, pack(code, held, block, 77))
    assert ids == [i for i, _ in held] and before == 77
    assert sizes.tolist() == [len(d) for d in docs]
    assert flat.tolist() == [x for d in docs for x in d]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abCDÉßñ .,'’\n\t\x0b\x1c\x85 ́ İΣσς1²½#<|>京\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|ENDofText|>", "don't ", "'S "]), max_size=30))
def test_words_give_what_the_library_gives(parts):
    text, (make, whole) = "".join(parts), make_both()
    assert np.frombuffer(make(text.encode()), make.kind).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1]


_both = []


def make_both():
    if not _both:
        _both.extend((WordIds(Output(memo=50)), Tokenizer.from_file(Output().tokenizer)))
    return _both


def check(spark, data, output=None):
    output = output or Output()
    df = spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, n int")
    whole = Tokenizer.from_file(output.tokenizer)
    ids = {(i, t): [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in data}
    path = shared_dir(spark, "test-ids")
    write_ids(df, path, output)
    got = sorted(read_ids(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids[i, t])) for i, t in data)
    start = 0
    for r in got:
        assert r.start == start
        start += len(r.ids)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    digests = sorted(written_ids(df, output).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in digests] == [(r.doc_id, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got]


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], Output(chunk_ids=5000, shard_ids=40000))


def test_edge_cases(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcde", k=5)) for _ in range(30000))
    check(spark, [(3, None), (2, ""), (2, "Two rows"), (2, "Two rows"), (None, "no id"), (None, None), (-5, "minus"), (1, long)], Output(chunk_ids=100, shard_ids=1000))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert written_ids(df).count() == 0
