import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kindred.llm.tokencount import Counting, Transducer, token_counts, unicode_classes

WHOLE = Tokenizer.from_file(Counting().tokenizer)
RUN = Transducer(Counting(memo=100), unicode_classes(Counting().tokenizer))
SMALL = Transducer(Counting(chunk=5, few=0, pieces=7), unicode_classes(Counting().tokenizer))
PARTS = [*"aést 1²'.!\n\t\r\x0b\x0c\x1c\x85\xa0 ́ 京\U0001f600<|", "  ", "'s", "'re", "'ll", "'r", " don't", "<|endoftext|>", "word ", "12"]


def n(text):
    return len(WHOLE.encode(text, add_special_tokens=False).ids)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_counts_are_the_library_s(parts):
    text = "".join(parts)
    assert RUN.count([text.encode()]) == SMALL.count([text.encode()]) == [n(text)]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([*"aA 1'.!\n\t<", "  ", "'s", "'re", "word ", "long stretch"]), max_size=40))
def test_chunk_maps_compose(parts):
    """The scan's maps are those of the texts up to each chunk's end, and texts at hand don't touch one another."""
    texts = ["".join(parts[i::3]) for i in range(3)]
    assert SMALL.count([t.encode() for t in texts]) == [n(t) for t in texts]
    cutter, text = SMALL.cutter, texts[0]
    kinds = cutter.kinds[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    chunks = [np.pad(kinds[i : i + 5], (0, max(0, i + 5 - len(kinds))), constant_values=cutter.pad) for i in range(0, len(kinds), 5)]
    if chunks:
        done = cutter.scan(cutter.maps(np.array(chunks)), np.zeros(len(chunks), int))
        for k in range(len(chunks)):
            for first in range(cutter.n_states):
                state = first
                for c in kinds[: 5 * (k + 1)]:
                    state = cutter.next[state, c]
                assert done[k, first] == state


def test_single_pieces_and_cleared_tables():
    rng = random.Random(5)
    pieces = ["".join(rng.choices("abcdeilnorst", k=rng.randrange(1, 60))) for _ in range(3000)] + ["x" * 3000, "ab" * 2000, "".join(rng.choices("aeioustr", k=9000))]
    for run in (RUN, SMALL):
        assert run.count([p.encode() for p in pieces]) == [n(p) for p in pieces]
        assert run.count([" ".join(pieces).encode()]) == [n(" ".join(pieces))]


def test_every_code_point():
    rng = random.Random(0)
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for c in rng.sample(points, 3000) + points[:0x600]:
        text = f"a{c}1 {c}b'{c}s{c}{c}!"
        assert RUN.count([text.encode()]) == [n(text)], hex(ord(c))


def check(spark, data):
    df = spark.createDataFrame([(*x, 0) for x in data], "doc_id long, text string, n_tokens int")
    got = Counter(tuple(r) for r in token_counts(df).collect())
    assert got == Counter((i, len((t or "").encode()), n(t or ""), n(t or "") > 512) for i, t in data)


def test_documents(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])


def test_edge_cases(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdé.,'", k=6)) for _ in range(40000))
    check(spark, [(1, None), (2, ""), (3, " \n "), (4, long), (4, long), (None, "no id"), (5, "x" * 70000), (6, " " * 70000), (7, "a<|endoftext|> b<|endoftext|>")])


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
