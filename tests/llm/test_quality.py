import re
from collections import Counter

import zstandard

from kindred.llm.quality import Bands, compression_quality, keep_good

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, bands):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if grams[g] > 1:
            marked |= {i, i + 1, i + 2}
    raw = text.encode()
    pack = zstandard.ZstdCompressor(level=bands.level).compress
    low, high = bands.band(len(raw))
    ratio = len(pack(raw)) / len(raw) if raw else 0.0
    step = bands.chunk_bytes
    parts = [len(pack(raw[i : i + step])) / step for i in range(0, len(raw) - step + 1, step)]
    bad = sum(not bands.chunk[0] <= p <= bands.chunk[1] for p in parts)
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    kept = not failed and low <= ratio <= high and bad <= bands.bad_share * len(parts)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed, kept)


def check(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string, n_words string")
    got = compression_quality(df).collect()
    want = Counter((i, *brute(t, Bands())) for i, t, _ in data)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
    kept = Counter((r.doc_id, r.text) for r in keep_good(df).collect())
    assert kept == Counter((i, t) for i, t, _ in data if brute(t, Bands())[-1])


def test_edge_cases(spark):
    long = " ".join(f"w{i * 7919 % 100003}x" for i in range(30000))
    check(spark, [(1, None, "x"), (2, "", None), (3, " \t\n\x0b", ""), (4, "a a a a", ""), (4, "a a a a", ""), (None, "b\nb\n\nb", ""), (5, long, ""), (6, "spam eggs " * 400, ""), (7, "éß #| x y z", "")])


def test_documents_match_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(spark, [(r.doc_id, r.text, "") for r in df.select("doc_id", "text").collect()])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert compression_quality(df).count() == 0
    assert keep_good(df).count() == 0
