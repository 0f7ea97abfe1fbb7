import random
import re

from kindred.llm.decontaminate import Search, contaminated, keep_clean

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    out = []
    for item_id, text in items:
        w = words(text)
        if not w:
            continue
        n = min(5, len(w))
        s = grams(w, n)
        for doc_id, doc in docs:
            found = len(s & grams(words(doc), n))
            if 100 * found >= 80 * len(s):
                out.append((doc_id, item_id, len(s), found))
    return sorted(out, key=str)


def check(spark, docs, items, search=None):
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = sorted(((r.doc_id, r.item_id, r.n_item_shingles, r.n_found) for r in contaminated(d, i, search).collect()), key=str)
    assert got == want
    texts = {t for k, t in docs if any(w[0] == k for w in want)}
    assert sorted(r.doc_id for r in keep_clean(d, i, search).collect()) == sorted(k for k, t in docs if t not in texts)


def test_documents_match_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert brute(docs, items)
    check(spark, docs, items)


def test_items_of_all_sizes_in_long_documents(spark):
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    sizes = [1, 2, 4, 5, 6, 7, 9, 12, 20, 33, 70, 140, 400, 900]
    items = [(k, make(n)) for k, n in enumerate(sizes)]
    docs = []
    for k, w in items:
        for lost in (0, len(w) // 8, len(w) // 3):
            docs.append((len(docs), " ".join(make(rng.randrange(3000)) + w[: len(w) - lost] + make(rng.randrange(3000)))))
    docs += [(1000, None), (1001, ""), (1002, " ".join(make(20000) + [x.upper() for x in items[8][1]]))]
    items = [(k, " ".join(w)) for k, w in items] + [(100, None), (101, ""), (102, items[9][1][0] + " alone")]
    check(spark, docs, items)
    check(spark, docs, items, Search(slice_items=4))


def test_empty_tables(spark):
    docs, items = [(1, "a b c d e f")], [(1, "a b c d e")]
    check(spark, [], items)
    check(spark, docs, [])
    check(spark, docs * 2, items * 2)


def test_small_and_repetitive_items_are_always_found(spark):
    rng = random.Random(7)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items = [make(5 + k % 9) for k in range(180)] + [make(2) * (10 + k) for k in range(40)] + [make(9) * 12 for _ in range(20)]
    docs = [" ".join(make(200) + w + make(200)) for w in items]
    check(spark, list(enumerate(docs)), [(k, " ".join(w)) for k, w in enumerate(items)])
