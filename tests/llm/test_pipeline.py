import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from kindred.llm.mixing import Mix, cut, plan
from kindred.llm.quality import Bands
from kindred.llm.tokenids import Output
from tests.llm.test_decontaminate import brute as holders
from tests.llm.test_minhash import brute as groups
from tests.llm.test_quality import brute as figures


def test_stages_match_brute_force(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in documents.collect()}

    good = stages["quality_rules"](spark, documents, sf_dir)
    want = {i for i, r in rows.items() if figures(r.text, Bands())[-1]}
    assert {r.doc_id: r for r in good.collect()} == {i: rows[i] for i in want}

    one = stages["near_dedup"](spark, good, sf_dir)
    found = groups([(i, rows[i].text) for i in sorted(want)])
    want = {i for i in want if found[i][2]}
    assert {r.doc_id: r for r in one.collect()} == {i: rows[i] for i in want}

    clean = stages["decontamination"](spark, one, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want -= {d for d, *_ in holders([(i, rows[i].text) for i in want], items)}
    assert {r.doc_id: r for r in clean.collect()} == {i: rows[i] for i in want}

    taken = stages["mix_sources"](spark, clean, sf_dir)
    parts = {}
    p = plan(clean)
    for r in p.assembled().join(p.places, ["s", "start"]).collect():
        parts.setdefault(r.doc_id, Counter())[r.word_from, r.n_words] += 1
    texts = {i: cut(rows[i].text.encode(), [{"word_from": a, "n_words": n, "uses": u} for (a, n), u in sorted(c.items())]) for i, c in parts.items()}
    assert taken.schema == documents.schema
    assert {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in taken.collect()} == {i: (t, rows[i].lang, rows[i].source, len(t)) for i, t in texts.items()}
    assert sum(len(t.split()) for t in texts.values()) >= (Mix().share - 0.1) * sum(len(rows[i].text.split()) for i in want)

    whole, start = Tokenizer.from_file(Output().tokenizer), 0
    final = {}
    for i in sorted(texts):
        ids = [*whole.encode(texts[i], add_special_tokens=False).ids, 1]
        final[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()} == final


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns with clashing names."""
    rng = np.random.default_rng(4)
    stems = "ba be bi bo da de di do fa fe fi fo ga ge gi go la le li lo ma me mi mo".split()
    prose = lambda n: " ".join("".join(rng.choice(stems, rng.integers(1, 5))) for _ in range(n)).capitalize() + "."
    one, other, item = prose(300), prose(400), prose(30)
    vocabulary = ["".join(rng.choice(list("abcdefghiklmnoprstuvwy"), rng.integers(2, 10))) for _ in range(6000)]
    long = " ".join(rng.choice(vocabulary, 150_000))
    rows = [(i, prose(int(rng.integers(80, 400))), "en", f"s{i % 3}") for i in range(60)]
    rows += [(None, prose(200), "en", "s1"), (100, None, None, None), (101, "", "de", "s1"), (102, " \n\t ", "de", None), (103, long, None, "s2"), (104, long + " end", None, "s2")]
    rows += [(105, one, "en", None), (105, one, "en", None), (105, other, "en", None), (106, one, "en", "s0"), (90, other + " more", "fr", "s0"), (107, f"{prose(200)} {item} {prose(200)}", "en", "s0")]
    rows += [(None, None, None, None), (None, one, None, None), (-5, prose(120), "en", "\u00e9")]
    names = ["h", "gone", "parts", "_key", "doc_id_", "n_words", "group", "class_id", "start", "uses"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[None if k % 2 else "x" for k in range(len(names))]) for r in rows], schema)
    spark.createDataFrame([(1, item), (2, None), (3, ""), (None, prose(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns, name
        held = {(r.doc_id, r.text) for r in before.collect()}
        kept = {(r.doc_id, r.text) for r in after.collect()}
        if name == "near_dedup":
            texts = {t for _, t in kept}
            assert (90, other + " more") in kept and (105, one) in kept and not {(105, other), (106, one), (104, long + " end")} & kept
            assert len([1 for i, t in kept if t and t.startswith(long[:1000])]) == 1 and {t for i, t in held if i is not None and i < 60} <= texts
        if name == "decontamination":
            assert 107 not in {i for i, _ in kept} and len(kept) == len(held) - 1
        before = spark.createDataFrame(after.collect(), docs.schema)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in before.collect())
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)


def test_empty_tables_go_through_all_stages(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
