"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import ctw, decontaminate, language, minhash, mixing, quality, substrings, tokencount, tokenids, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_quality(table(spark, sf_dir, "documents"))


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.written_ids(table(spark, sf_dir, "documents"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op5_substring_dedup"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
t as (select doc_id, words, len(words) as n from w),
p as (select doc_id, unnest(range(1, n - 11)) as i, words from t where n >= 13),
g as (select doc_id, i, array_to_string(words[i:i+12], ' ') as win from p),
m as (select win, min(doc_id) as first_id from g group by win),
r as (select distinct g.doc_id, unnest(range(g.i, g.i + 13)) as i from g join m on g.win = m.win where m.first_id < g.doc_id),
k as (select t.doc_id, t.n, u.i, t.words[u.i] as word from t, unnest(range(1, t.n + 1)) as u(i)),
s as (select k.doc_id, count(r.i) as n_removed, coalesce(string_agg(k.word, ' ' order by k.i) filter (where r.i is null), '') as kept
      from k left join r on k.doc_id = r.doc_id and k.i = r.i group by k.doc_id)
select t.doc_id, cast(t.n as bigint) as n_words, cast(coalesce(s.n_removed, 0) as bigint) as n_removed, sha256(coalesce(s.kept, '')) as kept_sha256
from t left join s on t.doc_id = s.doc_id
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


@query
def op8_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(table(spark, sf_dir, "documents"))


@query
def op1_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+')"

#: Items of fewer than five words, of which the tables have none, would be looked for as whole sequences.
ORACLES["op4_benchmark_decontamination"] = f"""
with dw as (select doc_id, {WORDS} as ws from documents), iw as (select item_id, {WORDS} as ws from benchmark),
d as (select distinct doc_id, array_to_string(ws[i:i+4], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from dw where len(ws) >= 5) x),
i as (select distinct item_id, array_to_string(ws[i:i+4], ' ') as s from (select item_id, ws, unnest(range(1, len(ws) - 3)) as i from iw where len(ws) >= 5) x),
t as (select item_id, count(*) as n from i group by item_id)
select d.doc_id, i.item_id, t.n as n_item_shingles, count(*) as n_found, count(*) / cast(t.n as double) as containment
from d join i on d.s = i.s join t on t.item_id = i.item_id group by d.doc_id, i.item_id, t.n having 100 * count(*) >= 80 * t.n
"""

ORACLES["op7_minhash_near_dedup"] = f"""
with recursive w as (select doc_id, {WORDS} as ws from documents), k as (select doc_id, ws, least(5, len(ws)) as n from w),
sh as (select distinct doc_id, array_to_string(ws[i:i+n-1], ' ') as s from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from k where n > 0) x),
c as (select doc_id, count(*) as n from sh group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as m from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as (select p.a, p.b from p join c x on x.doc_id = p.a join c y on y.doc_id = p.b where 100 * p.m >= 85 * (x.n + y.n - p.m)),
e as (select a, b from l union all select b, a from l),
r(node, seen) as (select a, a from e union select r.node, e.b from r join e on r.seen = e.a),
h as (select node, min(seen) as head from r group by node)
select w.doc_id, cast(coalesce(c.n, 0) as bigint) as n_shingles, coalesce(h.head, w.doc_id) as component_id, coalesce(h.head, w.doc_id) = w.doc_id as kept
from w left join c on c.doc_id = w.doc_id left join h on h.node = w.doc_id
"""

# --- what SQL can say of the operators that it can't express as a whole


@query
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule")


ORACLES["url_parts"] = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
p as (select page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u)
select page_id, host, path, case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
 when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
 when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/' when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from p
"""


@query
def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.compression_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


ORACLES["base_quality"] = r"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
h as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i+1], ws[i+2]) as n from g),
r as (select doc_id, count(distinct k) as n from (select doc_id, unnest([i, i + 1, i + 2]) as k from h where n > 1) x group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from w) x where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
b as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
 cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(l.n, 0) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words
 from w left join r on r.doc_id = w.doc_id left join l on l.doc_id = w.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b
"""


@query
def source_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size")


ORACLES["source_sizes"] = r"""
with w as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents)
select doc_id, cast(size as bigint) as size, cast(sum(size) over (partition by source) as bigint) as source_size from w
"""


@query
def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes")


ORACLES["text_bytes"] = "select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes from documents"
