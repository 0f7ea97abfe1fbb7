"""Queries over names, strings and dates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.plans.registry import query
from kindred.sources.bridge import CONTRIB, contrib, table
from kindred.sources.files import parsed_date, with_surrogate_id


def junk_sql(words: list[str]) -> str:
    return "|".join(rf"\b{w}\b" for w in words)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STRIP = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def split_name_ctes(source: str, out: str = "named") -> str:
    """CTEs from ``source`` (with NAME) to ``out``: all columns, last_name, middle_name, first_name."""
    return f"""{out}_a as (select *, regexp_replace(regexp_replace(coalesce(NAME,''), {lit(junk_sql(T.NAME_JUNK))}, '', 'g'), '[.0-9]', ' ', 'g') as cl from {source}),
{out}_b as (select *, strpos(cl, ',') as cm, string_split({STRIP.format("replace(substr(cl, strpos(cl, ',')+1), ',', ' ')")}, ' ') as tk, string_split(cl, ' ') as wd from {out}_a),
{out}_c as (select *, list_transform(tk, lambda x: length(x)) as sz, list_filter(tk, lambda x: length(x)=1) as one from {out}_b),
{out}_d as (select *, coalesce(list_position(sz, 1), 0) as at1, list_max(sz) as big from {out}_c),
{out} as (select * exclude (cl, cm, tk, wd, sz, one, at1, big),
 case when cm>1 then string_split(cl, ',')[1] else wd[1] end as last_name,
 case when cm<=1 or len(tk)=1 then '' when len(one)=0 then array_to_string(tk[2:], ' ') else one[1] end as middle_name,
 case when cm<=1 then array_to_string(wd[2:], ' ')
      when len(tk)=1 or len(one)=0 then tk[1]
      when len(one)=1 then trim(concat(array_to_string(tk[1:at1-1], ' '), ' ', array_to_string(tk[at1+1:], ' ')))
      when at1>1 then array_to_string(tk[1:at1-1], ' ')
      when big=1 then one[2] else tk[list_position(sz, big)] end as first_name
 from {out}_d)"""


HARD = [
    "SMITH, JOHN A", "SMITH, JOHN ALAN", "SMITH, J ALAN", "SMITH, A B", "SMITH, A B JOHN MARTINEZ", "SMITH, JOHN A B", "SMITH, MR. JOHN A. JR",
    "ACME CORP PAC", "SMITH,JOHN,A", "SMITH, ", ",JOHN", "", "DE LA CRUZ JR, MARY  ANN", "OBRIEN, DR 3 LI B", "X, A A", "ONE",
]
HARD_SQL = "hard as (select * from (values {}) v(NAME))".format(", ".join(f"({lit(n)})" for n in HARD))


@query("strip", "select doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as stripped from documents")
def strip_(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip(F.col("text")).alias("stripped"))


@query("name_junk", f"with {CONTRIB} select id, regexp_replace(concat('MR ', NAME, ' JR'), {lit(junk_sql(T.NAME_JUNK))}, '', 'g') as plain from contrib")
def name_junk(spark, sf_dir):
    return contrib(spark, sf_dir).select("id", T.without_name_junk(F.concat(F.lit("MR "), "NAME", F.lit(" JR"))).alias("plain"))


@query("splitname", f"with {CONTRIB}, src as (select id, NAME from contrib), {split_name_ctes('src')} select id, last_name, middle_name, first_name from named")
def splitname(spark, sf_dir):
    return T.with_names(contrib(spark, sf_dir).select("id", "NAME"), "NAME").drop("NAME")


@query("splitname_hard", f"with {HARD_SQL}, {split_name_ctes('hard')} select NAME, last_name, middle_name, first_name from named")
def splitname_hard(spark, sf_dir):
    n = T.split_name(F.col("NAME"))
    return spark.createDataFrame([(x,) for x in HARD], "NAME string").select("NAME", n["last"].alias("last_name"), n["middle"].alias("middle_name"), n["first"].alias("first_name"))


AFFILIATIONS = [
    "", "NA", "N/A", "SELFRIDGES", "TEACHER", "CEO", "OCEO INC", "NONESUCH", "DOCTOR", "HANNA", "BANANA CO", "TEACHERS COLLEGE", "ENGINEER", "ACME CORP",
    "NBA", "REGRET", "RETIREMENT HOME", "SELF EMPLOYED", "ATTORNEY", "PHYSICIAN", "N.A", "unknown", "Letter Sent", "REAL ESTATE", "NOT A", "RET", "best effort",
]
AFF_SQL = "aff as (select EMPLOYER as s from contrib union select OCCUPATION from contrib union select * from (values {}) v(s))".format(", ".join(f"({lit(a)})" for a in AFFILIATIONS))


def affiliations(spark, sf_dir):
    c = contrib(spark, sf_dir)
    more = spark.createDataFrame([(a,) for a in AFFILIATIONS], "s string")
    return c.selectExpr("EMPLOYER s").union(c.selectExpr("OCCUPATION")).union(more).distinct()


def bad_sql(pattern: str) -> str:
    return f"(s = '' or regexp_matches(s, {lit('(?i)' + pattern)}))"


@query("bad_employer", f"with {CONTRIB}, {AFF_SQL} select s, {bad_sql(T.BAD_EMPLOYER)} as bad from aff")
def bad_employer(spark, sf_dir):
    return affiliations(spark, sf_dir).select("s", T.bad_employer(F.col("s")).alias("bad"))


@query("bad_occupation", f"with {CONTRIB}, {AFF_SQL} select s, {bad_sql(T.BAD_OCCUPATION)} as bad from aff")
def bad_occupation(spark, sf_dir):
    return affiliations(spark, sf_dir).select("s", T.bad_occupation(F.col("s")).alias("bad"))


@query("single_word", f"with {CONTRIB} select distinct EMPLOYER from contrib where not regexp_matches(EMPLOYER, '[ .,|\\\\/\\-\\t]')")
def single_word(spark, sf_dir):
    return contrib(spark, sf_dir).where(T.single_word(F.col("EMPLOYER"))).select("EMPLOYER").distinct()


@query("reject_query", f"with {CONTRIB}, p as (select distinct string_split(NAME, ', ')[1] as s from contrib) select s, (length(s)<3 or contains(s,' ') or contains(s,'''') or contains(s,'\"')) as rejected from p")
def reject_query(spark, sf_dir):
    c = contrib(spark, sf_dir).select(F.split("NAME", ", ")[0].alias("s")).distinct()
    return c.select("s", T.rejected_name(F.col("s")).alias("rejected"))


PAIRS = "pairs as (select a.s as a, b.s as b from (select distinct EMPLOYER as s from contrib) a, (select distinct EMPLOYER as s from contrib) b where a.s < b.s)"


def employer_pairs(spark, sf_dir):
    """Distinct employers against each other: a fixed list of eleven, whatever the input."""
    e = contrib(spark, sf_dir).selectExpr("EMPLOYER s").distinct()
    return e.selectExpr("s a").join(e.selectExpr("s b"), F.col("a") < F.col("b"))


def tokens_sql(x: str) -> str:
    plain = STRIP.format(f"regexp_replace(regexp_replace({x}, {lit(junk_sql(T.EMPLOYER_JUNK))}, '', 'g'), '[.,\\-&\\\\/]', ' ', 'g')")
    return f"list_distinct(list_filter(string_split({plain}, ' '), lambda x: length(x)>3))"


@query("token_permuted", f"with {CONTRIB}, {PAIRS}, i as (select a, b, list_intersect({tokens_sql('a')}, {tokens_sql('b')}) as c from pairs) select a, b, (len(c)>=2 or (len(c)=1 and length(c[1])>=6)) as permuted from i")
def token_permuted(spark, sf_dir):
    return employer_pairs(spark, sf_dir).select("a", "b", T.tokens_permuted(F.col("a"), F.col("b")).alias("permuted"))


@query("editdist", f"with {CONTRIB}, {PAIRS} select a, b, cast(levenshtein(a, b) as int) as d from pairs")
def editdist(spark, sf_dir):
    return employer_pairs(spark, sf_dir).select("a", "b", F.levenshtein("a", "b").alias("d"))


def sorted_sql(x: str) -> str:
    return f"array_to_string(list_sort(string_split({x}, '')), '')"


@query("sorted_editdist", f"with {CONTRIB}, {PAIRS} select a, b, cast(levenshtein({sorted_sql('a')}, {sorted_sql('b')}) as int) as d from pairs where a<>''")
def sorted_editdist(spark, sf_dir):
    return employer_pairs(spark, sf_dir).where("a <> ''").select("a", "b", T.sorted_distance(F.col("a"), F.col("b")).alias("d"))


@query("rel_editdist", f"with {CONTRIB}, {PAIRS} select a, b, (levenshtein(a, b) < greatest(length(a), length(b))*cast(0.3 as double)) as near_employer, (levenshtein(a, b) < greatest(length(a), length(b))*cast(0.2 as double)) as near_occupation from pairs")
def rel_editdist(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return employer_pairs(spark, sf_dir).select("a", "b", T.within(a, b, 0.3).alias("near_employer"), T.within(a, b, 0.2).alias("near_occupation"))


@query("zip5", f"with {CONTRIB} select id, substr(concat(ZIP_CODE, '1234'), 1, 5) as zip from contrib")
def zip5(spark, sf_dir):
    return contrib(spark, sf_dir).select("id", T.zip5(F.concat("ZIP_CODE", F.lit("1234"))).alias("zip"))


@query("norm_emp", "select doc_id, nullif(upper(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')), '') as plain from documents")
def norm_emp(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.ascii_upper(F.col("text")).alias("plain"))


WORDS = "w as (select doc_id, list_distinct(string_split(lower(text), ' ')) as ws from documents)"


@query("jaccard", f"with {WORDS} select a.doc_id as a, b.doc_id as b, round(len(list_intersect(a.ws, b.ws)) / cast(len(list_distinct(list_concat(a.ws, b.ws))) as double), 9) as j from w a join w b on b.doc_id = a.doc_id + 1")
def jaccard(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("ws"))
    b = w.selectExpr("doc_id b", "ws wb").withColumn("a", F.col("b") - 1)
    return w.withColumnRenamed("doc_id", "a").join(b, "a").select("a", "b", F.round(T.jaccard(F.col("ws"), F.col("wb")), 9).alias("j"))


@query("hamming", "select o_orderkey, cast(list_sum(list_transform(range(1, 33), lambda i: case when substr(md5(cast(o_orderkey as varchar)), i, 1) <> substr(md5(cast(o_custkey as varchar)), i, 1) then 1 else 0 end)) as int) as d from orders")
def hamming(spark, sf_dir):
    d = T.hamming(F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.md5(F.col("o_custkey").cast("string").cast("binary")))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))


@query("pair_agree", f"""with {CONTRIB}, h as (select STATE, substr(md5(STATE), 1, 16) as s from (select distinct STATE from contrib) x)
select a.STATE as a, b.STATE as b, cast(list_sum(list_transform(range(1, 17), lambda i: case when substr(a.s, i, 1) = substr(b.s, i, 1) then 1 else 0 end)) as int) as same from h a, h b""")
def pair_agree(spark, sf_dir):
    h = contrib(spark, sf_dir).select("STATE").distinct().select("STATE", F.substring(F.md5(F.col("STATE").cast("binary")), 1, 16).alias("s"))
    pairs = h.selectExpr("STATE a", "s sa").join(h.selectExpr("STATE b", "s sb"))
    return pairs.select("a", "b", (F.lit(16) - T.hamming(F.col("sa"), F.col("sb"))).alias("same"))


@query("format_date", f"with {CONTRIB} select id, concat_ws('-', substr(TRANSACTION_DT,1,4), substr(TRANSACTION_DT,5,2), substr(TRANSACTION_DT,7,2)) as day from contrib")
def format_date(spark, sf_dir):
    return contrib(spark, sf_dir).select("id", T.dashed_date(F.col("TRANSACTION_DT")).alias("day"))


@query("date_parse", "select o_orderkey, cast(try_strptime(case when o_orderkey % 10=0 then '13312001' else strftime(o_orderdate, '%m%d%Y') end, '%m%d%Y') as date) as d from orders")
def date_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", parsed_date(F.expr("if(o_orderkey % 10 = 0, '13312001', date_format(o_orderdate, 'MMddyyyy'))")).alias("d"))


@query("surrogate_id", f"with {CONTRIB} select NAME, id as source_id, cast(row_number() over (order by STATE, NAME, TRANSACTION_DT, id) as bigint) as id from contrib")
def surrogate_id(spark, sf_dir):
    c = contrib(spark, sf_dir).selectExpr("NAME", "STATE", "TRANSACTION_DT", "id source_id")
    return with_surrogate_id(c, ["NAME", "TRANSACTION_DT", "source_id"], "STATE").select("NAME", "source_id", "id")


@query("record_string", f"with {CONTRIB} select id, concat_ws(chr(9), NAME, ZIP_CODE, CITY, STATE, EMPLOYER, OCCUPATION, TRANSACTION_DT) as line from contrib")
def record_string(spark, sf_dir):
    return contrib(spark, sf_dir).select("id", F.concat_ws("\t", "NAME", "ZIP_CODE", "CITY", "STATE", "EMPLOYER", "OCCUPATION", "TRANSACTION_DT").alias("line"))


@query("common_word", f"with {CONTRIB}, {PAIRS} select a, b, len(list_intersect(string_split(a,' '), string_split(b,' ')))>0 as shared from pairs")
def common_word(spark, sf_dir):
    return employer_pairs(spark, sf_dir).select("a", "b", T.common_word(F.col("a"), F.col("b")).alias("shared"))


@query("regex_freq", "select m as found, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-z]+ing\\b')) as m from documents) x group by m")
def regex_freq(spark, sf_dir):
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]+ing\b"), 0)
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("found")).groupBy("found").agg(F.count("*").alias("n"))


@query("search_regex", f"with {CONTRIB} select id, NAME, STATE, EMPLOYER from contrib where regexp_matches(NAME, '(?i)^sm[iy]th') and regexp_matches(EMPLOYER, '(?i)acme|state')")
def search_regex(spark, sf_dir):
    c = contrib(spark, sf_dir)
    return c.where(T.matches(c.NAME, "^sm[iy]th") & T.matches(c.EMPLOYER, "acme|state")).select("id", "NAME", "STATE", "EMPLOYER")


@query("fulltext_and", f"with {CONTRIB} select id, NAME from contrib where list_contains(regexp_split_to_array(upper(NAME), '[^A-Z0-9'']+'), 'CRUZ') and list_contains(regexp_split_to_array(upper(NAME), '[^A-Z0-9'']+'), 'MARIA')")
def fulltext_and(spark, sf_dir):
    return contrib(spark, sf_dir).where(T.has_words(F.col("NAME"), "cruz", "maria")).select("id", "NAME")
