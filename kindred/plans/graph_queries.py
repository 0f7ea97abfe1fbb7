"""Queries over tokens, persons and affiliation graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators import affiliation as A
from kindred.operators import graph as G
from kindred.operators import tokens as K
from kindred.plans.registry import query
from kindred.plans.scalar_queries import bad_sql, split_name_ctes
from kindred.sources.bridge import COMMITTEES, CONTRIB, KNOWN, VARIANT_PAIRS, VARIANTS, committees, contrib, known_names, table, variants

MEMBERS = f"""{CONTRIB}, src as (select *, concat(STATE,'|',NAME) as identity from contrib), {split_name_ctes('src')},
members as (select *, coalesce(nullif(upper(regexp_replace(EMPLOYER,'[^\\x00-\\x7F]','','g')),''),'') as employer_n,
 coalesce(nullif(upper(regexp_replace(OCCUPATION,'[^\\x00-\\x7F]','','g')),''),'') as occupation_n, CONTRIBUTOR_STREET_1 as address, substr(ZIP_CODE,1,5) as zip from named)"""
WITH = f"with {MEMBERS}"


def members(spark, sf_dir):
    """Normalised records; everyone of a name in a state is one person."""
    return K.normalised(contrib(spark, sf_dir)).withColumn("identity", F.concat_ws("|", "STATE", "NAME"))


def words(column, kind):
    return f"select id, STATE, {kind} as type, w as tok from (select id, STATE, unnest(string_split({column}, ' ')) as w from members) x where w<>''"


NAME_TOK = f"name_tok as ({words('last_name', 1)} union all {words('first_name', 2)} union all select id, STATE, 3, substr(middle_name,1,1) from members where middle_name<>'')"
FIELD_TOK = f"field_tok as ({words('employer_n', 67)} union all {words('occupation_n', 67)} union all {words('address', 5)} union all {words('zip', 4)})"


def grams(column, kind):
    return f"select id, {kind} as type, substr(w, cast(i as int), 2) as tok from (select id, w, unnest(range(1, length(w))) as i from (select id, unnest(string_split({column}, ' ')) as w from members) x where length(w)>=2) y"


def flat(records, tokens, *more):
    return records.select("id", *more, F.explode(tokens).alias("t")).select("id", *more, "t.type", "t.tok")


@query("tok_name", f"{WITH}, {NAME_TOK} select id, type, tok from name_tok")
def tok_name(spark, sf_dir):
    return flat(members(spark, sf_dir), K.name_tokens())


@query("tok_fields", f"{WITH}, {FIELD_TOK} select id, type, tok from field_tok")
def tok_fields(spark, sf_dir):
    return flat(members(spark, sf_dir), K.field_tokens())


@query("tok_bigram", f"{WITH}, {NAME_TOK} select id, type, tok from name_tok union all {grams('last_name', 1)} union all {grams('first_name', 2)}")
def tok_bigram(spark, sf_dir):
    return flat(members(spark, sf_dir), K.name_bigrams())


@query("vectors", f"{WITH}, {NAME_TOK}, {FIELD_TOK}, d as (select distinct id, concat(type,':',tok) as t from (select * from name_tok union all select * from field_tok) x) select id, string_agg(t, ' ' order by t) as tokens from d group by id")
def vectors(spark, sf_dir):
    v = K.vectors(members(spark, sf_dir), F.concat(K.name_tokens(), K.field_tokens()))
    return v.select("id", F.array_join(F.array_sort(F.transform("tokens", lambda t: F.concat_ws(":", t["type"].cast("string"), t["tok"]))), " ").alias("tokens"))


@query("token_counts", f"{WITH}, {NAME_TOK}, {FIELD_TOK} select STATE, type, tok, count(*) as cnt from (select * from name_tok union all select * from field_tok) x group by STATE, type, tok")
def token_counts(spark, sf_dir):
    return K.token_counts(members(spark, sf_dir), F.concat(K.name_tokens(), K.field_tokens()), "STATE")


@query("token_counts_usa", f"{WITH}, {NAME_TOK}, {FIELD_TOK}, c as (select type, tok, count(*) as cnt from (select * from name_tok union all select * from field_tok) x group by type, tok) select type, tok, cnt, cast(row_number() over (order by type, tok) as int) as idx from c")
def token_counts_usa(spark, sf_dir):
    c = K.token_counts(members(spark, sf_dir), F.concat(K.name_tokens(), K.field_tokens()))
    return c.withColumn("idx", F.row_number().over(Window.orderBy("type", "tok")))


@query("name_counts", f"{WITH} select last_name, count(*) as n from members group by last_name")
def name_counts(spark, sf_dir):
    return members(spark, sf_dir).groupBy("last_name").agg(F.count("*").alias("n"))


ATTRS = ["first_name", "last_name", "middle_name", "full_with", "full_without", "employer_n", "occupation_n"]
DOM = (
    "full_names as (select *, case when middle_name<>'' then concat_ws('|',last_name,middle_name,first_name) else '' end as full_with, concat_ws('|',last_name,'',first_name) as full_without from members), attr as ("
    + " union all ".join(f"select identity, '{a.removesuffix('_n')}' as attr, {a} as value from full_names where {a}<>''" for a in ATTRS)
    + "), cnts as (select identity, attr, value, count(*) as n from attr group by all), dom as (select identity, attr, value, n from (select *, row_number() over (partition by identity, attr order by n desc, value) as r from cnts) x where r=1)"
)
PERSON_TOK = "person_tok as (select case attr when 'first_name' then 2 when 'last_name' then 1 when 'middle_name' then 3 when 'full_with' then 123 when 'full_without' then 123 else 67 end as type, value as tok, count(*) as cnt from dom group by all)"


@query("dominant", f"{WITH}, {DOM} select * from dom where attr in ('employer','occupation','middle_name')")
def dominant(spark, sf_dir):
    return K.dominant(members(spark, sf_dir), ["employer", "occupation", "middle_name"])


@query("person_tokens", f"{WITH}, {DOM}, {PERSON_TOK} select * from person_tok")
def person_tokens(spark, sf_dir):
    return K.person_tokens(members(spark, sf_dir))


@query("freq_lookup", f"{WITH}, {NAME_TOK}, c as (select tok, count(*) as cnt from name_tok where type=1 group by tok) select m.id, m.last_name, coalesce(c.cnt, 0) as freq from members m left join c on c.tok=m.last_name")
def freq_lookup(spark, sf_dir):
    m = members(spark, sf_dir)
    return K.with_frequency(m, K.token_counts(m, K.name_tokens()), K.LAST, "last_name", "freq").select("id", "last_name", "freq")


@query("variant_lookup", f"{WITH}, {VARIANTS}, n as (select distinct first_name as x from members) select a.x as a, b.x as b, exists(select 1 from variants v where v.name=a.x and v.variant=b.x) as variant from n a, n b where a.x<b.x")
def variant_lookup(spark, sf_dir):
    n = members(spark, sf_dir).select("first_name").distinct()
    pairs = n.selectExpr("first_name a").join(n.selectExpr("first_name b"), F.col("a") < F.col("b"))
    v = variants(spark).selectExpr("name a", "variant b", "true v")
    return pairs.join(v, ["a", "b"], "left").select("a", "b", F.coalesce("v", F.lit(False)).alias("variant"))


@query("name_variants", "with l(list_id, names) as (values " + ", ".join(f"({i}, ['{a}','{b}'])" for i, (a, b) in enumerate(VARIANT_PAIRS + [("BOB", "ROB")])) + "), f as (select list_id, unnest(names) as name from l) select x.name, string_agg(distinct y.name, ',' order by y.name) as variants from f x join f y on x.list_id=y.list_id and x.name<>y.name group by x.name")
def name_variants(spark, sf_dir):
    lists = spark.createDataFrame([(i, list(p)) for i, p in enumerate(VARIANT_PAIRS + [("BOB", "ROB")])], "list_id int, names array<string>")
    return K.name_variants(lists).select("name", F.array_join("variants", ",").alias("variants"))


@query("all_names", f"with {VARIANTS}, {KNOWN} select name from variants union select variant from variants union select name from known_names")
def all_names(spark, sf_dir):
    v = variants(spark)
    return v.select("name").union(v.select("variant")).union(known_names(spark)).distinct()


@query("multistate", f"{WITH}, p as (select NAME, STATE from members group by all) select NAME, string_agg(STATE, ',' order by STATE) as states from p group by NAME having count(*)>1")
def multistate(spark, sf_dir):
    return K.multi_state(members(spark, sf_dir), "NAME").select("NAME", F.array_join("states", ",").alias("states"))


@query("middle_initials", f"{WITH} select concat(STATE,last_name,first_name) as person, string_agg(distinct substr(middle_name,1,1), '' order by substr(middle_name,1,1)) as initials from members where middle_name<>'' group by 1")
def middle_initials(spark, sf_dir):
    m = members(spark, sf_dir).where("middle_name <> ''")
    return m.groupBy(F.concat("STATE", "last_name", "first_name").alias("person")).agg(F.array_join(F.array_sort(F.collect_set(F.substring("middle_name", 1, 1))), "").alias("initials"))


@query("middle_freq", f"{WITH} select middle_name, count(*) as n from members where middle_name<>'' group by 1 order by n desc")
def middle_freq(spark, sf_dir):
    return members(spark, sf_dir).where("middle_name <> ''").groupBy("middle_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("multi_last", f"{WITH} select address, zip, count(distinct last_name) as n from members where address<>'' group by all having count(distinct last_name)>1")
def multi_last(spark, sf_dir):
    m = members(spark, sf_dir).where("address <> ''")
    return m.groupBy("address", "zip").agg(F.count_distinct("last_name").alias("n")).where("n > 1")


@query("timeline", f"{WITH} select identity, TRANSACTION_DT, EMPLOYER, cast(row_number() over (partition by identity order by TRANSACTION_DT, id) as int) as step from members")
def timeline(spark, sf_dir):
    return K.timeline(members(spark, sf_dir), "identity", "TRANSACTION_DT", "EMPLOYER")


def moves_sql(source, person, when, what, order="id"):
    return f"moves as (select {person} as person, {what} as a, lead({what}) over (partition by {person} order by {when}, {order}) as b from {source} where coalesce({what},'')<>'')"


EDGES = "edges as (select least(a,b) as a, greatest(a,b) as b, 2*count(*) as weight from moves where b is not null and a<>b group by 1, 2)"
EVENT_MOVES = moves_sql("events", "user_id", "ts", "event_type", "event_id")


def event_edges(spark, sf_dir):
    return A.transition_edges(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


def employer_edges(spark, sf_dir, *by):
    return A.transition_edges(members(spark, sf_dir), "identity", "TRANSACTION_DT", "EMPLOYER")


@query("transition_edges", f"{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'EMPLOYER')}, {EDGES} select * from edges")
def transition_edges(spark, sf_dir):
    return employer_edges(spark, sf_dir)


@query("event_transitions", f"with {EVENT_MOVES}, {EDGES} select * from edges")
def event_transitions(spark, sf_dir):
    return event_edges(spark, sf_dir)


@query("transition_directed", f"with {EVENT_MOVES} select a, b, count(*) as weight from moves where b is not null group by a, b")
def transition_directed(spark, sf_dir):
    return A.directed_edges(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


PV = f"pv as (select identity as p, EMPLOYER as v, count(*) as n from members where EMPLOYER<>'' group by all)"


@query("cooccur_base", f"{WITH}, {PV} select x.v as a, y.v as b, cast(sum(x.n) as bigint) as weight from pv x join pv y on x.p=y.p and x.v<>y.v group by all")
def cooccur_base(spark, sf_dir):
    return A.cooccurrence(members(spark, sf_dir), "identity", "EMPLOYER")


ZIPS = "zp as (select distinct NAME as p, zip as v from members where zip<>'')"


@query("migration_edges", f"{WITH}, {ZIPS} select x.v as a, y.v as b, count(*) as weight from zp x join zp y on x.p=y.p group by all")
def migration_edges(spark, sf_dir):
    return A.migrations(members(spark, sf_dir), "NAME", "zip")[0]


@query("migration_nodes", f"{WITH}, {ZIPS}, s as (select p, count(*)-1 as o from zp group by p) select v as node, cast(sum(o) as bigint) as score from zp join s using (p) group by v")
def migration_nodes(spark, sf_dir):
    return A.migrations(members(spark, sf_dir), "NAME", "zip")[1]


@query("cooccur_sets", f"{WITH}, s as (select distinct identity, OCCUPATION as v from members where OCCUPATION<>'' and not regexp_matches(OCCUPATION, '[ .,|\\\\/\\-\\t]')) select identity, string_agg(v, '|' order by v) as line from s group by identity having count(*)>1")
def cooccur_sets(spark, sf_dir):
    return A.cooccurrence_sets(members(spark, sf_dir), "identity", "OCCUPATION", T.single_word(F.col("OCCUPATION")))


@query("party_lookup", f"{WITH}, {COMMITTEES} select m.id, c.CMTE_PTY_AFFILIATION as party from members m left join committees c on m.CMTE_ID=c.CMTE_ID")
def party_lookup(spark, sf_dir):
    c = committees(spark, sf_dir).selectExpr("CMTE_ID", "CMTE_PTY_AFFILIATION party")
    return members(spark, sf_dir).join(c, "CMTE_ID", "left").select("id", "party")


NODES = """select EMPLOYER as node, count(*) as score, sqrt(count(*)) as size, round(coalesce(sum(case when party='DEM' then TRANSACTION_AMT end),0),2) as dem,
 round(coalesce(sum(case when party='REP' then TRANSACTION_AMT end),0),2) as rep, round(coalesce(sum(case when party='OTH' then TRANSACTION_AMT end),0),2) as oth
 from (select m.*, c.CMTE_PTY_AFFILIATION as party from members m left join committees c on m.CMTE_ID=c.CMTE_ID) x where EMPLOYER<>'' group by EMPLOYER"""


@query("party_amount", f"{WITH}, {COMMITTEES}, n as ({NODES}) select node, dem, rep, oth from n")
def party_amount(spark, sf_dir):
    return A.nodes(members(spark, sf_dir), "EMPLOYER", committees(spark, sf_dir)).select("node", "dem", "rep", "oth")


@query("aff_nodes", f"{WITH}, {COMMITTEES}, n as ({NODES}) select node, score, size from n")
def aff_nodes(spark, sf_dir):
    return A.nodes(members(spark, sf_dir), "EMPLOYER", committees(spark, sf_dir)).select("node", "score", "size")


@query("combine_edges", f"{WITH}, mv as (select STATE, EMPLOYER as a, lead(EMPLOYER) over (partition by identity order by TRANSACTION_DT, id) as b from members where EMPLOYER<>''), st as (select STATE, least(a,b) as a, greatest(a,b) as b, 2*count(*) as weight from mv where b is not null and a<>b group by 1, 2, 3) select a, b, cast(sum(weight) as bigint) as weight from st group by a, b")
def combine_edges(spark, sf_dir):
    moves = A.transitions(members(spark, sf_dir), "identity", "TRANSACTION_DT", "EMPLOYER").where("a <> b").withColumn("STATE", F.split("identity", r"\|")[0])
    per_state = moves.groupBy("STATE", *G.ordered_pair("a", "b")).agg((2 * F.count("*")).alias("weight"))
    return A.combined(per_state)


STRENGTH = "strength as (select node, sum(weight) as k from (select a as node, weight from edges union all select b, weight from edges) x group by node)"


@query("strength", f"with {EVENT_MOVES}, {EDGES}, {STRENGTH} select node, cast(k as bigint) as strength from strength")
def strength(spark, sf_dir):
    return A.strength(event_edges(spark, sf_dir))


def sig_sql(source):
    """CTEs from ``source`` (a, b, weight, q, p) to ``sig``: the tail is summed in logarithms."""
    return f"""term as (select *, list_transform(range(cast(weight as bigint), cast(q as bigint)+1), lambda i: lgamma(q+1)-lgamma(i+1)-lgamma(q-i+1)+i*ln(p)+(q-i)*ln(1-p)) as ts from {source}),
top as (select *, list_max(ts) as mx from term), sig as (select a, b, weight, round(-(mx + ln(list_sum(list_transform(ts, lambda t: exp(t-mx))))), 4) as significance from top)"""


MLF = f"""tot as (select sum(k)/2.0 as q from strength),
ep as (select e.a, e.b, e.weight, t.q, cast(x.k as double)*y.k/t.q/t.q/2 as p from edges e join strength x on e.a=x.node join strength y on e.b=y.node, tot t),
{sig_sql('ep')}"""


@query("significance", f"with {EVENT_MOVES}, {EDGES}, {STRENGTH}, {MLF} select * from sig")
def significance(spark, sf_dir):
    return A.significance(event_edges(spark, sf_dir)).select("a", "b", "weight", F.round("significance", 4).alias("significance"))


HAND = [("A", "B", 6), ("A", "C", 2), ("B", "C", 2), ("C", "D", 8)]
HAND_SQL = "edges as (select * from (values {}) v(a, b, weight))".format(", ".join(f"('{a}','{b}',{w})" for a, b, w in HAND))


@query("mlf_pvalue", f"with {HAND_SQL}, {STRENGTH}, {MLF} select a, b, cast(weight as bigint) as weight, significance from sig")
def mlf_pvalue(spark, sf_dir):
    return A.significance(spark.createDataFrame(HAND, "a string, b string, weight long")).select("a", "b", "weight", F.round("significance", 4).alias("significance"))


@query("mlf_directed", f"""with {EVENT_MOVES}, e as (select a, b, count(*) as weight from moves where b is not null group by a, b), ku as (select a, sum(weight) as k from e group by a), kv as (select b, sum(weight) as k from e group by b),
tot as (select sum(weight) as q from e), ep as (select e.*, cast(t.q as double) as q, cast(ku.k as double)*kv.k/t.q/t.q as p from e join ku on e.a=ku.a join kv on e.b=kv.b, tot t), {sig_sql('ep')} select a, b, weight, significance from sig""")
def mlf_directed(spark, sf_dir):
    edges = A.directed_edges(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")
    return A.directed_significance(edges).select("a", "b", "weight", F.round("significance", 4).alias("significance"))


PRUNED = "least_w as (select weight as lw from edges order by weight limit 1 offset (select cast(count(*) - count(*) * {0} // 100 as bigint) from edges))"


@query("prune_percent", f"{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'EMPLOYER')}, {EDGES}, {PRUNED.format(25)} select edges.* from edges, least_w where weight>=lw")
def prune_percent(spark, sf_dir):
    return A.pruned_percent(employer_edges(spark, sf_dir), "weight", 25)


@query("prune_count", f"{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'EMPLOYER')}, {EDGES} select a, b, weight from (select *, row_number() over (order by weight, a, b) as r from edges) x where r>5")
def prune_count(spark, sf_dir):
    return A.pruned_count(employer_edges(spark, sf_dir), "weight", 5).select("a", "b", "weight")


@query("edge_threshold", f"{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'EMPLOYER')}, {EDGES} select a, b, weight from edges where weight>=10")
def edge_threshold(spark, sf_dir):
    return employer_edges(spark, sf_dir).where("weight >= 10")


@query("lowest_edges", f"{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'EMPLOYER')}, {EDGES} select a, b, weight from edges order by weight, a, b limit 10")
def lowest_edges(spark, sf_dir):
    return employer_edges(spark, sf_dir).orderBy("weight", "a", "b").limit(10)


@query("aff_lookup", f"{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'EMPLOYER')}, {EDGES}, e as (select distinct EMPLOYER as s from members where EMPLOYER<>'') select x.s as a, y.s as b, edges.weight from e x join e y on x.s<y.s left join edges on edges.a=x.s and edges.b=y.s")
def aff_lookup(spark, sf_dir):
    m = members(spark, sf_dir)
    e = m.where("EMPLOYER <> ''").select("EMPLOYER").distinct()
    pairs = e.selectExpr("EMPLOYER a").join(e.selectExpr("EMPLOYER b"), F.col("a") < F.col("b"))
    return pairs.join(employer_edges(spark, sf_dir), ["a", "b"], "left").select("a", "b", "weight")


@query("rescale", f"with {EVENT_MOVES}, {EDGES} select a, b, round(1 + 9 * (weight - min(weight) over ()) / cast(nullif(max(weight) over () - min(weight) over (), 0) as double), 6) as width from edges")
def rescale(spark, sf_dir):
    e = event_edges(spark, sf_dir)
    ends = e.agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    return e.join(F.broadcast(ends)).select("a", "b", F.round(1 + 9 * (F.col("weight") - F.col("low")) / F.expr("nullif(high - low, 0)"), 6).alias("width"))


@query("top_identifiers", f"""{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'EMPLOYER')}, {EDGES}, n as (select EMPLOYER as node, count(*) as size from members where EMPLOYER<>'' group by 1),
top as (select node from n order by size desc, node limit 4), s as (select a, b from edges union all select b, a from edges)
select node, neighbour, cast(r as int) as rank from (select s.a as node, s.b as neighbour, row_number() over (partition by s.a order by n.size, s.b) as r from s join top on s.a=top.node join n on n.node=s.b) x where r<=20""")
def top_identifiers(spark, sf_dir):
    n = members(spark, sf_dir).where("EMPLOYER <> ''").groupBy(F.col("EMPLOYER").alias("node")).agg(F.count("*").alias("size"))
    return G.top_neighbours(n, employer_edges(spark, sf_dir), 4, 20)


SPARSE = "sparse as (select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_partkey<>l_suppkey)"


def sparse(spark, sf_dir):
    """Edges between the part and supplier numbers of all orders."""
    li = table(spark, sf_dir, "lineitem").where("l_partkey <> l_suppkey")
    return li.selectExpr("least(l_partkey, l_suppkey) a", "greatest(l_partkey, l_suppkey) b").distinct()




@query("components", f"with recursive {SPARSE}, sym as (select a, b from sparse union select b, a from sparse), reach(node, seen) as (select a, a from sym union select reach.node, s.b from reach join sym s on reach.seen=s.a and s.b<reach.node), low as (select node, min(seen) as m from reach group by node), full_reach(node, seen) as (select a, a from sym union select f.node, s.b from full_reach f join sym s on f.seen=s.a) select node, min(seen) as component from full_reach group by node")
def components(spark, sf_dir):
    return G.components(sparse(spark, sf_dir))


@query("khop", f"with {SPARSE}, sym as (select a, b from sparse union select b, a from sparse), h1 as (select distinct b as node from sym where a=1), h2 as (select distinct s.b as node from h1 join sym s on s.a=h1.node), u as (select 1 as node, 0 as hop union all select node, 1 from h1 union all select node, 2 from h2) select node, cast(min(hop) as int) as hop from u group by node")
def khop(spark, sf_dir):
    return G.neighbourhood(sparse(spark, sf_dir), spark.range(1, 2).selectExpr("id node"), 1)


LABEL = """l{1} as (select a as node, label from (select s.a, l.label, row_number() over (partition by s.a order by sum(s.weight) desc, l.label) as r from sym s join l{0} l on l.node=s.b group by s.a, l.label) x where r=1)"""


@query("communities", f"{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'OCCUPATION')}, {EDGES}, sym as (select a, b, weight from edges union all select b, a, weight from edges), l0 as (select distinct a as node, a as label from sym), {', '.join(LABEL.format(i, i + 1) for i in range(5))} select node, label from l5")
def communities(spark, sf_dir):
    return G.communities(A.transition_edges(members(spark, sf_dir), "identity", "TRANSACTION_DT", "OCCUPATION"))


@query("collapse", f"{WITH}, n as (select EMPLOYER as node, EMPLOYER as label, count(*) as size from members where EMPLOYER<>'' group by 1), g as (select node, label, size, substr(node, 1, 1) as grp from n) select grp as \"group\", cast(sum(size) as bigint) as size, string_agg(label, '|' order by label) as labels, (array_agg(label order by size desc, label desc))[1] as main, min(node) as first from g group by grp")
def collapse(spark, sf_dir):
    n = members(spark, sf_dir).where("EMPLOYER <> ''").groupBy(F.col("EMPLOYER").alias("node")).agg(F.count("*").alias("size")).withColumn("label", F.col("node"))
    return G.collapsed(n, n.select("node", F.substring("node", 1, 1).alias("group")))


@query("aff_graph", f"{WITH}, ind as (select * from members where ENTITY_TP='IND' and address<>''), {moves_sql('ind', 'concat(STATE,address,last_name)', 'TRANSACTION_DT', 'EMPLOYER')}, {EDGES}, {STRENGTH}, {MLF} select * from sig")
def aff_graph(spark, sf_dir):
    """The graph before stage 1: everyone of a last name at an address is one person."""
    ind = members(spark, sf_dir).where("ENTITY_TP = 'IND' and address <> ''").withColumn("person", F.concat("STATE", "address", "last_name"))
    edges = A.transition_edges(ind, "person", "TRANSACTION_DT", "EMPLOYER")
    return A.significance(edges).select("a", "b", "weight", F.round("significance", 4).alias("significance"))


@query("aff_graph_post", f"{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'OCCUPATION')}, {EDGES}, {STRENGTH}, {MLF} select * from sig")
def aff_graph_post(spark, sf_dir):
    """The graph after stage 1, over its identities."""
    edges = A.transition_edges(members(spark, sf_dir), "identity", "TRANSACTION_DT", "OCCUPATION")
    return A.significance(edges).select("a", "b", "weight", F.round("significance", 4).alias("significance"))


@query("balance_partitions")
def balance_partitions(spark, sf_dir):
    """Components packed onto eight partitions of about equal size."""
    sizes = G.components(sparse(spark, sf_dir)).groupBy(F.col("component").alias("item")).agg(F.count("*").alias("size"))
    return G.balanced(sizes, 8).join(sizes, "item").groupBy("part").agg(F.count("*").alias("n_items"), F.sum("size").alias("size"))


@query("bad_share", f"{WITH} select STATE, count(*) as n, cast(sum(case when {bad_sql(T.BAD_EMPLOYER).replace('s =', 'EMPLOYER =').replace('regexp_matches(s,', 'regexp_matches(EMPLOYER,')} then 1 else 0 end) as bigint) as n_bad from members group by STATE")
def bad_share(spark, sf_dir):
    m = members(spark, sf_dir)
    return m.groupBy("STATE").agg(F.count("*").alias("n"), F.sum(T.bad_employer(F.col("EMPLOYER")).cast("long")).alias("n_bad"))
