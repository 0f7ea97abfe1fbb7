"""Queries over candidate pairs, comparisons and identities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.cluster import written
from kindred.functions import text as T
from kindred.operators import affiliation as A
from kindred.operators import compare as C
from kindred.operators import graph as G
from kindred.operators import identity as I
from kindred.operators import lsh as L
from kindred.operators import stages as S
from kindred.operators import tokens as K
from kindred.plans.graph_queries import DOM, FIELD_TOK, NAME_TOK, PERSON_TOK, WITH, members
from kindred.plans.registry import query
from kindred.plans.scalar_queries import bad_sql, sorted_sql, tokens_sql
from kindred.sources.bridge import KNOWN, VARIANTS, contrib, known_names, table, variants



SEARCH = S.Search()
BITS, ROUNDS = SEARCH.bits, SEARCH.rounds


# --- hashes and neighbours


def spread(spark, sf_dir):
    """The members' fields, parsed by as many tasks as there are shuffle partitions, however small the joined tables are."""
    return K.normalised(contrib(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"))


def vectors(spark, sf_dir):
    m = spread(spark, sf_dir)
    return K.vectors(m, F.concat(K.name_tokens(), K.field_tokens())).select("id", F.transform("tokens", lambda t: F.concat_ws(":", t["type"].cast("string"), t["tok"])).alias("tokens"))


def hashed(spark, sf_dir):
    """Hashes of all records, written once: several passes in other orders follow."""
    return written(L.hashes(written(vectors(spark, sf_dir), "vectors"), BITS).join(contrib(spark, sf_dir).select("id", "STATE", "NAME"), "id"), "hashes")


VEC = f"{NAME_TOK}, {FIELD_TOK}, vec as (select distinct id, concat(type,':',tok) as t from (select id, type, tok from name_tok union all select id, type, tok from field_tok) x)"
HASH = f"""{VEC}, bit as (select t, unnest(range(0, {BITS})) as k from (select distinct t from vec) x), probe as (select t, k, case when substr(md5(concat(k//32,':',t)),cast(k%32+1 as int),1)>='8' then 1 else -1 end as s from bit),
sums as (select id, k, sum(s) as s from vec join probe using (t) group by id, k), hashed as (select id, STATE, NAME, string_agg(case when s>0 then '1' else '0' end, '' order by k) as hash from sums join members using (id) group by all)"""


def next_sql(source, order, n, by="STATE", out="nb"):
    return f"{out}_r as (select *, row_number() over (partition by {by} order by {order}, id) as rn from {source}), {out} as (select x.{by}, least(x.id,y.id) as a, greatest(x.id,y.id) as b from {out}_r x join {out}_r y on x.{by}=y.{by} and y.rn between x.rn+1 and x.rn+{n})"


@query("inner_product", f"{WITH}, {HASH} select id, k, cast(s as bigint) as s from sums")
def inner_product(spark, sf_dir):
    return L.inner_products(written(vectors(spark, sf_dir), "vectors"), BITS)


@query("srp_hash", f"{WITH}, {HASH} select id, hash from hashed")
def srp_hash(spark, sf_dir):
    return hashed(spark, sf_dir).select("id", "hash")


@query("srp_dense", "with p as (select k, i, case when substr(md5(concat(k//32,':',i)),cast(k%32+1 as int),1)>='8' then 1 else -1 end as s from range(0,8) a(k), range(0,64) b(i)), e as (select vec_id as id, unnest(range(0,64)) as i, unnest(embedding) as x from embeddings), s as (select id, k, sum(cast(x as double)*s) as v from e join p using (i) group by id, k) select id, string_agg(case when v>0 then '1' else '0' end, '' order by k) as hash from s group by id")
def srp_dense(spark, sf_dir):
    return L.dense_hashes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, 64)


def perm_sql(r, h="hash"):
    return "concat(" + ", ".join(f"substr({h},{i},1)" for i in L.permutation(BITS, r)) + ")"


@query("bit_permute", f"{WITH}, {HASH} select id, {perm_sql(3)} as hash from hashed")
def bit_permute(spark, sf_dir):
    return hashed(spark, sf_dir).select("id", L.permuted(F.col("hash"), BITS, 3).alias("hash"))


@query("neighbours", f"{WITH}, {HASH}, {next_sql('hashed', 'hash', SEARCH.near)} select STATE, a, b from nb")
def neighbours(spark, sf_dir):
    return L.neighbours(hashed(spark, sf_dir), ["hash"], SEARCH.near, ["STATE"])


@query("name_neighbours", f"{WITH}, {next_sql('members', 'NAME', SEARCH.near_names)} select STATE, a, b from nb")
def name_neighbours(spark, sf_dir):
    return L.neighbours(members(spark, sf_dir), ["NAME"], SEARCH.near_names, ["STATE"])


@query("nat_neighbours", f"{WITH}, {HASH}, h as (select *, 1 as one from hashed), {next_sql('h', 'hash', SEARCH.national_near, 'one')} select a, b from nb")
def nat_neighbours(spark, sf_dir):
    """Neighbours over one order of all states."""
    return L.neighbours(hashed(spark, sf_dir), ["hash"], SEARCH.national_near, [])


RUNS = "rr as (select *, case when hash=lag(hash) over (partition by STATE order by id) then 0 else 1 end as nw from hashed), rg as (select *, sum(nw) over (partition by STATE order by id rows unbounded preceding) as run from rr), rf as (select STATE, run, min(id) as a from rg group by all having count(*)>1), runs as (select rf.a, rg.id as b from rg join rf using (STATE, run) where rg.id>rf.a)"


@query("hash_runs", f"{WITH}, {HASH}, {RUNS} select a, b from runs")
def hash_runs(spark, sf_dir):
    return L.hash_runs(hashed(spark, sf_dir), "hash", ["STATE"])


CAND = ", ".join(f"p{r} as (select id, STATE, {perm_sql(r)} as h from hashed), {next_sql(f'p{r}', 'h', SEARCH.near, out=f'n{r}')}" for r in range(ROUNDS))
CAND += ", cand as (select a, b, count(*) as count from (" + " union all ".join(f"select a, b from n{r}" for r in range(ROUNDS)) + ") x group by a, b)"
NAT = ", ".join(f"p{r} as (select id, 1 as one, {perm_sql(r)} as h from hashed), {next_sql(f'p{r}', 'h', SEARCH.national_near, 'one', out=f'n{r}')}" for r in range(SEARCH.national_rounds))
NAT += ", cand as (select a, b, count(*) as count from (" + " union all ".join(f"select a, b from n{r}" for r in range(SEARCH.national_rounds)) + ") x group by a, b)"
IDP = "idn as (select id, concat(STATE,'|',NAME) as identity from members), idp as (select least(x.identity,y.identity) as identity1, greatest(x.identity,y.identity) as identity2, cast(sum(count) as bigint) as count from cand join idn x on x.id=cand.a join idn y on y.id=cand.b where x.identity<>y.identity group by 1, 2)"


def national(spark, sf_dir, least=1, most=None):
    """Pairs of identities that are neighbours over all states."""
    return L.identity_neighbours(hashed(spark, sf_dir), BITS, SEARCH.national_rounds, SEARCH.national_near, members(spark, sf_dir).select("id", "identity"), least, most)


@query("candidate_pairs", f"{WITH}, {HASH}, {CAND} select a, b, count from cand where count>1")
def candidate_pairs(spark, sf_dir):
    return L.candidate_pairs(hashed(spark, sf_dir), BITS, ROUNDS, SEARCH.near, ["STATE"], 1)


@query("nat_pairs", f"{WITH}, {HASH}, {NAT}, {IDP} select * from idp where count>1")
def nat_pairs(spark, sf_dir):
    return national(spark, sf_dir)


@query("identity_pair_weight", f"{WITH}, {HASH}, {NAT}, {IDP} select * from idp where count>2")
def identity_pair_weight(spark, sf_dir):
    return national(spark, sf_dir, 2)


@query("candidate_topn", f"{WITH}, {HASH}, {NAT}, {IDP} select * from idp where count>1 order by count desc, identity1, identity2 limit 100")
def candidate_topn(spark, sf_dir):
    return L.top_pairs(national(spark, sf_dir, most=100), 100)


@query("stage1_pairs", f"{WITH}, {HASH}, {CAND}, {RUNS}, {next_sql('members', 'NAME', SEARCH.near_names)} select a, b from cand union select a, b from runs union select a, b from nb")
def stage1_pairs(spark, sf_dir):
    """What stage 1 compares: runs of equal hashes, neighbours in name order and in the order of permuted hashes."""
    return L.all_candidates(hashed(spark, sf_dir), BITS, ROUNDS, SEARCH.near, members(spark, sf_dir), SEARCH.near_names, ["STATE"])


# --- comparisons

FIELDS = {"last": "last_name", "middle": "middle_name", "first": "first_name", "employer": "EMPLOYER", "occupation": "OCCUPATION", "address": "address", "zip": "zip", "city": "CITY", "state": "STATE"}
PAIR = "pr as (select nb.a, nb.b, " + ", ".join(f"x.{v} as {k}1, y.{v} as {k}2" for k, v in FIELDS.items()) + " from nb join members x on x.id=nb.a join members y on y.id=nb.b)"
LOOK = f"""cnt as (select type, tok, count(*) as cnt from name_tok group by type, tok),
emp_m as (select identity as person, EMPLOYER as a, lead(EMPLOYER) over (partition by identity order by TRANSACTION_DT, id) as b from members where EMPLOYER<>''),
emp_e as (select distinct least(a,b) as a, greatest(a,b) as b from emp_m where b is not null and a<>b),
occ_m as (select identity as person, OCCUPATION as a, lead(OCCUPATION) over (partition by identity order by TRANSACTION_DT, id) as b from members where OCCUPATION<>''),
occ_e as (select distinct least(a,b) as a, greatest(a,b) as b from occ_m where b is not null and a<>b),
lk as (select pr.*, coalesce(l1.cnt,0) as last_freq1, coalesce(l2.cnt,0) as last_freq2, coalesce(f1.cnt,0) as first_freq1, coalesce(f2.cnt,0) as first_freq2,
 exists(select 1 from known_names k where k.name=first1) as known1, exists(select 1 from known_names k where k.name=first2) as known2,
 exists(select 1 from variants v where v.name=first1 and v.variant=first2) as variant, ee.a is not null as employer_edge, oe.a is not null as occupation_edge
 from pr left join cnt l1 on l1.type=1 and l1.tok=last1 left join cnt l2 on l2.type=1 and l2.tok=last2 left join cnt f1 on f1.type=2 and f1.tok=first1 left join cnt f2 on f2.type=2 and f2.tok=first2
 left join emp_e ee on ee.a=least(employer1,employer2) and ee.b=greatest(employer1,employer2) left join occ_e oe on oe.a=least(occupation1,occupation2) and oe.b=greatest(occupation1,occupation2))"""


def names_sql(strict=False):
    both = "(middle1<>'' and middle2<>'')"
    full = "(length(middle1)>1 and length(middle2)>1)"
    best = f"(case when {both}{f' and not {full}' if strict else ''} then 4 else 3 end)"
    so_far = f"(case when levenshtein(last1,last2)=0 or last_freq1<=2 or last_freq2<=2 then {best} else 2 end)"
    initial = "(length(first1)=1 or length(first2)=1)"
    return f"""case when {both} and (substr(middle1,1,1)<>substr(middle2,1,1) or ({full} and middle1<>middle2)) then -1000
 when last1='' or last2='' then 1 when levenshtein(last1,last2)>=3 then 0 when first1=first2 then {so_far} when variant then {best} when known1 and known2 then 0
 when {initial} and (first1='' or first2='') then {so_far} when {initial} then case when substr(first1,1,1)=substr(first2,1,1) then 2 else 0 end
 when levenshtein(first1,first2)<2 then case when first_freq1<=2 or first_freq2<=2 then {so_far} else 2 end else 0 end"""


def near_sql(x, y, tol):
    return f"(levenshtein({x},{y}) < greatest(length({x}),length({y}))*cast({tol} as double))"


def aff_sql(own, other, pattern, tol, permuted):
    x, y, ox, oy = f"{own}1", f"{own}2", f"{other}1", f"{other}2"
    bx, by = (bad_sql(pattern).replace("s =", f"{v} =").replace("regexp_matches(s,", f"regexp_matches({v},") for v in (x, y))
    common = f"list_intersect({tokens_sql(x)}, {tokens_sql(y)})"
    perm = f" or len({common})>=2 or (len({common})=1 and length({common}[1])>=6)" if permuted else ""
    return f"""case when {bx} and {by} and {x}={y} then 2 when {bx} or {by} then 1 when {x}={y} then 4 when {own}_edge then 3
 when {near_sql(x, y, tol)}{perm} or {x}={oy} or {y}={ox} or ({oy}<>'' and {near_sql(x, oy, tol)}) or ({ox}<>'' and {near_sql(y, ox, tol)}) then 3 else 0 end"""


EMP_SQL, OCC_SQL = aff_sql("employer", "occupation", T.BAD_EMPLOYER, 0.3, True), aff_sql("occupation", "employer", T.BAD_OCCUPATION, 0.2, False)
ZIP_SQL = "case when zip1='' or zip2='' then 1 when zip1=zip2 then 2 else 0 end"


def context_sql(strict=False):
    diff = "'addressN_zipY'" if strict else "case when z=2 then 'addressN_zipY' else 'addressN_zipN' end"
    return f"case when state1<>state2 then 'stateN' when city1=city2 or z=2 then case when address1<>'' and address2<>'' then case when address1=address2 then 'addressY' else {diff} end when z=2 then 'addressNA_zipY' else 'addressNA_zipN' end else 'cityN' end"


RULES_SQL = {
    "addressY": "n>=2 and (e>=2 or o>=2)", "addressN_zipY": "n>=3 and (e>=3 or o>=3)", "addressN_zipN": "n>=3 and e>=3 and o>=3", "addressNA_zipY": "n>=3 and (e>=1 or o>=1)",
    "addressNA_zipN": "n>=3 and e>=3 and o>=3", "cityN": "n>=3 and ((e>=3 and o>=3) or o=4 or e=4)", "stateN": "n>=3 and (e>=3 or o>=3)",
}
NATIONAL_SQL = RULES_SQL | {
    "addressN_zipY": "(n=3 and (e>=3 or o>=3)) or (n=4 and (e>=2 or o>=2))", "addressNA_zipN": "(n=3 and e>=3 and o>=3) or (n=4 and (e>=2 or o>=2))",
    "cityN": "n>=3 and ((e>=3 and o>=3) or o=4 or e=4 or (e=2 and o>=3) or (o=2 and e>=3))", "stateN": "(n=4 and ((e=2 and o>=3) or (o=2 and e>=3))) or (n>=3 and e>=3 and o>=3)",
}


def compared_sql(rules=RULES_SQL, strict=False):
    rule = " ".join(f"when context='{k}' then ({v})" for k, v in rules.items())
    return f"""codes as (select *, {names_sql(strict)} as n, {EMP_SQL} as e, {OCC_SQL} as o, {ZIP_SQL} as z from lk),
ctx as (select *, {context_sql(strict)} as context from codes), cmp as (select *, case when n=-1000 and context<>'addressY' then -1000 when (case {rule} end) then 1 else 0 end as verdict from ctx)"""


NB = next_sql("members", "NAME", 5)
PAIRS = f"{WITH}, {NAME_TOK}, {VARIANTS}, {KNOWN}, {NB}, {PAIR}, {LOOK}"


def looked_up(spark, sf_dir):
    m = written(members(spark, sf_dir), "members")
    pairs = C.pairs_of(m, L.neighbours(m, ["NAME"], 5, ["STATE"]).select("a", "b"), FIELDS)
    e, o = (A.transition_edges(m, "identity", "TRANSACTION_DT", f).withColumn("significance", F.lit(1.0)) for f in ("EMPLOYER", "OCCUPATION"))
    return C.with_lookups(pairs, K.token_counts(m, K.name_tokens()), variants(spark), known_names(spark), e, o)


def coded(name, sql, column):
    @query(name, f"{PAIRS} select a, b, cast({sql} as int) as code from lk")
    def run(spark, sf_dir):
        return looked_up(spark, sf_dir).select("a", "b", column().cast("int").alias("code"))

    return run


coded("compare_names", names_sql(), C.names)
coded("compare_names_strict", names_sql(True), lambda: C.names(strict=True))
coded("compare_employers", EMP_SQL, C.employers)
coded("compare_occupations", OCC_SQL, C.occupations)
coded("compare_zip", ZIP_SQL, C.zip_code)
STRICT_NAMES = f"""((middle1='' and middle2='') or (middle1<>'' and (middle2='' or middle1=middle2))) and last1<>'' and last2<>'' and levenshtein({sorted_sql('last1')},{sorted_sql('last2')})<=2
 and (levenshtein(array_to_string(string_split(first1,''),' '), array_to_string(string_split(first2,''),' '))<=1 or variant)"""
coded("compare_strict_address", f"address1<>'' and address2<>'' and address1=address2 and {STRICT_NAMES}", C.strict_address)
coded("compare_strict_affiliation", f"employer1=employer2 and occupation1=occupation2 and employer1<>'' and occupation1<>'' and {STRICT_NAMES}", C.strict_affiliation)


def thorough(name, rules, method, strict=False):
    @query(name, f"{PAIRS}, {compared_sql(rules, strict)} select a, b, cast(n as int) as n, cast(e as int) as e, cast(o as int) as o, context, cast(verdict as int) as verdict from cmp")
    def run(spark, sf_dir):
        return C.compared(looked_up(spark, sf_dir), method, strict).select("a", "b", "n", "e", "o", "context", "verdict")

    return run


thorough("compare_thorough", RULES_SQL, None)
thorough("compare_thorough_strict", RULES_SQL, None, True)
thorough("compare_national", NATIONAL_SQL, "national")

GRID = "grid as (select n, e, o from (values (-1000),(0),(1),(2),(3),(4)) a(n), range(0,5) b(e), range(0,5) c(o))"


def method_sql(m):
    k = int(m) if m.isdigit() else 0
    r = dict(NATIONAL_SQL if m == "national" else RULES_SQL)
    if k:
        r["cityN"] = "n>=3 and e>=3 and o>=3"
        r["addressNA_zipY"] = "n>=3 and (e>=3 or o>=3)" if k % 2 else "n>=3 and (e>=2 or o>=1)"
    if 1 <= k <= 4:
        r["addressN_zipY"] = "n>=3 and e>=3 and o>=3"
    if k in (1, 2, 5, 6):
        r["addressN_zipN"] = "n>=3 and e>=4 and o>=4"
    return r


METHODS = ["thorough", "national", *"12345678"]


@query("verdict_table", f"with {GRID} " + " union all ".join(f"select '{m}' as method, '{k}' as context, n, cast(e as int) as e, cast(o as int) as o, ({v}) as verdict from grid" for m in METHODS for k, v in method_sql(m).items()))
def verdict_table(spark, sf_dir):
    grid = spark.createDataFrame([(n, e, o) for n in (-1000, 0, 1, 2, 3, 4) for e in range(5) for o in range(5)], "n int, e int, o int")
    each = []
    for m in METHODS:
        rules = C.verdicts(F.col("n"), F.col("e"), F.col("o"), None if m == "thorough" else m)
        each += [F.struct(F.lit(m).alias("method"), F.lit(k).alias("context"), v.alias("verdict")) for k, v in rules.items()]
    return grid.select("n", "e", "o", F.explode(F.array(*each)).alias("x")).select("x.method", "x.context", "n", "e", "o", "x.verdict")


@query("near_misses", f"{PAIRS}, {compared_sql()} select a, b, cast(n as int) as n, cast(e as int) as e, cast(o as int) as o from cmp where verdict=0 and n>1 and e>1 and o>1")
def near_misses(spark, sf_dir):
    return C.compared(looked_up(spark, sf_dir)).where("verdict = 0 and n > 1 and e > 1 and o > 1").select("a", "b", "n", "e", "o")


@query("name_pvalue", f"{WITH}, {NAME_TOK}, c as (select type, tok, count(*) as cnt from name_tok group by all) select id, last_name, round(coalesce(c.cnt,0) / cast((select count(*) from c) as double), 9) as p from members left join c on c.type=1 and c.tok=last_name")
def name_pvalue(spark, sf_dir):
    m = members(spark, sf_dir)
    counts = K.token_counts(m, K.name_tokens())
    n = counts.agg(F.count("*").alias("distinct"))
    return K.with_frequency(m, counts, K.LAST, "last_name", "f").join(F.broadcast(n)).select("id", "last_name", F.round(F.col("f") / F.col("distinct"), 9).alias("p"))


# --- people

BLOCK = f"""{WITH}, {VARIANTS}, who as (select STATE, address, last_name as last, middle_name as middle, first_name as first, min(id) as id from members where address<>'' group by all),
pr as (select x.id as a, y.id as b, x.last as last1, y.last as last2, x.middle as middle1, y.middle as middle2, x.first as first1, y.first as first2 from who x join who y on x.STATE=y.STATE and x.address=y.address and x.id<>y.id),
lk as (select *, exists(select 1 from variants v where v.name=first1 and v.variant=first2) as variant from pr), hit as (select a, b from lk where {STRICT_NAMES}),
sym as (select a, b from hit union select b, a from hit)"""
REACH = "walk(node, seen) as (select id, id from who union select w.node, s.b from walk w join sym s on w.seen=s.a), head as (select node, min(seen) as component from walk group by node)"


def same_address(spark, sf_dir):
    """Records, and matches of strictly equal addresses; records that agree in all compared fields meet once."""
    m = members(spark, sf_dir)
    who = m.where("address <> ''").groupBy("STATE", "address", "last_name", "middle_name", "first_name").agg(F.min("id").alias("id"))
    x = who.select("STATE", "address", F.col("id").alias("a"), *[F.col(f"{k}_name").alias(f"{k}1") for k in ("last", "middle", "first")])
    y = who.select("STATE", "address", F.col("id").alias("b"), *[F.col(f"{k}_name").alias(f"{k}2") for k in ("last", "middle", "first")])
    both = variants(spark).selectExpr("name first1", "variant first2", "true variant")
    pairs = x.join(y, ["STATE", "address"]).where("a <> b").join(both, ["first1", "first2"], "left").withColumn("variant", F.coalesce("variant", F.lit(False)))
    pairs = pairs.withColumns({"address1": F.col("address"), "address2": F.col("address")})
    return who, pairs.where(C.strict_address()).select("a", "b")


@query("people_per_state", BLOCK.replace("with ", "with recursive ", 1) + f", {REACH}, p as (select distinct STATE, component from who join head on head.node=who.id) select p.STATE, count(*) as people from p group by p.STATE")
def people_per_state(spark, sf_dir):
    """Distinct people with an address in every state, given strict same-address matching."""
    who, hits = same_address(spark, sf_dir)
    return I.stage1(who, hits).join(who.select("id", "STATE"), "id").groupBy("STATE").agg(F.count_distinct("component").alias("people"))


STAGE1 = PAIRS.replace("with ", "with recursive ", 1) + f", {compared_sql()}, hit as (select a, b from cmp where verdict=1), sym as (select a, b from hit union select b, a from hit), low(node, seen) as (select id, id from members union select w.node, s.b from low w join sym s on w.seen=s.a), comp as (select node as id, min(seen) as component from low group by node)"


def stage1(spark, sf_dir):
    m = written(members(spark, sf_dir), "members")
    e, o = (written(A.transition_edges(m, "identity", "TRANSACTION_DT", f).withColumn("significance", F.lit(1.0)), "edges") for f in ("EMPLOYER", "OCCUPATION"))
    counts = written(K.token_counts(m, K.name_tokens()), "counts")
    pairs = L.neighbours(m, ["NAME"], 5, ["STATE"]).select("a", "b")
    found = written(C.compared_by_values(m, pairs, counts, variants(spark), known_names(spark), e, o), "compared")
    held = I.stage1(m, found.where("verdict = 1").select("a", "b")).join(m.select("id", "STATE", "last_name", "middle_name").hint("merge"), "id")
    return m, found, written(held, "components")


@query("stage1_components", f"{STAGE1} select * from comp")
def stage1_components(spark, sf_dir):
    return stage1(spark, sf_dir)[2].select("id", "component")


SPLIT = """mem as (select c.id, c.component, m.STATE, m.last_name, nullif(substr(m.middle_name,1,1),'') as ini from comp c join members m using (id)), sev as (select component from mem group by 1 having count(distinct ini)>1),
siz as (select component, ini, count(*) as size from mem semi join sev using (component) where ini is not null group by all), vs as (select a, b, verdict from cmp union all select b, a, verdict from cmp),
opt as (select o.id, s.ini, coalesce((select sum(v.verdict) from vs v join mem d on d.id=v.b where v.a=o.id and d.component=o.component and d.ini=s.ini),0)/cast(s.size as double) as mean from mem o join sev using (component) join siz s on s.component=o.component where o.ini is null),
best as (select id, ini from (select *, row_number() over (partition by id order by mean desc, ini) as r from opt) x where r=1),
split as (select m.id, m.component, m.STATE, m.last_name, case when sev.component is null then '' else coalesce(m.ini, best.ini) end as spawn from mem m left join sev on sev.component=m.component left join best on best.id=m.id)"""


@query("split_middle", f"{STAGE1}, {SPLIT} select id, component, spawn from split")
def split_middle(spark, sf_dir):
    _, found, comp = stage1(spark, sf_dir)
    return I.split_on_middle(comp.select("id", "component", "middle_name"), found)


LABEL = "heads as (select STATE, component, spawn, min(last_name) as fl, min(id) as fi from split group by all), lab as (select *, concat(STATE,'-',cast(row_number() over (partition by STATE order by fl, fi)-1 as varchar)) as identity from heads)"


@query("identity_label", f"{STAGE1}, {SPLIT}, {LABEL} select s.id, l.identity from split s join lab l using (STATE, component, spawn)")
def identity_label(spark, sf_dir):
    _, found, comp = stage1(spark, sf_dir)
    split = I.split_on_middle(comp.select("id", "component", "middle_name"), found).join(comp.select("id", "STATE", "last_name").hint("merge"), "id")
    return I.labelled(split, ["component", "spawn"])


ID17 = "ids as (select id, concat(STATE,'|',NAME) as identity from members)"


@query("full_adjacency", f"{WITH}, {ID17} select x.id as a, y.id as b from ids x join ids y on x.identity=y.identity and x.id<>y.id")
def full_adjacency(spark, sf_dir):
    return I.full_adjacency(members(spark, sf_dir).select("id", "identity"))


def lookups(spark):
    return S.Lookups(variants(spark), known_names(spark))


@query("stage1_identities")
def stage1_identities(spark, sf_dir):
    """Stage 1 end to end, with all constants; tested in tests/test_stages.py."""
    return S.identities(spread(spark, sf_dir), lookups(spark))


@query("stage2_verdicts")
def stage2_verdicts(spark, sf_dir):
    """Stage 2 end to end on stage 1's identities, with calibrated sets; tested in tests/test_stages.py."""
    m = written(spread(spark, sf_dir), "records")
    hashes = S.hashed(m, SEARCH)
    return S.stage2(m.join(S.identities(m, lookups(spark), hashes=hashes), "id"), lookups(spark), hashes=hashes)


# --- linked identities: pairs of customers with synthetic verdicts

ADJ = """adj0 as (select concat('P',c_custkey) as i1, concat('P',c_custkey+1+c_custkey % 4) as i2,
 case when c_custkey % 5=0 then -1 when c_custkey % 9 in (1,4,7) then 4 when c_custkey % 9 in (2,5) then 1 else 0 end as verdict from customer
 union all select concat('P',c_custkey), concat('P',c_custkey+2), case when c_custkey % 11=0 then -1 when c_custkey % 7 in (0,3,5) then 1 else 0 end from customer),
adj as (select least(i1,i2) as identity1, greatest(i1,i2) as identity2, max(verdict) as verdict from adj0 where i1<>i2 group by 1, 2)"""


def adjacency_(spark, sf_dir):
    """A table of verdicts on as many identities as there are customers, derived from their numbers."""
    c = table(spark, sf_dir, "customer")
    code = "case when c_custkey % 5 = 0 then -1 when c_custkey % 9 in (1, 4, 7) then 4 when c_custkey % 9 in (2, 5) then 1 else 0 end verdict"
    raw = c.selectExpr("concat('P', c_custkey) identity1", "concat('P', c_custkey + 1 + c_custkey % 4) identity2", code)
    more = c.selectExpr("concat('P', c_custkey) identity1", "concat('P', c_custkey + 2) identity2", "case when c_custkey % 11 = 0 then -1 when c_custkey % 7 in (0, 3, 5) then 1 else 0 end verdict")
    return I.adjacency(raw.union(more).where("identity1 <> identity2"))


POS = "pos as (select identity1 as a, identity2 as b from adj where verdict>=1), psym as (select a, b from pos union select b, a from pos), pw(node, seen) as (select a, a from psym union select p.node, s.b from pw p join psym s on p.seen=s.a), pc as (select node, min(seen) as component from pw group by node)"


@query("adjacency", f"with {ADJ} select * from adj")
def adjacency(spark, sf_dir):
    return adjacency_(spark, sf_dir)


@query("sym_adjacency", f"with {ADJ} select identity1, identity2, verdict from adj union all select identity2, identity1, verdict from adj")
def sym_adjacency(spark, sf_dir):
    a = adjacency_(spark, sf_dir)
    return a.union(a.select("identity2", "identity1", "verdict"))


@query("related_list", f"with {ADJ}, s as (select identity1, identity2 from adj union select identity2, identity1 from adj) select identity1, string_agg(distinct identity2, '|' order by identity2) as related from s group by identity1")
def related_list(spark, sf_dir):
    return I.related_list(sym_adjacency(spark, sf_dir)).select("identity1", F.array_join("related", "|").alias("related"))


@query("reachable", f"with recursive {ADJ}, {POS} select * from pc")
def reachable(spark, sf_dir):
    return I.reachable(adjacency_(spark, sf_dir))


@query("conflicts", f"with recursive {ADJ}, {POS} select x.component, count(*) as conflicts from adj join pc x on x.node=identity1 join pc y on y.node=identity2 where verdict=-1 and x.component=y.component group by 1")
def conflicts(spark, sf_dir):
    a = adjacency_(spark, sf_dir)
    return G.conflicts(I.reachable(a), a.where("verdict = -1").selectExpr("identity1 a", "identity2 b"))


@query("super_identities", f"with recursive {ADJ}, {POS}, cf as (select x.component, count(*) as k from adj join pc x on x.node=identity1 join pc y on y.node=identity2 where verdict=-1 and x.component=y.component group by 1) select pc.component, string_agg(node, '|' order by node) as members, coalesce(max(k),0) as conflicts from pc left join cf on cf.component=pc.component group by 1")
def super_identities(spark, sf_dir):
    return I.super_identities(adjacency_(spark, sf_dir)).select("component", F.array_join("members", "|").alias("members"), "conflicts")


@query("resolve_conflicts")
def resolve_conflicts(spark, sf_dir):
    """Components parted so that no group holds a pair in conflict; greedy, so tested against a brute-force version."""
    return I.linked(adjacency_(spark, sf_dir))


@query("linked_pairs")
def linked_pairs(spark, sf_dir):
    return I.linked_pairs(I.linked(adjacency_(spark, sf_dir)))


@query("compound_identity")
def compound_identity(spark, sf_dir):
    return I.compound(I.linked(adjacency_(spark, sf_dir)))


@query("similar_not_linked", f"with {ADJ} select identity1, identity2 from adj where verdict>=0 except select identity1, identity2 from adj where verdict>=1")
def similar_not_linked(spark, sf_dir):
    a = adjacency_(spark, sf_dir)
    return a.where("verdict >= 0").select("identity1", "identity2").exceptAll(a.where("verdict >= 1").select("identity1", "identity2"))


# --- stage 2

CROSS = f"""{WITH}, {NAME_TOK}, {VARIANTS}, {KNOWN}, {DOM}, {PERSON_TOK}, ident2 as (select distinct concat(STATE,'|',last_name,'|',first_name) as identity, last_name, middle_name, first_name, EMPLOYER, OCCUPATION, STATE from members),
idl as (select distinct identity, split_part(identity,'|',2) as ln, STATE from ident2), idpairs as (select x.identity as identity1, y.identity as identity2 from idl x join idl y on x.STATE<y.STATE and x.ln=y.ln),
pr as (select identity1, identity2, x.last_name as last1, y.last_name as last2, x.middle_name as middle1, y.middle_name as middle2, x.first_name as first1, y.first_name as first2, x.EMPLOYER as employer1, y.EMPLOYER as employer2, x.OCCUPATION as occupation1, y.OCCUPATION as occupation2
 from idpairs join ident2 x on x.identity=identity1 join ident2 y on y.identity=identity2), {LOOK},
cd as (select *, {names_sql()} as n, {EMP_SQL} as e, {OCC_SQL} as o, case when middle1<>'' then middle1 else middle2 end as mid from lk),
fq as (select cd.*, coalesce(w.cnt,0) as f_with, coalesce(v.cnt,0) as f_without, case when occupation_edge then 1.0 else -1.0 end as osig, case when employer_edge then 1.0 else -1.0 end as esig from cd
 left join person_tok w on w.type=123 and w.tok=case when mid<>'' then concat_ws('|', last1, mid, first1) end left join person_tok v on v.type=123 and v.tok=concat_ws('|', last1, '', first1))"""
BEST = """bestn as (select identity1, identity2, n, f_with, f_without, worst from (select *, row_number() over (partition by identity1, identity2 order by n desc, f_with desc, f_without desc) as r, min(n) over (partition by identity1, identity2) as worst from fq) x where r=1),
bo as (select identity1, identity2, max(o) as o, max(e) as e from fq group by 1, 2),
pc2 as (select bestn.identity1, bestn.identity2, case when worst<0 then -1 else n end as n, f_with, f_without, o, e from bestn join bo using (identity1, identity2) where n>=3 and (o>=2 or e>=2))"""


STAGE2 = {"last": "last_name", "middle": "middle_name", "first": "first_name", "employer": "EMPLOYER", "occupation": "OCCUPATION"}


def stage2_pairs(m):
    """All records by identity (state, last and first name), and all pairs of identities of one last name in two states."""
    ident = m.select(F.concat_ws("|", "STATE", "last_name", "first_name").alias("identity"), "STATE", *[F.col(v).alias(k) for k, v in STAGE2.items()]).distinct()
    heads = ident.select("identity", "last", "STATE").distinct()
    pairs = heads.selectExpr("identity identity1", "last", "STATE s1").join(heads.selectExpr("identity identity2", "last", "STATE s2"), "last").where("s1 < s2")
    return ident, pairs.select("identity1", "identity2")


def stage2_codes(spark, sf_dir):
    """Codes of all identity pairs, in rows of name codes and rows of affiliation codes, for ``person_comparison``.

    A code is made once for two values under a last name. Of the affiliation codes only the best counts, so each
    value first takes its best against an identity, and not all pairs of records are made.
    """
    m = written(members(spark, sf_dir), "members")
    ident, pairs = stage2_pairs(m)
    ident = written(ident, "identities")
    e, o = (A.transition_edges(m, "identity", "TRANSACTION_DT", f).withColumn("significance", F.lit(1.0)) for f in ("EMPLOYER", "OCCUPATION"))

    def coded(*fields):
        values = ident.select("last", *fields).distinct()
        x, y = (values.select(*[(F.col(f) if f in values.columns else F.lit("")).alias(f + side) for f in STAGE2]) for side in "12")
        return C.with_lookups(x.join(y, F.col("last1") == F.col("last2")), K.token_counts(m, K.name_tokens()), variants(spark), known_names(spark), e, o)

    names = C.frequency_pair(coded("middle", "first"), K.person_tokens(m)).select("last1", "middle1", "first1", "last2", "middle2", "first2", C.names().alias("n"), "f_with", "f_without")
    by_name = I.cross(pairs, ident, ["last", "middle", "first"]).join(written(names, "codes"), [f + side for f in ("last", "middle", "first") for side in "12"])
    codes = coded("employer", "occupation").select("last1", "employer1", "occupation1", "employer2", "occupation2", F.struct(C.occupations().alias("code"), F.coalesce("occupation_sig", F.lit(-1.0)).alias("sig")).alias("o"), F.struct(C.employers().alias("code"), F.coalesce("employer_sig", F.lit(-1.0)).alias("sig")).alias("e"))
    held = [ident.select(F.col("identity").alias(f"identity{side}"), F.col("STATE").alias(f"s{side}"), F.col("last").alias("last1"), F.col("employer").alias(f"employer{side}"), F.col("occupation").alias(f"occupation{side}")).distinct() for side in "12"]
    best = held[0].join(written(codes, "codes"), ["last1", "employer1", "occupation1"]).groupBy("identity1", "s1", "last1", "employer2", "occupation2").agg(F.max("o").alias("o"), F.max("e").alias("e"))
    by_affiliation = best.join(held[1], ["last1", "employer2", "occupation2"]).where("s1 < s2").selectExpr("identity1", "identity2", "o.code o", "o.sig osig", "e.code e", "e.sig esig")
    return by_name.select("identity1", "identity2", "n", "f_with", "f_without").unionByName(by_affiliation, allowMissingColumns=True)


@query("identity_cross", f"{CROSS} select identity1, identity2, count(*) as n from pr group by all")
def identity_cross(spark, sf_dir):
    ident, pairs = stage2_pairs(written(members(spark, sf_dir), "members"))
    sizes = ident.groupBy("identity").agg(F.count("*").alias("n"))
    held = pairs.join(sizes.selectExpr("identity identity1", "n n1"), "identity1").join(sizes.selectExpr("identity identity2", "n n2"), "identity2")
    return held.select("identity1", "identity2", (F.col("n1") * F.col("n2")).alias("n"))


@query("identity_compare", f"{CROSS}, {BEST} select identity1, identity2, cast(n as int) as n, f_with, f_without, cast(o as int) as o, cast(e as int) as e from pc2")
def identity_compare(spark, sf_dir):
    return I.person_comparison(stage2_codes(spark, sf_dir)).select("identity1", "identity2", "n", "f_with", "f_without", "o", "e")


CAL = [(k, f1, f2) for k in ("o_4", "e_4", "o_3", "e_3", "o_2", "e_2") for f1 in range(0, 6) for f2 in range(0, 12) if (f1 + 2 * f2 + int(k[2])) % 3]
THR = [("o_4", 9), ("e_4", 8), ("o_3", 7), ("e_3", 6), ("o_2", 4), ("e_2", 3)]
CAL_SQL = "cal as (select * from (values {}) v(key, f1, f2)), thr as (select * from (values {}) v(key, most))".format(", ".join(f"('{k}',{a},{b})" for k, a, b in CAL), ", ".join(f"('{k}',{m})" for k, m in THR))


def level_sql(n, test, scale):
    return " ".join(f"when n={n} and {f}={lv} and {test.format(k=f'{f}_{lv}')} then {scale * lv}" for lv in (4, 3, 2) for f in "oe")


@query("verdict", f"{CROSS}, {BEST}, {CAL_SQL} select identity1, identity2, cast(case when n between 0 and 2 or (o<2 and e<2) then 0 when n=-1 then case when (e=4 and o>=3) or (o=4 and e>=3) then 1 else -1 end "
       + level_sql(4, "exists(select 1 from cal where key='{k}' and cal.f1=f_with and cal.f2=f_without)", 3) + " " + level_sql(3, "f_without<(select most from thr where key='{k}')", 2) + " else 0 end as int) as verdict from pc2")
def verdict(spark, sf_dir):
    cal = spark.createDataFrame(CAL, "key string, f1 long, f2 long")
    thr = spark.createDataFrame(THR, "key string, most long")
    return I.verdict(I.person_comparison(stage2_codes(spark, sf_dir)), cal, thr).select("identity1", "identity2", "verdict")


@query("compatibility", f"{STAGE1}, m2 as (select id, concat(STATE,last_name) as component from members), sz as (select component, count(*) as n from m2 group by 1), vs as (select a, b, verdict from cmp union all select b, a, verdict from cmp), s as (select x.component as p, y.component as q, sum(verdict) as t from vs join m2 x on x.id=vs.a join m2 y on y.id=vs.b where x.component<y.component group by 1, 2) select p, q, round(t/(cast(a.n as double)*b.n), 9) as compatibility from s join sz a on a.component=p join sz b on b.component=q")
def compatibility(spark, sf_dir):
    m = members(spark, sf_dir).select("id", F.concat("STATE", "last_name").alias("component"))
    found = C.compared(looked_up(spark, sf_dir)).select("a", "b", "verdict")
    a, b = m.selectExpr("id a", "component p"), m.selectExpr("id b", "component q")
    pairs = G.symmetric(found).join(a, "a").join(b, "b").where("p < q").select("p", "q").distinct()
    return I.compatibility(pairs, found, m).select("p", "q", F.round("compatibility", 9).alias("compatibility"))


@query("bootstrap_split", f"{WITH}, d as (select id, identity, row_number() over (partition by identity order by id) as k, count(*) over (partition by identity) as n from members) select id, case when substr(md5(identity),1,1)<'8' and n>1 then concat(identity, case when k<=n//2 then '|1' else '|2' end) else identity end as identity from d")
def bootstrap_split(spark, sf_dir):
    return I.bootstrap_split(members(spark, sf_dir).select("id", "identity"))


@query("split_matches", f"{WITH}, h as (select distinct identity from members), p as (select concat(identity,'|1') as identity1, case when length(identity) % 2=0 then concat(identity,'|2') else identity end as identity2 from h) select identity1, identity2, (regexp_extract(identity1,'^(.*)\\|([12])',1)<>'' and regexp_extract(identity2,'^(.*)\\|([12])',1)<>'' and regexp_extract(identity1,'^(.*)\\|([12])',1)=regexp_extract(identity2,'^(.*)\\|([12])',1)) as recovered from p")
def split_matches(spark, sf_dir):
    h = members(spark, sf_dir).select("identity").distinct()
    return I.split_matches(h.selectExpr("concat(identity, '|1') identity1", "if(length(identity) % 2 = 0, concat(identity, '|2'), identity) identity2"))


POINTS = "pts as (select l_orderkey % 1300 as f1, l_linenumber*3 + cast(l_quantity as int) as f2 from lineitem)"


def points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 1300 f1", "l_linenumber * 3 + int(l_quantity) f2")


HIST2 = "h2 as (select f1, f2, count(*) as n from pts where f1 between 0 and 1198 and f2 between 0 and 98 group by 1, 2)"


@query("hist2d", f"with {POINTS}, {HIST2} select f1, f2, n from h2")
def hist2d(spark, sf_dir):
    return I.histogram2d(points(spark, sf_dir))


@query("hist1d", f"with {POINTS} select f2, count(*) as n from pts where f2 between 0 and 1198 group by 1")
def hist1d(spark, sf_dir):
    return points(spark, sf_dir).where("f2 between 0 and 1198").groupBy("f2").agg(F.count("*").alias("n"))


@query("cum_threshold", f"with {POINTS}, {HIST2}, g as (select n, sum(n) as m from h2 group by n), w as (select n, sum(m) over (order by n) as cum, sum(m) over () as al from g) select min(n) as threshold from w where cum > al*0.05")
def cum_threshold(spark, sf_dir):
    return I.mass_threshold(I.histogram2d(points(spark, sf_dir)), 95)


@query("calibrate1d", f"with {POINTS}, h as (select f2, count(*) as n from pts group by 1), w as (select f2, sum(n) over (order by f2) as cum, sum(n) over () as al from h) select min(f2) as threshold from w where cum > al*0.95")
def calibrate1d(spark, sf_dir):
    return I.percentile_bin(hist1d(spark, sf_dir), "f2", 95)


@query("calibrate2d")
def calibrate2d(spark, sf_dir):
    """Accepted frequency pairs: cells of the blurred histogram above its mass threshold; at most 1199 x 99 cells."""
    dense = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 30 f1", "l_linenumber * 3 + int(l_quantity) f2")
    cells = I.histogram2d(dense)
    threshold = I.mass_threshold(cells, 95).first()["threshold"] or 0
    region = I.blurred_region([(r.f1, r.f2, r.n) for r in cells.collect()], threshold)
    return spark.createDataFrame(region, "f1 int, f2 int")


# --- applications

VOTERS = "voters as (select c_custkey as personid, list_extract(string_split('SMITH,SMYTH,LEE,PATEL,GARCIA',','), cast(c_custkey % 5 as int)+1) as last, list_extract(string_split('JOHN,MARY,LI,ANNA',','), cast(c_custkey % 4 as int)+1) as first, n_name as state, concat('CITY', c_custkey % 7) as city, concat(100+c_custkey % 90,' MAIN ST') as street, lpad(cast(10000+c_custkey % 50 as varchar),5,'0') as zip from customer join nation on c_nationkey=n_nationkey)"


def voters(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.selectExpr("c_custkey personid", "element_at(split('SMITH,SMYTH,LEE,PATEL,GARCIA', ','), int(c_custkey % 5) + 1) last", "element_at(split('JOHN,MARY,LI,ANNA', ','), int(c_custkey % 4) + 1) first", "n_name state", "concat('CITY', c_custkey % 7) city", "concat(100 + c_custkey % 90, ' MAIN ST') street", "lpad(string(10000 + c_custkey % 50), 5, '0') zip")


@query("voter_match", f"{WITH}, {VOTERS}, j as (select personid, id, levenshtein(street, address) as d, v.zip as vz, m.zip as mz, address from voters v join members m on m.last_name=v.last and m.first_name=v.first and m.STATE=v.state and m.CITY=v.city) select personid, id, case when address<>'' and d<2 then 'address' else 'zip' end as how from j where (address<>'' and d<2) or vz=mz")
def voter_match(spark, sf_dir):
    """Voters and contributions of one name, city and state, by address or else by zip code."""
    m = members(spark, sf_dir).selectExpr("id", "last_name last", "first_name first", "STATE state", "CITY city", "address", "zip mz")
    held = voters(spark, sf_dir).join(m, ["last", "first", "state", "city"])
    near = (F.col("address") != "") & (F.levenshtein("street", "address") < 2)
    return held.where(near | (F.col("zip") == F.col("mz"))).select("personid", "id", F.when(near, "address").otherwise("zip").alias("how"))


@query("voter_freq", f"with {VOTERS}, f as (select last, first, count(*) as n from voters group by all) select personid, coalesce(n, 0) as n from voters left join f using (last, first)")
def voter_freq(spark, sf_dir):
    v = voters(spark, sf_dir)
    f = v.groupBy("last", "first").agg(F.count("*").alias("n"))
    return v.join(f, ["last", "first"], "left").select("personid", F.coalesce("n", F.lit(0)).alias("n"))


@query("coding_table", f"{WITH}, {VOTERS}, t as (select distinct last, first from voters), hits as (select t.last, t.first, m.id, m.identity from t join members m on list_contains(regexp_split_to_array(upper(m.NAME), '[^A-Z0-9'']+'), t.last) and list_contains(regexp_split_to_array(upper(m.NAME), '[^A-Z0-9'']+'), t.first)) select last, first, id, identity, case when identity like 'NATION_1|%' then 1 else 3 end as section from hits")
def coding_table(spark, sf_dir):
    """For hand coding: per target the records of linked (1) and of similar, unlinked (3) identities."""
    t = voters(spark, sf_dir).select("last", "first").distinct()
    tokens = members(spark, sf_dir).select("id", "identity", F.array_distinct(F.split(F.upper("NAME"), r"[^A-Z0-9']+")).alias("tokens"))
    by_last = tokens.select("id", "identity", "tokens", F.explode("tokens").alias("last"))
    hits = t.join(by_last, "last").where(F.array_contains("tokens", F.col("first")))
    return hits.select("last", "first", "id", "identity", F.when(F.col("identity").startswith("NATION_1|"), 1).otherwise(3).alias("section"))


@query("persons", f"{WITH} select identity, count(*) as n_records, min(TRANSACTION_DT) as first_day, max(TRANSACTION_DT) as last_day, string_agg(distinct EMPLOYER, '|' order by EMPLOYER) as employers from members group by identity")
def persons(spark, sf_dir):
    m = members(spark, sf_dir)
    return m.groupBy("identity").agg(
        F.count("*").alias("n_records"), F.min("TRANSACTION_DT").alias("first_day"), F.max("TRANSACTION_DT").alias("last_day"),
        F.array_join(F.array_sort(F.collect_set("EMPLOYER")), "|").alias("employers"),
    )


@query("merge_persons")
def merge_persons(spark, sf_dir):
    """Persons by last name and state whose records agree often enough become one; tested in tests/test_functions.py."""
    m = members(spark, sf_dir).select("id", F.concat("STATE", "last_name").alias("component"))
    found = C.compared(looked_up(spark, sf_dir)).select("a", "b", "verdict")
    a, b = m.selectExpr("id a", "component p"), m.selectExpr("id b", "component q")
    pairs = G.symmetric(found).join(a, "a").join(b, "b").where("p < q").select("p", "q").distinct()
    return I.merged(m, pairs, found)
