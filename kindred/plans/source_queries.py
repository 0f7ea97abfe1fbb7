"""Queries that write tables in the shared folder and read them again, lookups and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.cluster import shared_dir
from kindred.functions.html import table_row
from kindred.operators import affiliation as A
from kindred.operators import compare as C
from kindred.operators import identity as I
from kindred.plans.graph_queries import EDGES, STRENGTH, WITH, employer_edges, members, moves_sql
from kindred.plans.linkage_queries import ADJ, HASH, PAIRS, RULES_SQL, STRICT_NAMES, VOTERS, adjacency_, compared_sql, hashed, looked_up, method_sql, voters
from kindred.plans.registry import query
from kindred.sources import files, schema
from kindred.sources.bridge import COMMITTEES, CONTRIB, committees, contrib, table


def shaped(df, kind):
    """The columns of a table's schema, empty where ``df`` has none of the name."""
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit("").cast(f.dataType)).alias(f.name) for f in schema.TABLES[kind]])


def through_psv(spark, df, kind):
    path = shared_dir(spark, kind)
    shaped(df, kind).write.option("sep", "|").option("quote", "").option("emptyValue", "").csv(path)
    return files.scan_psv(spark, path, kind)


def through_csv(spark, df, kind):
    path = shared_dir(spark, kind)
    shaped(df, kind).write.option("header", True).csv(path)
    return files.scan_csv(spark, path, kind)


@query("scan_committees", f"with {CONTRIB}, {COMMITTEES} select CMTE_ID, CMTE_TP, CMTE_DSGN, CMTE_PTY_AFFILIATION as party, cast(null as varchar) as name from committees")
def scan_committees(spark, sf_dir):
    return through_psv(spark, committees(spark, sf_dir), "committee_master").selectExpr("CMTE_ID", "CMTE_TP", "CMTE_DSGN", "CMTE_PTY_AFFILIATION party", "CMTE_NM name")


@query("scan_candidates", "select concat('S', cast(s_suppkey as varchar)) as id, s_name as name, concat('N', cast(s_nationkey as varchar)) as state from supplier")
def scan_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "supplier").selectExpr("concat('S', s_suppkey) CAND_ID", "s_name CAND_NAME", "concat('N', s_nationkey) CAND_ST")
    return through_psv(spark, c, "candidate_master").selectExpr("CAND_ID id", "CAND_NAME name", "CAND_ST state")


@query("scan_linkage", f"with {CONTRIB}, {COMMITTEES} select CMTE_ID, concat('S', substr(CMTE_ID, 2)) as CAND_ID from committees")
def scan_linkage(spark, sf_dir):
    c = committees(spark, sf_dir).withColumn("CAND_ID", F.concat(F.lit("S"), F.substr("CMTE_ID", F.lit(2))))
    return through_psv(spark, c, "candidate_to_committee_linkage").select("CMTE_ID", "CAND_ID")


@query("scan_candidate_contributions", f"with {CONTRIB} select CMTE_ID, NAME, STATE, concat('S', cast(id % 100 as varchar)) as CAND_ID, cast(round(TRANSACTION_AMT * 100) as bigint) as cents from contrib")
def scan_candidate_contributions(spark, sf_dir):
    c = contrib(spark, sf_dir).withColumns({"CAND_ID": F.expr("concat('S', id % 100)"), "TRANSACTION_AMT": F.expr("cast(round(TRANSACTION_AMT * 100) as bigint) / cast(100 as decimal(3, 0))")})
    return through_psv(spark, c, "contributions_to_candidates").selectExpr("CMTE_ID", "NAME", "STATE", "CAND_ID", "cast(TRANSACTION_AMT * 100 as bigint) cents")


@query("scan_voters", f"with {VOTERS} select cast(personid as varchar) as personid, first, last, city, zip from voters")
def scan_voters(spark, sf_dir):
    v = voters(spark, sf_dir).selectExpr("personid", "first first_name", "last last_name", "street reg_address_street1", "city reg_address_city", "state reg_address_state", "zip reg_address_zip5")
    return through_csv(spark, v, "voter").selectExpr("personid", "first_name first", "last_name last", "reg_address_city city", "reg_address_zip5 zip")


@query("scan_name_freq", f"with {VOTERS} select cast(personid as varchar) as personid, count(*) over (partition by last, first, zip) as voters_in_zip5, count(*) over (partition by last, first, state) as voters_in_state from voters")
def scan_name_freq(spark, sf_dir):
    def same(*by):
        return F.count("*").over(Window.partitionBy("last", "first", *by))

    return through_csv(spark, voters(spark, sf_dir).select("personid", same("zip").alias("voters_in_zip5"), same("state").alias("voters_in_state")), "name_freq")


@query("scan_directors", "select cast(s_suppkey as varchar) as id, s_name as name, concat('ACME, ', cast(s_nationkey as varchar)) as employer, 'DIRECTOR \"A\"' as role from supplier")
def scan_directors(spark, sf_dir):
    """Directors as records to be found: names and companies hold commas and quotes."""
    d = table(spark, sf_dir, "supplier").selectExpr("string(s_suppkey) directorid", "s_name `Director Name`", "concat('ACME, ', s_nationkey) `employment_Company Name`", "'DIRECTOR \"A\"' employment_Role")
    path = shared_dir(spark, "directors")
    shaped(d, "directors").write.option("header", True).option("escape", '"').csv(path)
    found = spark.read.schema(schema.DIRECTORS).option("header", True).option("escape", '"').csv(path)
    return found.selectExpr("directorid id", "`Director Name` name", "`employment_Company Name` employer", "employment_Role role")


@query("saved_hashes", f"{WITH}, {HASH} select id, STATE, hash from hashed")
def saved_hashes(spark, sf_dir):
    """Saved by state, so that one state is read without the others."""
    path = shared_dir(spark, "saved")
    files.save_table(hashed(spark, sf_dir).select("id", "STATE", "hash"), path, partition_by="STATE")
    return spark.read.parquet(path).select("id", "STATE", "hash")


@query("saved_graph", f"{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'EMPLOYER')}, {EDGES}, {STRENGTH} select e.a, e.b, cast(e.weight as bigint) as weight, cast(x.k as bigint) as ka, cast(y.k as bigint) as kb from edges e join strength x on x.node=e.a join strength y on y.node=e.b")
def saved_graph(spark, sf_dir):
    edges = employer_edges(spark, sf_dir)
    path = shared_dir(spark, "graph")
    files.save_graph(A.strength(edges), edges, path)
    nodes, edges = files.load_graph(spark, path)
    return edges.join(nodes.selectExpr("node a", "strength ka"), "a").join(nodes.selectExpr("node b", "strength kb"), "b").select("a", "b", "weight", "ka", "kb")


@query("saved_edges", f"{WITH}, {moves_sql('members', 'identity', 'TRANSACTION_DT', 'OCCUPATION')}, {EDGES} select a, b, cast(weight as bigint) as weight, kind from edges, (values ('json'),('csv')) k(kind)")
def saved_edges(spark, sf_dir):
    """Edge lists as JSON lines and as CSV."""
    edges, found = A.transition_edges(members(spark, sf_dir), "identity", "TRANSACTION_DT", "OCCUPATION"), []
    for kind in ("json", "csv"):
        path = shared_dir(spark, "edges")
        files.save_edges(edges, path, kind)
        read = spark.read.schema("a string, b string, weight long")
        found.append((read.json if kind == "json" else read.csv)(path).withColumn("kind", F.lit(kind)))
    return found[0].unionByName(found[1])


@query("saved_identities", f"{WITH} select id, identity from members")
def saved_identities(spark, sf_dir):
    """A table that is made, filled, dropped, made again, and appended to in two parts."""
    path, ids = shared_dir(spark, "identities"), members(spark, sf_dir).select("id", "identity")
    files.ensure_table(spark, path, schema.IDENTITIES)
    files.save_table(ids, path, mode="append")
    files.drop_table(spark, path)
    files.ensure_table(spark, path, schema.IDENTITIES)
    files.save_table(ids.where("id % 2 = 0"), path, mode="append")
    files.save_table(ids.where("id % 2 <> 0"), path, mode="append")
    return files.ensure_table(spark, path, schema.IDENTITIES)


@query("missing_graphs", f"{WITH}, f as (select field from (values ('EMPLOYER'),('OCCUPATION')) v(field)), s as (select distinct STATE from members), have as (select distinct STATE, 'EMPLOYER' as field from members where EMPLOYER='GLOBEX') select STATE, field from s, f except select STATE, field from have")
def missing_graphs(spark, sf_dir):
    """Which states still lack which affiliation graph."""
    m = members(spark, sf_dir)
    jobs = m.select("STATE").distinct().withColumn("field", F.explode(F.array(F.lit("EMPLOYER"), F.lit("OCCUPATION"))))
    have = m.where("EMPLOYER = 'GLOBEX'").select("STATE", F.lit("EMPLOYER").alias("field")).distinct()
    return jobs.join(have, ["STATE", "field"], "left_anti")


MODES = ["thorough", "national", *"12345678"]


def rules_case(mode):
    return " ".join(f"when context='{k}' then ({v})" for k, v in method_sql(mode).items())


@query("compare_modes", f"{PAIRS}, strict as (select a, b, cast(address1<>'' and address2<>'' and address1=address2 and {STRICT_NAMES} as int) as sa, cast(employer1=employer2 and occupation1=occupation2 and employer1<>'' and occupation1<>'' and {STRICT_NAMES} as int) as sf from lk), "
       + compared_sql(RULES_SQL).split(", cmp as")[0] + ", " + ", ".join(f"v{m} as (select a, b, '{m}' as mode, case when n=-1000 and context<>'addressY' then -1000 when (case {rules_case(m)} end) then 1 else 0 end as verdict from ctx)" for m in MODES)
       + " select a, b, 'strict_address' as mode, sa as verdict from strict union all select a, b, 'strict_affiliation', sf from strict" + "".join(f" union all select * from v{m}" for m in MODES))
def compare_modes(spark, sf_dir):
    """One verdict for each pair and mode."""
    from kindred.cluster import written

    pairs = written(looked_up(spark, sf_dir), "looked-up")
    found = None
    for mode in ("strict_address", "strict_affiliation", *MODES):
        own = C.by_mode(pairs, mode).select("a", "b", F.lit(mode).alias("mode"), "verdict")
        found = own if found is None else found.union(own)
    return found


WANTED = "wanted as (select concat('P', n) as identity from (values ('1'),('7'),('13'),('nobody')) v(n))"


def wanted(spark):
    return spark.createDataFrame([(f"P{n}",) for n in ("1", "7", "13", "nobody")], "identity string")


@query("related_identities", f"with {ADJ}, {WANTED}, s as (select identity1 as identity, identity2 as related, verdict from adj union all select identity2, identity1, verdict from adj) select s.* from s semi join wanted using (identity)")
def related_identities(spark, sf_dir):
    return I.related_of(adjacency_(spark, sf_dir), wanted(spark))


LINKS = "links as (select concat('P', cast(c_custkey as varchar)) as identity, min(c_custkey) over (partition by c_nationkey, c_mktsegment) as super from customer)"


@query("linked_identities", f"with {LINKS}, {WANTED} select x.identity, y.identity as linked from links x join links y on x.super=y.super and x.identity<>y.identity semi join wanted on wanted.identity=x.identity")
def linked_identities(spark, sf_dir):
    links = table(spark, sf_dir, "customer").select(F.expr("concat('P', c_custkey)").alias("identity"), F.min("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment")).alias("super"))
    return I.linked_of(links, wanted(spark))


@query("person_window", f"{WITH}, p as (select STATE, identity, row_number() over (partition by STATE order by min(id)) as i from members group by STATE, identity) select x.identity, y.identity as near from p x join p y on x.STATE=y.STATE and y.i between x.i-3 and x.i+3 and y.i<>x.i")
def person_window(spark, sf_dir):
    """Persons within three places of one another, in the order of their first records."""
    from kindred.operators import lsh

    heads = members(spark, sf_dir).groupBy("STATE", "identity").agg(F.min("id").alias("id"))
    pairs = lsh.neighbours(heads.select("STATE", "id"), [], 3, ["STATE"]).select("a", "b")
    both = pairs.union(pairs.select("b", "a"))
    return both.join(heads.selectExpr("id a", "identity"), "a").join(heads.selectExpr("id b", "identity near"), "b").select("identity", "near")


@query("verdict_base", f"with {ADJ} select identity1, identity2, 1 as verdict from adj")
def verdict_base(spark, sf_dir):
    """The simplest authority: every candidate pair is a match."""
    return adjacency_(spark, sf_dir).select("identity1", "identity2", F.lit(1).alias("verdict"))


@query("html_rows", "select o_orderkey, concat('<tr class=\"order\"><td>', cast(o_orderkey as varchar), '</td><td>', replace(replace(replace(concat('<', o_orderpriority, '> & more'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</td><td></td></tr>') as html from orders")
def html_rows(spark, sf_dir):
    said = F.concat(F.lit("<"), F.col("o_orderpriority"), F.lit("> & more"))
    return table(spark, sf_dir, "orders").select("o_orderkey", table_row(F.col("o_orderkey"), said, F.lit(None), classes="order").alias("html"))
