"""Queries over the contribution and address tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.cluster import shared_dir
from kindred.operators import etl
from kindred.plans.registry import query
from kindred.sources import files
from kindred.sources.bridge import ADDRESSES, COMMITTEES, CONTRIB, addresses, committees, contrib, table

CA = f"with {CONTRIB}, {ADDRESSES}"
PLACE = "CONTRIBUTOR_ZIP, CONTRIBUTOR_STATE, CONTRIBUTOR_CITY, CONTRIBUTOR_STREET_1"
UNIQUES = "uniques as (select TRAN_ID, CMTE_ID from addresses group by TRAN_ID, CMTE_ID having count(*)=1)"
DUPS = f"dups as (select TRAN_ID, CMTE_ID, {PLACE}, count(*) as c from addresses where TRAN_ID<>'' and CMTE_ID<>'' group by TRAN_ID, CMTE_ID, {PLACE} having count(*)>1)"
SINGLE = "single as (select TRAN_ID, CMTE_ID, count(*) as c from dups group by TRAN_ID, CMTE_ID having count(*)=1)"
IDENT = "ident as (select * from uniques union select TRAN_ID, CMTE_ID from single)"
FIRST = f"first_rows as (select * from (select a.*, row_number() over (partition by TRAN_ID, CMTE_ID order by {PLACE}, id) as r from addresses a semi join ident using (TRAN_ID, CMTE_ID)) x where r=1)"
ALONE = "alone as (select * from (select c.*, count(*) over (partition by TRAN_ID, CMTE_ID) as k from contrib c) x where k=1 and TRAN_ID<>'' and CMTE_ID<>'')"
CHAIN = f"{CA}, {UNIQUES}, {DUPS}, {SINGLE}, {IDENT}"


@query("scan_psv", "select o_orderkey as id, o_orderstatus as status, o_orderpriority as priority, cast(o_custkey as varchar) as cust from orders")
def scan_psv(spark, sf_dir):
    """Written as pipe-separated text in the shared folder and scanned again."""
    path = shared_dir(spark, "psv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")).write.mode("overwrite").option("sep", "|").csv(path)
    return files.scan_psv(spark, path, spark.createDataFrame([], "id long, status string, priority string, cust string").schema)


@query("retrieve", f"with {CONTRIB} select upper(NAME) as NAME, upper(CITY) as CITY, upper(EMPLOYER) as EMPLOYER, id from contrib where STATE < 'NATION_2' order by NAME, TRANSACTION_DT, id limit 200 offset 50")
def retrieve(spark, sf_dir):
    return files.retrieved(contrib(spark, sf_dir), ["NAME", "CITY", "EMPLOYER", "id"], where="STATE < 'NATION_2'", order="NAME, TRANSACTION_DT, id", limit=(50, 200))


@query("retrieve_by_id", f"with {CONTRIB} select id, NAME, STATE from contrib where id in (select o_orderkey from orders where o_orderstatus='F')")
def retrieve_by_id(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey id")
    return files.by_ids(contrib(spark, sf_dir), ids).select("id", "NAME", "STATE")


@query("export_with_identity", f"with {CONTRIB} select case when id % 3=0 then concat(STATE, '-', cast(id % 17 as varchar)) else '' end as identity, id, NAME from contrib")
def export_with_identity(spark, sf_dir):
    c = contrib(spark, sf_dir)
    ids = c.where("id % 3 = 0").selectExpr("id", "concat(STATE, '-', id % 17) identity")
    return files.with_identity(c.select("id", "NAME"), ids)


@query("committees", f"with {CONTRIB}, {COMMITTEES} select CMTE_ID, CMTE_PTY_AFFILIATION as party from committees where CMTE_TP in ('H','S','P') and CMTE_DSGN='P'")
def committees_(spark, sf_dir):
    c = committees(spark, sf_dir)
    return c.where(c.CMTE_TP.isin("H", "S", "P") & (c.CMTE_DSGN == "P")).selectExpr("CMTE_ID", "CMTE_PTY_AFFILIATION party")


@query("get_identities", f"with {CONTRIB} select id, concat(STATE, '-', cast(id % 17 as varchar)) as identity from contrib where id in (select l_orderkey from lineitem where l_quantity > 49)")
def get_identities(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 49").selectExpr("l_orderkey id")
    return files.by_ids(contrib(spark, sf_dir).selectExpr("id", "concat(STATE, '-', id % 17) identity"), ids)


@query("state_slice", f"with {CONTRIB} select id, NAME from contrib where STATE='NATION_7'")
def state_slice(spark, sf_dir):
    return contrib(spark, sf_dir).where("STATE = 'NATION_7'").select("id", "NAME")


@query("nonempty_key", f"with {CONTRIB} select id, TRAN_ID, CMTE_ID from contrib where TRAN_ID<>'' and CMTE_ID<>''")
def nonempty_key(spark, sf_dir):
    return etl.nonempty_key(contrib(spark, sf_dir)).select("id", "TRAN_ID", "CMTE_ID")


@query("ind_filter", f"with {CONTRIB} select id, NAME from contrib where ENTITY_TP='IND'")
def ind_filter(spark, sf_dir):
    return contrib(spark, sf_dir).where("ENTITY_TP = 'IND'").select("id", "NAME")


@query("where_expression", f"with {CONTRIB} select id from contrib where TRANSACTION_AMT > 1000 and EMPLOYER='GLOBEX'")
def where_expression(spark, sf_dir):
    return files.retrieved(contrib(spark, sf_dir), ["id"], where="TRANSACTION_AMT > 1000 and EMPLOYER = 'GLOBEX'")


@query("identity_state", f"with {CONTRIB}, i as (select id, concat(STATE, '-', cast(id % 17 as varchar)) as identity from contrib) select id, identity from i where identity like 'NATION_5-%'")
def identity_state(spark, sf_dir):
    return contrib(spark, sf_dir).selectExpr("id", "concat(STATE, '-', id % 17) identity").where(F.col("identity").startswith("NATION_5-"))


@query("size_guard", f"with {CONTRIB}, n as (select id, NAME, count(*) over (partition by NAME) as hits from contrib) select id, NAME, hits from n where hits <= 30")
def size_guard(spark, sf_dir):
    c = contrib(spark, sf_dir)
    hits = c.groupBy("NAME").agg(F.count("*").alias("hits")).where("hits <= 30")
    return c.join(hits, "NAME").select("id", "NAME", "hits")


@query("uniques", f"{CA}, {UNIQUES} select * from uniques")
def uniques(spark, sf_dir):
    return etl.unique_keys(addresses(spark, sf_dir))


@query("dup_groups", f"{CA}, {DUPS} select * from dups")
def dup_groups(spark, sf_dir):
    return etl.duplicate_groups(addresses(spark, sf_dir))


@query("single_dup_groups", f"{CA}, {DUPS}, {SINGLE} select * from single")
def single_dup_groups(spark, sf_dir):
    return etl.single_duplicate_groups(addresses(spark, sf_dir))


@query("identifiables", f"{CHAIN} select * from ident")
def identifiables(spark, sf_dir):
    return etl.identifiable_keys(addresses(spark, sf_dir))


@query("identifiables_strict", f"{CA} select TRAN_ID, CMTE_ID from addresses where TRAN_ID<>'' and CMTE_ID<>'' group by TRAN_ID, CMTE_ID having count(distinct concat_ws('|', {PLACE}))=1")
def identifiables_strict(spark, sf_dir):
    return etl.identifiable_keys(addresses(spark, sf_dir), strict=True)


@query("important_dups", f"{CA}, g as (select TRAN_ID, CMTE_ID, CONTRIBUTOR_STREET_1, CONTRIBUTOR_CITY, count(*) as c from addresses where TRAN_ID<>'' and CMTE_ID<>'' group by all having count(*)>1) select TRAN_ID, CMTE_ID, count(*) as groups, cast(sum(c) as bigint) as n_rows from g group by TRAN_ID, CMTE_ID having count(*)=1")
def important_dups(spark, sf_dir):
    return etl.important_duplicates(addresses(spark, sf_dir), ["CONTRIBUTOR_STREET_1", "CONTRIBUTOR_CITY"])


@query("addr_truncate", f"{CA} select id, CONTRIBUTOR_STREET_1 from addresses a where exists (select 1 from contrib c where c.ENTITY_TP='IND' and c.TRAN_ID=a.TRAN_ID and c.CMTE_ID=a.CMTE_ID)")
def addr_truncate(spark, sf_dir):
    return etl.truncated(addresses(spark, sf_dir), contrib(spark, sf_dir).where("ENTITY_TP = 'IND'")).select("id", "CONTRIBUTOR_STREET_1")


@query("addr_unique", f"{CA}, {UNIQUES} select a.id, a.TRAN_ID, a.CMTE_ID, a.CONTRIBUTOR_STREET_1 from addresses a join uniques using (TRAN_ID, CMTE_ID)")
def addr_unique(spark, sf_dir):
    return etl.unique_addresses(addresses(spark, sf_dir)).select("id", "TRAN_ID", "CMTE_ID", "CONTRIBUTOR_STREET_1")


@query("addr_identifiable", f"{CHAIN}, {FIRST} select id, TRAN_ID, CMTE_ID, CONTRIBUTOR_STREET_1 from first_rows")
def addr_identifiable(spark, sf_dir):
    return etl.identifiable_addresses(addresses(spark, sf_dir)).select("id", "TRAN_ID", "CMTE_ID", "CONTRIBUTOR_STREET_1")


@query("anti_dup", f"with {CONTRIB}, {ALONE} select id, TRAN_ID, CMTE_ID from alone")
def anti_dup(spark, sf_dir):
    return etl.without_duplicate_keys(contrib(spark, sf_dir)).select("id", "TRAN_ID", "CMTE_ID")


@query("state_addresses", f"{CHAIN}, {FIRST}, {ALONE} select a.id, a.STATE, f.CONTRIBUTOR_STREET_1 as street from alone a join first_rows f using (TRAN_ID, CMTE_ID)")
def state_addresses(spark, sf_dir):
    return etl.state_addresses(contrib(spark, sf_dir).drop("CONTRIBUTOR_STREET_1"), addresses(spark, sf_dir)).selectExpr("id", "STATE", "CONTRIBUTOR_STREET_1 street")


@query("state_combined", f"{CHAIN}, {FIRST}, {ALONE}, s as (select TRAN_ID, CMTE_ID, f.CONTRIBUTOR_STREET_1 as street, f.CONTRIBUTOR_CITY as city from alone a join first_rows f using (TRAN_ID, CMTE_ID)) select c.id, c.NAME, s.street, s.city from contrib c left join s on c.TRAN_ID=s.TRAN_ID and c.CMTE_ID=s.CMTE_ID where c.STATE='NATION_3' order by c.NAME, c.TRANSACTION_DT, c.ZIP_CODE")
def state_combined(spark, sf_dir):
    c = contrib(spark, sf_dir).drop("CONTRIBUTOR_STREET_1")
    found = etl.combined(c, addresses(spark, sf_dir)).where("STATE = 'NATION_3'").orderBy("NAME", "TRANSACTION_DT", "ZIP_CODE")
    return found.selectExpr("id", "NAME", "CONTRIBUTOR_STREET_1 street", "CONTRIBUTOR_CITY city")


@query("usa_combined", f"{CHAIN}, {FIRST}, {ALONE}, s as (select TRAN_ID, CMTE_ID, f.CONTRIBUTOR_STREET_1 as street from alone a join first_rows f using (TRAN_ID, CMTE_ID)) select c.STATE, count(*) as n, count(s.street) as n_street from contrib c left join s on c.TRAN_ID=s.TRAN_ID and c.CMTE_ID=s.CMTE_ID group by c.STATE")
def usa_combined(spark, sf_dir):
    """All states are partitions of one table, so the national table is the table itself."""
    found = etl.combined(contrib(spark, sf_dir).drop("CONTRIBUTOR_STREET_1"), addresses(spark, sf_dir))
    return found.groupBy("STATE").agg(F.count("*").alias("n"), F.count("CONTRIBUTOR_STREET_1").alias("n_street"))


@query("state_counts", f"with {CONTRIB} select STATE, count(*) as n from contrib group by STATE")
def state_counts(spark, sf_dir):
    return contrib(spark, sf_dir).groupBy("STATE").agg(F.count("*").alias("n"))


@query("state_order", f"with {CONTRIB}, n as (select STATE, count(*) as n, round(sum(TRANSACTION_AMT), 2) as amount from contrib group by STATE) select STATE, n, cast(row_number() over (order by n desc, STATE) as int) as by_rows, cast(row_number() over (order by amount desc, STATE) as int) as by_amount from n")
def state_order(spark, sf_dir):
    n = contrib(spark, sf_dir).groupBy("STATE").agg(F.count("*").alias("n"), F.round(F.sum("TRANSACTION_AMT"), 2).alias("amount"))
    return n.select("STATE", "n", F.row_number().over(Window.orderBy(F.desc("n"), "STATE")).alias("by_rows"), F.row_number().over(Window.orderBy(F.desc("amount"), "STATE")).alias("by_amount"))


@query("ordered", f"with {CONTRIB} select NAME, TRANSACTION_DT, ZIP_CODE, CMTE_ID, id from contrib order by NAME, TRANSACTION_DT, ZIP_CODE, CMTE_ID, id")
def ordered(spark, sf_dir):
    return contrib(spark, sf_dir).select("NAME", "TRANSACTION_DT", "ZIP_CODE", "CMTE_ID", "id").orderBy("NAME", "TRANSACTION_DT", "ZIP_CODE", "CMTE_ID", "id")


@query("limit_offset", f"with {CONTRIB} select id, NAME from contrib order by NAME, id limit 100 offset 500")
def limit_offset(spark, sf_dir):
    return contrib(spark, sf_dir).select("id", "NAME").orderBy("NAME", "id").offset(500).limit(100)


@query("sample_ids")
def sample_ids(spark, sf_dir):
    """A thousand ids drawn with replacement; the same ones on every run."""
    c = contrib(spark, sf_dir).select("id")
    n = c.count()
    draws = spark.range(1000).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(n, 1))).alias("at"))
    numbered = files.with_surrogate_id(c.withColumn("b", F.pmod("id", F.lit(64))), ["id"], "b", "at").selectExpr("id", "at - 1 at")
    return draws.join(numbered, "at").select("draw", "id")


@query("ntile_chunks", f"with {CONTRIB} select id, cast(ntile(8) over (order by id) as int) as chunk from contrib")
def ntile_chunks(spark, sf_dir):
    """Eight chunks of ids in order, as even as can be, without numbering all rows in one task."""
    c = contrib(spark, sf_dir).select("id")
    n = c.count()
    numbered = files.with_surrogate_id(c.withColumn("b", F.expr("id div 4096")), ["id"], "b", "r").withColumn("r", F.col("r") - 1)
    big, small = n % 8, n // 8
    cut = big * (small + 1)
    chunk = F.when(F.col("r") < cut, F.expr(f"r div {small + 1}")).otherwise(F.lit(big) + F.expr(f"(r - {cut}) div {max(small, 1)}"))
    return numbered.select("id", (chunk + 1).cast("int").alias("chunk"))
