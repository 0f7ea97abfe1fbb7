"""Contribution-shaped tables over the driver's tables, as DataFrames and as the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PICK = {
    "last": "SMITH,SMYTH,JOHNSON,JONSON,GARCIA,NGUYEN,OKAFOR,DE LA CRUZ,OBRIEN,KOWALSKI,LEE,PATEL",
    "first": "JOHN,JACK,ROBERT,BOB,MARIA,MARY,LI,ANNA,ELIZABETH,LIZ,AHMED,WEI",
    "middle": ",A,B,ALAN,A,,C,",
    "employer": "ACME CORP,ACME CORPORATION,SELF EMPLOYED,N/A,ALVARADO & GERKEN,ALVARADO GERKEN & BENNETT,STATE UNIVERSITY,RETIRED,,GLOBEX,INITECH",
    "occupation": "ATTORNEY,LAWYER,RETIRED,TEACHER,NONE,ENGINEER,SOFTWARE ENGINEER,,PHYSICIAN",
}


def contrib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contribution for each order."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name")
    base = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    base = base.selectExpr("o_orderkey id", "c_custkey k", "o_orderkey ok", "o_orderkey - if(o_orderkey % 6 = 1, 1, 0) kk", "n_name STATE", "o_orderdate", "o_totalprice")

    def pick(what: str, index: str) -> str:
        return f"element_at(split('{_PICK[what]}', ',', -1), int({index}) + 1)"

    middle = pick("middle", "(k div 144) % 8")
    return base.selectExpr(
        "id",
        "STATE",
        f"concat({pick('last', 'k % 12')}, ', ', {pick('first', '(k div 12) % 12')}, if({middle} = '' or ok % 4 = 0, '', concat(' ', {middle}))) NAME",
        "concat('CITY', k % 7) CITY",
        "if(ok % 9 = 0, '', lpad(string(10000 + k % 50), 5, '0')) ZIP_CODE",
        "if(ok % 5 = 0, '', concat(string(100 + k % 90), ' MAIN ST')) CONTRIBUTOR_STREET_1",
        f"{pick('employer', '(k + ok % 3) % 11')} EMPLOYER",
        f"{pick('occupation', '(k + ok % 2) % 9')} OCCUPATION",
        "date_format(o_orderdate, 'yyyyMMdd') TRANSACTION_DT",
        "o_totalprice TRANSACTION_AMT",
        "concat('C', lpad(string(kk % 97), 8, '0')) CMTE_ID",
        "if(ok % 50 = 0, '', concat('T', string(kk))) TRAN_ID",
        "if(ok % 11 = 0, 'ORG', 'IND') ENTITY_TP",
    )


def _duck_pick(what: str, index: str) -> str:
    return f"list_extract(string_split('{_PICK[what]}', ','), cast({index} as int)+1)"


_DUCK_MIDDLE = _duck_pick("middle", "(k // 144) % 8")

#: CTE ``contrib``.
CONTRIB = f"""cbase as (
  select o.o_orderkey as id, c.c_custkey as k, o.o_orderkey as ok, o.o_orderkey - (case when o.o_orderkey % 6=1 then 1 else 0 end) as kk,
         n.n_name as STATE, o.o_orderdate, o.o_totalprice
  from orders o join customer c on o.o_custkey=c.c_custkey join nation n on c.c_nationkey=n.n_nationkey),
contrib as (
 select id, STATE,
  concat({_duck_pick('last', 'k % 12')}, ', ', {_duck_pick('first', '(k // 12) % 12')},
         case when {_DUCK_MIDDLE}='' or ok % 4=0 then '' else concat(' ', {_DUCK_MIDDLE}) end) as NAME,
  concat('CITY', cast(k % 7 as varchar)) as CITY,
  case when ok % 9=0 then '' else lpad(cast(10000 + k % 50 as varchar),5,'0') end as ZIP_CODE,
  case when ok % 5=0 then '' else concat(cast(100+k % 90 as varchar),' MAIN ST') end as CONTRIBUTOR_STREET_1,
  {_duck_pick('employer', '(k+ok % 3) % 11')} as EMPLOYER, {_duck_pick('occupation', '(k+ok % 2) % 9')} as OCCUPATION,
  strftime(o_orderdate,'%Y%m%d') as TRANSACTION_DT, o_totalprice as TRANSACTION_AMT,
  concat('C', lpad(cast(kk % 97 as varchar),8,'0')) as CMTE_ID,
  case when ok % 50=0 then '' else concat('T', cast(kk as varchar)) end as TRAN_ID,
  case when ok % 11=0 then 'ORG' else 'IND' end as ENTITY_TP
 from cbase)"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses mined for the contributions that have a street; some rows twice, some with another street."""
    rows = contrib(spark, sf_dir).where("CONTRIBUTOR_STREET_1 <> ''")
    rows = rows.selectExpr(
        "id", "TRAN_ID", "CMTE_ID", "CITY CONTRIBUTOR_CITY", "STATE CONTRIBUTOR_STATE", "ZIP_CODE CONTRIBUTOR_ZIP",
        "if(id % 7 = 3, concat(CONTRIBUTOR_STREET_1, ' REAR'), CONTRIBUTOR_STREET_1) CONTRIBUTOR_STREET_1", "explode(array_repeat(1, if(id % 4 = 2, 2, 1))) again",
    )
    return rows.drop("again")


#: CTE ``addresses``, after CONTRIB.
ADDRESSES = """addresses as (
 select id, TRAN_ID, CMTE_ID, CITY as CONTRIBUTOR_CITY, STATE as CONTRIBUTOR_STATE, ZIP_CODE as CONTRIBUTOR_ZIP,
  case when id % 7=3 then concat(CONTRIBUTOR_STREET_1,' REAR') else CONTRIBUTOR_STREET_1 end as CONTRIBUTOR_STREET_1
 from contrib, (values (1),(2)) r(again) where CONTRIBUTOR_STREET_1<>'' and (again=1 or id % 4=2))"""


def committees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committees of the contributions, with type, designation and party."""
    ids = contrib(spark, sf_dir).select("CMTE_ID").distinct().withColumn("n", F.expr("int(substr(CMTE_ID, 2))"))
    return ids.selectExpr(
        "CMTE_ID", "element_at(array('H', 'S', 'P', 'X'), n % 4 + 1) CMTE_TP", "if(n % 5 = 0, 'A', 'P') CMTE_DSGN",
        "element_at(array('DEM', 'REP', 'OTH'), n % 3 + 1) CMTE_PTY_AFFILIATION",
    )


#: CTE ``committees``, after CONTRIB.
COMMITTEES = """committees as (
 select CMTE_ID, list_extract(['H','S','P','X'], n % 4 + 1) as CMTE_TP, case when n % 5=0 then 'A' else 'P' end as CMTE_DSGN,
  list_extract(['DEM','REP','OTH'], n % 3 + 1) as CMTE_PTY_AFFILIATION
 from (select distinct CMTE_ID, cast(substr(CMTE_ID, 2) as int) as n from contrib))"""

VARIANT_PAIRS = [("JOHN", "JACK"), ("ROBERT", "BOB"), ("MARIA", "MARY"), ("ELIZABETH", "LIZ")]
#: First names of the dictionary; WEI and LIZ are left out, so that they count as misspelt.
KNOWN_NAMES = ["JOHN", "JACK", "ROBERT", "BOB", "MARIA", "MARY", "LI", "ANNA", "ELIZABETH", "AHMED"]


def variants(spark: SparkSession) -> DataFrame:
    """Pairs of variants, in both directions."""
    return spark.createDataFrame(VARIANT_PAIRS + [(b, a) for a, b in VARIANT_PAIRS], "name string, variant string")


def known_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in KNOWN_NAMES], "name string")


#: CTEs ``variants`` and ``known_names``.
VARIANTS = "variants as (select * from (values {}) v(name, variant))".format(", ".join(f"('{a}','{b}'), ('{b}','{a}')" for a, b in VARIANT_PAIRS))
KNOWN = "known_names as (select * from (values {}) v(name))".format(", ".join(f"('{n}')" for n in KNOWN_NAMES))
