"""Which addresses identify a contribution, and the combined table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["TRAN_ID", "CMTE_ID"]
PLACE = ["CONTRIBUTOR_ZIP", "CONTRIBUTOR_STATE", "CONTRIBUTOR_CITY", "CONTRIBUTOR_STREET_1"]


def nonempty_key(df: DataFrame) -> DataFrame:
    return df.where("TRAN_ID <> '' and CMTE_ID <> ''")


def unique_keys(addresses: DataFrame) -> DataFrame:
    """Keys of one row; empty ones as well."""
    return addresses.groupBy(*KEY).agg(F.count("*").alias("n")).where("n = 1").select(*KEY)


def duplicate_groups(addresses: DataFrame) -> DataFrame:
    """Full addresses that a key has more than once."""
    return nonempty_key(addresses).groupBy(*KEY, *PLACE).agg(F.count("*").alias("c")).where("c > 1")


def single_duplicate_groups(addresses: DataFrame) -> DataFrame:
    """Keys with exactly one duplicated address."""
    return duplicate_groups(addresses).groupBy(*KEY).agg(F.count("*").alias("c")).where("c = 1")


def identifiable_keys(addresses: DataFrame, strict: bool = False) -> DataFrame:
    """Keys whose rows tell one address; ``strict``: all rows agree, instead of one address being repeated."""
    if strict:
        return nonempty_key(addresses).groupBy(*KEY).agg(F.count_distinct(F.struct(*PLACE)).alias("n")).where("n = 1").select(*KEY)
    return unique_keys(addresses).union(single_duplicate_groups(addresses).select(*KEY)).distinct()


def truncated(addresses: DataFrame, contributions: DataFrame) -> DataFrame:
    """Addresses of known contributions."""
    return addresses.join(contributions.select(*KEY), KEY, "left_semi")


def unique_addresses(addresses: DataFrame) -> DataFrame:
    return addresses.join(unique_keys(addresses), KEY, "left_semi")


def identifiable_addresses(addresses: DataFrame, order: str = "id") -> DataFrame:
    """The first row of every identifiable key."""
    first = Window.partitionBy(*KEY).orderBy(*PLACE, order)
    held = addresses.join(identifiable_keys(addresses), KEY, "left_semi")
    return held.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def without_duplicate_keys(df: DataFrame) -> DataFrame:
    """Rows whose key no other row has."""
    single = df.groupBy(*KEY).agg(F.count("*").alias("_n")).where("_n = 1").select(*KEY)
    return nonempty_key(df).join(single, KEY, "left_semi")


def state_addresses(contributions: DataFrame, addresses: DataFrame) -> DataFrame:
    """Contributions with keys of their own, with their identifiable address."""
    places = identifiable_addresses(addresses).select(*KEY, *PLACE)
    return without_duplicate_keys(contributions).join(places, KEY)


def combined(contributions: DataFrame, addresses: DataFrame) -> DataFrame:
    """All contributions, with an address where one is identifiable; keep partitioned by STATE when written."""
    found = state_addresses(contributions, addresses).select(*KEY, *PLACE)
    return contributions.join(found, KEY, "left")


def important_duplicates(df: DataFrame, fields: list[str]) -> DataFrame:
    """Keys with one group of rows that agree in the important fields, repeated, and no other such group."""
    groups = nonempty_key(df).groupBy(*KEY, *fields).agg(F.count("*").alias("c")).where("c > 1")
    return groups.groupBy(*KEY).agg(F.count("*").alias("groups"), F.sum("c").alias("n_rows")).where("groups = 1")
