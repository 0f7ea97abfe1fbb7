"""Tokens of records, their counts, and token counts over persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import ascii_upper, with_names, zip5

#: Token types.
LAST, FIRST, MIDDLE, ZIP, STREET, AFFILIATION, FULL = 1, 2, 3, 4, 5, 67, 123
#: Names as rare as this count as misspelt.
RARE = 2


def normalised(records: DataFrame) -> DataFrame:
    """Records with last_name, middle_name, first_name, employer, occupation, address and zip."""
    return with_names(records, "NAME").withColumns({
        "employer": F.coalesce(ascii_upper(F.col("EMPLOYER")), F.lit("")), "occupation": F.coalesce(ascii_upper(F.col("OCCUPATION")), F.lit("")),
        "address": F.col("CONTRIBUTOR_STREET_1"), "zip": zip5(F.col("ZIP_CODE")),
    })


def _words(column: str, kind: int) -> Column:
    return F.transform(F.filter(F.split(column, " "), lambda w: w != ""), lambda w: F.struct(F.lit(kind).alias("type"), w.alias("tok")))


def name_tokens() -> Column:
    """Words of the last and first name and the middle initial."""
    initial = F.when(F.col("middle_name") != "", F.array(F.struct(F.lit(MIDDLE).alias("type"), F.substring("middle_name", 1, 1).alias("tok")))).otherwise(F.array())
    return F.concat(_words("last_name", LAST), _words("first_name", FIRST), initial)


def field_tokens() -> Column:
    """Words of employer, occupation and street, and the zip code."""
    return F.concat(_words("employer", AFFILIATION), _words("occupation", AFFILIATION), _words("address", STREET), _words("zip", ZIP))


def bigrams(column: str, kind: int) -> Column:
    """Pairs of neighbouring letters inside the words."""
    words = F.filter(F.split(column, r"\s+"), lambda w: F.length(w) >= 2)
    pairs = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    return F.transform(pairs, lambda p: F.struct(F.lit(kind).alias("type"), p.alias("tok")))


def name_bigrams() -> Column:
    return F.concat(name_tokens(), bigrams("last_name", LAST), bigrams("first_name", FIRST))


def vectors(records: DataFrame, tokens: Column) -> DataFrame:
    """id and the set of tokens of every record."""
    return records.select("id", F.array_sort(F.array_distinct(tokens)).alias("tokens"))


def token_counts(records: DataFrame, tokens: Column, *by: str) -> DataFrame:
    """How often each token occurs, for each group of ``by`` or in all."""
    flat = records.select(*by, F.explode(tokens).alias("t"))
    return flat.groupBy(*by, F.col("t.type").alias("type"), F.col("t.tok").alias("tok")).agg(F.count("*").alias("cnt"))


def dominant(members: DataFrame, attributes: list[str], identity: str = "identity") -> DataFrame:
    """(identity, attr, value, n): the most frequent value that is not empty; of equals the smallest."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in attributes])).alias("p")
    flat = members.select(identity, pairs).select(identity, "p.attr", "p.value").where("value <> ''")
    counts = flat.groupBy(identity, "attr", "value").agg(F.count("*").alias("n"))
    return counts.groupBy(identity, "attr").agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b")).select(identity, "attr", "b.value", (-F.col("b.m")).alias("n"))


def with_full_names(members: DataFrame) -> DataFrame:
    """Full names with the middle name, where there is one, and without."""
    return members.withColumns({
        "full_with": F.when(F.col("middle_name") != "", F.concat_ws("|", "last_name", "middle_name", "first_name")).otherwise(""),
        "full_without": F.concat_ws("|", "last_name", F.lit(""), "first_name"),
    })


def person_tokens(members: DataFrame, identity: str = "identity") -> DataFrame:
    """(type, tok, cnt): how many persons have a token as the dominant value of an attribute."""
    kinds = {"first_name": FIRST, "last_name": LAST, "middle_name": MIDDLE, "full_with": FULL, "full_without": FULL, "employer": AFFILIATION, "occupation": AFFILIATION}
    best = dominant(with_full_names(members), list(kinds), identity)
    kind = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])
    return best.groupBy(kind[F.col("attr")].alias("type"), F.col("value").alias("tok")).agg(F.count("*").alias("cnt"))


def with_frequency(df: DataFrame, counts: DataFrame, kind: int, column: str, out: str) -> DataFrame:
    """Add how often the value of ``column`` occurs as a token of a type; 0 if never."""
    held = counts.where(F.col("type") == kind).select(F.col("tok").alias("_tok"), F.col("cnt").alias("_cnt"))
    return df.join(held, df[column] == held["_tok"], "left").withColumn(out, F.coalesce("_cnt", F.lit(0))).drop("_tok", "_cnt")


def name_variants(lists: DataFrame) -> DataFrame:
    """(name, variants) from lists of names that go for one another."""
    a = lists.select("list_id", F.explode("names").alias("name"))
    pairs = a.join(a.withColumnRenamed("name", "other"), "list_id").where("name <> other")
    return pairs.groupBy("name").agg(F.array_sort(F.collect_set("other")).alias("variants"))


def multi_state(members: DataFrame, identity: str = "identity") -> DataFrame:
    return members.groupBy(identity).agg(F.array_sort(F.collect_set("STATE")).alias("states")).where(F.size("states") > 1)


def timeline(members: DataFrame, person: str, when: str, what: str, order: str = "id") -> DataFrame:
    """(person, when, what, step) in order of date."""
    w = Window.partitionBy(person).orderBy(when, order)
    return members.withColumn("step", F.row_number().over(w)).select(person, when, what, "step")
