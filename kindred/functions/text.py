"""Column functions over names, affiliations and other short strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is taken out of a name before it is parsed.
NAME_JUNK = (
    "MS MISS MRS MR MASTER REV FR DR MD ATTY PROF HON PRES GOV COACH OFC MSGR SR BR SUPT REP SEN AMB TREAS SEC PVT CPL SGT ADM MAJ CAPT CMDR LT COL GEN "
    "ESQ ESQUIRE JR JNR SR SNR II III IV AND THE IS ARE TO BUT OVER AT HONORABLE JUDGE"
).split()
#: What is taken out of an employer before its tokens are compared.
EMPLOYER_JUNK = ["AND", "WITH", "CO"]
#: Patterns of employers and occupations that say little. The blanks stand for line breaks in the
#: published pattern; "docto\br" holds a word boundary where none was meant, and never matches.
BAD_EMPLOYER = (
    r"\bNA\b|N\.A|employed|self|N\/A|\n                |information request|retired|teacher\b|scientist\b|\n                |applicable|not employed|none|"
    r"\n                |homemaker|requested|executive|educator\b|\n                |attorney\b|physician|real estate|"
    r"\n                |student\b|unemployed|professor\b|refused|docto\br|housewife|\n                |at home|president|best effort|consultant\b|"
    r"\n                |email sent|letter sent|software engineer|CEO|founder|lawyer\b|\n                |instructor\b|chairman\b"
)
BAD_OCCUPATION = r"unknown|requested|retired|none|retire|retited|ret\b|declined|N.A\b|refused|NA\b|employed|self"


def junk_pattern(words: list[str]) -> str:
    return "|".join(rf"\b{w}\b" for w in words)


def strip(s: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def without_name_junk(name: Column) -> Column:
    return F.regexp_replace(name, junk_pattern(NAME_JUNK), "")


def split_name(name: Column) -> Column:
    """struct<last, middle, first> of "LAST, FIRST M"; without a comma the first word is the last name.

    A single letter right of the comma is the middle name. Of several, the first one is; the first name is then what
    stands before it, or else the longest word, or else the second letter.
    """
    clean = F.regexp_replace(without_name_junk(F.coalesce(name, F.lit(""))), "[.0-9]", " ")
    comma = F.instr(clean, ",")
    right = F.split(strip(F.translate(F.substring(clean, comma + 1, F.length(clean)), ",", " ")), " ")
    letters = F.filter(right, lambda t: F.length(t) == 1)
    sizes = F.transform(right, F.length)
    at = F.array_position(sizes, 1).cast("int")
    longest = F.element_at(right, F.greatest(F.array_position(sizes, F.array_max(sizes)), F.lit(1)).cast("int"))

    def joined(start: Column | int, n: Column) -> Column:
        return F.array_join(F.slice(right, start, F.greatest(n, F.lit(0))), " ")

    before, after = joined(1, at - 1), joined(F.greatest(at + 1, F.lit(1)), F.size(right) - at)
    middle = F.when(F.size(right) == 1, "").when(F.size(letters) == 0, joined(2, F.size(right) - 1)).otherwise(F.get(letters, F.lit(0)))
    first = (
        F.when((F.size(right) == 1) | (F.size(letters) == 0), F.get(right, F.lit(0)))
        .when(F.size(letters) == 1, F.concat_ws(" ", F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))))
        .when(at > 1, before)
        .when(F.array_max(sizes) == 1, F.get(letters, F.lit(1)))
        .otherwise(longest)
    )
    words = F.split(clean, " ")
    plain = F.struct(F.get(words, F.lit(0)).alias("last"), F.lit("").alias("middle"), F.array_join(F.slice(words, 2, F.size(words)), " ").alias("first"))
    return F.when(comma > 1, F.struct(F.substring_index(clean, ",", 1).alias("last"), middle.alias("middle"), first.alias("first"))).otherwise(plain)


def with_names(df: DataFrame, name: str) -> DataFrame:
    """``df`` with last_name, middle_name and first_name, by the rules of ``split_name``.

    The parts that several results need are columns of projections of their own, so each is made once a row.
    """
    clean = F.regexp_replace(without_name_junk(F.coalesce(name, F.lit(""))), "[.0-9]", " ")
    df = df.withColumn("_clean", clean).withColumn("_comma", F.instr("_clean", ","))
    right = F.split(strip(F.translate(F.expr("substring(_clean, _comma + 1)"), ",", " ")), " ")
    df = df.withColumn("_right", F.when(F.col("_comma") > 1, right).otherwise(F.split("_clean", " ")))
    df = df.withColumn("_sizes", F.transform("_right", F.length)).withColumns({"_ones": F.expr("size(filter(_sizes, n -> n = 1))"), "_at": F.array_position("_sizes", 1).cast("int"), "_n": F.size("_right")})
    middle = """case when _comma <= 1 or _n = 1 then '' when _ones = 0 then array_join(slice(_right, 2, _n), ' ') else _right[_at - 1] end"""
    first = """case when _comma <= 1 then array_join(slice(_right, 2, _n), ' ')
        when _n = 1 or _ones = 0 then _right[0]
        when _ones = 1 then concat_ws(' ', nullif(array_join(slice(_right, 1, greatest(_at - 1, 0)), ' '), ''), nullif(array_join(slice(_right, _at + 1, _n), ' '), ''))
        when _at > 1 then array_join(slice(_right, 1, greatest(_at - 1, 0)), ' ')
        when array_max(_sizes) = 1 then _right[1]
        else _right[int(array_position(_sizes, array_max(_sizes))) - 1] end"""
    last = "case when _comma > 1 then substring_index(_clean, ',', 1) else _right[0] end"
    df = df.withColumns({"last_name": F.expr(last), "middle_name": F.expr(middle), "first_name": F.expr(first)})
    return df.drop("_clean", "_comma", "_right", "_sizes", "_ones", "_at", "_n")


def bad_employer(s: Column) -> Column:
    return _bad(s, BAD_EMPLOYER)


def bad_occupation(s: Column) -> Column:
    return _bad(s, BAD_OCCUPATION)


def _bad(s: Column, pattern: str) -> Column:
    s = F.coalesce(s, F.lit(""))
    return (s == "") | s.rlike("(?i)" + pattern)


def employer_tokens(e: Column) -> Column:
    """Words of more than three letters, without junk and punctuation."""
    plain = strip(F.regexp_replace(F.regexp_replace(e, junk_pattern(EMPLOYER_JUNK), ""), r"[.,\-&\\/]", " "))
    return F.array_distinct(F.filter(F.split(plain, " "), lambda t: F.length(t) > 3))


def tokens_permuted(a: Column, b: Column) -> Column:
    """Two words in common, or one of six letters or more."""
    common = F.array_intersect(employer_tokens(a), employer_tokens(b))
    return (F.size(common) >= 2) | ((F.size(common) == 1) & (F.length(F.get(common, F.lit(0))) >= 6))


def ascii_upper(s: Column) -> Column:
    """Upper case without other characters than ASCII; null for nothing."""
    return F.nullif(F.upper(F.regexp_replace(s, r"[^\x00-\x7F]", "")), F.lit(""))


def zip5(z: Column) -> Column:
    return F.substring(z, 1, 5)


def single_word(s: Column) -> Column:
    return ~s.rlike(r"[ .,|\\/\-\t]")


def rejected_name(name: Column) -> Column:
    """Too short, or with a space or quote: not to be searched for."""
    return (F.length(name) < 3) | name.contains(" ") | name.contains("'") | name.contains('"')


def sorted_letters(s: Column) -> Column:
    return F.array_join(F.array_sort(F.split(s, "")), "")


def sorted_distance(a: Column, b: Column) -> Column:
    """Edit distance of the sorted letters, which forgives transpositions."""
    return F.levenshtein(sorted_letters(a), sorted_letters(b))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Edit distance below a share of the longer string."""
    return F.levenshtein(a, b) < F.greatest(F.length(a), F.length(b)) * tolerance


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two strings of one length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def dashed_date(d: Column) -> Column:
    """yyyymmdd to yyyy-mm-dd."""
    return F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))


def common_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.split(a, " "), F.split(b, " "))


def has_words(name: Column, *words: str) -> Column:
    """All words occur in the name as whole tokens, whatever their case."""
    tokens = F.split(F.upper(name), r"[^A-Z0-9']+")
    found = F.lit(True)
    for w in words:
        found = found & F.array_contains(tokens, w.upper())
    return found


def matches(column: Column, pattern: str) -> Column:
    """Unanchored regular expression without regard to case."""
    return column.rlike("(?i)" + pattern)
