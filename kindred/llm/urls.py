"""URL filters: host and path rules, then association rules mined by Spark's FP-growth.

Every labelled URL is a transaction: its tokens and, if its document is bad, the item ``=bad``. Rules whose
consequent is that item stay if enough URLs support them, if their confidence is high enough even at the lower end of
its Wilson interval, and if their lift is; a rule goes if one with fewer tokens has at least its confidence. Where
labels have nothing to do with URLs no rule stays, and only the given rules block. Rules are matched by an inverted index: each stands under its
rarest token, and only the rules under a URL's own tokens are looked at.

Rows: a null URL, or one without ``://``, has an empty host and path; a null one has no tokens. Every row is judged by
itself, so page_ids may be missing or repeated. Labels without a page or without figures are not learned from; without
any bad and any good label no rule is mined. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import rows, written

BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Mining:
    #: Labelled URLs learned from, about this many by a hash of their id.
    train_urls: int = 200_000
    #: A rule is supported by so many bad URLs, and by this share of all that are learned from.
    min_urls: int = 10
    min_share: float = 0.0002
    min_confidence: float = 0.7
    #: Standard deviations between a confidence and the lower end of its interval, which has to reach the least one.
    z: float = 1.96
    min_lift: float = 1.5
    #: Rules that a task holds at a time; more are matched in further passes.
    slice_rules: int = 50_000


#: (verdict, host, path): what the contract of the registered query fixes.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The rule and verdict of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(url: str | None) -> list[str]:
    """Tokens of a URL by where they stand: h: host, p: path, q: query and fragment; numbers are one token."""
    if not url:
        return []
    rest = url.lower().partition("://")[2] or url.lower()
    found = set()
    for mark, part in zip("hpq", re.match(r"([^/?#]*)([^?#]*)(.*)", rest, re.S).groups(), strict=True):
        found.update(f"{mark}:{'#' if w.isdigit() else w}" for w in WORD.findall(part))
    return sorted(found)


def transactions(pages: DataFrame, labels: DataFrame, mining: Mining) -> DataFrame:
    """items array<string> of the labelled URLs (pages: page_id, url; labels: doc_id, quality, toxic)."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    known = known.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    some = pages.selectExpr("page_id", "url").where("url is not null").join(known, F.col("page_id") == F.col("doc_id")).select("page_id", "url", "bad")
    total = some.count()
    if total > mining.train_urls:
        some = some.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < int(mining.train_urls / total * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [tokens(u.decode()) + [BAD] * bad for u, bad in rows(batch, "url", "bad")]
            yield pa.RecordBatch.from_pydict({"items": pa.array(items, pa.list_(pa.string()))})

    return some.select("url", "bad").mapInArrow(run, "items array<string>")


def wilson(share: Column, n: Column, z: float) -> Column:
    """Lower end of the Wilson interval of a share of ``n``."""
    middle = share + z * z / 2 / n
    return (middle - z * F.sqrt(share * (1 - share) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def mined_rules(items: DataFrame, mining: Mining) -> DataFrame:
    """antecedent array<string>, confidence, lift, support of the rules for ``=bad`` that stay."""
    spark = items.sparkSession
    items = written(items, "transactions")
    total = items.count()
    bad = items.where(F.array_contains("items", BAD)).count()
    schema = "antecedent array<string>, confidence double, lift double, support double"
    if not bad or bad == total:
        return spark.createDataFrame([], schema)
    least = max(mining.min_urls / total, mining.min_share)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least), minConfidence=mining.min_confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & (F.col("lift") >= mining.min_lift))
    rules = rules.where(wilson(F.col("confidence"), F.col("support") / F.col("confidence") * total, mining.z) >= mining.min_confidence)
    rules = written(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support"), "rules")
    none = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate("antecedent", none, lambda held, t: F.concat(held, F.transform(held, lambda s: F.array_append(s, t))))
    parts = rules.select("antecedent", "confidence", F.explode(subsets).alias("part")).where("0 < size(part) and size(part) < size(antecedent)")
    shorter = rules.selectExpr("antecedent part", "confidence least")
    worse = parts.join(shorter, "part").where("least >= confidence").select("antecedent").distinct()
    return rules.join(worse, "antecedent", "left_anti")


class RuleIndex:
    """Inverted index of some rules: each under the token that the fewest rules have."""

    def __init__(self, rules: list[tuple[list[str], float]]) -> None:
        often = defaultdict(int)
        for antecedent, _ in rules:
            for t in antecedent:
                often[t] += 1
        self.under: dict[str, list[tuple[frozenset[str], float]]] = defaultdict(list)
        for antecedent, confidence in sorted(rules):
            self.under[min(antecedent, key=lambda t: (often[t], t))].append((frozenset(antecedent), confidence))

    def best(self, found: list[str]) -> float:
        """Highest confidence of the rules that fit a URL's tokens; 0 if none does."""
        own = set(found)
        return max((c for t in found for rule, c in self.under.get(t, ()) if rule <= own), default=0.0)


def matched(urls: DataFrame, rules: DataFrame, mining: Mining) -> DataFrame:
    """``urls`` (page_id, url) and the highest confidence of a mined rule, without a shuffle of the urls."""
    spark = urls.sparkSession
    rules = rules.select("antecedent", "confidence")
    slices = -(-rules.count() // mining.slice_rules)

    def through(urls: DataFrame, k: int) -> DataFrame:
        own = rules.where(F.pmod(F.xxhash64("antecedent"), F.lit(slices)) == k)
        shared = spark.sparkContext.broadcast(sorted((r.antecedent, r.confidence) for r in own.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = RuleIndex(shared.value)
            for batch in batches:
                best = [max(c, index.best(tokens(u.decode() if u is not None else None))) for u, c in rows(batch, "url", "confidence")]
                yield batch.set_column(batch.schema.names.index("confidence"), "confidence", pa.array(best, pa.float64()))

        return urls.mapInArrow(run, urls.schema)

    return reduce(through, range(slices), urls.withColumn("confidence", F.lit(0.0)))


def judged(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, mining: Mining | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the mined confidence of every page."""
    mining = mining or Mining()
    mined = mined_rules(transactions(pages, labels, mining), mining)
    host, path = host_and_path(F.col("url"))
    found = matched(pages.select("page_id", "url"), mined, mining).withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("confidence") > 0, "block").otherwise("allow")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "confidence")
