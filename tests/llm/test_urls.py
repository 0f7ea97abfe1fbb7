import math
from collections import Counter
from itertools import combinations

import pytest

from kindred.llm.urls import BAD, RULES, Mining, judged, mined_rules, tokens, transactions


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rules(items, m):
    """All rules for =bad by counting every combination."""
    n, count = len(items), Counter()
    for t in items:
        own = sorted(set(t) - {BAD})
        for k in range(len(own) + 1):
            for s in combinations(own, k):
                count[s, False] += 1
                count[s, True] += BAD in t
    rules = {}
    for (s, bad), c in count.items():
        if bad and s and c >= max(m.min_urls, m.min_share * n):
            confidence, k = c / count[s, False], count[s, False]
            low = (confidence + m.z**2 / 2 / k - m.z * math.sqrt(confidence * (1 - confidence) / k + (m.z / 2 / k) ** 2)) / (1 + m.z**2 / k)
            if low >= m.min_confidence and confidence * n / count[(), True] >= m.min_lift:
                rules[s] = confidence
    return {s: c for s, c in rules.items() if not any(rules.get(p, -1) >= c for k in range(1, len(s)) for p in combinations(s, k))}


def brute(pages, labels, m):
    bad = {}
    for i, q, t in labels:
        if i is not None and (q is not None or t is not None):
            bad[i] = bad.get(i, False) or q == 0 or t == 1
    items = [tokens(u) + [BAD] * bad[i] for i, u in pages if u is not None and i in bad]
    rules = brute_rules(items, m) if any(BAD in t for t in items) and not all(BAD in t for t in items) else {}
    out = []
    for i, u in pages:
        host, path = split(u)
        fits = [(len(h + p), h + p, k) for k, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, None))
        own = set(tokens(u))
        out.append((i, host, path, rule, verdict or ("block" if any(set(s) <= own for s in rules) else "allow")))
    return Counter(out), rules


def check(spark, pages, labels, m):
    p = spark.createDataFrame([(*x, "h") for x in pages], "page_id long, url string, rule string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want, rules = brute(pages, labels, m)
    got = {tuple(r.antecedent): r.confidence for r in mined_rules(transactions(p, lab, m), m).collect()}
    assert got == pytest.approx(rules)
    assert Counter(tuple(r)[:5] for r in judged(p, lab, mining=m).collect()) == want
    return rules


def test_pages_match_brute_force(spark):
    path = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{path}/pages.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{path}/labels.parquet").collect()]
    assert check(spark, pages, labels, Mining(min_urls=3, min_share=0, min_confidence=0.4, min_lift=1.1, slice_rules=4, z=0))


def test_edge_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q#f", "x://net", "http://net/", "http://sub.org/fr/1", "http://xorg/fr/", "http://example.com/de", "http://example.com/de/a", "http://a://b/c", "http://bad-site.com/a", "http://É.example.NET/En/" + "x" * 5000]
    pages = list(enumerate(urls)) + [(None, "http://bad-site.com/b"), (12, "http://bad-site.com/a")] + [(100 + i, f"http://{'bad-site' if i % 3 == 0 else 'fine'}.com/{i}") for i in range(60)]
    labels = [(100 + i, int(i % 3 != 0), 0) for i in range(60)] + [(100, 1, None), (101, None, None), (None, 0, 1), (999, 0, 1)]
    assert check(spark, pages, labels, Mining(min_urls=5, z=1))


def test_empty_tables(spark):
    check(spark, [], [], Mining())
    check(spark, [(1, "http://a.net/")], [], Mining())
    check(spark, [(1, "http://a.net/")], [(1, 0, 0)], Mining())


def test_planted_hosts_are_found_with_production_parameters(spark):
    """On the pages of a table as it is, labels follow two hosts and a combination of host and path."""
    pages = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    pages += [(10**6 + i, f"https://www.cheap-pills{i % 2}.example.com/en/{i}.html") for i in range(60)]
    pages += [(2 * 10**6 + i, f"https://files.example.com/{'warez' if i % 2 else 'docs'}/{i}") for i in range(80)]
    bad = {i for i, u in pages if "cheap" in u or "warez" in u}
    labels = [(i, int(i not in bad and i % 7 != 0), 0) for i, _ in pages]
    p = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = mined_rules(transactions(p, lab, Mining()), Mining()).collect()
    assert {"h:cheap"} in [set(r.antecedent) for r in rules] and {"p:warez"} in [set(r.antecedent) for r in rules]
    got = {r.page_id: r for r in judged(p, lab).collect()}
    assert all(got[i].verdict == "block" for i in bad if got[i].rule is None)
    blocked = [i for i, r in got.items() if r.rule is None and r.verdict == "block" and i not in bad]
    assert len(blocked) <= 0.01 * len(got)
