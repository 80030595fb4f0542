"""URL rules by filter cascades against a plain walk through the rules."""

import random

import pytest
from pyspark.sql import functions as F

from itemloom.llm import url_filters
from itemloom.llm.url_filters import build_cascade, judge_urls, learn_filter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "https://a.b.NET/?q#f", "x://example.net/en/1?a=/de/",
    "http://notexample.com/de/", "http://example.com/de", "http://example.com/de/", "http://www.Example.com/de/x#/en/", "http://é.org/fr/é",
    "http://org/fr/", "http://org/fr", "http://a..net/", "http://net./", "http://user@example.com:80/de/", "a://b://net/", "http://example.com?/de/",
    "http://" + "a." * 2_000 + "net/" + "x" * 20_000, "http://h.org/FR/", "http://ORG/fr/\n", "http://net/", "http://net/",
]


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host, rest = (rest[: ends[0]], rest[ends[0] :]) if ends else (rest, "")
    path = rest[: min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judged(url, rules):
    host, path = parts_of(url)
    fits = [
        (len(h + p), len(h), h + p, v == "block", v)
        for v, h, p in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return (host, path, best[2], best[4]) if best else (host, path, None, "allow")


def frame_of(spark, urls):
    rows = [(i, u, "rule", "verdict", "host", "path") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string, host string, path string").repartition(3)


def check(spark, urls, rules):
    pages = frame_of(spark, urls)
    listed = spark.createDataFrame(rules, "verdict string, host string, path string")
    found = judge_urls(pages, learn_filter(pages, listed)).select("row.page_id", "row.rule", "host", "path", F.col("rule"), "verdict")
    expected = [(i, "rule", *judged(u, rules)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_hard_urls(spark):
    check(spark, URLS, RULES)


@pytest.mark.parametrize("rules", [[("allow", "net", "/")], [("block", "", ""), ("allow", "net", "")], [("block", "net", "/"), ("allow", "net", "/")]])
def test_other_rules(spark, rules):
    check(spark, URLS, rules)


def test_no_rules_and_no_urls(spark):
    pages = frame_of(spark, URLS)
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {(r.rule, r.verdict) for r in judge_urls(pages, learn_filter(pages, none)).collect()} == {(None, "allow")}
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    assert judge_urls(pages.limit(0), learn_filter(pages.limit(0), rules)).collect() == []


def test_many_rules(spark):
    make = random.Random(5)
    hosts = [f"{a}.{b}" for a in "abcdefghij" for b in ("com", "net")] + ["com"]
    rules = list({(h, p): (make.choice(["block", "allow"]), h, p) for h in make.sample(hosts, 12) for p in ("/", "/x/", "/xy")}.values())
    urls = [f"http://{make.choice(['', 'www.', 'm.'])}{make.choice(hosts)}{make.choice(['', '/', '/x', '/x/1', '/xyz'])}" for _ in range(400)]
    check(spark, urls, rules)


@pytest.mark.parametrize("bits", [1, 10])
def test_cascades_are_exact_on_their_universe(spark, monkeypatch, bits):
    """With one bit a key many levels are needed; membership stays exact."""
    monkeypatch.setattr(url_filters, "BITS_PER_KEY", bits)
    universe = spark.range(6_000).select(F.concat(F.lit("key"), F.col("id")).alias("key"))
    listed = universe.where("hash(key) % 7 = 0")
    cascade = build_cascade(listed.union(listed).union(spark.sql("SELECT CAST(NULL AS STRING) AS key")), universe)
    assert len(cascade.levels) >= 2 and (bits == 10 or len(cascade.levels) > 3)
    found = universe.select("key", cascade.contains(F.col("key")).alias("found"))
    assert found.where("found <> (hash(key) % 7 = 0)").count() == 0


def test_plan_has_no_join_or_exchange(spark):
    pages = frame_of(spark, URLS)
    known = learn_filter(pages, spark.createDataFrame(RULES, "verdict string, host string, path string"))
    plan = judge_urls(pages.coalesce(1), known)._jdf.queryExecution().executedPlan().toString()
    body = plan.split("Subquery", 1)[0]
    assert "Join" not in plan and "Python" not in plan and "Exchange" not in body


def test_too_large_lists_are_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "MOST_WORDS", 2)
    keys = spark.range(100).select(F.col("id").cast("string").alias("key"))
    with pytest.raises(ValueError):
        build_cascade(keys, keys)
