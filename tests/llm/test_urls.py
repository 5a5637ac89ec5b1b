import re

import pytest
from pyspark.sql import functions as F

from codexmill.llm import urls


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


URLS = [None, "", "example.net/en/", "http://example.net", "http://example.net/", "https://a.b.Example.NET/en/x?y=1#z", "http://myexample.net/en/", "http://example.com/de/x", "http://example.com/de", "http://x.org/fr/1", "http://org/fr/", "http://fr.org?/fr/", "http://a..net/x", "://net/", "http://net/", "http://http://net/", "ftp://u@w.net:80/a", "http://.net/a", "http://x.net/" + "p" * 5000]


def test_judges_like_brute_force(spark):
    rows = [(i, u, "h", "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], "h", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule_host string")
    got = urls.judge(pages, urls.rule_table(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id], urls.RULES)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_large_lists_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_BLOCKS", limit)
    monkeypatch.setattr(urls, "BROADCAST_ENTRIES", limit)
    rules = [(f"h{i}.example", "/" + "x" * (i % 4), "block" if i % 3 else "allow") for i in range(500)]
    pages = [(i, f"http://s{i}.h{i % 700}.example/{'x' * (i % 5)}") for i in range(1500)]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), urls.rule_table(spark, rules)).collect()
    assert all((r.host, r.path, r.rule, r.verdict) == brute(pages[r.page_id][1], rules) for r in got)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    rules = urls.rule_table(spark, [(f"h{i}", "/", "block") for i in range(2000)])
    blocks = 2000 * 12 // 512
    table = {r.block: [r[f"w{w}"] for w in range(8)] for r in urls.bloom(rules, blocks).collect()}
    probe = spark.createDataFrame([(f"{k}{i}", "/") for k in "hz" for i in range(2000)], "rule_host string, rule_path string")
    h = urls._hash(F.col("rule_host"), F.col("rule_path"))
    hits = {"h": 0, "z": 0}
    for r in probe.select("rule_host", F.pmod(h, F.lit(blocks)).alias("b"), urls._bits(h).alias("bits")).collect():
        words = table.get(r.b, [0] * 8)
        hits[r.rule_host[0]] += all(words[x // 64] >> (x % 64) & 1 for x in r.bits)
    assert hits["h"] == 2000 and hits["z"] < 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, urls.rule_table(spark)).count() == 0
    no_rules = spark.createDataFrame([], "rule_host string, rule_path string, rule_verdict string")
    got = urls.judge(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), no_rules).first()
    assert (got.rule, got.verdict) == (None, "allow")


def test_hot_urls_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls.common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(urls.common, "HOT_ROWS", 3)
    pages = [(i, u) for i, u in enumerate(["http://a.net/x"] * 9 + ["http://b.com/"] * 9 + [None] * 9 + ["nothing"] * 5 + ["http://c.net/"])]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), urls.rule_table(spark)).collect()
    assert len(got) == len(pages) and all((r.host, r.path, r.rule, r.verdict) == brute(pages[r.page_id][1], urls.RULES) for r in got)
