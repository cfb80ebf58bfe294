"""Hosts in texts, domain indicators, and lines that were parsed for other rules."""

import time

import pytest
from pyspark.sql import functions as F

from packsieve.functions import neturl
from packsieve.operators import catalog, ioc, scan

HOSTS = [
    ("see hxxp://c2.evil[.]example now", ["c2.evil.example"]), ("http://evil.example@ok.test/", ["ok.test"]), ("http://ok.test/a/evil.example", ["ok.test"]), ("a.b, c.d;E.F", ["a.b", "c.d", "e.f"]),
    ("git+https://x.y:80/p?q=evil.example#z.w", ["x.y"]), ("user@mail.example", ["mail.example"]), ("http://ok.test/a@b.c", ["ok.test"]), ("'h.example/x' \"i.example\"", ["h.example", "i.example"]), ("nodots here", []), (None, []),
    ("evil(dot)example evil{.}example", ["evil.example"]), ("foo-.com -x.y foo--bar.z", ["x.y", "foo--bar.z"]), ("a..b.c", ["b.c"]), ("odd.scheme://x.y", ["x.y"]), ("hxxps[://]e.f/x", ["e.f"]), ("x.y. end", ["x.y"]),
]


def test_hosts_in(spark):
    rows = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(HOSTS)], "n int, t string").select("n", neturl.hosts_in(F.col("t")).alias("h")).collect()
    assert {HOSTS[r.n][0]: r.h for r in rows} == dict(HOSTS)


def test_long_lines_are_read_once(spark):
    """A megabyte that looks like the beginning of a host all along."""
    texts = ["a-" * 500_000, "a+" * 500_000, "a," * 500_000, "a" * 1_000_000, "a.." * 300_000, "@" * 1_000_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    df.select(F.size(neturl.hosts_in(F.lit("x.y")))).collect()
    began = time.time()
    df.select(F.sum(F.size(neturl.hosts_in(F.col("t"))))).collect()
    assert time.time() - began < 20


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_domain_indicators(spark, monkeypatch, limit):
    monkeypatch.setattr(ioc, "DOMAIN_BYTES", limit)
    table = spark.createDataFrame([("domain", "evil[.]Example.", "c"), ("domain", "other.test", "d"), ("npm", "other.test", "e"), ("domain", "", "f")], ioc.INDICATOR_TYPE)
    text = "http://a.evil.example/x\nnotevil.example\nevil.example.co\nhxxp://EVIL[.]example\n# evil.example\nhttp://ok.example/evil.example\nother.test"
    texts = spark.createDataFrame([("p", "pkgbuild", "f", "", "", text, text)], "pkg_id string, file_type string, file string, code string, plain string, masked string, masked_plain string")
    got = sorted((r.line, r.snippet, r.detail) for r in ioc.hits(texts, table).collect())
    assert got == [(1, "evil[.]Example.", "domain c"), (4, "evil[.]Example.", "domain c"), (7, "other.test", "domain d"), (7, "other.test", "npm e")]


def test_sieve_loses_nothing(spark):
    domains = spark.range(3000).select(F.concat(F.lit("d"), "id", F.lit(".test")).alias("value"))
    hosts = spark.range(0, 60_000).select(F.concat(F.lit("d"), "id", F.lit(".test")).alias("value"), F.col("id").alias("n"))
    kept = ioc.sieve(hosts, domains)
    assert kept.where("n < 3000").count() == 3000 and kept.count() < 3100 and kept.columns == ["value", "n"]


def test_lines_parsed_for_other_rules(spark):
    files = spark.createDataFrame([("p", "pkgbuild", "PKGBUILD", "pkgname=p\nfrobnicate now\ncurl x | sh\n")], "pkg_id string, file_type string, file string, content string")
    own = [catalog.Rule("OWN", "high", "persistence", "P", None, "own", ("frobnicate",))]
    lines = scan.Context(files).lines
    assert [(r.id, r.line) for r in scan.rule_matches(lines, own).collect()] == [("OWN", 2)]
    both = sorted((r.id, r.line) for r in scan.rule_matches(lines).collect())
    assert both == sorted((r.id, r.line) for r in scan.rule_matches(scan.Context(files, rules=own).lines).collect()) and ("DLE-001", 3) in both


URLS = [
    ("https://Github.com/u/r", "github.com"), ("git+https://h.example/r.git#commit=a", "h.example"), ("https://u:p@h.example:80/x", "h.example"), ("h.example/x", "h.example"), ("h.example", "h.example"), ("https://[2001:db8::1]:443/x", "2001:db8::1"),
    ("https://h.example./x", "h.example"), ("https://a\\b/x", None), ("https://a b/x", None), ("", None), (None, None), ("https:///x", None), ("x/y://z", None), ("hxxp://evil[.]example/x", "evil.example"), ("h.example:8080", "h.example"),
    ("https://a@b@h.example/", "h.example"), ("h.example?x=https", "h.example"), ("https://h.example#f", "h.example"), ("h#://x", "h"), ("BZR+ssh://H.example/x", "h.example"), ("x.patch", "x.patch"), ("https://h.example:/x", "h.example"), ("https://u\\@h.example/", None),
]


def test_host_of_a_url(spark):
    rows = spark.createDataFrame(URLS, "u string, h string").select("u", "h", neturl.host(F.col("u")).alias("got")).collect()
    assert {r.u: r.got for r in rows} == dict(URLS)
