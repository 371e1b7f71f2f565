from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarn.functions import urls

NORMAL = [
    ("HTTPS://Example.COM/Path", "https://example.com/Path"),
    ("http://example.com:80/a", "http://example.com/a"),
    ("https://example.com:443/", "https://example.com/"),
    ("https://example.com:8443/", "https://example.com:8443/"),
    ("https://user:pw@example.com/x#frag", "https://example.com/x"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com?b=2&a=1", "https://example.com/?a=1&b=2"),
    ("https://example.com/?utm_source=x&UTM_Medium=y&q=1", "https://example.com/?q=1"),
    ("https://example.com/?fbclid=z", "https://example.com/"),
    ("https://example.com/?foo", "https://example.com/?foo="),
    ("https://example.com/?b=1&a=2&b=0", "https://example.com/?a=2&b=1&b=0"),
    ("https://example.com/?q=a%20b", "https://example.com/?q=a+b"),
    ("https://example.com/a/../b/./c", "https://example.com/b/c"),
    ("https://example.com/a/..", "https://example.com/"),
    ("not a url", None),
    ("/relative", None),
    (None, None),
]


@pytest.fixture(scope="module")
def one(spark):
    def run(expr, *values):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]

    return run


def test_normalize(spark):
    df = spark.createDataFrame(NORMAL, "u string, want string").withColumn("got", urls.normalize_url("u"))
    assert [(r.u, r.got) for r in df.collect()] == NORMAL


def test_normalize_is_idempotent(spark):
    df = spark.createDataFrame(NORMAL, "u string, want string").withColumn("a", urls.normalize_url("u")).withColumn("b", urls.normalize_url("a"))
    assert df.filter("not (a <=> b)").count() == 0


@pytest.mark.parametrize(
    ("url", "prefix", "want"),
    [
        ("https://www.example.com/foo", "https://example.com/", True),
        ("https://example.com/foo", "https://www.example.com/", True),
        ("http://example.com/foo", "https://example.com/", False),
        ("https://example.com/docs/a", "https://example.com/docs/", True),
        ("https://example.com/blog", "https://example.com/docs/", False),
        ("https://example.org/", "https://example.com/", False),
        ("nonsense", "https://example.com/", False),
    ],
)
def test_in_prefix(one, url, prefix, want):
    assert one(urls.in_prefix, url, prefix) is want


def test_hosts_differ_by_purpose(one):
    url = "https://me@WWW.Example.com:8080/x"
    assert one(urls.host_of, url) == "example.com"
    assert one(urls.index_host, url) == "www.example.com"
    assert one(urls.ranking_domain, url) == "www.example.com:8080"
    assert one(urls.ranking_domain, "https://a.b?x=1") == "a.b?x=1"
    assert one(urls.host_of, "mailto:a@b.c") is None
    assert one(urls.index_host, "mailto:a@b.c") == ""


@pytest.mark.parametrize(("url", "want"), [("https://m.facebook.com/x", True), ("https://facebook.com", True), ("https://notfacebook.com", False), ("https://i0.wp.com/a", True), ("junk", False)])
def test_blacklist(one, url, want):
    assert one(urls.is_blacklisted, url) is want


def test_resolve(one):
    assert one(urls.resolve_url, "https://a.b/c/d", "../e") == "https://a.b/e"


def test_canonical_prefix(spark):
    cases = [("https://a.b/s", "https://www.a.b/s/", 200, "https://www.a.b/s/"), ("https://a.b/s", "https://a.b/other", 200, None), ("https://a.b/s", "https://a.b/s", 200, None), ("https://a.b/s", "https://a.b/s/", 404, None)]
    df = spark.createDataFrame(cases, "asked string, final string, status int, want string")
    assert df.select(urls.canonical_prefix("asked", "final", "status"), "want").filter("not (#0 <=> want)".replace("#0", "`" + df.select(urls.canonical_prefix("asked", "final", "status")).columns[0] + "`")).count() == 0


def test_split_links(spark):
    links = spark.createDataFrame([("c", "https://a.b/x"), ("c", "https://www.a.b/y"), ("c", "https://z.b/x"), ("d", "https://a.b/x")], "collection_id string, target_url string")
    targets = spark.createDataFrame([("c", "https://a.b/"), ("c", "https://a.b/deep/")], "collection_id string, url_prefix string")
    got = {(r.collection_id, r.target_url): r.in_prefix for r in urls.split_links(links, targets).collect()}
    assert got == {("c", "https://a.b/x"): True, ("c", "https://www.a.b/y"): True, ("c", "https://z.b/x"): False, ("d", "https://a.b/x"): False}
