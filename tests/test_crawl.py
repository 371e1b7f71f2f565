from __future__ import annotations

from tarn.functions import html
from tarn.operators import crawl, outlinks
from tarn.sources import robots

PAGE = """<html><head><title> A &amp; B </title><style>x</style><link rel="canonical alternate" href="/canon"></head>
<body><p>Hello <b>big</b> world<script>no("</p>")</script><noscript>no</noscript>
<a href="/a?x=1">first <i>link</i></a><a href="#top">t</a><a href="mailto:x@y">m</a><a href="JavaScript:x">j</a><a href="https://o.example">out</a><a>none</a></body></html>"""


def test_extraction():
    p = html.parse(PAGE, "https://h.example/dir/page")
    assert p["title"] == "A & B"
    assert p["text"] == "Hello big world first link t m j out none"
    assert p["canonical"] == "https://h.example/canon"
    assert p["links"] == [{"url": "https://h.example/a?x=1", "text": "first link"}, {"url": "https://o.example/", "text": "out"}]


def test_extraction_of_odd_pages():
    assert html.parse(None, "https://h.example/") is None
    assert html.parse("", "https://h.example/") == {"title": "", "text": "", "canonical": None, "links": []}
    assert html.parse("<p>open <b>tags", "https://h.example/")["text"] == "open tags"


FETCH = "collection_id string, url string, status int, content_type string, etag string, last_modified string, content_hash string"
KNOWN = "collection_id string, url string, etag string, last_modified string, content_hash string, last_status int, last_crawled_at long, indexed_content_hash string"


def test_outcomes_write_what_they_should(spark):
    fetches = spark.createDataFrame([("c", f"u{s}", s, "text/html", "new", None, "h2") for s in (200, 304, 404, 429)] + [("c", "pdf", 200, "application/pdf", "new", None, "h2")], FETCH)
    known = spark.createDataFrame([("c", f"u{s}", "old", "lm", "h1", 200, 1, "h1") for s in (200, 304, 404, 429)], KNOWN)
    seen = crawl.outcomes(fetches, known)
    got = {r.url: (r.etag, r.content_hash, r.last_status, r.indexed_content_hash) for r in crawl.merge_pages(known, crawl.page_rows(seen, 9)).collect()}
    assert got == {"u200": ("new", "h2", 200, "h1"), "u304": ("old", "h1", 304, "h1"), "u404": ("old", "h1", 404, "h1"), "u429": ("old", "h1", 200, "h1")}
    assert [r.url for r in crawl.needs_index(seen).collect()] == ["u200"]
    assert tuple(crawl.run_stats(seen).first()) == (3, 1, 1, 1)


def test_frontier_is_first_in_first_out(spark):
    seeds = spark.createDataFrame([("s", 0)], "url string, pos int")
    links = spark.createDataFrame([("s", "b", 0), ("s", "a", 1), ("a", "c", 0), ("b", "e", 0), ("b", "d", 1), ("d", "s", 0), ("e", "f", 0)], "source_url string, target_url string, pos int")
    order = lambda n: [r.url for r in crawl.frontier(seeds, links, n).orderBy("ord").collect()]
    assert order(100) == ["s", "b", "a", "e", "d", "c", "f"]
    assert order(4) == ["s", "b", "a", "e"]


def test_due(spark):
    targets = spark.createDataFrame([("1", "c", 100, None, True), ("2", "c", 100, 950, True), ("3", "c", 100, 900, True), ("4", "c", 100, None, False)], "id string, collection_id string, recrawl_interval_s long, last_crawled_at long, enabled boolean")
    collections = spark.createDataFrame([("c", "n")], "id string, name string")
    assert sorted(r.id for r in crawl.due_targets(targets, collections, 1000).collect()) == ["1", "3"]


HITS = "collection_id string, host string, source_url string, target_url string, link_text string, seen_at long, seq long"


def test_outlinks(spark):
    hits = spark.createDataFrame([("c", "h", f"s{k % 7}", "t", "x", 10 + k, k) for k in range(9)], HITS)
    r = outlinks.rollup(hits).first()
    assert (r.link_count, r.first_seen_at, r.last_seen_at, [e.source_url for e in r.examples]) == (9, 10, 18, ["s0", "s1", "s2", "s3", "s4"])


def test_decided_hosts_ignore_hits(spark):
    hits = spark.createDataFrame([("c", h, "s", "t", "x", 1, 1) for h in ("p", "d", "n")], HITS)
    before = outlinks.rollup(hits.filter("host <> 'n'")).selectExpr("*", "if(host = 'd', 'dismissed', 'pending') as status")
    got = {r.host: (r.link_count, r.status, len(r.examples)) for r in outlinks.recorded(before, hits).collect()}
    assert got == {"p": (2, "pending", 1), "d": (1, "dismissed", 1), "n": (1, "pending", 1)}
    promoted = outlinks.decide(before, before.filter("host = 'p'").select("collection_id", "host"), "promoted")
    assert {r.host: r.status for r in promoted.collect()} == {"p": "promoted", "d": "dismissed"}
    assert [r.url_prefix for r in outlinks.promoted_targets(before, before.filter("host = 'p'").select("collection_id", "host")).collect()] == ["https://p/"]


def test_reached_has_no_depth_limit(spark):
    links = spark.createDataFrame([(f"u{k}", f"u{k + 1}") for k in range(9)] + [("u9", "u0"), ("u0", "u2"), ("far", "away")], "source_url string, target_url string")
    got = crawl.reached(spark.createDataFrame([("u0",)], "url string"), links).collect()
    assert sorted((r.url, r.level) for r in got) == [("u0", 0), ("u1", 1)] + [(f"u{k}", k - 1) for k in range(2, 10)]


def test_throttling_aborts_after_a_run(spark):
    rows = [("c", k, 429 if k not in (0, 4) else 200) for k in range(12)]
    assert [tuple(r) for r in crawl.throttle_aborts(spark.createDataFrame(rows, "collection_id string, seq long, status int")).collect()] == [("c", 9)]


def test_retarget_skips_taken_prefixes(spark):
    targets = spark.createDataFrame([("1", "c", "http://a/"), ("2", "c", "https://a/"), ("3", "c", "http://b/")], "id string, collection_id string, url_prefix string")
    moves = spark.createDataFrame([("http://a/", "https://a/"), ("http://b/", "https://b/")], "url_prefix string, canonical string")
    assert {r.id: r.url_prefix for r in crawl.retargeted(targets, moves).collect()} == {"1": "http://a/", "2": "https://a/", "3": "https://b/"}


def test_robots(spark):
    body = "User-agent: tarn\nUser-agent: x\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 1.6\n# note\nUser-agent: *\nDisallow: /\nSitemap: https://a.b/s.xml"
    rules = robots.robots_rules(spark.createDataFrame([("https://a.b", body), ("https://n.b", None)], "origin string, body string"), "Tarn")
    paths = ["", "private", "private/open", "private/open/x", "other"]
    pages = spark.createDataFrame([(f"https://a.b/{p}",) for p in paths] + [("https://n.b/z",), ("https://unknown.b/",)], "url string")
    assert [r.allowed for r in robots.allowed(pages, rules).orderBy("url").collect()] == [True, True, False, True, True, True, True]
    r = rules.filter("origin = 'https://a.b'").first()
    assert (r.crawl_delay, r.sitemaps) == (2, ["https://a.b/s.xml"])


def test_sitemaps(spark):
    docs = spark.createDataFrame([("s", '<?xml version="1.0"?><!-- c --><urlset xmlns="x"><url><loc> https://a.b/1?a=1&amp;b=2 </loc></url><url><loc></loc></url></urlset>'), ("i", "<n:sitemapindex xmlns:n='x'><n:sitemap><n:loc>https://a.b/s</n:loc></n:sitemap></n:sitemapindex>")], "sitemap string, body string")
    assert sorted(map(tuple, robots.sitemap_urls(docs).collect())) == [("i", True, "https://a.b/s"), ("s", False, "https://a.b/1?a=1&b=2")]


def test_raw_text_is_lossy_and_cut(spark):
    from pyspark.sql import functions as F

    from tarn.operators.schedule import raw_text

    df = spark.createDataFrame([(bytearray(b"ab\xffcdef"), 200), (bytearray(b"x"), 404), (None, 200)], "b binary, s int")
    assert [r[0] for r in df.select(raw_text(F.col("b"), F.col("s"), 4)).collect()] == ["ab�c", None, None]


def test_a_tick_waits(spark):
    from tarn.operators.schedule import tick

    targets = spark.createDataFrame([("1", "c", 1, None, True), ("2", "c", 1, None, True)], "id string, collection_id string, recrawl_interval_s long, last_crawled_at long, enabled boolean")
    names, running = spark.createDataFrame([("c", "n")], "id string, name string"), targets.filter("id = '2'")
    assert [r.id for r in tick(targets, names, running, 5).collect()] == ["1"]
    assert tick(targets, names, running, 5, paused=True).count() == tick(targets, names, running, 5, full=True).count() == 0
