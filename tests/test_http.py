"""Fetches and peers against a server of this machine."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tarn.functions.scalars import fetch_outcome
from tarn.operators import crawl, federation
from tarn.sources import robots
from tarn.sources.http import HttpPeers, fetched, raw_texts

RESULT = {"title": "T", "url": "https://a.b/1", "snippet_html": "s", "source": "local", "timestamp": 5, "score": 2.0}


class Site(BaseHTTPRequestHandler):
    seen: list = []

    def log_message(self, *args):
        pass

    def say(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):  # noqa: N802
        self.seen.append((self.path, self.headers.get("User-Agent"), self.headers.get("If-None-Match"), self.headers.get("If-Modified-Since")))
        path, _, rest = self.path.partition("?")
        if path == "/page":
            if self.headers.get("If-None-Match") == '"v1"':
                return self.say(304)
            return self.say(200, "<title>é</title>".encode("latin-1"), Content_Type="text/HTML; charset=latin-1", ETag='"v1"', Last_Modified="then")
        if path == "/hop":
            left = int(rest)
            return self.say(302, Location=f"/hop?{left - 1}" if left else "/page")
        if path == "/slow":
            return self.say(429, Retry_After="7")
        if path == "/pdf":
            return self.say(200, b"%PDF", Content_Type="application/pdf")
        if path == "/robots.txt":
            return self.say(200, b"User-agent: *\nDisallow: /private\xff", Content_Type="text/plain")
        if path == "/good/api/collections":
            return self.say(200, json.dumps({"collections": [{"name": "c", "description": None}, {"name": "d", "description": "x"}]}).encode())
        return self.say(500 if path.startswith("/bad") else 404)

    def do_POST(self):  # noqa: N802
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, asked))
        if self.path == "/good/api/search":
            body = f": hi\n\nevent: source_complete\ndata: {{}}\n\nevent: result\ndata: {json.dumps(RESULT)}\n\nevent: complete\ndata: {{}}\n\nevent: result\ndata: broken\n\n"
            return self.say(200, body.encode(), Content_Type="text/event-stream")
        if self.path == "/odd/api/search":
            return self.say(200, f"event: result\ndata: {json.dumps(RESULT)}\n\nevent: result\ndata: broken\n\n".encode(), Content_Type="text/event-stream")
        return self.say(500)


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_fetches(spark, site):
    urls = ["/page", "/hop?3", "/hop?9", "/slow", "/pdf", "/none"]
    rows = [(site + u, None, None) for u in urls] + [(site + "/page?known", '"v1"', "then"), ("http://127.0.0.1:1/", None, None), ("no url", None, None)]
    got = {r.url.removeprefix(site): r for r in fetched(spark.createDataFrame(rows, "url string, etag string, last_modified string"), "me/1", 5, 0).withColumn("outcome", fetch_outcome("status", "content_type")).collect()}
    assert len(got) == len(rows)
    page = got["/page"]
    assert (page.status, page.body, page.etag, page.last_modified, page.outcome, page.error) == (200, "<title>é</title>", '"v1"', "then", "fresh", None)
    assert (got["/hop?3"].status, got["/hop?3"].final_url) == (200, site + "/page")
    assert got["/hop?9"].outcome != "fresh" and got["/hop?9"].body is None
    assert (got["/slow"].outcome, got["/slow"].retry_after) == ("rate_limited", "7")
    assert (got["/pdf"].outcome, got["/pdf"].body) == ("not_html", None)
    assert got["/none"].outcome == "other_status" and got["/page?known"].outcome == "not_modified"
    for u in ("http://127.0.0.1:1/", "no url"):
        assert got[u].status is None and got[u].error and got[u].outcome == "error"
    assert ("/page?known", "me/1", '"v1"', "then") in Site.seen


def test_fetches_become_pages(spark, site):
    """From requests to rows of pages and the run's counters, failures counted."""
    known = spark.createDataFrame([], "collection_id string, url string, etag string, last_modified string, content_hash string, last_status int, last_crawled_at long, indexed_content_hash string")
    asked = spark.createDataFrame([(f"{site}{u}", None, None) for u in ("/page", "/pdf", "/slow")] + [("http://127.0.0.1:1/", None, None)], "url string, etag string, last_modified string")
    answers = fetched(asked, delay=0, timeout=5).withColumn("collection_id", F.lit("c")).withColumn("content_hash", F.sha2("body", 256)).checkpoint()
    seen = crawl.outcomes(answers, known)
    assert tuple(crawl.run_stats(seen).first()) == (1, 1, 0, 2)
    assert [(r.url, r.last_status) for r in crawl.page_rows(seen, 9).collect()] == [(f"{site}/page", 200)]


def test_robots_over_http(spark, site):
    files = raw_texts(spark.createDataFrame([(f"{site}/robots.txt",), (f"{site}/none",)], "url string"), delay=0)
    got = {r.url.removeprefix(site): r.body for r in files.collect()}
    assert got == {"/robots.txt": "User-agent: *\nDisallow: /private�", "/none": None}
    rules = robots.robots_rules(files.filter("body is not null").select(F.lit(site).alias("origin"), "body"), "tarn")
    assert rules.first().rules[0].path.startswith("/private")


def test_peers(spark, site):
    peers = spark.createDataFrame([(f"{site}/good/", "r1"), (f"{site}/odd", "r2"), (f"{site}/bad", "r3"), ("http://127.0.0.1:1", "r4")], "peer_url string, remote_collection string")
    client = HttpPeers(5)
    rows = client.search(peers, "rust", 1).collect()
    by = {r.remote_collection: r for r in rows}
    assert len(rows) == 4 and ("/good/api/search", {"query": "rust", "collection": "r1", "depth": 1}) in Site.seen
    assert (by["r1"].title, by["r1"].score, by["r1"].error) == ("T", 2.0, None) and by["r1"].elapsed_ms >= 0
    assert all(by[k].error and by[k].url is None for k in ("r2", "r3", "r4"))
    known = peers.withColumn("source_weight", F.lit(0.5))
    merged = federation.peer_results(client.search(peers, "rust").filter("error is null"), known).collect()
    assert [(r.score, r.source) for r in merged] == [(1.0, f"peer:{site}/good//r1")]
    assert {(r.peer_url.removeprefix(site), r.name, r.error is None) for r in client.list_collections(peers.limit(1).union(peers.filter("remote_collection = 'r3'"))).collect()} == {("/good/", "c", True), ("/good/", "d", True), ("/bad", None, False)}
    assert {r.url.removeprefix(site): r.healthy for r in client.health_check(peers).collect()} == {"/good/": True, "/odd": False, "/bad": False, "http://127.0.0.1:1": False}
