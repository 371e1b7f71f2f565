from __future__ import annotations

import json

import pytest

from tarn import config, queries
from tarn.functions import scalars
from tarn.operators import admin, federation, limits
from tarn.schemas import TABLES
from tarn.sources import envelopes, exchange


def test_rate_limit_ladder(spark):
    """Two requests in 10 s; then cool-offs of 5, 20 and 20 s; a clean time forgets."""
    times = [0, 1, 2, 3, 7, 8, 12, 40, 41, 42, 200]
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "key string, now long, id long")
    got = [(r.now, r.allowed, r.seconds_remaining) for r in limits.rate_limited(df, 2, 10, (5, 20), 100).orderBy("id").collect()]
    assert got == [(0, True, 0), (1, True, 0), (2, False, 5), (3, False, 4), (7, False, 20), (8, False, 19), (12, False, 15), (40, True, 0), (41, True, 0), (42, False, 20), (200, True, 0)]


def test_lockout(spark):
    rows = [(t, ok) for t, ok in [(0, False), (1, False), (2, True), (3, False), (4, False), (5, False), (6, True), (100, True)]]
    df = spark.createDataFrame([("k", t, i, ok) for i, (t, ok) in enumerate(rows)], "key string, now long, id long, ok boolean")
    got = [(r.locked, r.failed_count) for r in limits.lockouts(df, 3, 50).orderBy("id").collect()]
    assert got == [(False, 1), (False, 2), (False, 0), (False, 1), (False, 2), (False, 3), (True, 3), (False, 0)]


ENGINE = "url string, name string, description string, first_seen long, last_seen long"


def test_gossip(spark):
    local = spark.createDataFrame([("a", "l", "l", 5, 10), ("b", "l", "l", 5, 30), ("c", "l", "l", 5, 7), ("t", "l", "l", 5, 9)], ENGINE)
    inc = spark.createDataFrame([("a", "i", "i", 3, 20), ("b", "i", "i", 9, 20), ("d", "i", "i", 1, 2), ("t", "i", "i", 6, 9)], ENGINE)
    got = [tuple(r) for r in federation.directory(federation.merge_engines(local, inc, 25)).collect()]
    assert got == [("b", "l", "l", 5, 30), ("a", "i", "i", 3, 25), ("d", "i", "i", 1, 25), ("t", "i", "i", 5, 25), ("c", "l", "l", 5, 7)]
    again = federation.merge_engines(federation.merge_engines(local, inc, 25), inc, 25)
    assert sorted(map(tuple, again.collect())) == sorted(got)
    assert federation.without_engine(local, "a", "a").count() == 4 and federation.without_engine(local, "b", "a").count() == 3
    answer, merged = federation.exchange(local, inc, "2.0", 25)
    assert answer is local and merged.count() == 4


def test_health(spark):
    probes = spark.createDataFrame([("p", k, k in (2, 9)) for k in range(12)] + [("q", 0, True)], "peer string, seq long, ok boolean")
    assert sorted(map(tuple, federation.peer_health(probes).collect())) == [("p", 2, 7), ("q", 0, None)]
    nodes = spark.createDataFrame([("u", False, 7, 3), ("v", False, 6, 4), ("w", True, 0, None)], "url string, enabled boolean, consecutive_failures long, disabled_at long")
    up = spark.createDataFrame([("u", True), ("v", False)], "url string, healthy boolean")
    assert sorted(map(tuple, federation.reenabled(nodes, up).collect())) == [("u", True, 0, None), ("v", False, 6, 4), ("w", True, 0, None)]


def test_peers(spark):
    nodes = spark.createDataFrame([("1", "https://a", None, True), ("2", "https://b", "B", False)], "id string, url string, name string, enabled boolean")
    subs = spark.createDataFrame([("c", "1", "r", 0.5, True), ("c", "1", "s", 0.5, False), ("c", "2", "r", 1.0, True)], "local_collection string, node_peer_id string, remote_collection string, source_weight double, enabled boolean")
    peers = federation.active_peers(subs, nodes)
    assert [(r.peer_url, r.label, r.remote_collection) for r in peers.collect()] == [("https://a", "https://a", "r")]
    assert federation.active_peers_of(subs, nodes, None).count() == 0
    assert [federation.fan_out_depth(d) for d in (-1, 0, 1, 9)] == [(False, 0), (False, 0), (True, 0), (True, 1)]
    left_nodes, left_subs = admin.drop_nodes(nodes, subs, nodes.filter("id = '1'"))
    assert left_nodes.count() == 1 and left_subs.count() == 1


@pytest.mark.parametrize(("v", "want"), [("1", "compatible"), ("1.0", "compatible"), ("1.0.7", "compatible"), ("1.1", "minor_mismatch"), ("2.0.0", "incompatible"), ("", "incompatible"), ("one", "incompatible"), ("1.0.0.0", "incompatible"), (None, "incompatible")])
def test_versions(spark, v, want):
    assert spark.createDataFrame([(v,)], "v string").select(scalars.compatibility("v")).first()[0] == want


def _tables(spark, **rows):
    return {k: spark.createDataFrame(rows.get(k, []), v) for k, v in TABLES.items()}


@pytest.mark.parametrize("gz", [True, False])
def test_export_round_trip(spark, tmp_path, gz):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    tables = _tables(
        spark,
        collections=[("1", "tech", "d", t, t)],
        crawl_targets=[("t", "1", "https://a/", 60, 5, True, None, 1)],
        crawled_pages=[("1", "t", "https://a/x", "e", None, "h", 200, 7, "h")],
        node_peers=[("n", "https://p", None, True, 0, None, None, None)],
        collection_peers=[("tech", "n", "r", 0.5, True)],
        outlink_host_suggestions=[("1", "h", 3, [("s", "t", "x")], 1, 2, "pending", None)],
    )
    docs = spark.createDataFrame([("tech", "https://a/x", "T", "B", 7), ("gone", "https://g/", "T", "B", 7)], "collection string, url string, title string, body string, indexed_at long")
    path = str(tmp_path / "export")
    exchange.write_export(exchange.envelope(tables, docs, "now", "self"), path, gz)
    back = exchange.read_export(spark, path)
    empty = _tables(spark)
    new = exchange.import_tables(back, empty)
    assert [(r.name, r.description) for r in new["collections"].collect()] == [("tech", "d")]
    page = new["crawled_pages"].first()
    assert (page.url, page.content_hash, page.indexed_content_hash) == ("https://a/x", "h", None)
    assert [(r.url, r.collection) for r in new["documents"].collect()] == [("https://a/x", "tech")]
    assert new["collection_peers"].count() == 1 and new["outlink_host_suggestions"].first().link_count == 3
    report = exchange.import_report(back, tables).first()
    assert (report.collections_added, report.collections_skipped, report.node_peers_added, report.collection_peers_added) == (0, 1, 0, 1)


def test_other_versions_are_refused(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"format_version": 2}')
    with pytest.raises(exchange.FormatError):
        exchange.read_export(spark, str(tmp_path))


def test_cascades(spark):
    tables = _tables(spark, crawl_targets=[("t", "1", "https://a/", 60, 5, True, None, 1)], crawled_pages=[("1", "t", "https://a/x", "e", None, "h", 200, 7, "h")])
    docs = spark.createDataFrame([("https://a/x",), ("https://b/",)], "url string")
    left, kept = admin.drop_target(tables, docs, tables["crawl_targets"].select("id"))
    assert left["crawl_targets"].count() == left["crawled_pages"].count() == 0 and kept.count() == 1


def test_envelopes(spark):
    row = spark.createDataFrame([("t", "u", "s", "local", 1, 2.0)], "title string, url string, snippet_html string, source string, timestamp long, score double")
    body = json.loads(envelopes.json_answer(row, 3).first().body)
    assert body["duration_ms"] == 3 and body["results"][0]["url"] == "u" and body["protocol_version"] == "1.0"
    remote = row.selectExpr("title", "url", "snippet_html", "'peer:a/r' source", "timestamp", "score", "7L elapsed_ms")
    ends = spark.createDataFrame([("peer:a/r", 7, None), ("peer:b/r", 3, "timeout")], "source string, elapsed_ms long, error string")
    events = envelopes.event_stream(row, remote, ends).collect()
    assert [(e.event, e.source) for e in events] == [("result", "local"), ("source_complete", "local"), ("source_complete", "peer:b/r"), ("result", "peer:a/r"), ("source_complete", "peer:a/r"), ("done", "")]
    text = "event: result\ndata: {\"url\": \"u\"}\n\nevent: noise\ndata: {}\n\nevent: complete\ndata: {}\n\nevent: result\ndata: {\"url\": \"late\"}\n"
    assert envelopes.read_events(text) == [{"url": "u"}]
    assert envelopes.wants_json("application/json") and not envelopes.wants_json("text/event-stream, application/json")


def test_search_events_are_whole(spark, tmp_path):
    """Every answer of an active peer is in the stream, against a brute-force one."""
    d = str(tmp_path)
    spark.createDataFrame([(k, 0, f"S{k}", 10.0 if k != 2 else -1.0) for k in (1, 2, 3)], "s_suppkey long, s_nationkey int, s_name string, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(k, f"p{k}", 100.0 + k) for k in range(1, 41)], "p_partkey long, p_name string, p_retailprice double").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(k, "rights " + "x " * k, "en", "src0") for k in range(30)], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    got = queries.queries()["search_events"](spark, d).collect()
    assert [r.seq for r in got] == list(range(1, len(got) + 1))
    local = [r for r in got if r.source == "local"]
    assert [r.event for r in local] == ["result"] * 25 + ["source_complete"] and local == got[:26]
    weight = {k: (k % 4 + 1) / 2 for k in (1, 3)}  # the second peer is off
    answers = [(k % 3 + 1, (100.0 + k) / 100 * weight[k % 3 + 1], f"https://x.example.org/{k}") for k in range(1, 41) if k % 3 + 1 in weight]
    want = []
    for peer in (1, 3):
        want += [x[2] for x in sorted((x for x in answers if x[0] == peer), key=lambda x: (-x[1], x[2]))] + [None]
    assert [json.loads(r.payload).get("url") for r in got[26:-1]] == want and got[-1].event == "done"


def test_rpc():
    ask = lambda method, **p: envelopes.rpc({"jsonrpc": "2.0", "id": 1, "method": method, "params": p}, lambda q, c, d: [{"q": q, "d": d}])
    assert ask("ping")["result"] == {}
    assert ask("tools/list")["result"]["tools"][0]["name"] == "search"
    assert json.loads(ask("tools/call", name="search", arguments={"query": "x", "depth": 9})["result"]["content"][0]["text"]) == [{"q": "x", "d": 2}]
    assert ask("tools/call", name="search", arguments={})["error"]["code"] == -32602
    assert ask("nope")["error"]["code"] == -32601
    assert envelopes.rpc([], lambda *a: [])["error"]["code"] == -32600
    assert envelopes.rpc({"jsonrpc": "2.0", "method": "ping"}, lambda *a: []) is None


def test_config(tmp_path):
    (tmp_path / ".env").write_text("# c\nTARN_SELF_URL='https://x'\nTARN_FETCH_TIMEOUT_SECS=5\n")
    got = config.load({"TARN_FETCH_TIMEOUT_SECS": "7"}, tmp_path / ".env")
    assert (got.self_url, got.fetch_timeout_secs, got.politeness_delay_ms) == ("https://x", 7, 250)
    assert config.patched({"a": 1, "b": 2}, {"b": None}) == {"a": 1, "b": None}
