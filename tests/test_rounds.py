"""Crawl runs, rounds of gossip, and exports as lines."""

from __future__ import annotations

import gzip
import json
import random
from functools import reduce
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarn.operators import crawl, federation, schedule
from tarn.schemas import TABLES
from tarn.sources import exchange, lines
from tarn.sources.exchange import FormatError

# ---------------------------------------------------------------- crawls


def walked(seeds, answers, links, most_pages):
    """One run by a queue: (ord, url, outcome, throttled, waited)."""
    queue, seen, out, fetched, carry = list(dict.fromkeys(seeds)), set(seeds), [], 0, 0
    while queue and fetched < most_pages:
        url = queue.pop(0)
        throttled, retry, outcome = answers.get(url, (0, None, "error"))
        times = waited = 0
        for _ in range(throttled):
            carry += 1
            if carry >= 5:
                outcome = "aborted"
                break
            times += 1
            waited += min(retry, 120) if retry is not None else 2 ** (carry - 1)
        out.append((len(out), url, outcome, times, waited))
        if outcome == "aborted":
            break
        if outcome in crawl.FETCHED:
            carry, fetched = 0, fetched + 1
        if outcome == "fresh":
            for target in links.get(url, []):
                if target not in seen:
                    seen.add(target)
                    queue.append(target)
    return out


@pytest.mark.parametrize("most", [1, 12, 1000])
def test_runs_against_a_queue(spark, most):
    rng = random.Random(most)
    urls = [f"u{i}" for i in range(60)]
    answers = {u: (rng.choice([0, 0, 0, 1, 2, 4]), rng.choice([None, None, 0, 7, 300]), rng.choice(["fresh"] * 5 + ["not_modified", "other_status", "not_html", "not_html"])) for u in urls[:57]}
    links = {u: rng.sample(urls, rng.randint(0, 6)) for u in urls}
    seeds = {r: rng.sample(urls, rng.randint(1, 3)) for r in range(12)}
    got = crawl.crawl_runs(
        spark.createDataFrame([(r, u, i) for r, us in seeds.items() for i, u in enumerate(us)], "run int, url string, pos int"),
        spark.createDataFrame([(u, *a) for u, a in answers.items()], "url string, throttled long, retry_after long, outcome string"),
        spark.createDataFrame([(u, t, i) for u, ts in links.items() for i, t in enumerate(ts)], "source_url string, target_url string, pos int"),
        most,
    )
    rows = got.collect()
    for r, us in seeds.items():
        assert sorted((x.ord, x.url, x.outcome, x.throttled, x.waited) for x in rows if x.run == r) == walked(us, answers, links, most)
    ends = {r.run: r.ended for r in crawl.run_ends(got, most).collect()}
    assert all(v in ("cap", "aborted", "done") for v in ends.values()) and (most > 1 or "cap" in ends.values())


def test_redirects_and_canonical_urls_are_followed_first(spark):
    kind = "url string, url_prefix string, final_url string, canonical string, links array<struct<url:string,text:string>>"
    rows = [("https://a.b/1", "https://a.b/", "https://a.b/2", "https://a.b/3#x", [("https://a.b/4", ""), ("https://c.d/", ""), ("https://a.b/2", ""), ("https://a.b/4?utm_source=q", "")]), ("https://a.b/5", "https://a.b/", "https://z.z/5", "https://a.b/5", [])]
    got = crawl.followed(spark.createDataFrame(rows, kind)).orderBy("source_url", "pos").collect()
    assert [tuple(r) for r in got] == [("https://a.b/1", "https://a.b/2", -2), ("https://a.b/1", "https://a.b/3", -1), ("https://a.b/1", "https://a.b/4", 0)]


# ---------------------------------------------------------------- gossip

ENGINE = "url string, name string, description string, first_seen long, last_seen long"


def test_rounds_against_merging_one_by_one(spark):
    rng = random.Random(6)
    engine = lambda who: (f"e{rng.randint(0, 9)}", who, f"d{who}", rng.randint(0, 50), rng.randint(0, 60))
    local = [(f"e{i}", "own", "d", 10, rng.randint(0, 40)) for i in range(4)]
    peers = [(f"p{i}", i != 2, i) for i in range(5)]
    times, told = [20, 30, 45], []
    for r in (1, 2, 3):
        for p, _, i in peers:
            if (r + i) % 3:
                told += [(r, p, *e) for e in {x[0]: x for x in (engine(f"{p}{r}") for _ in range(3))}.values()]
    one, every = spark.createDataFrame(local, ENGINE), spark.createDataFrame(told, f"round int, peer string, {ENGINE}")
    asked = schedule.exchanges(spark.createDataFrame(peers, "url string, enabled boolean, pos int"), every.select("round", "peer"), times)
    directory = schedule.gossip_heard(one, asked, every)
    steps = [(r, p) for r in (1, 2, 3) for p, on, i in peers if on]
    merged, sent = one, {}
    for r, p in steps:
        mine = [x[2:] for x in told if x[:2] == (r, p)]
        sent[r, p] = (merged.count(), len(mine)) if mine else (0, 0)
        if mine:
            merged = spark.createDataFrame(federation.merge_engines(merged, spark.createDataFrame(mine, ENGINE), times[r - 1]).collect(), ENGINE)
    assert sorted(directory.select(*merged.columns).collect()) == sorted(merged.collect())
    log = schedule.gossip_log(one, asked, every, directory)
    assert {(x.round, x.peer): (x.sent, x.received) for x in log.collect()} == sent
    totals = {x.round: (x.attempted, x.succeeded, x.failed) for x in schedule.gossip_rounds(log).collect()}
    assert totals == {r: (4, *[sum((s[0] == r) and bool(sent[s][1]) is ok for s in steps) for ok in (True, False)]) for r in (1, 2, 3)}
    synced = {x.peer: (x.last_sync_at, x.failures) for x in schedule.peer_sync(log, asked).collect()}
    for p in {p for _, p in steps}:
        good = [r for r, q in steps if q == p and sent[r, q][1]]
        assert synced[p] == (times[good[-1] - 1] if good else None, sum(r > max(good, default=0) and not sent[r, q][1] for r, q in steps if q == p))


def test_ticks_skip_what_a_long_round_missed():
    assert schedule.ticks(0, 10, [(10, 35)], 60) == [10, 40, 50, 60]
    assert reduce(max, schedule.ticks(5, 10, [], 9), 0) == 0


# ---------------------------------------------------------------- exports


@pytest.fixture(scope="module")
def tables(spark):
    empty = {k: spark.createDataFrame([], v) for k, v in TABLES.items()}
    when = F.timestamp_seconds(F.lit(1_700_000_000))
    full = {
        "collections": spark.createDataFrame([("1", "a", 'say "x"'), ("2", "b]}", None), ("3", "empty", "")], "id string, name string, description string").withColumn("created_at", when).withColumn("updated_at", when),
        "crawl_targets": spark.createDataFrame([("t1", "1", "https://x/", 60, None, True, None, 5), ("t2", "1", "https://y/", 60, 1, False, 3, 5), ("t3", "2", "https://x/", 60, 1, True, 3, 5)], TABLES["crawl_targets"]),
        "crawled_pages": spark.createDataFrame([("1", "t1", f"https://x/{i}", None, "lm", f"h{i}", 200, 7, "h") for i in range(30)] + [("2", "t3", "https://x/0", "e", None, None, 404, 7, None)], TABLES["crawled_pages"]),
        "ranking_config": spark.createDataFrame([("1", 30.0, {"local": 2.0}, {}, "{}")], TABLES["ranking_config"]),
        "outlink_host_suggestions": spark.createDataFrame([("1", "o.example", 3, [("s", "t", "x\ny")], 1, 2, "pending", None)], TABLES["outlink_host_suggestions"]),
        "node_peers": spark.createDataFrame([("n1", "https://p", "P", True, 0, 0, 0, None)], TABLES["node_peers"]),
        "collection_peers": spark.createDataFrame([("a", "n1", "r", 1.5, True)], TABLES["collection_peers"]),
    }
    docs = spark.createDataFrame([("a", f"https://x/{i:03}", f"t{i}", f'line "{i}"\nlast  ]}} é', i) for i in range(200)] + [("b]}", "https://x/0", None, "", None), ("gone", "https://x/0", "t", "b", 1)], "collection string, url string, title string, body string, indexed_at long")
    return empty | full, docs


def written(tables, path, gz):
    lines.write_lines(lines.export_lines(*tables, "now", "self").repartition(5), path, gz)
    parts = sorted(Path(path).glob("part-*"))
    return b"".join((gzip.decompress(p.read_bytes()) if gz else p.read_bytes()) for p in parts)


def plain(x):
    """Without the elements' own marks, lists in order of their keys."""
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items() if k not in ("kind", "collection", "target") and v is not None and v != []}
    return [plain(v) for v in x] if isinstance(x, list) else x


def test_lines_are_the_document(spark, tables, tmp_path):
    """Part files joined by name are the JSON that the envelope makes, gzipped or not; documents and pages in order."""
    whole = json.loads(written(tables, f"{tmp_path}/plain", False))
    assert json.loads(written(tables, f"{tmp_path}/gz", True)) == whole
    want = json.loads(exchange.envelope(*tables, "now", "self").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    assert plain(whole) == plain(want)
    assert [d["url"] for d in whole["collections"][0]["documents"]] == [f"https://x/{i:03}" for i in range(200)]


@pytest.mark.parametrize(("gz", "rename"), [(True, True), (False, False)])
def test_import_gives_back_what_was_exported(spark, tables, tmp_path, gz, rename):
    """Read by content: gzipped parts without a telling name, one joined file, and plain ones."""
    body = written(tables, f"{tmp_path}/out", gz)
    source = tmp_path / "in"
    source.mkdir()
    if rename:
        for i, p in enumerate(sorted((tmp_path / "out").glob("part-*"))):
            (source / f"{i}.json").write_bytes(p.read_bytes())
    else:
        (source / "all.gz").write_bytes(body)
    read = lines.checked(lines.read_lines(spark, str(source)))
    none = {k: spark.createDataFrame([], v) for k, v in TABLES.items()}
    got, want = lines.imported(read, none), exchange.import_tables(exchange.envelope(*tables, "now", "self"), none)
    assert set(got) == set(want)
    for name, df in want.items():
        columns = sorted(df.columns)
        assert sorted(map(repr, got[name].select(*columns).collect())) == sorted(map(repr, df.select(*columns).collect())), name
    skipped = lines.imported(read, none | {"collections": tables[0]["collections"].filter("name = 'a'")})
    assert {r.collection for r in skipped["documents"].collect()} == {"b]}"}


def test_the_report_needs_no_whole_document(spark, tables, tmp_path):
    """Counts of lines in many files, as of the one document."""
    written(tables, f"{tmp_path}/out", True)
    known = {k: spark.createDataFrame([], v) for k, v in TABLES.items()} | {"collections": tables[0]["collections"].filter("name = 'a'")}
    got = lines.import_report(lines.read_lines(spark, f"{tmp_path}/out"), known)
    assert got.first().asDict() == exchange.import_report(exchange.envelope(*tables, "now", "self"), known).first().asDict()


def test_files_joined_or_cut_anywhere_unpack(spark, tmp_path):
    """Gzip members of all sizes in one file, and members larger than a piece; part files hold a bounded number of lines."""
    rng = random.Random(3)
    want = [f"{i} {rng.random()} {'x' * rng.randrange(3000)}" for i in range(3000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"".join(gzip.compress("".join(f"{w}\n" for w in want[i:j]).encode(), k) for i, j, k in ((0, 1, 9), (1, 2500, 0), (2500, 2600, 9), (2600, 3000, 1))))
    assert [r.line for r in lines.read_lines(spark, f"{tmp_path}/in").collect()] == want
    keys = dict.fromkeys(("name", "key", "page"), "''") | dict.fromkeys(("top", "part", "sub"), "0")
    lines.write_lines(spark.range(5000).selectExpr("cast(id as string) as line", *[f"{v} as {k}" for k, v in keys.items()]), f"{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("part-*"))) >= 5000 / lines.FILE_LINES


def test_refused_imports(spark, tmp_path):
    (tmp_path / "x").write_bytes(gzip.compress(b'{"format_version":2,"collections":[\n'))
    with pytest.raises(FormatError):
        lines.checked(lines.read_lines(spark, str(tmp_path)))
    with pytest.raises(FormatError):
        lines.read_lines(spark, str(tmp_path), most=10)
    (tmp_path / "x").write_bytes(gzip.compress(b"\n" * 100_000))
    with pytest.raises(Exception, match="more than 5000 bytes"):
        lines.read_lines(spark, str(tmp_path), most=5000).count()
