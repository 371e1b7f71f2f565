"""The segment log, the indexer's streams, ordered folds and the standing index."""

from __future__ import annotations

import random
import threading
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from tarn.operators import index, limits, search
from tarn.operators.ranking import RankingConfig
from tarn.operators.segments import SegmentStore
from tarn.operators.standing import StandingIndex, postings
from tarn.streaming import indexer

JOB = "op string, collection string, collection_id string, url string, title string, body string, indexed_at long, content_hash string, seq long"


def job(op, url, seq, body="b"):
    return (op, "c", "c", f"https://a.b/{url}", f"t{seq}", body, seq, f"h{seq}", seq)


def contents(store):
    return {r.url[12:]: r.title for r in store.read().collect()}


def test_commits_against_a_dictionary(spark, tmp_path):
    """Random batches of upserts and deletes: what a reader sees, and never more than `most` segments."""
    rng, want = random.Random(4), {}
    store = SegmentStore(spark, str(tmp_path), most=3)
    assert store.read().count() == 0 and store.size_bytes() == 0
    seq = 0
    for batch in range(9):
        jobs = []
        for _ in range(rng.randint(1, 6) * (20 if batch == 2 else 1)):
            seq += 1
            op, url = rng.choice(["upsert", "upsert", "delete"]), str(rng.randint(0, 12))
            jobs.append(job(op, url, seq))
            want.pop(url, None)
            if op == "upsert":
                want[url] = f"t{seq}"
        rng.shuffle(jobs)
        before = store.versions()
        store.commit(spark.createDataFrame(jobs, JOB), batch=batch)
        assert contents(store) == want
        assert len(store.manifest().segments) <= 3
        assert set(before) <= set(store.versions())
    version = store.manifest().version
    store.commit(spark.createDataFrame([job("upsert", "again", 999)], JOB), batch=8)  # comes again after a crash
    assert store.manifest().version == version and contents(store) == want
    assert store.manifest().jobs == seq
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{tmp_path}/segments").select("path", "length").collect()
    assert store.size_bytes() == sum(f.length for f in files if f.path.split("/segments/")[1].split("/")[0] in {s.name for s in store.manifest().segments})
    store.vacuum(1)
    assert contents(store) == want and store.versions() == [version]


def test_a_commit_writes_its_own_batch(spark, tmp_path):
    store = SegmentStore(spark, str(tmp_path))
    store.commit(spark.range(20_000).selectExpr("'upsert' op", "'c' collection", "concat('https://a.b/', id) url", "'t' title", "repeat(cast(rand(1) as string), 20) body", "id indexed_at", "id seq"))
    large = store.size_bytes()
    store.commit(spark.createDataFrame([job("upsert", "x", 1)], JOB))
    assert store.manifest().segments[1].bytes < large / 100
    old = store.read(1)
    assert (old.count(), store.read().count()) == (20_000, 20_001)


def test_two_writers_take_turns(spark, tmp_path):
    """Each of two threads commits its own streams' batches; none is lost and no version is taken twice."""
    store, failed = SegmentStore(spark, str(tmp_path)), []

    def write(name):
        try:
            for k in range(4):
                SegmentStore(spark, str(tmp_path)).commit(spark.createDataFrame([job("upsert", f"{name}{k}", k)], JOB), name, k)
        except Exception as e:  # shown by the assertion below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert not failed
    assert set(contents(store)) == {f"{n}{k}" for n in "xy" for k in range(4)}
    assert store.manifest().batches == {"x": 3, "y": 3} and store.manifest().jobs == 8


def test_deletes_do_not_wait(spark, tmp_path):
    """Upserts by the timer, deletes at once, in one store; then nothing is in flight, and the journal marked the pages."""
    schema = spark.createDataFrame([], JOB).schema
    store, inflight, marked = SegmentStore(spark, f"{tmp_path}/index"), indexer.InFlight(), []
    spark.createDataFrame([job("upsert", str(k), k) for k in range(3)], JOB).write.parquet(f"{tmp_path}/upserts")
    spark.createDataFrame([job("delete", "none", 9)], JOB).write.parquet(f"{tmp_path}/deletes")
    spark.streams.addListener(inflight)
    try:
        up = indexer.indexer(indexer.job_files(spark, f"{tmp_path}/upserts", schema), store, f"{tmp_path}/c1", lambda j: marked.extend(r.url for r in j.collect()), name="upserts", inflight=inflight)
        down = indexer.indexer(indexer.job_files(spark, f"{tmp_path}/deletes", schema), store, f"{tmp_path}/c2", name="deletes", at_once=True, inflight=inflight)
        end = time.time() + 90
        while time.time() < end and store.manifest().jobs < 4:
            time.sleep(0.5)
        spark.createDataFrame([job("delete", "1", 10)], JOB).write.mode("append").parquet(f"{tmp_path}/deletes")
        while time.time() < end and store.manifest().jobs < 5:
            time.sleep(0.5)
        up.stop()
        down.stop()
    finally:
        spark.streams.removeListener(inflight)
    assert set(contents(store)) == {"0", "2"}
    assert inflight.count == 0 and sorted(u[12:] for u in marked) == ["0", "1", "2"]


def test_queue_is_bounded():
    assert indexer.queue_options("kafka") == {"minOffsetsPerTrigger": "50", "maxTriggerDelay": "5s", "maxOffsetsPerTrigger": "256"}


def test_triggers(spark):
    """Size, age (with its timer running on while nothing waits), delete and closing."""
    rows = [("w", t, i, op) for i, (t, op) in enumerate([(0, "u"), (1, "u"), (2, "u"), (3, "u"), (20, "u"), (24, "delete"), (29, "u"), (31, "u"), (60, "u")])]
    got = limits.job_commits(spark.createDataFrame(rows, "writer string, at long, seq long, op string"), 3, 5).orderBy("number").collect()
    # the timer runs from the commit at 2: 7, 12, 17, 22; the job of 20 is committed at 22; the delete at 24 alone;
    # the job of 29 comes as the timer runs out and is taken first, so it is committed then; that of 31 at 34
    assert [(r.reason, r.at, r.jobs, r.deletes) for r in got] == [("size", 2, 3, 0), ("age", 7, 1, 0), ("age", 22, 1, 0), ("delete", 24, 1, 1), ("age", 29, 1, 0), ("age", 34, 1, 0), ("closed", 60, 1, 0)]


# ---------------------------------------------------------------- folds


def test_a_key_of_many_events(spark):
    """Half a million events of one key, and null keys beside it: time in proportion, results as by a plain loop."""
    n = 500_000
    rows = spark.range(n).selectExpr("if(id % 1000 = 7, null, 'hot') as key", "id div 3 as now", "id", "id % 5 > 1 as ok").repartition(7)
    began = time.time()
    got = limits.lockouts(rows, 3, 10).filter("locked").groupBy("key").count().collect()
    took = time.time() - began
    want = {"hot": 0, None: 0}
    state = {"hot": [0, 0], None: [0, 0]}
    for i in range(n):
        key, now, ok = (None if i % 1000 == 7 else "hot"), i // 3, i % 5 > 1
        s = state[key]
        if s[1] > now:
            want[key] += 1
        elif ok:
            s[:] = [0, 0]
        else:
            s[0] += 1
            if s[0] >= 3:
                s[1] = now + 10
    assert {r.key: r["count"] for r in got} == {k: v for k, v in want.items() if v}
    assert took < 60


def test_rate_limit_against_a_loop(spark):
    rng = random.Random(2)
    events = [(rng.choice("ab"), rng.randint(0, 4000), i) for i in range(3000)]
    got = {r.id: (r.allowed, r.seconds_remaining) for r in limits.rate_limited(spark.createDataFrame(events, "key string, now long, id long"), 5, 20, (10, 30), 100).collect()}
    for key in "ab":
        log, violations, until, last = deque(), 0, 0, 0
        for now, i in sorted((now, i) for k, now, i in events if k == key):
            if last and now - last > 100 and until <= now:
                violations = 0
            if until > now:
                assert got[i] == (False, until - now)
                continue
            log = deque(t for t in log if t > now - 20)
            if len(log) >= 5:
                wait = (10, 30)[min(violations, 1)]
                violations, until, last = violations + 1, now + wait, now
                assert got[i] == (False, wait)
            else:
                log.append(now)
                assert got[i] == (True, 0)


# ---------------------------------------------------------------- the standing index


@pytest.fixture(scope="module")
def standing(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["red", "house", "big", "rust", "run", "running", "the", "of", "search"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=rng.randint(0, 12))), f"https://{rng.choice(['one', 'two'])}.example/{i}", rng.choice(["tech", "food"]), 1000 * i) for i in range(80)]
    rows += [("Zoë", "naïve café", "https://one.example/z", "tech", 5), (None, None, "https://one.example/n", "food", 5)]
    docs = spark.createDataFrame(rows, "title string, body string, url string, collection string, indexed_at long")
    return docs, StandingIndex(spark, str(tmp_path_factory.mktemp("standing")), buckets=8).build(docs)


QUERIES = [
    "rust", "red house", '"red house"', 'title:"red house" big', "+red -house", "red AND (big OR rust)", "the site:one.example", "site:two.example", "-red", "host:one.example^2 red^3",
    "body:[house TO run]", "title:{house TO run} red", "body:>=s", "body:<big", 'body:"the ru"*', '"the ru"* -big', "café", "red NOT body:[r TO s}", "unknownword", "", "(red", "body:[* TO *]", "[a TO b]", '"ru"*',
]


@pytest.mark.parametrize("q", QUERIES)
def test_index_answers_as_a_scan(standing, q):
    docs, built = standing
    rows = lambda df: {r.url: round(r.bm25, 9) for r in df.select("url", "bm25").collect()}
    for collection in (None, "tech"):
        assert rows(built.candidates(q, collection, limit=None)) == rows(search.candidates(docs, q, collection, limit=None))
    assert rows(built.candidates(q, limit=3)) == rows(search.candidates(docs, q, limit=3))


def test_index_ranks_as_a_scan(standing):
    docs, built = standing
    config = RankingConfig(30.0, {"local": 2.0}, {"one.example": 3.0})
    assert built.search("red house", 90_000, config=config, limit=5).collect() == search.search(docs, "red house", 90_000, config=config, limit=5).collect()


def test_index_reads_its_terms_only(standing):
    """The plan names the terms' folders and pushes the terms into the scan; ranges push their ends."""
    plan = standing[1].scores("red house")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term, [house,red])" in plan
    assert "GreaterThanOrEqual(term,house)" in standing[1].scores("body:[house TO run]")._jdf.queryExecution().toString()


def test_index_is_built_without_a_shuffle(spark):
    """Documents are inverted where they are read: what a build takes on disk is the index."""
    docs = spark.range(0, 40, 1, 8).selectExpr("concat('https://one.example/', id) AS url", "'tech' AS collection", "'Red house' AS title", "concat('a red red house ', id) AS body")
    rows = postings(docs)
    assert "Exchange" not in rows._jdf.queryExecution().toString()
    assert {(r.tf, tuple(r.positions)) for r in rows.filter("field = 'body' and term = 'red'").collect()} == {(2, (1, 2))}


def test_upsert_helpers_agree_with_the_log(spark, tmp_path):
    jobs = spark.createDataFrame([job("upsert", "1", 1), job("upsert", "1", 2), job("delete", "2", 3), job("upsert", "3", 4), job("delete", "3", 5)], JOB)
    store = SegmentStore(spark, str(tmp_path))
    store.commit(jobs)
    empty = store.read().limit(0)
    assert sorted(store.read().collect()) == sorted(indexer.apply_batch(empty, jobs).collect())
    assert [r.content_hash for r in index.journal(jobs.filter(F.col("url").endswith("/1"))).collect()] == ["h2"]
