"""Ticks of the crawl scheduler and rounds of gossip, as data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators.crawl import due_targets
from tarn.operators.federation import merge_engines
from tarn.operators.folds import folded


def tick(targets: DataFrame, collections: DataFrame, running: DataFrame, now: int, paused: bool = False, full: bool = False) -> DataFrame:
    """The targets that a tick starts: those due and not running (id); none while paused or when the index is full."""
    due = due_targets(targets, collections, now).join(running.select("id").distinct(), "id", "left_anti")
    return due.filter(F.lit(not (paused or full)))


def finished(targets: DataFrame, done: DataFrame, now: int) -> DataFrame:
    """targets with last_crawled_at set for those a run has finished."""
    named = done.select("id", F.lit(True).alias("_done")).distinct()
    return targets.join(named, "id", "left").withColumn("last_crawled_at", F.when(F.col("_done"), F.lit(now).cast("long")).otherwise(F.col("last_crawled_at"))).select(*targets.columns)


def gossip_round(local: DataFrame, answers: list[DataFrame], now: int) -> tuple[DataFrame, DataFrame]:
    """(directory, counts): the answers of peers merged one after the other; how many entries went out and came in."""
    merged = reduce(lambda acc, inc: merge_engines(acc, inc, now), answers, local)
    sent = local.agg((F.count("*") * len(answers)).alias("sent"))
    every = reduce(DataFrame.unionByName, [a.select("url") for a in answers], local.select("url").limit(0))
    return merged, sent.crossJoin(every.agg(F.count("*").alias("received"))).withColumn("synced", F.lit(len(answers)))


def exchanges(peers: DataFrame, answered: DataFrame, times: list[int]) -> DataFrame:
    """(round, pos, peer, at, ok): every exchange of the rounds at `times`: each enabled peer (url, enabled, pos) is asked
    once a round, in order of pos; answered: (round, peer), one row for each answer that came. A failure ends only its own exchange."""
    rounds = peers.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(times)], "round int, at long")
    came = answered.select("round", "peer", F.lit(True).alias("_ok")).distinct()
    asked = peers.filter("enabled").select(F.col("url").alias("peer"), F.col("pos").cast("long").alias("pos")).crossJoin(F.broadcast(rounds))
    return asked.join(came, ["round", "peer"], "left").select("round", "pos", "peer", "at", F.coalesce("_ok", F.lit(False)).alias("ok"))


def gossip_heard(local: DataFrame, asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(url, name, description, first_seen, last_seen, joined): the directory after all rounds, as if each answer had been
    merged when it came (see `merge_engines`). joined: (round, pos) of the exchange that brought the url, null if it was known.

    answers: (round, peer, url, name, description, first_seen, last_seen). Each url is folded over its own sightings in
    order, so rounds and peers add no steps to the plan.
    """
    one = answers.groupBy("round", "peer", "url").agg(F.max_by(F.struct("name", "description"), "last_seen").alias("r"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    heard = one.join(asked.filter("ok"), ["round", "peer"]).select("url", "round", "pos", "at", F.col("r.name").alias("name"), F.col("r.description").alias("description"), F.col("first_seen").cast("long").alias("first_seen"), F.col("last_seen").cast("long").alias("last_seen"))
    known = local.select("url", F.lit(0).alias("round"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("at"), "name", "description", F.col("first_seen").cast("long").alias("first_seen"), F.col("last_seen").cast("long").alias("last_seen"))

    def step(state: dict, row: tuple):
        url, turn, pos, at, name, description, first, last = row
        if not state:
            state |= {"url": url, "name": name, "description": description, "first": first, "last": last if at is None else max(last, at), "joined": None if at is None else (turn, pos)}
            return
        if last >= state["last"]:
            state["name"], state["description"] = name, description
        state["first"], state["last"] = min(state["first"], first), max(state["last"], last, at or last)
        yield from ()

    def end(state: dict):
        yield state["url"], state["name"], state["description"], state["first"], state["last"], *(state["joined"] or (None, None))

    schema = T.StructType([T.StructField(n, t) for n, t in (("url", T.StringType()), ("name", T.StringType()), ("description", T.StringType()), ("first_seen", T.LongType()), ("last_seen", T.LongType()), ("joined_round", T.IntegerType()), ("joined_pos", T.LongType()))])
    return folded(known.unionByName(heard), ["url"], ["round", "pos"], dict, step, schema, end)


def gossip_log(local: DataFrame, asked: DataFrame, answers: DataFrame, directory: DataFrame) -> DataFrame:
    """(round, pos, peer, ok, sent, received): what each exchange sent (the directory as it stood; nothing if it failed) and got."""
    got = answers.groupBy("round", "peer").agg(F.count("*").alias("received"))
    new = directory.filter("joined_round is not null").groupBy(F.col("joined_round").alias("round"), F.col("joined_pos").alias("pos")).agg(F.count("*").alias("new"))
    size = local.agg(F.count_distinct("url").alias("size"))
    # exchanges are as many as peers and rounds; what came in earlier rounds is a row a round
    in_round = Window.partitionBy("round").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    totals = new.groupBy("round").agg(F.sum("new").alias("total"))
    before = totals.select(F.col("round").alias("earlier"), "total").join(asked.select("round").distinct(), F.col("earlier") < F.col("round")).groupBy("round").agg(F.sum("total").alias("before"))
    rows = asked.join(new, ["round", "pos"], "left").join(got, ["round", "peer"], "left").join(before, "round", "left").crossJoin(F.broadcast(size))
    sent = F.col("size") + F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("new").over(in_round), F.lit(0))
    return rows.select("round", "pos", "peer", "ok", F.when(F.col("ok"), sent).otherwise(0).alias("sent"), F.when(F.col("ok"), F.coalesce("received", F.lit(0))).otherwise(0).alias("received"))


def gossip_rounds(log: DataFrame) -> DataFrame:
    """(round, attempted, succeeded, failed, sent, received): the counters of each round."""
    return log.groupBy("round").agg(F.count("*").alias("attempted"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum("sent").alias("sent"), F.sum("received").alias("received"))


def peer_sync(log: DataFrame, asked: DataFrame) -> DataFrame:
    """(peer, last_sync_at, failures): when each peer last answered, and how many exchanges have failed since."""
    rows = log.join(asked.select("round", "peer", "at"), ["round", "peer"])
    last = rows.groupBy("peer").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_sync_at"))
    return rows.join(last, "peer").groupBy("peer", "last_sync_at").agg(F.count_if(~F.col("ok") & (F.col("last_sync_at").isNull() | (F.col("at") > F.col("last_sync_at")))).alias("failures"))


def ticks(start: int, interval: int, busy: list[tuple[int, int]], until: int) -> list[int]:
    """When the loop's rounds begin: first a whole interval after the start; a tick during a round (begin, end) is skipped."""
    return [t for t in range(start + interval, until + 1, interval) if not any(a < t < b for a, b in busy)]


def request_limits(requests: DataFrame, nodes: DataFrame, anonymous: int = 30, peer: int = 120) -> DataFrame:
    """requests (host, ...) with `limit`: more for the hosts of enabled node peers. On a stream the nodes are read anew in each batch."""
    from tarn.functions.urls import index_host

    hosts = nodes.filter("enabled").select(index_host("url").alias("host"), F.lit(True).alias("_peer")).distinct()
    return requests.join(hosts, "host", "left").withColumn("limit", F.when(F.col("_peer"), peer).otherwise(anonymous)).drop("_peer")


def raw_text(body: Column, status: Column, max_bytes: int) -> Column:
    """A fetched body as text: null unless the answer was 2xx, cut at max_bytes, bytes that are no UTF-8 replaced."""
    cut = F.when(F.octet_length(body) > max_bytes, F.substring(body, 1, max_bytes)).otherwise(body)
    return F.when(status.between(200, 299), F.make_valid_utf8(cut.cast("string")))
