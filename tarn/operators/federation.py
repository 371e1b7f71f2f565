"""Peers: subscriptions, merged results under a time budget, the engine directory, and peer health."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.scalars import compatibility, source_label

FAILURES = 5
BUDGET_MS = 5000
MAX_DEPTH = 2


class PeerClient(Protocol):
    """How peers are asked: peers (peer_url, remote_collection) go in, answers and failures come as rows. See `sources.http`."""

    def search(self, peers: DataFrame, query: str, depth: int) -> DataFrame: ...

    def list_collections(self, peers: DataFrame) -> DataFrame: ...

    def health_check(self, peers: DataFrame) -> DataFrame: ...


def active_peers(subscriptions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Subscriptions that are enabled, to nodes that are."""
    known = nodes.filter("enabled").select(F.col("id").alias("node_peer_id"), F.col("url").alias("peer_url"), F.coalesce("name", "url").alias("label"))
    return subscriptions.filter("enabled").drop("enabled").join(known, "node_peer_id")


def active_peers_of(subscriptions: DataFrame, nodes: DataFrame, collection: str | None) -> DataFrame:
    """Those of one collection; without a collection there are none."""
    return active_peers(subscriptions, nodes).filter(F.col("local_collection") == (collection or ""))


def fan_out_depth(depth: int) -> tuple[bool, int]:
    """(whether to ask peers, the depth to send them)."""
    depth = max(0, min(depth, MAX_DEPTH))
    return depth > 0, max(0, depth - 1)


def sent_depth(depth: Column) -> Column:
    """The depth that peers are asked with; null where none is asked."""
    held = F.greatest(F.lit(0), F.least(depth, F.lit(MAX_DEPTH)))
    return F.when(held > 0, held - 1)


def asked_peers(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(peer, hops): the engines that a search at `start` (peer) reaches over links (peer, asks): one level for each step of depth, two at most."""
    seen = at = start.select("peer", F.lit(0).alias("hops")).distinct()
    for hop in range(1, max(0, min(depth, MAX_DEPTH)) + 1):
        at = links.join(at.select("peer"), "peer").select(F.col("asks").alias("peer")).distinct().join(seen.select("peer"), "peer", "left_anti").select("peer", F.lit(hop).alias("hops"))
        seen = seen.unionByName(at)
    return seen


def peer_results(answers: DataFrame, peers: DataFrame, budget_ms: int | None = None) -> DataFrame:
    """Answers (peer_url, remote_collection, elapsed_ms, result columns) of active peers, weighted and relabelled.

    With a budget, peers that answered later are dropped whole; all peers are asked at once.
    """
    known = peers.select("peer_url", "remote_collection", "source_weight")
    if budget_ms is not None:
        answers = answers.filter(F.col("elapsed_ms") <= budget_ms)
    joined = answers.join(known, ["peer_url", "remote_collection"])
    return joined.withColumn("score", F.col("score") * F.col("source_weight")).withColumn("source", source_label("peer_url", "remote_collection")).drop("source_weight")


def merged_results(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Everything, best first; the same url from two sources stays twice, nothing is cut."""
    columns = ["title", "url", "snippet_html", "source", "timestamp", "score"]
    return local.select(*columns).unionByName(remote.select(*columns)).orderBy(F.desc("score"), "source", "url")


def merge_engines(local: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """Two engine lists as one by url: the oldest first_seen; name and description of the newer sighting (incoming on a
    tie); last_seen of whatever came in is at least now. Of repeated incoming urls the last by last_seen counts."""
    sides = {}
    for name, df in (("l", local), ("i", incoming)):
        one = df.groupBy("url").agg(F.max_by(F.struct("name", "description"), "last_seen").alias("r"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        sides[name] = one.select("url", F.col("r.name").alias(f"{name}_name"), F.col("r.description").alias(f"{name}_description"), F.col("first_seen").alias(f"{name}_first"), F.col("last_seen").alias(f"{name}_last"))
    both = sides["l"].join(sides["i"], "url", "full_outer")
    wins = F.col("l_last").isNull() | (F.col("i_last") >= F.col("l_last"))
    take = lambda c: F.when(wins, F.col(f"i_{c}")).otherwise(F.col(f"l_{c}"))
    last = F.when(F.col("i_last").isNull(), F.col("l_last")).otherwise(F.greatest("l_last", "i_last", F.lit(now)))
    return both.select("url", take("name").alias("name"), take("description").alias("description"), F.least("l_first", "i_first").alias("first_seen"), last.cast("long").alias("last_seen"))


def directory(engines: DataFrame) -> DataFrame:
    return engines.orderBy(F.desc("last_seen"), "url")


def stored_engines(stored: DataFrame, new: DataFrame) -> DataFrame:
    """What an upsert keeps: new name and description, the stored first_seen, the larger last_seen."""
    old = stored.select("url", F.col("name").alias("o_name"), F.col("description").alias("o_description"), F.col("first_seen").alias("o_first"), F.col("last_seen").alias("o_last"))
    return old.join(new, "url", "full_outer").select("url", F.coalesce("name", "o_name").alias("name"), F.coalesce("description", "o_description").alias("description"), F.coalesce("o_first", "first_seen").alias("first_seen"), F.greatest("o_last", "last_seen").alias("last_seen"))


def without_engine(engines: DataFrame, url: str, self_url: str) -> DataFrame:
    """The directory without one engine; the own entry stays."""
    return engines if url == self_url else engines.filter(F.col("url") != url)


def exchange(local: DataFrame, incoming: DataFrame, version: str, now: int) -> tuple[DataFrame, DataFrame]:
    """(answer, new directory) of a gossip call: the answer is the list as it was before; an incompatible caller changes nothing."""
    fits = local.sparkSession.range(1).select((compatibility(F.lit(version)) != "incompatible").alias("ok"))
    return local, merge_engines(local, incoming.crossJoin(F.broadcast(fits)).filter("ok").drop("ok"), now)


def health_runs(probes: DataFrame) -> DataFrame:
    """probes (peer, seq, ok) with `failures`: failures in a row up to and with each probe."""
    w = Window.partitionBy("peer").orderBy("seq")
    island = F.sum(F.col("ok").cast("int")).over(w)
    return probes.withColumn("_i", island).withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("peer", "_i").orderBy("seq"))).drop("_i")


def peer_health(probes: DataFrame, most: int = FAILURES) -> DataFrame:
    """(peer, consecutive_failures, disabled_at): the run a peer ends with, and the first probe with `most` failures in a row.

    Failures count on after a peer is disabled; only a probe by hand enables it again.
    """
    runs = health_runs(probes)
    return runs.groupBy("peer").agg(F.max_by("failures", "seq").alias("consecutive_failures"), F.min(F.when(F.col("failures") >= most, F.col("seq"))).alias("disabled_at"))


def disabled_notices(health: DataFrame, most: int = FAILURES) -> DataFrame:
    """The notification that each peer's disabling appends."""
    message = F.concat(F.lit("Peer "), F.col("peer").cast("string"), F.lit(f" auto-disabled after {most} consecutive failures"))
    return health.filter("disabled_at is not null").select(F.lit("peer_disabled").alias("kind"), message.alias("message"), F.col("disabled_at").alias("created_at"))


def reenabled(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """Nodes after a probe of the disabled ones: those that answered are enabled with a clean count."""
    answered = probes.filter("healthy").select("url", F.lit(True).alias("_up")).distinct()
    back = (~F.col("enabled")) & F.coalesce("_up", F.lit(False))
    return (
        nodes.join(answered, "url", "left")
        .withColumn("consecutive_failures", F.when(back, 0).otherwise(F.col("consecutive_failures")))
        .withColumn("disabled_at", F.when(~back, F.col("disabled_at")))
        .withColumn("enabled", F.col("enabled") | back)
        .select(*nodes.columns)
    )
