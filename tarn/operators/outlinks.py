"""Links out of scope, rolled up by host into a review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.urls import host_of, promoted_prefix

EXAMPLES = 5
PENDING, PROMOTED, DISMISSED = "pending", "promoted", "dismissed"


def first_examples(hits: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(collection_id, host, examples): the first `most` distinct pairs of source and target in order of `seq`.

    Distinct pairs are found by an aggregation that is combined before its shuffle; the rank limit is applied on both
    sides of the next one, so a host with very many links sends few rows.
    """
    distinct = hits.groupBy("collection_id", "host", "source_url", "target_url").agg(F.min(F.struct("seq", "link_text")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("collection_id", "host").orderBy("f.seq", "source_url", "target_url"))
    few = distinct.withColumn("k", rank).filter(F.col("k") <= most)
    listed = few.groupBy("collection_id", "host").agg(F.array_sort(F.collect_list(F.struct("k", "source_url", "target_url", F.col("f.link_text").alias("link_text")))).alias("e"))
    return listed.select("collection_id", "host", F.transform("e", lambda x: F.struct(x["source_url"].alias("source_url"), x["target_url"].alias("target_url"), x["link_text"].alias("link_text"))).alias("examples"))


def rollup(hits: DataFrame) -> DataFrame:
    """(collection_id, host, link_count, first_seen_at, last_seen_at, examples); every occurrence counts.

    hits: collection_id, host, source_url, target_url, link_text, seen_at, seq.
    """
    counts = hits.groupBy("collection_id", "host").agg(F.count("*").alias("link_count"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))
    return counts.join(first_examples(hits), ["collection_id", "host"])


def recorded(suggestions: DataFrame, hits: DataFrame) -> DataFrame:
    """suggestions after more hits: pending rows grow, new hosts are added, hosts that were decided ignore theirs."""
    decided = suggestions.filter(F.col("status") != PENDING)
    new = rollup(hits.join(decided.select("collection_id", "host"), ["collection_id", "host"], "left_anti"))
    old = suggestions.filter(F.col("status") == PENDING)
    both = old.select("collection_id", "host", *[F.col(c).alias(f"o_{c}") for c in ("link_count", "first_seen_at", "last_seen_at", "examples", "status")]).join(new, ["collection_id", "host"], "full_outer")
    pair = lambda x: F.struct(x["source_url"], x["target_url"])
    fresh = F.filter("examples", lambda e: ~F.exists(F.coalesce("o_examples", F.array()), lambda o: pair(o).eqNullSafe(pair(e))))
    examples = F.when(F.col("o_examples").isNull(), F.col("examples")).when(F.col("examples").isNull(), F.col("o_examples")).otherwise(F.slice(F.concat("o_examples", fresh), 1, EXAMPLES))
    grown = both.select(
        "collection_id", "host", (F.coalesce("o_link_count", F.lit(0)) + F.coalesce("link_count", F.lit(0))).alias("link_count"),
        F.least("o_first_seen_at", "first_seen_at").alias("first_seen_at"), F.greatest("o_last_seen_at", "last_seen_at").alias("last_seen_at"), examples.alias("examples"), F.lit(PENDING).alias("status"),
    )
    return grown.unionByName(decided.select(*grown.columns))


def hits_of(links: DataFrame) -> DataFrame:
    """Outlinks with the host they go to."""
    return links.withColumn("host", host_of("target_url")).filter("host is not null")


def queue_page(suggestions: DataFrame, collection_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Pending suggestions of a collection, most links first, then most recent; limit 1 to 500."""
    limit, offset = max(1, min(limit, 500)), max(0, offset)
    rows = suggestions.filter((F.col("collection_id") == collection_id) & (F.col("status") == PENDING))
    return rows.orderBy(F.desc("link_count"), F.desc("last_seen_at"), "host").offset(offset).limit(limit)


def decide(suggestions: DataFrame, keys: DataFrame, status: str) -> DataFrame:
    """suggestions with those named by keys (collection_id, host) promoted or dismissed."""
    named = keys.select("collection_id", "host", F.lit(True).alias("_named"))
    return suggestions.join(named, ["collection_id", "host"], "left").withColumn("status", F.when(F.col("_named"), status).otherwise(F.col("status"))).select(*suggestions.columns)


def promoted_targets(suggestions: DataFrame, keys: DataFrame) -> DataFrame:
    """The crawl targets that promotion adds: https://host/ of each collection."""
    return suggestions.join(keys, ["collection_id", "host"], "left_semi").select("collection_id", promoted_prefix("host").alias("url_prefix")).distinct()


