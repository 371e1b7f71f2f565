"""Relational views and changes of the administrator: overviews, counts, cascades and guarded inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.urls import normalize_url
from tarn.operators.index import merged


def target_overview(targets: DataFrame, collections: DataFrame, pages: DataFrame) -> DataFrame:
    """Each target with its collection, whether it was throttled, its failing pages and its pages with content.

    One conditional aggregation of pages stands in for three lookups a target; a count of content is of content_hash.
    """
    status = F.col("last_status")
    per = pages.groupBy("target_id").agg(
        F.bool_or(status == 429).alias("rate_limited"), F.count_if((status >= 400) & (status != 429)).alias("error_count"), F.count("content_hash").alias("indexed_pages_count")
    )
    names = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection"))
    joined = targets.join(names, "collection_id").join(per, targets["id"] == per["target_id"], "left").drop("target_id")
    return joined.fillna({"rate_limited": False, "error_count": 0, "indexed_pages_count": 0}).orderBy("collection", *[c for c in ("created_at",) if c in targets.columns], "id")


def collection_counts(collections: DataFrame, docs: DataFrame) -> DataFrame:
    """Collections by name with their number of documents, 0 if none; documents hold the name."""
    n = docs.groupBy("collection").agg(F.count("*").alias("documents"))
    return collections.join(n, collections["name"] == n["collection"], "left").select("name", "description", F.coalesce("documents", F.lit(0)).alias("documents")).orderBy("name")


def target_counts(targets: DataFrame) -> DataFrame:
    return targets.groupBy("collection_id").agg(F.count("*").alias("targets"), F.count_if("enabled").alias("enabled_targets"))


def target_urls(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """The urls crawled for each target, in order."""
    return pages.select("target_id", "url").join(targets.select(F.col("id").alias("target_id"), "url_prefix"), "target_id").orderBy("target_id", "url")


def status_snapshot(docs: DataFrame, collections: DataFrame, targets: DataFrame, suggestions: DataFrame, index_bytes: int, max_bytes: int) -> DataFrame:
    """One row of totals."""
    one = docs.agg(F.count("*").alias("documents"))
    for df, column in ((collections, "collections"), (targets, "targets"), (suggestions.filter("status = 'pending'"), "pending_outlinks")):
        one = one.crossJoin(df.agg(F.count("*").alias(column)))
    return one.withColumn("index_bytes", F.lit(index_bytes)).withColumn("index_full", F.lit(index_bytes >= max_bytes))


def drop_collections(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without some collections and all that hangs on them; indexed documents stay, they hold the name."""
    gone = ids.select(F.col("id").alias("collection_id")).distinct()
    out = dict(tables)
    out["collections"] = tables["collections"].join(ids.select("id").distinct(), "id", "left_anti")
    for name in ("crawl_targets", "crawled_pages", "outlink_host_suggestions", "ranking_config"):
        if name in tables:
            out[name] = tables[name].join(gone, "collection_id", "left_anti").select(*tables[name].columns)
    return out


def saved_collections(collections: DataFrame, rows: DataFrame) -> DataFrame:
    """Collections with some created, or updated where the id is known; a name that another collection has is left out."""
    others = collections.select(F.col("name"), F.col("id").alias("_id"))
    free = rows.join(others, "name", "left").filter(F.col("_id").isNull() | (F.col("_id") == F.col("id"))).select(*rows.columns)
    return merged(collections, free, ["id"])


def add_targets(targets: DataFrame, new: DataFrame) -> DataFrame:
    """Targets with some added, their prefix in normal form; a prefix that the collection has, or that is no URL, is left out."""
    clean = new.withColumn("url_prefix", normalize_url("url_prefix")).filter("url_prefix is not null").dropDuplicates(["collection_id", "url_prefix"])
    return targets.unionByName(clean.join(targets.select("collection_id", "url_prefix"), ["collection_id", "url_prefix"], "left_anti").select(*new.columns), allowMissingColumns=True)


def set_on_targets(targets: DataFrame, changes: DataFrame) -> DataFrame:
    """Targets with the columns of changes (id, recrawl_interval_s, crawl_delay_secs or enabled) where they are not null."""
    named = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"_{c}") for c in named])
    return targets.join(new, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in named}).select(*targets.columns)


def exported_sets(docs: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(kind, value): the distinct collections that documents are in and the distinct remote collections subscribed to."""
    one = docs.select(F.lit("collection").alias("kind"), F.col("collection").alias("value")).distinct()
    return one.unionByName(subscriptions.select(F.lit("remote").alias("kind"), F.col("remote_collection").alias("value")).distinct())


def drop_target(tables: dict[str, DataFrame], docs: DataFrame, ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without some targets and their pages, and docs without what those pages indexed."""
    gone = ids.select(F.col("id").alias("target_id")).distinct()
    pages = tables["crawled_pages"]
    out = tables | {"crawl_targets": tables["crawl_targets"].join(ids.select("id").distinct(), "id", "left_anti"), "crawled_pages": pages.join(gone, "target_id", "left_anti").select(*pages.columns)}
    return out, docs.join(pages.join(gone, "target_id", "left_semi").select("url").distinct(), "url", "left_anti").select(*docs.columns)


def drop_nodes(nodes: DataFrame, subscriptions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node peers without some, and subscriptions without theirs."""
    gone = ids.select("id").distinct()
    return nodes.join(gone, "id", "left_anti"), subscriptions.join(gone, subscriptions["node_peer_id"] == gone["id"], "left_anti")


def enable_nodes(nodes: DataFrame, ids: DataFrame, enabled: bool) -> DataFrame:
    """Nodes switched on or off by hand; switching on clears the failures."""
    named = nodes.join(ids.select("id", F.lit(True).alias("_n")).distinct(), "id", "left")
    on = F.col("_n") & F.lit(enabled)
    return (
        named.withColumn("consecutive_failures", F.when(on, 0).otherwise(F.col("consecutive_failures")))
        .withColumn("disabled_at", F.when(F.coalesce(on, F.lit(False)), F.lit(None)).otherwise(F.col("disabled_at")))
        .withColumn("enabled", F.when(F.col("_n"), F.lit(enabled)).otherwise(F.col("enabled")))
        .select(*nodes.columns)
    )


def add_subscriptions(subscriptions: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Subscriptions upserted by their key; those to unknown nodes are left out."""
    known = new.join(nodes.select(F.col("id").alias("node_peer_id")), "node_peer_id", "left_semi")
    return merged(subscriptions, known, ["local_collection", "node_peer_id", "remote_collection"])


def promoted_node(nodes: DataFrame, engines: DataFrame, url: str) -> DataFrame:
    """A discovered engine as a node peer, unless it is one."""
    new = engines.filter(F.col("url") == url).join(nodes.select("url"), "url", "left_anti").select("url", "name", F.lit(True).alias("enabled"), F.lit(0).cast("long").alias("consecutive_failures"), F.sha2("url", 256).alias("id"))
    return nodes.unionByName(new, allowMissingColumns=True)


def set_values(settings: DataFrame, new: DataFrame) -> DataFrame:
    return merged(settings, new, ["key"])


def notify(notifications: DataFrame, new: DataFrame) -> DataFrame:
    return notifications.unionByName(new, allowMissingColumns=True)
