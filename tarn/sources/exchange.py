"""Export and import of whole collections as one nested JSON document, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.scalars import import_hash
from tarn.schemas import ENVELOPE, FORMAT_VERSION


class FormatError(ValueError):
    """The document is of another format version, or no export at all."""


def _time(c: str):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def documents_by_collection(docs: DataFrame) -> DataFrame:
    """(name, documents): each collection's documents in order of url. The name is how documents know their collection."""
    item = F.struct("url", "title", "body", "indexed_at")
    return docs.groupBy(F.col("collection").alias("name")).agg(F.array_sort(F.collect_list(item)).alias("documents"))


def exported_collections(tables: dict[str, DataFrame], docs: DataFrame) -> DataFrame:
    """One nested row for each collection, in the shape of the envelope; documents of unknown names are left out."""
    page = F.struct("url", "etag", "last_modified", "content_hash", F.col("last_status").cast("long").alias("last_status"), "last_crawled_at", "indexed_content_hash")
    pages = tables["crawled_pages"].groupBy("target_id").agg(F.array_sort(F.collect_list(page)).alias("crawled_pages"))
    target = F.struct(
        "url_prefix", "recrawl_interval_s", F.col("recrawl_interval_s").alias("recrawl_interval_secs"), F.col("enabled").cast("long").alias("enabled"), "crawl_delay_secs",
        F.col("created_at").cast("string").alias("created_at"), F.coalesce("crawled_pages", F.array().cast(pages.schema["crawled_pages"].dataType)).alias("crawled_pages"),
    )
    t = tables["crawl_targets"]
    targets = t.join(pages, t["id"] == pages["target_id"], "left").drop("target_id").groupBy("collection_id").agg(F.array_sort(F.collect_list(target)).alias("crawl_targets"))
    ranking = tables["ranking_config"].select("collection_id", F.struct("freshness_half_life_days", F.to_json("source_weights").alias("source_weights_json"), F.to_json("domain_boosts").alias("domain_boosts_json"), "config_json").alias("ranking_config"))
    outlink = F.struct("host", "link_count", F.to_json("examples").alias("examples_json"), "first_seen_at", "last_seen_at", "status")
    outlinks = tables["outlink_host_suggestions"].groupBy("collection_id").agg(F.array_sort(F.collect_list(outlink)).alias("outlink_host_suggestions"))
    out = tables["collections"].withColumnRenamed("id", "collection_id")
    for part in (targets, ranking, outlinks):
        out = out.join(part, "collection_id", "left")
    out = out.join(documents_by_collection(docs), "name", "left")
    return out.select("name", "description", _time("created_at").alias("created_at"), _time("updated_at").alias("updated_at"), "crawl_targets", "ranking_config", "documents", "outlink_host_suggestions").orderBy("name")


def envelope(tables: dict[str, DataFrame], docs: DataFrame, exported_at: str, self_url: str) -> DataFrame:
    """The one-row export. It is one JSON document by its format, so it must fit in one task; export_rows has no such bound."""
    one = exported_collections(tables, docs).agg(F.array_sort(F.collect_list(F.struct("name", "description", "created_at", "updated_at", "crawl_targets", "ranking_config", "documents", "outlink_host_suggestions"))).alias("collections"))
    nodes = tables["node_peers"]
    peers = nodes.agg(F.array_sort(F.collect_list(F.struct("url", "name", F.col("enabled").cast("long").alias("enabled")))).alias("node_peers"))
    item = F.struct("local_collection", "node_peer_url", "remote_collection", "source_weight", F.col("enabled").cast("long").alias("enabled"))
    subscriptions = tables["collection_peers"].join(nodes.select(F.col("id").alias("node_peer_id"), F.col("url").alias("node_peer_url")), "node_peer_id").agg(F.array_sort(F.collect_list(item)).alias("collection_peers"))
    head = [F.lit(FORMAT_VERSION).cast("long").alias("format_version"), F.lit(exported_at).alias("exported_at"), F.lit(self_url).alias("self_url")]
    return one.crossJoin(peers).crossJoin(subscriptions).select(*head, "collections", "node_peers", "collection_peers")


def write_export(export: DataFrame, path: str, gzip: bool = True) -> None:
    export.write.mode("overwrite").json(path, compression="gzip" if gzip else "none", ignoreNullFields=False)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The export at path, gzipped or plain by its name. FormatError unless every document is of the known version."""
    found = spark.read.schema(ENVELOPE).json(path)
    if found.filter(~F.col("format_version").eqNullSafe(F.lit(FORMAT_VERSION))).limit(1).count():
        raise FormatError(f"format_version is not {FORMAT_VERSION}")
    return found


def new_collections(export: DataFrame, existing: DataFrame) -> DataFrame:
    """Exported collections whose name is not taken; one that is taken is skipped with all it holds."""
    rows = export.select(F.explode("collections").alias("c")).select("c.*")
    return rows.join(existing.select("name"), "name", "left_anti")


def import_tables(export: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that an import adds to each table, and to `documents` (with their import hash).

    Ids follow from names. Pages come without indexed_content_hash, so they are indexed once more. Node peers are added
    unless their url is known; subscriptions need a collection and a node that exist then.
    """
    new = new_collections(export, tables["collections"]).withColumn("id", F.sha2("name", 256))
    targets = new.select(F.col("id").alias("collection_id"), F.explode("crawl_targets").alias("t")).select("collection_id", "t.*").withColumn("id", F.sha2(F.concat_ws("\n", "collection_id", "url_prefix"), 256))
    pages = targets.select("collection_id", F.col("id").alias("target_id"), F.explode("crawled_pages").alias("p")).select("collection_id", "target_id", "p.*").withColumn("indexed_content_hash", F.lit(None).cast("string"))
    known = tables["collections"].select("name").unionByName(new.select("name"))
    nodes = export.select(F.explode("node_peers").alias("n")).select("n.*").join(tables["node_peers"].select("url"), "url", "left_anti").withColumn("id", F.sha2("url", 256))
    every = tables["node_peers"].select("id", "url").unionByName(nodes.select("id", "url"))
    asked = export.select(F.explode("collection_peers").alias("s")).select("s.*")
    subscriptions = asked.join(known.withColumnRenamed("name", "local_collection"), "local_collection", "left_semi").join(every.select(F.col("id").alias("node_peer_id"), F.col("url").alias("node_peer_url")), "node_peer_url")
    docs = new.select(F.col("name").alias("collection"), F.explode("documents").alias("d")).select("collection", "d.*").withColumn("content_hash", import_hash("body"))
    return {
        "collections": new.select("id", "name", "description", "created_at", "updated_at"),
        "crawl_targets": targets.drop("crawled_pages", "recrawl_interval_secs"),
        "crawled_pages": pages,
        "ranking_config": new.filter("ranking_config is not null").select(F.col("id").alias("collection_id"), "ranking_config.*"),
        "outlink_host_suggestions": new.select(F.col("id").alias("collection_id"), F.explode("outlink_host_suggestions").alias("o")).select("collection_id", "o.*"),
        "node_peers": nodes,
        "collection_peers": subscriptions.select("local_collection", "node_peer_id", "remote_collection", "source_weight", "enabled"),
        "documents": docs,
    }


def import_report(export: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: what was applied and what was skipped."""
    total = export.select(F.coalesce(F.size("collections"), F.lit(0)).cast("long").alias("n"))
    return report(total.agg(F.sum("n").alias("collections_total")), import_tables(export, tables))


def report(total: DataFrame, added: dict[str, DataFrame]) -> DataFrame:
    """One row of counts: all collections (total), the rows added to each table, the collections skipped."""
    one = total
    for name in ("collections", "crawl_targets", "crawled_pages", "documents", "node_peers", "collection_peers"):
        one = one.crossJoin(added[name].agg(F.count("*").alias(f"{name}_added")))
    return one.withColumn("collections_skipped", F.col("collections_total") - F.col("collections_added"))
