"""Changes to the document index as data: upserts by url, deletes, and the journal of a commit. See `segments` for its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.urls import index_host
from tarn.schemas import DOCUMENT


def last_of_each(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The row with the largest `order` of each key; one aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(index: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """index with the last document of each url of the batch in place of what was there. The url alone is the identity."""
    latest = last_of_each(batch, ["url"], order).withColumn("host", index_host("url")).select(*DOCUMENT.names)
    return index.join(latest.select("url"), "url", "left_anti").select(*DOCUMENT.names).unionByName(latest)


def delete(index: DataFrame, urls: DataFrame) -> DataFrame:
    return index.join(urls.select("url").distinct(), "url", "left_anti").select(*index.columns)


def journal(batch: DataFrame, order: str = "seq") -> DataFrame:
    """(collection_id, url, content_hash) of what a commit made durable."""
    return last_of_each(batch, ["url"], order).select("collection_id", "url", "content_hash")


def mark_indexed(pages: DataFrame, entries: DataFrame, keys: tuple[str, ...] | list[str] = ("collection_id", "url")) -> DataFrame:
    """crawled_pages with indexed_content_hash set from the journal, which is written after the commit; safe to repeat.

    Rows whose `keys` are equal are marked alike; further keys tell apart what shares a url.
    """
    new = entries.groupBy(*keys).agg(F.max("content_hash").alias("_new"))
    return pages.join(new, list(keys), "left").withColumn("indexed_content_hash", F.coalesce("_new", "indexed_content_hash")).drop("_new").select(*pages.columns)


def merged(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A keyed upsert: rows take the place of those with the same key."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def is_full(used: int, most: int) -> bool:
    return used >= most


def ranked_versions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """All versions with their rank from the newest, for audits of what an upsert dropped."""
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
