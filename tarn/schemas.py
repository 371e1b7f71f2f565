"""Explicit schemas: the search document, the relational tables and the exchange envelope. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _d, _b = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


DOCUMENT = _struct(collection=_s, url=_s, host=_s, title=_s, body=_s, indexed_at=_l)
UPSERT = _struct(collection=_s, collection_id=_s, url=_s, title=_s, body=_s, indexed_at=_l, content_hash=_s, seq=_l)
JOURNAL = _struct(collection_id=_s, url=_s, content_hash=_s)
RESULT = _struct(title=_s, url=_s, snippet_html=_s, source=_s, timestamp=_l, score=_d)
LINK = _struct(source_url=_s, target_url=_s, link_text=_s, pos=T.IntegerType())
FETCH = _struct(url=_s, status=T.IntegerType(), content_type=_s, etag=_s, last_modified=_s, retry_after=_s, final_url=_s, body=_s)
EXAMPLE = _struct(source_url=_s, target_url=_s, link_text=_s)

#: Relational tables by name; keys are the natural ones, ids are strings.
TABLES: dict[str, T.StructType] = {
    "settings": _struct(key=_s, value=_s),
    "app_config": _struct(key=_s, value=_s),
    "collections": _struct(id=_s, name=_s, description=_s, created_at=T.TimestampType(), updated_at=T.TimestampType()),
    "crawl_targets": _struct(id=_s, collection_id=_s, url_prefix=_s, recrawl_interval_s=_l, last_crawled_at=_l, enabled=_b, crawl_delay_secs=_l, created_at=_l),
    "crawled_pages": _struct(collection_id=_s, target_id=_s, url=_s, etag=_s, last_modified=_s, content_hash=_s, last_status=T.IntegerType(), last_crawled_at=_l, indexed_content_hash=_s),
    "ranking_config": _struct(collection_id=_s, freshness_half_life_days=_d, source_weights=T.MapType(_s, _d), domain_boosts=T.MapType(_s, _d), config_json=_s),
    "outlink_host_suggestions": _struct(collection_id=_s, host=_s, link_count=_l, examples=T.ArrayType(EXAMPLE), first_seen_at=_l, last_seen_at=_l, status=_s, promoted_target_id=_s),
    "node_peers": _struct(id=_s, url=_s, name=_s, enabled=_b, consecutive_failures=_l, last_response_ms=_l, last_checked_at=_l, disabled_at=_l),
    "collection_peers": _struct(local_collection=_s, node_peer_id=_s, remote_collection=_s, source_weight=_d, enabled=_b),
    "discovered_engines": _struct(url=_s, name=_s, description=_s, first_seen=_l, last_seen=_l),
    "rate_limit_state": _struct(ip=_s, request_log=T.ArrayType(_l), violations=_l, cooloff_until=_l, last_violation_at=_l),
    "auth_attempts": _struct(ip=_s, failed_count=_l, lockout_until=_l, last_attempt_at=_l),
    "admin_notifications": _struct(id=_s, kind=_s, message=_s, created_at=_l, read_at=_l),
}

#: The keys on which upserts merge.
KEYS: dict[str, list[str]] = {
    "settings": ["key"],
    "app_config": ["key"],
    "collections": ["name"],
    "crawl_targets": ["collection_id", "url_prefix"],
    "crawled_pages": ["collection_id", "url"],
    "ranking_config": ["collection_id"],
    "outlink_host_suggestions": ["collection_id", "host"],
    "node_peers": ["url"],
    "collection_peers": ["local_collection", "node_peer_id", "remote_collection"],
    "discovered_engines": ["url"],
    "rate_limit_state": ["ip"],
    "auth_attempts": ["ip"],
    "admin_notifications": ["id"],
}

_PAGE = _struct(url=_s, etag=_s, last_modified=_s, content_hash=_s, last_status=_l, last_crawled_at=_l, indexed_content_hash=_s)
_TARGET = _struct(url_prefix=_s, recrawl_interval_s=_l, recrawl_interval_secs=_l, enabled=_l, crawl_delay_secs=_l, created_at=_s, crawled_pages=T.ArrayType(_PAGE))
_RANKING = _struct(freshness_half_life_days=_d, source_weights_json=_s, domain_boosts_json=_s, config_json=_s)
_DOC = _struct(url=_s, title=_s, body=_s, indexed_at=_l)
_OUTLINK = _struct(host=_s, link_count=_l, examples_json=_s, first_seen_at=_l, last_seen_at=_l, status=_s)
COLLECTION = _struct(name=_s, description=_s, created_at=_s, updated_at=_s, crawl_targets=T.ArrayType(_TARGET), ranking_config=_RANKING, documents=T.ArrayType(_DOC), outlink_host_suggestions=T.ArrayType(_OUTLINK))
ENVELOPE = _struct(
    format_version=_l,
    exported_at=_s,
    self_url=_s,
    collections=T.ArrayType(COLLECTION),
    node_peers=T.ArrayType(_struct(url=_s, name=_s, enabled=_l)),
    collection_peers=T.ArrayType(_struct(local_collection=_s, node_peer_url=_s, remote_collection=_s, source_weight=_d, enabled=_l)),
)
FORMAT_VERSION = 1
