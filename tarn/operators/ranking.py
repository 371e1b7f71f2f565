"""The ranking formula: base relevance x source weight x freshness x domain boost."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.scalars import json_map
from tarn.operators.index import merged

DAY = 86400.0
HALF_LIFE_DAYS = 90.0


@dataclass(frozen=True)
class RankingConfig:
    half_life_days: float = HALF_LIFE_DAYS
    source_weights: dict[str, float] = field(default_factory=lambda: {"local": 1.0})
    domain_boosts: dict[str, float] = field(default_factory=dict)


def freshness(timestamp: Column, now: Column | int, half_life_days: Column | float) -> Column:
    """0.5 ^ (age / half-life); 1 for times to come and for a half-life of 0 or less."""
    now = F.lit(now) if isinstance(now, int) else now
    half = F.lit(float(half_life_days)) if isinstance(half_life_days, int | float) else half_life_days
    age = F.greatest(now - timestamp, F.lit(0)) / F.lit(DAY)
    return F.when(half <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age / half))


def weight(weights: dict[str, float] | Column, key: Column) -> Column:
    """The key's number, 1 if there is none. A Python dict becomes a literal map."""
    if isinstance(weights, dict):
        if not weights:
            return F.lit(1.0)
        weights = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(weights, key), F.lit(1.0))


def final_score(base: Column, source: Column, domain: Column, timestamp: Column, now: Column | int, config: RankingConfig) -> Column:
    return base * weight(config.source_weights, source) * freshness(timestamp, now, config.half_life_days) * weight(config.domain_boosts, domain)


def configs(collections: DataFrame, stored: DataFrame) -> DataFrame:
    """Each collection's ranking config, defaults where nothing (or nonsense) is stored.

    stored: collection_id, freshness_half_life_days, source_weights_json, domain_boosts_json.
    """
    default = F.create_map(F.lit("local"), F.lit(1.0))
    return (
        collections.select(F.col("id").alias("collection_id"))
        .join(stored, "collection_id", "left")
        .select(
            "collection_id",
            F.coalesce("freshness_half_life_days", F.lit(HALF_LIFE_DAYS)).alias("freshness_half_life_days"),
            F.when(F.col("source_weights_json").isNull(), default).otherwise(json_map("source_weights_json")).alias("source_weights"),
            json_map("domain_boosts_json").alias("domain_boosts"),
        )
    )


def saved_configs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored configs with some saved over them: the typed half-life, and the JSON of both maps as it was sent, for echo."""
    return merged(stored, new, ["collection_id"])


def scored_by_collection(hits: DataFrame, config: DataFrame, now: int) -> DataFrame:
    """hits (collection_id, bm25, source, domain, indexed_at) scored with the config of their own collection."""
    joined = hits.join(config, "collection_id", "left")
    half = F.coalesce("freshness_half_life_days", F.lit(HALF_LIFE_DAYS))
    score = F.col("bm25") * weight(F.col("source_weights"), F.col("source")) * freshness(F.col("indexed_at"), now, half) * weight(F.col("domain_boosts"), F.col("domain"))
    return joined.withColumn("score", score).drop("freshness_half_life_days", "source_weights", "domain_boosts")


def relabelled(peer_results: DataFrame, peers: DataFrame) -> DataFrame:
    """Peer results (peer_url, remote_collection, ...) with the subscription's weight in the score and the source naming the peer."""
    known = peers.select("peer_url", "remote_collection", "source_weight")
    label = F.concat(F.lit("peer:"), F.col("peer_url"), F.lit("/"), F.col("remote_collection"))
    return peer_results.join(known, ["peer_url", "remote_collection"]).withColumn("score", F.col("score") * F.col("source_weight")).withColumn("source", label).drop("source_weight")
