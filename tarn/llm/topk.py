"""Exact top-k by Hamming distance over binary codes: incremental multi-index hashing in every shard of the codes.

A code is cut into segments. If two codes differ in at most m * (r + 1) - 1 bits, some one of m segments differs in at
most r. Every shard indexes each segment; a query probes all values within radius 0, 1, 2 ... of its own, and stops once
its k-th verified distance is within what the radius has covered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import arrow, checkpointed, release

K = 10
SEGMENT_BITS = 16
#: Queries of one block and codes of one shard: what a task holds at a time.
BLOCK_QUERIES = 1 << 16
SHARD_CODES = 1 << 19
#: A shard is not cut below this many codes for the sake of more tasks.
LEAST_CODES = 1 << 12


def codes(vectors: DataFrame, vector: str = "embedding", row_id: str = "vec_id", words: int | None = None) -> DataFrame:
    """(id, code): bit i is set if number i is above zero; a code is `words` times 64 bits, by default as many as the longest needs.

    Null vectors and ids have no code; null numbers and missing ones are 0.
    """
    known = vectors.filter(F.col(row_id).isNotNull() & F.col(vector).isNotNull())
    if words is None:
        words = max(1, -(-int(known.agg(F.max(F.size(vector))).first()[0] or 0) // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if isinstance(lists, pa.LargeListArray):
                lists = lists.cast(pa.list_(lists.type.value_type))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.fill_null(0).to_numpy(zero_copy_only=False)
            size = np.diff(offsets)
            row, at = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            bits = np.zeros((len(size), 64 * words), bool)
            if len(size):
                bits[row, at] = flat[offsets[0] : offsets[-1]] > 0
            packed = np.packbits(bits, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], ["id", "code"])

    return known.select(F.col(row_id).cast("long"), F.col(vector)).transform(arrow, run, "id long, code binary")


class Index:
    """The distinct codes of one shard by the values of each segment; each has the `most` smallest of its ids."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, most: int, segment_bits: int = SEGMENT_BITS):
        order = np.lexsort((ids, *codes.T))
        ids, codes = ids[order], codes[order]
        new = np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)] if len(ids) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        keep = np.arange(len(ids)) - first[group] < most
        self.ids, self.codes, self.bits = ids[keep], codes[new], segment_bits
        self.first = np.r_[0, np.cumsum(np.bincount(group[keep], minlength=len(first)))]
        self.segments = 64 // segment_bits * codes.shape[1]
        self.orders, self.firsts = [], []
        for s in range(self.segments):
            part = self.part(self.codes, s)
            by = np.argsort(part, kind="stable")
            self.orders.append(by)
            self.firsts.append(np.searchsorted(part[by], np.arange((1 << segment_bits) + 1)))
        self.masks = [np.array([sum(1 << b for b in c) for c in combinations(range(segment_bits), r)], np.int64) for r in range(segment_bits + 1)]
        self.seen = np.zeros(len(self.codes), bool)

    def part(self, values: np.ndarray, s: int) -> np.ndarray:
        word, at = divmod(s * self.bits, 64)
        return ((values[:, word] >> np.uint64(at)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def search(self, own: int, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest, by distance and then id; rows with the id `own` are left out."""
        found, distance, touched = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        n = 0
        for radius in range(self.bits + 1):
            fresh = []
            for s in range(self.segments):
                value = self.part(code[None, :], s)[0] ^ self.masks[radius]
                low, high = self.firsts[s][value], self.firsts[s][value + 1]
                full = high > low
                low, size = low[full], (high - low)[full]
                rows = self.orders[s][np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                rows = rows[~self.seen[rows]]
                self.seen[rows] = True
                fresh.append(rows)
            rows = np.concatenate(fresh)
            touched.append(rows)
            n += len(rows)
            apart = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
            count = self.first[rows + 1] - self.first[rows]
            ids = self.ids[np.repeat(self.first[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            apart = np.repeat(apart, count)
            found, distance = np.concatenate([found, ids[ids != own]]), np.concatenate([distance, apart[ids != own]])
            found, distance = nearest_of(found, distance, k)
            if len(found) == k and distance[-1] <= self.segments * (radius + 1) - 1 or n == len(self.codes):
                break
        self.seen[np.concatenate(touched)] = False
        return found, distance


def nearest_of(ids: np.ndarray, distances: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest, by distance and then id, each id once with its least distance."""
    order = np.lexsort((ids, distances))
    ids, distances = ids[order], distances[order]
    once = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[once], distances[once]


def _words(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width) if len(column) else np.zeros((0, width), np.uint64)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, vector: str = "embedding", row_id: str = "vec_id", segment_bits: int = SEGMENT_BITS, block: int = BLOCK_QUERIES, shard: int = SHARD_CODES) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): the k nearest ids of each query id, by distance, then id; itself left out.

    An id is one candidate and one query, however many rows it has: the distance of two ids is the least between any of
    their rows. Every shard of codes meets every block of queries in a task of its own; both are dealt by the hash of id
    and code, so a common id or code is spread, and equal rows are one before that. Of a common code the k + 1 smallest
    ids of a shard are enough. Fewer than k other ids give fewer results.
    """
    flagged = vectors.withColumns({"_id": F.col(row_id), "_vector": F.col(vector), "_asked": F.coalesce(is_query, F.lit(False))}).select("_id", "_vector", "_asked")
    width = max(1, -(-int(flagged.filter("_id is not null").agg(F.max(F.size("_vector"))).first()[0] or 0) // 64))
    every = checkpointed(codes(flagged, "_vector", "_id", width).distinct())
    asked = checkpointed(codes(flagged.filter("_asked"), "_vector", "_id", width).distinct())
    n, q = every.count(), asked.count()
    tasks = min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_CODES))
    shards, blocks = max(1, tasks, -(-n // shard)), max(1, -(-q // block))
    deal = lambda parts: F.pmod(F.xxhash64("id", "code"), F.lit(parts)).cast("int")
    every = every.withColumn("shard", deal(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", deal(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(held: pa.Table, wanted: pa.Table) -> pa.Table:
        own, ask = wanted.column("id").to_numpy(), _words(wanted.column("code").combine_chunks(), width)
        index = Index(held.column("id").to_numpy(), _words(held.column("code").combine_chunks(), width), k + 1, segment_bits)
        got = [index.search(int(a), c, k) for a, c in zip(own, ask, strict=True)]
        release()
        query = np.repeat(own, [len(x) for x, _ in got])
        ids, apart = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"query_id": pa.array(query, pa.int64()), "neighbour_id": pa.array(ids, pa.int64()), "distance": pa.array(apart.astype(np.int32))})

    found = every.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, "query_id long, neighbour_id long, distance int")
    least = found.groupBy("query_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return least.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "distance")
