"""Helpers shared by the corpus operators: vectorised words and hashes, checkpoints, broadcast bounds."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
CHUNK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch between Spark and a Python worker. Spark's own 64 MB, times the copies that a step makes,
#: times the workers of an executor, would not leave room beside the heap.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_BYTES, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Gives memory that a task has freed back to the system, so that idle workers don't sit on it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches, with what a task has used given back at its end."""
    small_batches(df.sparkSession)

    def light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(light, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the folder named by spark.checkpoint.dir.

    Only a local master gets a folder of its own where that is unset; executors of a cluster could not share one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tarn-checkpoint-"))
    return df.checkpoint()


def identity(doc_id: Column, text: Column) -> Column:
    """A row by its id and text, as 128 bits; rows that agree in both are the same to every operator here."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(1), doc_id.isNull(), doc_id, text.isNull(), text).alias("b"))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names like those wanted that no column of docs has, whatever their case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of the map of keys that may_hold broadcasts: 8 MB whatever the number of keys. Full, it lets every row travel.
KEY_BITS = 1 << 26


def may_hold(df: DataFrame, key: Column, keys: DataFrame, flag: str, bits: int = KEY_BITS) -> DataFrame:
    """df with a column `flag`: whether key may be among the one column of keys (both 64-bit hashes); false is certain."""
    name = keys.columns[0]
    at = F.pmod(F.col(name), F.lit(bits))
    made = keys.select(F.bitmap_bucket_number(at).alias("_b"), F.bitmap_bit_position(at).alias("_at")).groupBy("_b").agg(F.bitmap_construct_agg("_at").alias("_map"))
    place = F.pmod(key, F.lit(bits))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.bitmap_bit_position(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, (F.bitmap_bit_position(place) % 8).cast("int")) == 1, F.lit(False))
    return df.join(F.broadcast(made), F.bitmap_bucket_number(place) == F.col("_b"), "left").select(*[df[c] for c in df.columns], hit.alias(flag))


def maybe(df: DataFrame, key: str, keys: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """Rows of df whose key may be among keys; none that is gets lost."""
    (flag,) = free_names(df, "_maybe")
    return may_hold(df, F.col(key), keys, flag, bits).filter(flag).drop(flag)


def remainder(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 4: remainder 2 is held out. A null id has remainder null."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column | str) -> Column:
    """True where the remainder is 2; a null id is not held out."""
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


# ---------------------------------------------------------------- vectorised text


class _Powers:
    """P^i and P^-i modulo 2^64, grown when a longer text comes and cut back after it."""

    keep = 4 << 20

    def __init__(self, base: int = _ODD):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) >= n:
            return self.up, self.down
        out = []
        for base in (self.base, self.inverse):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        if n <= self.keep:
            self.up, self.down = out
        return out[0], out[1]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of values[start:end] for each pair, by prefix sums; equal contents have equal hashes."""
    n = len(values)
    up, down = _POWERS.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_parts(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts, each of about `most` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of some texts: byte spans, 64-bit hashes, and the first word of each row (rows + 1 numbers)."""

    __slots__ = ("ends", "first", "hashes", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None, hashed: bool = True):
        n = len(data)
        flags = is_word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = flags[:-1], flags[1:]
        heads, tails = offsets[:-1], offsets[1:] - 1
        before[heads[heads < n]] = False
        after[tails[tails >= 0]] = False
        self.starts = np.flatnonzero(flags & ~before)
        self.ends = np.flatnonzero(flags & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = span_hash((data if fold is None else fold[data]).astype(np.uint64) + np.uint64(1), self.starts, self.ends) if hashed else None

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def byte_set(outside: str) -> np.ndarray:
    """Which bytes of UTF-8 belong to words; `outside` lists the ASCII characters that don't."""
    out = np.ones(256, bool)
    out[[ord(c) for c in outside]] = False
    return out


#: A word is a run of anything but space and U+0009 to U+000D.
SPACED = byte_set(" \t\n\v\f\r")
#: A word is a run of digits, letters a to z (after folding) and anything outside ASCII.
PLAIN = byte_set("".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def window_ends(words: Words, size: int) -> np.ndarray:
    """The words at which a window of `size` words of one row can start."""
    counts = np.diff(words.first)
    fits = np.maximum(counts - size + 1, 0)
    return np.repeat(words.first[:-1], fits) + (np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits))


class SortedHashes:
    """Distinct 64-bit keys in an array sorted by hash, with an index on the leading bits; lookups are vectorised."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(np.asarray(keys, np.uint64))
        h = keys * np.uint64(_ODD)
        order = np.argsort(h, kind="stable")
        self.keys, h = keys[order], h[order]
        self.order = order  # position here -> position among the sorted keys
        bits = max(4, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.index = np.searchsorted(h >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)
        self.longest = int(np.diff(self.index).max()) if len(keys) else 0

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key in self.keys, or -1."""
        if not len(self.keys) or not len(wanted):
            return np.full(len(wanted), -1, np.int64)
        bucket = ((wanted * np.uint64(_ODD)) >> self.shift).astype(np.int64)
        at, top = self.index[bucket], self.index[bucket + 1]
        out = np.where((at < top) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted), at, -1)
        left = np.flatnonzero((out < 0) & (at + 1 < top))
        for step in range(1, self.longest):
            if not len(left):
                break
            hit = self.keys[at[left] + step] == wanted[left]
            out[left[hit]] = at[left[hit]] + step
            left = left[~hit]
            left = left[at[left] + step + 1 < top[left]]
        return out


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]] along axis 0, zero for empty segments."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint sorted intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]
