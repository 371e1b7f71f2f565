"""Near-duplicates by SimHash: pigeonhole blocks find the close fingerprints, stars join them into components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import arrow, checkpointed, free_names, identity, may_hold

BITS = 64
#: Fingerprints of one block that are compared with one another; a fuller block is cut again by finer blocks.
BLOCK_MOST = 256
FINE_BLOCKS = 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one text: a bit is 1 if set in over half the shingle hashes; no word gives zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns `keep` for each row; a null or empty text has fingerprint zero. Only ASCII letters are folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()) if batch.num_rows else []
            got = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])

    taken = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in taken.schema.fields[2:])
    return taken.transform(arrow, run, "doc_id long, fp long" + more)


def _blocks(bits: int, parts: int) -> list[int]:
    """Masks that split the fingerprint into blocks of about equal width."""
    cuts = [round(bits * i / parts) for i in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    return fps.select("fp", table.alias("k")).select("k.t", "k.key", "fp")


def _verified(keyed: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(a, b), a < b, of each table's groups, each close pair in its first table only."""
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = reduce(lambda rest, im: F.when(differ.bitwiseAND(F.lit(im[1])) == 0, F.lit(im[0])).otherwise(rest), list(enumerate(masks))[::-1], F.lit(-1)) if len(masks) <= 16 else F.col("t")
    pairs = keyed.withColumnRenamed("fp", "a").join(keyed.withColumnRenamed("fp", "b"), ["t", "key"])
    return pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius) & (F.col("t") == first)).select("a", "b")


def close_pairs(fps: DataFrame, radius: int = 2, spare: int = 3, most: int = BLOCK_MOST, fine: int = FINE_BLOCKS) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints `fp` that `radius` or fewer bits part.

    radius + spare blocks; two close fingerprints agree on at least `spare` of them, so each choice of `spare` blocks is
    a table to join on, and each pair of a group is verified. Groups of more than `most` are cut again by `fine` blocks,
    of which close fingerprints agree on all but `radius`: what is left free in a fine group is radius blocks of a few
    bits, so for two bits and 16 blocks no group can hold more than 256 fingerprints, whatever the data.
    """
    coarse = [_signed(reduce(int.__or__, c)) for c in combinations(_blocks(BITS, radius + spare), spare)]
    keyed = _keyed(fps, coarse)
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    small = keyed.join(sizes.filter(F.col("n") <= most).select("t", "key"), ["t", "key"], "left_semi")
    large = keyed.join(sizes.filter(F.col("n") > most).select("t", "key"), ["t", "key"], "left_semi").select("fp").distinct()
    finer = [_signed(reduce(int.__or__, c)) for c in combinations(_blocks(BITS, fine), fine - radius)]
    return _verified(small, coarse, radius).unionByName(_verified(_keyed(large, finer), finer, radius).distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node that a node of `edges` (a, b) reaches; large and small stars in turn.

    Hubs are summed up by partial aggregation and met by joins that Spark may split, never gathered in one group.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(df: DataFrame) -> DataFrame:
        both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return small.filter("u <> v").distinct()

    was = state(edges)
    for _ in range(rounds):
        if not was[0]:
            break
        edges = checkpointed(star(edges))
        now = state(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, most: int = BLOCK_MOST) -> DataFrame:
    """One row for each row of docs: doc_id, fp (long), component_id.

    component_id is the smallest doc_id that the document reaches over links of `radius` or fewer bits, itself
    included; equal texts always link. A null doc_id takes part in the links but is never an id; where nothing in a
    component has an id, component_id is null. Null and empty texts share fingerprint zero and link like any other.
    Repeated rows each get a row. Extra columns are ignored.
    """
    known = checkpointed(fingerprints(docs, shingle))
    groups = known.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(close_pairs(groups.select("fp"), radius, most=most))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return known.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column | str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, radius: int = 2) -> DataFrame:
    """docs, all columns, with one row of each component of near-duplicates.

    The row with the smallest doc_id stays; of rows that share it, that with the smallest hash of its text, and of rows
    equal in both any one. A component without ids keeps the row with the smallest hash. Null and empty texts are one
    component. Rows that stay for certain are never shuffled: a bounded map tells which rows may be in the way.
    """
    ids, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    name, maybe_name, count = free_names(docs, "_row", "_maybe", "_n")
    taken = docs.select(ids.alias("doc_id"), text.alias("text"), identity(ids, text).alias("row"))
    known = checkpointed(fingerprints(taken, keep=("row",)).groupBy("row", "doc_id", "fp").agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    least = known.groupBy("fp").agg(F.min(order).alias("least"))
    roots = components(close_pairs(least.select("fp"), radius))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stays = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    # rows that go, and rows of which one copy stays
    gone = checkpointed(known.join(stays.withColumn("stays", F.lit(True)), "row", "left").filter("stays is null or n > 1").select("row", F.coalesce("stays", F.lit(False)).alias("stays")))
    flagged = may_hold(docs.withColumn(name, identity(ids, text)), F.col(f"{name}.a"), gone.select("row.a"), maybe_name)
    judged = flagged.filter(maybe_name).join(gone.select(F.col("row").alias(name), F.col("stays").alias(count)), name, "left")
    kept = judged.filter(F.col(count).isNull())
    once = judged.filter(count).dropDuplicates([name])
    return flagged.filter(~F.col(maybe_name)).select(*docs.columns).unionByName(kept.select(*docs.columns)).unionByName(once.select(*docs.columns))
