"""Filter interaction audit: what each order of the filters keeps, removes and wastes, by one matrix product a part.

A document is the mask of the filters that it fails. A part (source) is a row of three histograms over the 2^k masks: all
documents, the good ones, the toxic ones. What an order of filters does at a step is the same linear function of such a
histogram for every part, so each outcome (kept, removed, redundant, unique) is one integer matrix of 2^k rows and
orders x steps columns (32 by 600 for five filters), and stacked parts are multiplied by it. Texts are read once; no
order is run.

Defined results: a null text is empty, and so has no words and fails only the word count (and, where a smaller id is empty
too, identity). A null id is never smaller than another and has none smaller. Rows that share an id are documents of their
own; none makes the other fail by identity. Several labels of an id count together: it is good if any row says so. A null
part is the empty string. An empty table has no parts and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import arrow

#: Space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
#: Parts multiplied at once.
STACK = 256


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails each filter that needs no other text."""
    inner = F.btrim(text, F.lit(BLANKS))
    words = F.split(inner, r"[\x20\x09-\x0D]+")
    some = inner != ""
    n = F.when(some, F.size(words)).otherwise(0)
    distinct = F.when(some, F.size(F.array_distinct(words))).otherwise(0)
    return {
        "A": n < 50,
        "B": 100 * distinct < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def histograms(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents of a part by the filters that they fail; bit i is the i-th of ABCDE.

    Equal rows are counted before they travel, and identity is a join on (text digest, least id): copies of a text have
    keys of their own, so a group of copies spreads like any other rows. No text is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = list(text_filters(F.col("text")).values())
    rows = (
        docs.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
        .select("doc_id", "part", F.unhex(F.md5("text")).alias("digest"), sum(f.cast("int") * (1 << i) for i, f in enumerate(fails)).alias("own"))
        .groupBy("digest", "doc_id", "part", "own")
        .agg(F.count("*").alias("n"))
    )
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.groupBy("doc_id").agg(F.max(F.expr("cast(quality = 1 as int)")).alias("good"), F.max(F.expr("cast(toxic = 1 as int)")).alias("toxic")).filter("doc_id is not null")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)) * F.col("n")
    return (
        rows.join(first, ["digest", "doc_id"], "left")
        .join(known, "doc_id", "left")
        .groupBy("part", (F.col("own") + copy.cast("int") * (1 << len(fails))).alias("mask"))
        .agg(F.sum("n").alias("n"), F.sum(flag("good")).alias("good"), F.sum(flag("toxic")).alias("toxic"))
    )


def outcome_matrices(letters: str) -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """(orders, filter of each column, integer matrices by outcome) for all orders of the letters; column = order x step."""
    k = len(letters)
    orders = list(permutations(range(k)))
    masks = np.arange(1 << k)
    at = np.array([f for order in orders for f in order])
    before = np.array([sum(1 << f for f in order[:step]) for order in orders for step in range(k)])
    fails = (masks[:, None] >> at) & 1
    gone = ((masks[:, None] & before) != 0).astype(np.int64)
    out = {
        "kept": (1 - gone) * (1 - fails),
        "removed": (1 - gone) * fails,
        "redundant": gone * fails,
        "unique_fails": (masks[:, None] == (1 << at)).astype(np.int64),
    }
    # a filter's removals over all orders, at whatever step it stands, in every column of that filter
    total = np.stack([out["removed"][:, at == f].sum(axis=1) for f in range(k)], axis=1)
    out["shapley"] = total[:, at]
    return ["".join(letters[f] for f in order) for order in orders], at, {name: m.astype(np.int64) for name, m in out.items()}


def interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row per part, filter_order and step from rows (part, mask, n, good, toxic): the stacked product.

    A part is at most 2^k rows after its histograms are summed, whatever its documents, so parts are gathered by groups
    and multiplied STACK at a time.
    """
    size = 1 << len(letters)
    dense = lambda c: F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c)
    rows = counts.groupBy("part").agg(*[dense(c) for c in ("n", "good", "toxic")])
    rows = rows.select("part", *[F.expr(f"transform(sequence(0, {size - 1}), m -> cast(coalesce({c}[m], 0) as long))").alias(c) for c in ("n", "good", "toxic")])
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, _, by = outcome_matrices(letters)
        steps = len(letters)
        for whole in batches:
            for i in range(0, whole.num_rows, STACK):
                batch = whole.slice(i, STACK)
                n, good, toxic = (np.asarray(batch.column(c).flatten()).reshape(-1, size) for c in ("n", "good", "toxic"))
                lost = {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
                found = {name: n @ m for name, m in by.items()} | lost
                parts = batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), len(orders) * steps)))
                order = pa.array(np.tile(np.repeat(np.array(orders, object), steps), batch.num_rows), pa.string())
                step = pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), batch.num_rows * len(orders)))
                yield pa.RecordBatch.from_arrays([parts, order, step, *[pa.array(found[c].reshape(-1)) for c in columns]], ["part", "filter_order", "step", *columns])

    return arrow(rows, multiplied, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of the five filters: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return interactions(histograms(docs, labels, part))
