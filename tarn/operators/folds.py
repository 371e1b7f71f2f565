"""Ordered folds with a bounded state: a key's events stream by in order, none of them is kept.

Where a state feeds back into what counts, no window function says the same. The rows are dealt by key, sorted within
their partitions (which spills), and walked batch by batch, so that a key of any length takes the memory of one batch and
time in proportion to its events. Keys are independent and spread over the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_NONE = object()


def folded(rows: DataFrame, keys: list[str], order: list[str | Column], start: Callable[[], Any], step: Callable[[Any, tuple], Iterator[tuple]], schema: StructType, end: Callable[[Any], Iterator[tuple]] | None = None) -> DataFrame:
    """What `step(state, row)` yields for each row of each key in order, and `end(state)` after a key's last row.

    A row is the tuple of all columns of `rows`, a result a tuple in the order of `schema`. `start()` makes a key's
    state, which step changes in place.
    """
    names = rows.columns
    at = [names.index(k) for k in keys]
    fields = to_arrow_schema(schema)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = _NONE, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = tuple(row[i] for i in at)
                if own != key:
                    if end is not None and key is not _NONE:
                        out.extend(end(state))
                    key, state = own, start()
                out.extend(step(state, row))
            yield batch_of(out)
        if end is not None and key is not _NONE:
            yield batch_of(list(end(state)))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
