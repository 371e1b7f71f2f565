"""The indexer as streams: upserts and deletes in micro-batches, each one commit of a segment, safe to repeat.

Upserts wait for a batch or their age: a Kafka source holds a micro-batch back until it has BATCH_JOBS jobs or MAX_AGE has
passed (`queue_options`); a file source runs every MAX_AGE. Deletes run as a stream of their own, at once; both commit
to one segment log, where a writer that loses a race for a version takes the next. A bounded queue: a micro-batch takes
at most CAPACITY jobs (or files), the rest waits in the source, which is what slows its producers.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from tarn.operators.index import delete, journal, last_of_each, upsert
from tarn.operators.limits import BATCH_JOBS, MAX_AGE_SECONDS
from tarn.operators.segments import SegmentStore

MAX_AGE = f"{MAX_AGE_SECONDS} seconds"
CAPACITY = 256


def queue_options(source: str) -> dict[str, str]:
    """The options by which a source makes micro-batches as an index writer would."""
    if source == "kafka":
        return {"minOffsetsPerTrigger": str(BATCH_JOBS), "maxTriggerDelay": f"{MAX_AGE_SECONDS}s", "maxOffsetsPerTrigger": str(CAPACITY)}
    return {"maxFilesPerTrigger": str(CAPACITY)}


def job_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A folder of Parquet files of jobs as a bounded queue."""
    return spark.readStream.schema(schema).options(**queue_options("parquet")).parquet(path)


def apply_batch(index: DataFrame, jobs: DataFrame) -> DataFrame:
    """index after jobs (op = upsert | delete, and the document): the last job of each url decides."""
    latest = last_of_each(jobs, ["url"])
    return upsert(delete(index, latest.filter("op = 'delete'")), latest.filter("op = 'upsert'"))


class InFlight(StreamingQueryListener):
    """Jobs that the indexer's streams have taken from their queues and not yet committed, while they run.

    A stream's progress tells what was taken, `committed` what a commit made durable; it is zero once a queue is drained.
    """

    def __init__(self) -> None:
        self._lock, self._taken, self._done = threading.Lock(), 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """A stream that ended has given back what it had not committed: its next run takes those jobs again."""
        with self._lock:
            self._taken = self._done

    def queued(self, jobs: int) -> None:
        with self._lock:
            self._taken += jobs

    def committed(self, jobs: int) -> None:
        with self._lock:
            self._done += jobs

    @property
    def count(self) -> int:
        with self._lock:
            return self._taken - self._done


def indexer(
    jobs: DataFrame, store: SegmentStore, checkpoint: str, on_commit: Callable[[DataFrame], None] | None = None, available_now: bool = False, name: str = "jobs", at_once: bool = False, inflight: InFlight | None = None
) -> StreamingQuery:
    """Runs jobs into the store. A batch that comes again after a crash is skipped by its number; the journal of what
    became durable is handed on after the commit, so marking may happen twice but never too early. `at_once` is for the
    stream of deletes, which waits for no timer; `name` tells the streams of one store apart."""

    def run(batch: DataFrame, number: int) -> None:
        taken = batch.count() if inflight is not None else 0
        if inflight is not None:
            inflight.queued(taken)
        if not batch.isEmpty():
            store.commit(batch, name, number)
        if inflight is not None:
            inflight.committed(taken)
        if on_commit is not None:
            on_commit(journal(batch.filter(F.col("op") == "upsert")))

    writer = jobs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return (writer if at_once else writer.trigger(processingTime=MAX_AGE)).start()
