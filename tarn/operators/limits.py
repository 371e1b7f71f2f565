"""State machines over ordered events of a key: the rate limiter, the login lockout and the commits of an index writer.

Each is a fold with a state of bounded size (see folds); the streams in tarn.streaming take the same steps, with the state
kept between batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tarn.operators.folds import folded

LIMIT, WINDOW_SECONDS = 30, 60
COOLOFF_LADDER = (60, 300, 3600)
CLEAN_SECONDS = 3600
LOCKOUT_FAILURES, LOCKOUT_SECONDS = 5, 900
BATCH_JOBS, MAX_AGE_SECONDS = 50, 5


def _schema(rows: DataFrame, key: str, **columns) -> StructType:
    return StructType([rows.schema[key], *[StructField(n, t) for n, t in columns.items()]])


def sliding_counts(requests: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """requests (key, now) with `n`: those of the key in the last `seconds`, itself included; what a limiter without
    feedback would see."""
    w = Window.partitionBy("key").orderBy("now").rangeBetween(-(seconds - 1), 0)
    return requests.withColumn("n", F.count("*").over(w))


class RateLimit:
    """The limiter's state for a key: times of the requests let through within the window, violations, cool-off."""

    def __init__(self, limit: int, window: int, ladder: tuple[int, ...], clean: int):
        self.limit, self.window, self.ladder, self.clean = limit, window, ladder, clean
        self.log: deque[int] = deque()
        self.violations = self.until = self.last = 0

    def decide(self, now: int) -> tuple[bool, int]:
        """(allowed, seconds remaining) of a request, which the state then knows of."""
        if self.last > 0 and now - self.last > self.clean and self.until <= now:
            self.violations = 0
        if self.until > now:
            return False, self.until - now
        while self.log and self.log[0] <= now - self.window:
            self.log.popleft()
        if len(self.log) >= self.limit:
            wait = self.ladder[min(self.violations, len(self.ladder) - 1)]
            self.violations, self.until, self.last = self.violations + 1, now + wait, now
            return False, wait
        self.log.append(now)
        return True, 0


def rate_limited(requests: DataFrame, limit: int = LIMIT, window: int = WINDOW_SECONDS, ladder: tuple[int, ...] = COOLOFF_LADDER, clean: int = CLEAN_SECONDS) -> DataFrame:
    """(key, now, id, allowed, seconds_remaining) of each request (key, now, id), in order of now and id.

    A request over the limit starts a cool-off, longer with each violation; while one runs, requests are refused and
    leave no trace. Violations are forgotten after a clean time. The state is at most `limit` times.
    """

    def step(state: RateLimit, row: tuple) -> Iterator[tuple]:
        yield (*row, *state.decide(row[1]))

    rows = requests.select("key", F.col("now").cast("long").alias("now"), F.col("id").cast("long").alias("id"))
    schema = _schema(rows, "key", now=LongType(), id=LongType(), allowed=BooleanType(), seconds_remaining=LongType())
    return folded(rows, ["key"], ["now", "id"], lambda: RateLimit(limit, window, ladder, clean), step, schema)


def lockouts(attempts: DataFrame, failures: int = LOCKOUT_FAILURES, seconds: int = LOCKOUT_SECONDS) -> DataFrame:
    """(key, now, id, ok, locked, failed_count, lockout_until) of each attempt (key, now, id, ok).

    While locked an attempt is refused before it is judged. A failure counts up, and from the `failures`-th on locks
    anew; a success forgets everything. The state is two numbers.
    """

    def step(state: list[int], row: tuple) -> Iterator[tuple]:
        _, now, _, ok = row
        locked = state[1] > now
        if not locked and ok:
            state[:] = [0, 0]
        elif not locked:
            state[0] += 1
            if state[0] >= failures:
                state[1] = now + seconds
        yield (*row, locked, *state)

    rows = attempts.select("key", F.col("now").cast("long").alias("now"), F.col("id").cast("long").alias("id"), "ok")
    schema = _schema(rows, "key", now=LongType(), id=LongType(), ok=BooleanType(), locked=BooleanType(), failed_count=LongType(), lockout_until=LongType())
    return folded(rows, ["key"], ["now", "id"], lambda: [0, 0], step, schema)


def job_commits(jobs: DataFrame, size: int = BATCH_JOBS, age: int = MAX_AGE_SECONDS) -> DataFrame:
    """(writer, number, reason, at, jobs, deletes): the commits of each index writer over its jobs (writer, at, seq, op).

    A writer commits when `size` upserts are pending ("size"), at once on a delete ("delete"), when its timer finds
    something pending ("age"), and when its queue closes with its last job ("closed"). The timer runs for `age` seconds
    from the writer's first job, from each commit, and from each time that it ran out with nothing pending; a job that
    comes as it runs out is taken first. The state is six numbers.
    """

    def flush(state: dict, at: int, reason: str) -> Iterator[tuple]:
        yield state["writer"], state["number"], reason, at, state["jobs"], state["deletes"]
        state["number"] += 1
        state["jobs"] = state["deletes"] = 0
        state["deadline"] = at + age

    def step(state: dict, row: tuple) -> Iterator[tuple]:
        writer, at, _, op = row
        if "deadline" not in state:
            state |= {"writer": writer, "number": 1, "jobs": 0, "deletes": 0, "deadline": at + age}
        if at > state["deadline"]:
            if state["jobs"]:
                yield from flush(state, state["deadline"], "age")
            if at > state["deadline"]:
                state["deadline"] += -(-(at - state["deadline"]) // age) * age
        state["jobs"] += 1
        state["last"] = at
        if op == "delete":
            state["deletes"] = 1
            yield from flush(state, at, "delete")
        elif state["jobs"] >= size:
            yield from flush(state, at, "size")

    def end(state: dict) -> Iterator[tuple]:
        if state["jobs"]:
            yield from flush(state, state["last"], "closed")

    rows = jobs.select("writer", F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"), "op")
    schema = _schema(rows, "writer", number=LongType(), reason=StringType(), at=LongType(), jobs=LongType(), deletes=LongType())
    return folded(rows, ["writer"], ["at", "seq"], dict, step, schema, end)


def inflight(jobs: DataFrame, commits: DataFrame) -> DataFrame:
    """(writer, at, queued, committed, inflight): how many jobs of each writer wait, after all that happened at each time.

    jobs: (writer, at); commits: (writer, at, jobs). Counts of a time are summed before they meet, so a busy second is a row.
    """
    gone = commits.select("writer", "at", F.lit(0).cast("long").alias("queued"), F.col("jobs").alias("committed"))
    came = jobs.select("writer", F.col("at").cast("long").alias("at"), F.lit(1).cast("long").alias("queued"), F.lit(0).cast("long").alias("committed"))
    each = came.unionByName(gone).groupBy("writer", "at").agg(F.sum("queued").alias("queued"), F.sum("committed").alias("committed"))
    so_far = Window.partitionBy("writer").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = each.select("writer", "at", F.sum("queued").over(so_far).alias("queued"), F.sum("committed").over(so_far).alias("committed"))
    return running.withColumn("inflight", F.col("queued") - F.col("committed"))
