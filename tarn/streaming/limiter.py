"""The rate limiter and the health fold on streams: a state for each key, kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.operators.federation import FAILURES
from tarn.operators.limits import CLEAN_SECONDS, COOLOFF_LADDER, LIMIT, WINDOW_SECONDS, RateLimit


def rate_limiter(requests: DataFrame, limit: int = LIMIT, window: int = WINDOW_SECONDS, ladder: tuple[int, ...] = COOLOFF_LADDER, clean: int = CLEAN_SECONDS) -> DataFrame:
    """(key, now, id, allowed, seconds_remaining) of a stream of requests (key string, now long, id long).

    Within a batch a key's requests are taken in order of now and id. The state is that of `limits.RateLimit`: the log of at
    most `limit` times, the violations, the end of the cool-off and the last violation.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = RateLimit(limit, window, ladder, clean)
        if state.exists:
            log, machine.violations, machine.until, machine.last = state.get
            machine.log.extend(log)
        rows = pd.concat(list(frames)).sort_values(["now", "id"])
        out = [(key[0], now, rid, *machine.decide(now)) for now, rid in zip(rows["now"].tolist(), rows["id"].tolist(), strict=True)]
        state.update((list(machine.log), machine.violations, machine.until, machine.last))
        yield pd.DataFrame(out, columns=["key", "now", "id", "allowed", "seconds_remaining"])

    return requests.groupBy("key").applyInPandasWithState(run, "key string, now long, id long, allowed boolean, seconds_remaining long", "log array<long>, violations long, until long, last long", "append", GroupStateTimeout.NoTimeout)


def health(probes: DataFrame, most: int = FAILURES) -> DataFrame:
    """(peer, seq, failures, disabled) of a stream of probes (peer string, seq long, ok boolean)."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, disabled = state.get if state.exists else (0, False)
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            failures = 0 if r.ok else failures + 1
            disabled = bool(disabled or failures >= most)
            out.append((key[0], r.seq, failures, disabled))
        state.update((failures, disabled))
        yield pd.DataFrame(out, columns=["peer", "seq", "failures", "disabled"])

    return probes.groupBy("peer").applyInPandasWithState(run, "peer string, seq long, failures long, disabled boolean", "failures long, disabled boolean", "append", GroupStateTimeout.NoTimeout)
