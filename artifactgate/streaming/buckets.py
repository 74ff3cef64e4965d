"""A token bucket for each client: batch and stream share the step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "client string, ts timestamp, allowed boolean, retry_after double"


def step(tokens: float, last: float, now: float, per_minute: int) -> tuple[float, bool, float]:
    """(tokens after, allowed, seconds to wait): refill, then take one if there is one."""
    rate = per_minute / 60.0
    tokens = min(float(per_minute), tokens + max(0.0, now - last) * rate)
    return (tokens - 1, True, 0.0) if tokens >= 1 else (tokens, False, (1 - tokens) / rate)


def _run(client: str, times: pd.Series, tokens: float, last: float | None, per_minute: int) -> tuple[pd.DataFrame, float, float]:
    rows = []
    for ts in times.sort_values():
        now = ts.timestamp()
        tokens, ok, wait = step(tokens, now if last is None else last, now, per_minute)
        last = now if last is None else max(last, now)
        rows.append((client, ts, ok, wait))
    return pd.DataFrame(rows, columns=["client", "ts", "allowed", "retry_after"]), tokens, last


def limited(requests: DataFrame, per_minute: int = 60) -> DataFrame:
    """Of each (client, ts) whether it is let through, and seconds to wait if not; a client's requests in order of time.

    Rows are sorted by client and time and read batch by batch, with one client's
    bucket in memory; no client's history is ever held whole.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, tokens, last = None, float(per_minute), None
        for frame in frames:
            out = []
            for own, times in frame.groupby("client", sort=False, dropna=False)["ts"]:
                own = None if pd.isna(own) else own
                if own != client or last is None:
                    client, tokens, last = own, float(per_minute), None
                rows, tokens, last = _run(own, times, tokens, last, per_minute)
                out.append(rows)
            if out:
                yield pd.concat(out)

    return requests.select("client", "ts").repartition("client").sortWithinPartitions("client", "ts").mapInPandas(walk, OUT)


def limited_stream(requests: DataFrame, per_minute: int = 60, idle: str = "10 minutes") -> DataFrame:
    """The same over a stream; a client's state goes after it has been idle."""
    minutes = int(idle.split()[0]) * 60_000

    def one(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(per_minute), None)
        frames = list(frames)
        out, tokens, last = _run(key[0], pd.concat([f["ts"] for f in frames]), tokens, last, per_minute)
        state.update((tokens, last))
        state.setTimeoutDuration(minutes)
        yield out

    return requests.select("client", "ts").groupBy("client").applyInPandasWithState(one, OUT, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)
