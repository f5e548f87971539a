"""A rolling-window rate limiter over a stream of requests.

A request is allowed if its key is under every window, and only allowed
requests count, so a windowed count would be wrong. The state of a key is the
times of its allowed requests within the longest window, at most as many as
the tightest limit of that window allows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "key string, ts timestamp, allowed boolean, window string, retry_after int"

Window = tuple[int, int, str]  # limit, seconds, name


def decide(hits: list[float], now: float, windows: Iterable[Window]) -> tuple[bool, str | None, int | None]:
    """Whether a request is allowed after ``hits``, the window that refuses it, and the wait in whole seconds."""
    for limit, seconds, name in windows:
        recent = [t for t in hits if t > now - seconds]
        if len(recent) >= limit:
            return False, name, max(1, int(recent[0] + seconds - now) + 1) if recent else seconds
    return True, None, None


def _run(key: str, times: Iterable[pd.Timestamp], hits: list[float], windows: tuple[Window, ...]) -> tuple[list[tuple], list[float]]:
    longest = max(seconds for _, seconds, _ in windows)
    rows = []
    for ts in sorted(times):
        now = ts.timestamp()
        hits = [t for t in hits if t > now - longest]
        allowed, name, wait = decide(hits, now, windows)
        if allowed:
            hits.append(now)
        rows.append((key, ts, allowed, name, wait))
    return rows, hits


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "ts", "allowed", "window", "retry_after"])
    return out.assign(retry_after=pd.array(out["retry_after"], dtype="Int32"))


def limit_stream(requests: DataFrame, windows: tuple[Window, ...]) -> DataFrame:
    """Decisions for a stream of (key, ts).

    Requests may come late by as much as the longest window; later ones are
    dropped by the watermark. A key whose last request is older than that is
    forgotten, so the state follows the keys that are active.
    """
    longest = max(seconds for _, seconds, _ in windows)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        times = [t for frame in frames for t in frame["ts"]]
        rows, hits = _run(key[0], times, hits, windows)
        state.update((hits,))
        state.setTimeoutTimestamp(int((max(times).timestamp() + longest) * 1000))
        yield _frame(rows)

    return requests.withWatermark("ts", f"{longest} seconds").groupBy("key").applyInPandasWithState(step, SCHEMA, "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def limit_batch(requests: DataFrame, windows: tuple[Window, ...]) -> DataFrame:
    """The same decisions over a table.

    Each depends on those before it, so the requests of a key run past one task
    in order of time; it holds the allowed times of the current key only, never
    the key's requests.
    """

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hits = None, []
        for frame in frames:
            out: list[tuple] = []
            for name, part in frame.groupby("key", sort=False):
                rows, hits = _run(name, part["ts"], hits if name == key else [], windows)
                key = name
                out.extend(rows)
            yield _frame(out)

    return requests.select("key", "ts").repartition("key").sortWithinPartitions("key", "ts").mapInPandas(step, SCHEMA)


def status_counts(decisions: DataFrame) -> DataFrame:
    """(allowed, window, n): decisions by outcome, for a table or a stream."""
    return decisions.groupBy("allowed", "window").agg(F.count("*").alias("n"))
