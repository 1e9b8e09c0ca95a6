"""Sliding-window rate limits, windowed counts and expiry of finished batches over event time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def seconds(times: pd.Series) -> list[float]:
    return (times.dt.tz_localize("UTC") if times.dt.tz is None else times).map(pd.Timestamp.timestamp).tolist()


class Window:
    """The times of the allowed requests of one key that lie within ``seconds`` before the last: ``limit`` at most."""

    def __init__(self, limit: int, seconds: float, held: Iterable[float] = ()):
        self.limit, self.seconds, self.held = limit, seconds, deque(held)

    def take(self, t: float) -> bool:
        """Whether a request, not earlier than the last, is allowed; rejected ones do not count."""
        while self.held and self.held[0] < t - self.seconds:
            self.held.popleft()
        if ok := len(self.held) < self.limit:
            self.held.append(t)
        return ok


def rate_limit(requests: DataFrame, limit: int, window_seconds: int = 600, key: str = "client", scope: str = "scope", at: str = "ts", watermark: str = "10 minutes") -> DataFrame:
    """(scope, key, at, allowed) of each request of a stream: denied when ``limit`` allowed ones lie within the window before it.

    The rows of a trigger are judged in order of time, whatever batches they come in.  State
    per scope and key is the allowed times of one window, ``limit`` at most; idle keys time out.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([b[[at]] for b in batches]).sort_values(at, kind="stable")  # times only
        window = Window(limit, window_seconds, state.get[0] if state.exists else ())
        allowed, held = [window.take(t) for t in seconds(rows[at])], list(window.held)
        yield pd.DataFrame({scope: name[0], key: name[1], at: rows[at].to_numpy(), "allowed": allowed})
        state.update((held,))
        state.setTimeoutTimestamp(max(int(1000 * (max(held, default=0) + window_seconds)), state.getCurrentWatermarkMs() + 1))

    stamped = requests.select(scope, key, F.col(at).cast("timestamp").alias(at)).withWatermark(at, watermark)
    kinds = ", ".join(f"{c} {requests.schema[c].dataType.simpleString()}" for c in (scope, key))
    return stamped.groupBy(scope, key).applyInPandasWithState(step, f"{kinds}, {at} timestamp, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def judged(requests: DataFrame, limit: int, window_seconds: int = 600, key: str = "client", scope: str = "scope", at: str = "ts") -> DataFrame:
    """The same judgement over a finished table: a scope's and key's rows in order of time, streamed through a task.

    Rows come sorted, so a task holds the allowed times of one window of one key only.
    """
    schema = requests.select(scope, key, F.col(at).cast("timestamp").alias(at)).withColumn("allowed", F.lit(True)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        window, now = None, None
        for batch in batches:
            allowed = []
            for s, k, t in zip(batch[scope], batch[key], seconds(batch[at]), strict=True):
                if window is None or (s, k) != now:
                    window, now = Window(limit, window_seconds), (s, k)
                allowed.append(window.take(t))
            yield batch.assign(allowed=allowed)

    rows = requests.select(scope, key, F.col(at).cast("timestamp").alias(at))
    return rows.repartition(scope, key).sortWithinPartitions(scope, key, at).mapInPandas(run, schema)


def finished_batches(items: DataFrame, batch: str = "batch_id", at: str = "ts", ttl: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """(batch, first, expires, settled) of the items of a stream: a batch is let go once no item of it came for ``ttl``."""
    stamped = items.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
    session = stamped.groupBy(F.session_window(at, ttl), batch).agg(F.count_if(F.col("state").isin("completed", "failed", "cancelled")).alias("settled"))
    return session.select(batch, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("expires"), "settled")


def requests_per_window(requests: DataFrame, key: str = "client", at: str = "ts", window: str = "10 minutes", slide: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Requests of each key in sliding windows; late ones count up to the watermark."""
    stamped = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
    return stamped.groupBy(F.window(at, window, slide), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
