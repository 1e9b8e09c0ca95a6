"""Bounded queues and the life of their batches, over streams as state and over finished tables.

Events of a queue are submissions and ends of batches.  A queue takes a batch while
fewer than its bound of taken ones are open; refused ones never count.  A taken batch
is settled when all its items are; it is kept for a time after that, then forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: At one time ends come before submissions, so that a place that becomes free is free.
ENDS_FIRST = ("finish", "submit")


def _millis(times: pd.Series) -> list[int]:
    return times.astype("datetime64[ms]").astype("int64").tolist()


class Places:
    """The open batches of one queue: ``most`` at most."""

    def __init__(self, most: int, open_: set | None = None):
        self.most, self.open = most, set(open_ or ())

    def take(self, kind: str, batch: object) -> tuple[bool, int] | None:
        """(accepted, open before) of a submission, None for an end; of a batch that is open a second submission is refused."""
        if kind != "submit":
            self.open.discard(batch)
            return None
        before = len(self.open)
        if ok := before < self.most and batch not in self.open:
            self.open.add(batch)
        return ok, before


def _events(events: DataFrame) -> DataFrame:
    return events.where(F.col("kind").isin(*ENDS_FIRST) & F.col("ts").isNotNull() & F.col("batch_id").isNotNull()).select("queue", "batch_id", "kind", F.col("ts").cast("timestamp").alias("ts"))


def events_of(requests: DataFrame, queue: str, batch: str, at: str, until: str) -> DataFrame:
    """(queue, batch_id, kind, ts): a submission of each request and, where it is known, its end."""
    row = lambda kind, ts: requests.select(F.col(queue).alias("queue"), F.col(batch).alias("batch_id"), F.lit(kind).alias("kind"), F.col(ts).cast("timestamp").alias("ts"))
    return row("submit", at).unionByName(row("finish", until).where("ts is not null"))


def admission(events: DataFrame, most: int = 25) -> DataFrame:
    """(queue, batch_id, ts, accepted, open) of every submission in a finished table of events (queue, batch_id, kind, ts).

    A queue's events pass through a task in order of time, ends before submissions and
    then by batch; the task holds the open batches of one queue, ``most`` at most.  What
    a queue takes depends on all it took before, so a queue is not split.

    Ends of batches that are not open are ignored, as are events without time, batch or
    known kind; null queues are one queue.  Repeated submissions are judged each.  An empty table gives none.
    """
    rows = _events(events)
    schema = T.StructType([rows.schema["queue"], rows.schema["batch_id"], rows.schema["ts"], T.StructField("accepted", T.BooleanType()), T.StructField("open", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places, queue = None, None
        for part in batches:
            judged = []
            for q, b, kind in zip(part["same"], part["batch_id"], part["kind"], strict=True):
                if places is None or q != queue:
                    places, queue = Places(most), q
                judged.append(places.take(kind, b))
            asked = part[[j is not None for j in judged]]
            told = [j for j in judged if j is not None]
            yield asked[["queue", "batch_id", "ts"]].assign(accepted=[j[0] for j in told], open=[j[1] for j in told])

    keyed = rows.withColumn("same", F.to_json(F.struct("queue"))).withColumn("late", F.col("kind") == "submit")
    return keyed.repartition("same").sortWithinPartitions("same", "ts", "late", "batch_id").mapInPandas(run, schema)


class Admission(StatefulProcessor):
    """Events wait until the watermark has passed them, then are judged in order of time."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, kind string, batch_id string")
        self.open = handle.getMapState("open", "batch_id string", "taken boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for t, kind, b in zip(_millis(part["ts"]), part["kind"], part["batch_id"], strict=True):
                self.waiting.appendValue((t, kind, b))
                self.handle.registerTimer(t)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())  # the first of several timers judges all
        held = [tuple(x) for x in self.waiting.get()]
        due = sorted((x for x in held if x[0] <= now), key=lambda x: (x[0], x[1] == "submit", x[2]))
        if not due:
            return
        if rest := [x for x in held if x[0] > now]:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        before = {k[0] for k in self.open.keys()}
        places = Places(self.most, before)
        out = [(key[0], b, t, *told) for t, kind, b in due if (told := places.take(kind, b)) is not None]
        for b in before - places.open:
            self.open.removeKey((b,))
        for b in places.open - before:
            self.open.updateValue((b,), (True,))
        if out:
            frame = pd.DataFrame(out, columns=["queue", "batch_id", "ts", "accepted", "open"])
            yield frame.assign(ts=pd.to_datetime(frame["ts"], unit="ms"))


def admission_stream(events: DataFrame, most: int = 25, watermark: str = "10 minutes") -> DataFrame:
    """The same judgement over a stream of events, batches as text; an event is judged once the watermark has passed its time (in milliseconds).

    State of a queue is its open batches and the events that the watermark has not passed.
    The session keeps state in RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = _events(events).withColumn("batch_id", F.col("batch_id").cast("string")).withColumn("queue", F.coalesce(F.col("queue").cast("string"), F.lit(""))).withWatermark("ts", watermark)
    schema = "queue string, batch_id string, ts timestamp, accepted boolean, open long"
    return rows.groupBy("queue").transformWithStateInPandas(Admission(most), schema, "append", "eventTime")


#: States that end an item.
ENDS = ("completed", "failed")


def _status(total: Column, ended: Column, begun: Column, cancelled: Column) -> Column:
    return F.when(ended == total, F.when(cancelled, "cancelled").otherwise("completed")).when(begun > 0, "running").otherwise("queued")


def batch_life(changes: DataFrame, cancels: DataFrame, ttl_seconds: int = 1800) -> DataFrame:
    """A row per batch: batch_id, status, total, completed, failed, cancelled, cancel_requested, finished_at, expires_at.

    ``changes`` (batch_id, item, state, ts) say when items were queued, running, completed or
    failed, ``cancels`` (batch_id, ts) when a batch's end was asked for.  An item that has not
    begun before that is cancelled; others go on.  A batch is finished when its last item
    is; a request to cancel after that changes nothing.  It is forgotten ``ttl_seconds`` later.

    Items are reduced before batches meet, so large batches are no large group.  The
    first time of a state counts, repeated rows change nothing; null batches and items
    are one each.  Cancels of unknown batches give no row.  An empty table gives none.
    """
    at = F.col("ts").cast("timestamp")
    when = lambda *s: F.min(F.when(F.col("state").isin(*s), at))
    items = changes.groupBy("batch_id", "item").agg(when("running", *ENDS).alias("begun"), F.min(F.when(F.col("state").isin(*ENDS), F.struct(at.alias("ts"), F.col("state").alias("state")))).alias("end"))
    asked = cancels.groupBy(F.col("batch_id").alias("of")).agg(F.min(at).alias("asked_at"))
    known = items.join(asked, F.col("batch_id").eqNullSafe(F.col("of")), "left")
    stopped = F.col("asked_at").isNotNull() & (F.col("begun").isNull() | (F.col("begun") >= F.col("asked_at")))
    n = F.count_if
    out = known.withColumn("stopped", stopped).groupBy("batch_id").agg(
        F.count("*").alias("total"), n(~F.col("stopped") & (F.col("end.state") == "completed")).alias("completed"), n(~F.col("stopped") & (F.col("end.state") == "failed")).alias("failed"), n("stopped").alias("cancelled"),
        n(F.col("begun").isNotNull() & ~F.col("stopped")).alias("begun"), F.max(F.when(F.col("stopped"), F.col("asked_at")).otherwise(F.col("end.ts"))).alias("last"), F.first("asked_at").alias("asked_at"),
    )
    done = F.col("completed") + F.col("failed") + F.col("cancelled")
    out = out.withColumn("finished_at", F.when(done == F.col("total"), F.col("last")))
    out = out.withColumn("cancel_requested", F.col("asked_at").isNotNull() & (F.col("finished_at").isNull() | (F.col("asked_at") <= F.col("finished_at"))))
    status = _status(F.col("total"), done, F.col("begun"), F.col("cancel_requested"))
    return out.select("batch_id", status.alias("status"), "total", "completed", "failed", "cancelled", "cancel_requested", "finished_at", (F.col("finished_at") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("expires_at"))


class BatchLife(StatefulProcessor):
    """A batch's items as first times of their states, so that the order in which events come does not matter."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "item string", "begun long, ended long, state string")
        self.asked = handle.getValueState("asked", "ms long")
        self.expires = handle.getValueState("expires", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = self.asked.get()[0] if self.asked.exists() else None
        for part in rows:
            for t, item, state in zip(_millis(part["ts"]), part["item"], part["state"], strict=True):
                if state == "cancel":
                    asked = t if asked is None else min(asked, t)
                    self.asked.update((asked,))
                    continue
                begun, ended, end = self.items.getValue((item,)) if self.items.containsKey((item,)) else (None, None, None)
                if state == "running" or state in ENDS:
                    begun = t if begun is None else min(begun, t)
                if state in ENDS and (ended is None or (t, state) < (ended, end)):
                    ended, end = t, state
                self.items.updateValue((item,), (begun, ended, end))
        if out := self.snapshot(key, asked):
            yield pd.DataFrame([out], columns=COLUMNS)

    def snapshot(self, key, asked):
        total = completed = failed = cancelled = begun_ = 0
        last = None
        for begun, ended, end in self.items.values():
            total += 1
            if asked is not None and (begun is None or begun >= asked):
                cancelled, at = cancelled + 1, asked
            else:
                begun_ += begun is not None
                completed, failed, at = completed + (end == "completed"), failed + (end == "failed"), ended
            last = at if last is None or (at is not None and at > last) else last
        if not total:
            return None
        done = completed + failed + cancelled == total
        requested = asked is not None and (not done or asked <= last)
        status = ("cancelled" if requested else "completed") if done else "running" if begun_ else "queued"
        if self.expires.exists():
            self.handle.deleteTimer(self.expires.get()[0])
            self.expires.clear()
        if done:
            self.expires.update((last + self.ttl_ms,))
            self.handle.registerTimer(last + self.ttl_ms)
        stamp = lambda ms: pd.NaT if ms is None else pd.Timestamp(ms, unit="ms")
        return (key[0], status, total, completed, failed, cancelled, requested, stamp(last if done else None), stamp(last + self.ttl_ms if done else None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.expires.get()[0] if self.expires.exists() else None
        if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            asked = self.asked.get()[0] if self.asked.exists() else None
            row = self.snapshot(key, asked)
            for state in (self.items, self.asked, self.expires):
                state.clear()
            self.handle.deleteTimer(due)
            yield pd.DataFrame([(row[0], "expired", *row[2:])], columns=COLUMNS)


COLUMNS = ["batch_id", "status", "total", "completed", "failed", "cancelled", "cancel_requested", "finished_at", "expires_at"]


def batch_life_stream(events: DataFrame, ttl_seconds: int = 1800, watermark: str = "10 minutes") -> DataFrame:
    """The life of batches over a stream of events (batch_id, item, state, ts); a cancel is an event of that state without item.

    Each trigger gives the rows of ``batch_life`` for the batches that it touches; a batch that is
    forgotten, ``ttl_seconds`` after it finished and not after its last event, gives a row of
    status expired and leaves no state.  State is kept in RocksDB, an entry an item, times in milliseconds.
    """
    rows = events.select(F.coalesce(F.col("batch_id").cast("string"), F.lit("")).alias("batch_id"), F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "state", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null").withWatermark("ts", watermark)
    schema = "batch_id string, status string, total long, completed long, failed long, cancelled long, cancel_requested boolean, finished_at timestamp, expires_at timestamp"
    return rows.groupBy("batch_id").transformWithStateInPandas(BatchLife(1000 * ttl_seconds), schema, "update", "eventTime")
