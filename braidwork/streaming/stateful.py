"""Boundaries and batches of conversations as their messages arrive, with state and timers for each conversation.

Messages wait in the state until the watermark has passed them, so that they come out in order of time whatever the order
in which they came. Spark drops messages that come behind the watermark. Rows without a conversation, a time or
an id take no part; null tokens count as none. The state lies in RocksDB and is saved under the checkpoint, so a lost executor
or a restart goes on from the last micro-batch. A state holds the waiting messages of one conversation only (six numbers each,
no text), but reads them whole: a conversation that gets millions of messages within the watermark's delay needs their memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from braidwork.operators.conversation import CHANGES, IDLE_MINUTES, split_batches

#: Of a waiting message: microseconds, id, tokens, and the month, week and day of its time, which Spark works out.
WAITING = "us long, tie long, tokens long, month int, week int, day int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Message = tuple[int, int, int, int, int, int]


def change(before: Message | None, now: Message) -> int:
    """``conversation.boundary_strength`` of two messages."""
    if before is None:
        return 0
    for name, place in (("month", 3), ("week", 4), ("day", 5)):
        if before[place] != now[place]:
            return CHANGES[name]
    return CHANGES["idle"] if now[0] - before[0] >= IDLE_MINUTES * 60_000_000 else 0


class _Waiting(StatefulProcessor):
    """Messages in the state, and one timer that is moved as they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.timer = handle.getValueState("timer", "at long")

    def add(self, rows: Iterator[pd.DataFrame]) -> list[Message]:
        new = [r for f in rows for r in zip(*(map(int, f[c]) for c in ("us", "tie", "tokens", "month", "week", "day")))]
        if new:
            self.waiting.appendList(new)
        return new

    def wake(self, at: int | None) -> None:
        """The timer at this millisecond instead of the one before; None for no timer."""
        before = self.timer.get() if self.timer.exists() else None
        if before is not None and before[0] != at:
            self.handle.deleteTimer(before[0])
        if at is None:
            self.timer.clear()
        elif before is None or before[0] != at:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


class _Boundaries(_Waiting):
    def __init__(self, names: list[str]) -> None:
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", WAITING)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = self.add(rows)
        if new:
            due = min(r[0] for r in new) // 1000 + 1
            before = self.timer.get() if self.timer.exists() else None
            self.wake(due if before is None else min(due, before[0]))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, rows = timerValues.getCurrentWatermarkInMs(), sorted(tuple(r) for r in self.waiting.get())
        n = sum(r[0] // 1000 < passed for r in rows)
        before, out = tuple(self.last.get()) if self.last.exists() else None, []
        for r in rows[:n]:
            out.append((*key, *r[:3], change(before, r)))
            before = r
        if n < len(rows):
            self.waiting.put(rows[n:])
        else:
            self.waiting.clear()
        # The timer that fired is gone already.
        self.timer.clear()
        self.wake(rows[n][0] // 1000 + 1 if n < len(rows) else None)
        if out:
            self.last.update(before)
            yield pd.DataFrame(out, columns=self.names)


class _Closed(_Waiting):
    def __init__(self, names: list[str], target: int, quiet_ms: int) -> None:
        self.names, self.target, self.quiet_ms = names, target, quiet_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = self.add(rows)
        if new:
            due = max(r[0] for r in new) // 1000 + self.quiet_ms
            before = self.timer.get() if self.timer.exists() else None
            self.wake(due if before is None else max(due, before[0]))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = sorted(tuple(r) for r in self.waiting.get())
        self.waiting.clear()
        self.timer.clear()
        strength = [change(b, r) for b, r in zip([None, *rows], rows)]
        batch = split_batches([r[2] for r in rows], strength, self.target)
        yield pd.DataFrame([(*key, *r[:3], s, rows[0][0], b) for r, s, b in zip(rows, strength, batch)], columns=self.names)


def _ready(rows: DataFrame, conversation: str, at: str, tokens: str, tie: str, late: str) -> DataFrame:
    t = F.col(at)
    parts = {"month": F.year(t) * 12 + F.month(t), "week": F.extract(F.lit("YEAROFWEEK"), t) * 100 + F.weekofyear(t), "day": F.unix_date(F.to_date(t))}
    known = rows.where(F.col(conversation).isNotNull() & t.isNotNull() & F.col(tie).isNotNull()).withWatermark(at, late)
    return known.select(
        conversation, at, F.unix_micros(at).alias("us"), F.col(tie).cast("long").alias("tie"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"), *[c.cast("int").alias(n) for n, c in parts.items()]
    )


def boundaries(rows: DataFrame, conversation: str, at: str, tokens: str, tie: str, late: str = "10 minutes") -> DataFrame:
    """(conversation, time, tie, tokens, strength) of a stream's messages, each once the watermark has passed it.

    ``strength`` is that of ``conversation.boundary_strength`` over all messages that came in time. ``at`` is a timestamp."""
    ready = _ready(rows, conversation, at, tokens, tie, late)
    fields = f"`{conversation}` {rows.schema[conversation].dataType.simpleString()}, us long, tie long, tokens long, strength int"
    names = [conversation, "us", "tie", "tokens", "strength"]
    out = ready.groupBy(conversation).transformWithStateInPandas(_Boundaries(names), fields, "append", "EventTime")
    return out.select(conversation, F.timestamp_micros("us").alias(at), F.col("tie").alias(tie), F.col("tokens").alias(tokens), "strength")


def closed_batches(rows: DataFrame, conversation: str, at: str, tokens: str, tie: str, target: int, quiet_minutes: int = 1440, late: str = "10 minutes") -> DataFrame:
    """(conversation, started, time, tie, tokens, strength, batch) of a stream's conversations, each as soon as the watermark
    is ``quiet_minutes`` past its last message.

    Batches are those of ``conversation.time_aligned_batches`` over the messages between two such silences, the first of
    which is ``started``. The state goes with the silence; what comes later begins anew."""
    ready = _ready(rows, conversation, at, tokens, tie, late)
    fields = f"`{conversation}` {rows.schema[conversation].dataType.simpleString()}, us long, tie long, tokens long, strength int, started long, batch int"
    names = [conversation, "us", "tie", "tokens", "strength", "started", "batch"]
    out = ready.groupBy(conversation).transformWithStateInPandas(_Closed(names, target, quiet_minutes * 60_000), fields, "append", "EventTime")
    return out.select(
        conversation, F.timestamp_micros("started").alias("started"), F.timestamp_micros("us").alias(at), F.col("tie").alias(tie), F.col("tokens").alias(tokens), "strength", "batch"
    )


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which these operators need; the session's setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def to_parquet(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what is there into the files at ``path``, once each; the next run goes on from the checkpoint."""
    with rocksdb(out.sparkSession):
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
