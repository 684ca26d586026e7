"""Deduplication, the weak join and replies on streams; batch and stream mean the same.

State is per key, kept by RocksDB with the checkpoint, and ends by event time: once the watermark has passed, a timer clears a
key's memory, or emits its open group, also if nothing more arrives for it. Messages later than the watermark are dropped,
so that no expired state is missed. A batch that fails changes no state, so a message that is read again isn't taken for its
own duplicate. What a micro-batch begins and ends within itself never enters the state: each access is a round trip to the JVM.
Keys are handled by rows, since most have a few in a micro-batch, for which a frame each costs more than the work.

A key's messages of one micro-batch are handled in one task: deduplication holds one for each second, the weak join sorts all. What a
micro-batch holds is bounded by its source's limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _timed(df: DataFrame, us: str, late: str) -> DataFrame:
    return df.withColumn("__ts", F.timestamp_micros(us)).withWatermark("__ts", late)


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    spark: SparkSession = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(key).transformWithState(processor, schema, "append", "EventTime")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


class _Dedup(StatefulProcessor):
    """State: the second at which the key's last message was accepted, until the TTL is over."""

    def __init__(self, us: str, tie: str, ttl_s: int):
        self.us, self.tie, self.ttl_s = us, tie, ttl_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "second long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get()
        free, firsts, kept = known[0] + self.ttl_s if known else None, {}, []
        for row in rows:  # of a second only the first message can be accepted; so many are held, however many there are
            at = _place(row, self.us, self.tie)
            second = at[0] // 1_000_000
            if (free is None or second >= free) and (second not in firsts or at < firsts[second][0]):
                firsts[second] = at, row
        for second in sorted(firsts):
            if free is None or second >= free:
                kept.append(firsts[second][1])
                free = second + self.ttl_s
        if kept:
            self.last.update((free - self.ttl_s,))
            self.handle.registerTimer(free * 1000)
        return iter(kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.last.get()
        if known and (known[0] + self.ttl_s) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()  # else a later message has been accepted
        return iter(())

    def close(self) -> None:
        pass


def _place(row: Row, us: str, tie: str) -> tuple:
    """What a message is sorted by: its time, and its tie, nulls last."""
    return row[us], row[tie] is None, row[tie]


def dedup_ttl(df: DataFrame, key: str, us: str, tie: str, ttl_s: int, late: str = "0 seconds") -> DataFrame:
    """A message is accepted if none of its key was, or the last accepted one is ``ttl_s`` whole seconds old."""
    if ttl_s <= 0:
        return df
    columns = [c for c in df.columns if c != key]
    out = _with_state(_timed(df, us, late), key, _Dedup(us, tie, ttl_s), _schema(df))
    return out.select(key, *columns).select(*df.columns)


class _Join(StatefulProcessor):
    """State: the open group's messages, a list that only grows at its end, and the time of its first one and their number. Groups that
    begin and end within a micro-batch never enter it."""

    def __init__(self, key: str, us: str, tie: str, columns: list[str], kinds: str, count: int, timeout_us: int):
        self.key, self.us, self.tie, self.columns, self.kinds, self.count, self.timeout_us = key, us, tie, columns, kinds, count, timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held, self.open = handle.getListState("held", self.kinds), handle.getValueState("open", "start long, n int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted([(_place(row, self.us, self.tie), tuple(row[c] for c in self.columns)) for row in rows], key=itemgetter(0))
        known = self.open.get()
        stored = known is not None  # the open group's beginning is in the state
        start, n = known or (0, 0)
        fresh, out = [], []  # the open group's messages of this batch, and groups that have ended
        for (us, *_), message in rows:
            if n and us >= start + self.timeout_us:  # what was open is overdue
                out.append(self._group(key, stored, fresh))
                stored, fresh, n = False, [], 0
            if not n:
                start = us
            fresh.append(message)
            n += 1
            if n >= self.count:
                out.append(self._group(key, stored, fresh))
                stored, fresh, n = False, [], 0
        if fresh:
            self.held.appendList(fresh)
            self.open.update((start, n))
        if n and not stored:
            self.handle.registerTimer(self._due(start))
        elif not n and known:
            self.open.clear()
        return iter(out)

    def _due(self, start: int) -> int:
        return -(-(start + self.timeout_us) // 1000)

    def _group(self, key, stored: bool, fresh: Sequence[tuple] = ()) -> Row:
        found = [*(map(tuple, self.held.get()) if stored else ()), *fresh]
        if stored:
            self.held.clear()
        return Row(**{self.key: key[0], "size": len(found), "held": [dict(zip(self.columns, x, strict=True)) for x in found]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known, out = self.open.get(), []
        if known and self._due(known[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._group(key, True))
            self.open.clear()
        return iter(out)

    def close(self) -> None:
        pass


def grouped(df: DataFrame, key: str, us: str, tie: str, columns: list[str], count: int, timeout_us: int, late: str = "0 seconds") -> DataFrame:
    """(key, size, held: the group's messages with ``columns``, in order). A group is emitted when it is full, or overdue at a later
    arrival or as the watermark passes."""
    fields = [df.schema[c] for c in columns]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    out = f"`{key}` {df.schema[key].dataType.simpleString()}, size int, held array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in fields)}>>"
    return _with_state(_timed(df, us, late), key, _Join(key, us, tie, columns, kinds, count, timeout_us), out)


def weak_join(df: DataFrame, key: str, us: str, tie: str, payload: str, count: int, timeout_us: int, late: str = "0 seconds") -> DataFrame:
    """(key, size, payload array) of each group; see :func:`grouped`."""
    out = grouped(df.select(key, us, tie, payload), key, us, tie, [payload], count, timeout_us, late)
    return out.select(key, "size", F.transform("held", lambda x: x[payload]).alias("payloads"))


def replies(requests: DataFrame, answers: DataFrame, key: str, asked: str, answered: str, timeout_us: int, late: str = "0 seconds") -> DataFrame:
    """Each request with the answers of its key within ``timeout_us``, as they arrive, or alone with nulls once the watermark shows
    that none will; times are microseconds. A stream-stream outer join, whose state ends with the timeout."""
    asks = requests.withColumn("__asked", F.timestamp_micros(asked)).withWatermark("__asked", late)
    gives = answers.withColumnRenamed(key, "__of").withColumn("__answered", F.timestamp_micros(answered)).withWatermark("__answered", late)
    span = F.expr(f"interval {int(timeout_us)} microseconds")
    on = (F.col(key) == F.col("__of")) & (F.col("__answered") >= F.col("__asked")) & (F.col("__answered") <= F.col("__asked") + span)
    return asks.join(gives, on, "leftOuter").withColumn("timed_out", F.col("__of").isNull()).drop("__asked", "__answered", "__of")
