"""Streams whose state waits for event time: throttled progress, claims of jobs, and entries that expire.

Rows may come in any order within the watermark's delay. A key's state keeps what can't be decided yet, a timer tells when
nothing earlier can come any more, and then the rows are taken in the order of their event times. So each stream gives the
rows of its batch operator, and a query that starts again from its checkpoint goes on where it stopped. State that nothing
can ask for is removed: a key's state is bounded by what it receives in the delay, and the few fields of its last state.

Spark keeps such state in RocksDB: see ``use_rocksdb``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.streaming.progress import TERMINAL_STATES

#: Columns of their own; pandas renames those that begin with an underscore.
_MS = "event_ms"


def use_rocksdb(spark: SparkSession) -> None:
    """Let streams of this session that start from now on keep their state in RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(events: DataFrame, time: str, delay: str) -> DataFrame:
    """``events`` under a watermark, with the event time in milliseconds."""
    use_rocksdb(events.sparkSession)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).withColumn(_MS, F.unix_millis(time))


def _plain(value: Any) -> Any:
    """A value of a pandas row as state takes it."""
    if value is None or (not isinstance(value, str) and pd.isna(value)):
        return None
    return value.item() if hasattr(value, "item") else value


class _Throttle(StatefulProcessor):
    """The last row of each slot of time, given out once the slot is over."""

    def __init__(self, names: list[str], kinds: str, width: int) -> None:
        self.names, self.kinds, self.width = names, kinds, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", f"{_MS} long, {self.kinds}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for part in rows:
            for ms, *values in part[[_MS, *self.names]].itertuples(index=False, name=None):
                slot, row = int(ms) // self.width, (int(ms), *map(_plain, values))
                if slot not in best or best[slot][0] < row[0]:
                    best[slot] = row
        for slot, row in best.items():
            if not self.slots.containsKey((slot,)):
                self.handle.registerTimer((slot + 1) * self.width)
            elif tuple(self.slots.getValue((slot,)))[0] >= row[0]:
                continue
            self.slots.updateValue((slot,), row)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        slot = expiredTimerInfo.getExpiryTimeInMs() // self.width - 1
        row = tuple(self.slots.getValue((slot,)))
        self.slots.removeKey((slot,))
        yield pd.DataFrame([[*key, *row]], columns=[*(f"key_{i}" for i in range(len(key))), _MS, *self.names])

    def close(self) -> None:
        pass


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def throttled(events: DataFrame, keys: list[str], time: str, seconds: float, delay: str) -> DataFrame:
    """The stream of ``progress.throttled``: of each key at most one event in ``seconds``, the last; terminal ones always.

    A slot's event is given out when the watermark (``delay`` behind the latest event) has passed the slot's end; terminal ones
    at once. ``events`` has no two events of one key and time; times count to the millisecond.
    """
    final = F.col("status").isin(*TERMINAL_STATES)
    own = [c for c in events.columns if c not in keys and c != time]
    kept = _timed(events.where(~final), time, delay)
    kinds, marked = _fields(events, own), T.StructType([*[T.StructField(f"key_{i}", events.schema[k].dataType) for i, k in enumerate(keys)], T.StructField(_MS, T.LongType()), *[events.schema[c] for c in events.columns if c in own]])
    processor = _Throttle([f.name for f in events.schema.fields if f.name in own], kinds, int(seconds * 1000))
    last = kept.groupBy(*keys).transformWithStateInPandas(processor, marked, "append", "EventTime")
    made = last.select(*[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)], F.timestamp_millis(_MS).alias(time), *own)
    return made.select(events.columns).unionByName(events.where(final).withColumn(time, F.col(time).cast("timestamp")))


class _Claims(StatefulProcessor):
    """Claims, releases and cancellations of a job, in the order of their times."""

    def __init__(self, order: str, keep: int | None) -> None:
        self.order, self.keep = order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, place long, kind string, who string")
        self.state = handle.getValueState("state", "owner string, cancelled boolean, ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ms, place, kind, who in part[[_MS, self.order, "kind", "who"]].itertuples(index=False, name=None):
                self.waiting.appendValue((int(ms), int(place), _plain(kind), _plain(who)))
                self.handle.registerTimer(int(ms))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, waiting = expiredTimerInfo.getExpiryTimeInMs(), sorted(tuple(x) for x in self.waiting.get())
        due = [x for x in waiting if x[0] <= now]
        owner, cancelled, last = tuple(self.state.get()) if self.state.exists() else (None, False, None)
        if not due:
            if self.keep is not None and last is not None and last + self.keep <= now and not waiting:
                self.state.clear()
            return
        out = []
        for ms, place, kind, who in due:
            if self.keep is not None and last is not None and last + self.keep <= ms:
                owner, cancelled = None, False
            if kind == "claim" and owner is None and not cancelled:
                owner = who
            elif kind == "cancel" or (kind == "release" and owner is not None and owner == who):
                owner, cancelled = None, cancelled or kind == "cancel"
            last = ms
            out.append((key[0], place, kind, who, owner, cancelled))
        self.state.update((owner, cancelled, last))
        if left := waiting[len(due) :]:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if self.keep is not None:
            self.handle.registerTimer(last + self.keep)
        yield pd.DataFrame(out, columns=["key_0", self.order, "kind", "who", "owner", "cancelled"])

    def close(self) -> None:
        pass


def claims(events: DataFrame, key: str, time: str, delay: str, order: str = "seq", keep_seconds: float | None = None) -> DataFrame:
    """The stream of ``progress.claims``: key, order, kind, who, and who holds the job after that event.

    ``order`` must rise with ``time``. The last row of a job is what the batch operator gives for it. A job without an event for
    ``keep_seconds`` is forgotten, its cancellation too (None: never).
    """
    kind = events.schema[key].dataType.simpleString()
    rows = _timed(events, time, delay).select(F.col(key).alias("key_0"), F.col(order).cast("long").alias(order), "kind", "who", time, _MS)
    processor = _Claims(order, None if keep_seconds is None else int(keep_seconds * 1000))
    made = rows.groupBy("key_0").transformWithStateInPandas(processor, f"key_0 {kind}, `{order}` long, kind string, who string, owner string, cancelled boolean", "append", "EventTime")
    return made.withColumnRenamed("key_0", key)


class _Expiry(StatefulProcessor):
    """Times of a key that no later one follows soon enough."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getMapState("times", "ms long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for ms in {int(x) for part in rows for x in part[_MS].tolist()}:
            self.times.updateValue((ms,), (1,))
            self.handle.registerTimer(ms + self.ttl)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        used = end - self.ttl
        renewed = any(used < tuple(k)[0] <= end for k in self.times.keys())
        self.times.removeKey((used,))
        if not renewed:
            yield pd.DataFrame([[*key, used, end]], columns=[*(f"key_{i}" for i in range(len(key))), "used", "expired"])

    def close(self) -> None:
        pass


def expiries(events: DataFrame, keys: list[str], time: str, seconds: float) -> DataFrame:
    """keys, used, expired: each time after which a key had no event for ``seconds``, and when it expired. A batch operator.

    The last event of a key counts too: what hasn't expired yet is a matter of the time at which one asks.
    """
    at = events.select(*keys, F.unix_millis(F.col(time).cast("timestamp")).alias("_used")).distinct()
    after = F.lead("_used").over(Window.partitionBy(*keys).orderBy("_used"))
    ttl = int(seconds * 1000)
    ended = at.withColumn("_next", after).where(F.col("_next").isNull() | (F.col("_next") - F.col("_used") > ttl))
    return ended.select(*keys, F.timestamp_millis("_used").alias("used"), F.timestamp_millis(F.col("_used") + ttl).alias("expired"))


def expiring(events: DataFrame, keys: list[str], time: str, seconds: float, delay: str) -> DataFrame:
    """The stream of ``expiries``: a row is given out when the watermark has passed its expiry."""
    rows = _timed(events, time, delay).select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], time, _MS)
    marked = T.StructType([*[T.StructField(f"key_{i}", events.schema[k].dataType) for i, k in enumerate(keys)], T.StructField("used", T.LongType()), T.StructField("expired", T.LongType())])
    made = rows.groupBy(*[f"key_{i}" for i in range(len(keys))]).transformWithStateInPandas(_Expiry(int(seconds * 1000)), marked, "append", "EventTime")
    return made.select(*[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)], F.timestamp_millis("used").alias("used"), F.timestamp_millis("expired").alias("expired"))
