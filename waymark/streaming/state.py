"""Operators of streams that keep state by key, with timers on event time that bound it. Each has a batch form that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

QUIET_MS, IDLE_MS = 300, 600_000
PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REQUEST, RESPONSE = "request", "response"


def _with_provider(spark: SparkSession) -> None:
    """State with timers needs this store; a store that the user has chosen stays."""
    if spark.conf.get(PROVIDER, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def _in_order(rows: list[tuple]) -> list[tuple]:
    """Rows by time, then by their other values, nulls first."""
    return sorted(rows, key=lambda r: (r[0], [(v is not None, v if v is not None else 0) for v in r[1:]]))


def _named(fields: StructType, values) -> Row:
    return Row(**dict(zip(fields.names, values, strict=True)))


class Debounce(StatefulProcessor):
    """Holds a key's events until the watermark is ``quiet`` beyond them, then lets through those that no other event follows sooner.

    Events behind the watermark are dropped. State: the events whose quiet time isn't over, so as many as a key has in the delay of the watermark plus ``quiet``.
    """

    def __init__(self, fields: StructType, quiet: int):
        self.fields, self.quiet = fields, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", StructType([StructField("millis", LongType()), *self.fields]))

    def again(self, events: list[tuple]) -> None:
        """Keep these events and wait for the first one's time."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not events:
            self.held.clear()
            return
        self.held.put(events)
        self.handle.registerTimer(events[0][0] + self.quiet)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = [e for r in rows if (e := tuple(r))[0] >= passed]
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        self.again(_in_order(held + fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        events = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        over = sum(e[0] + self.quiet <= now for e in events)
        out = [e for k, e in enumerate(events[:over]) if k + 1 == len(events) or events[k + 1][0] - e[0] >= self.quiet]
        self.again(events[over:])
        return iter([_named(self.fields, e[1:]) for e in out])


def _millis(at: str):
    return F.unix_millis(F.col(at).cast("timestamp"))


def debounce(events: DataFrame, key: str, at: str, quiet_ms: int = QUIET_MS, late: str = "10 seconds") -> DataFrame:
    """The events of a stream after which their key is quiet for ``quiet_ms``; of events at the same millisecond the greatest one counts. Append mode; an event comes out once the watermark is past its quiet time."""
    _with_provider(events.sparkSession)
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    others = [c for c in events.columns if c != at]
    plain = rows.select(_millis(at).alias("millis"), at, *others)
    fields = StructType([f for f in plain.schema if f.name != "millis"])
    return plain.groupBy(key).transformWithState(Debounce(fields, quiet_ms), fields, "append", "EventTime").select(*events.columns)


def debounced(events: DataFrame, key: str, at: str, quiet_ms: int = QUIET_MS) -> DataFrame:
    """The same rows from a table of events."""
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("millis", _millis(at))
    following = F.lead("millis").over(Window.partitionBy(key).orderBy("millis", at, *[c for c in events.columns if c != at]))
    return rows.withColumn("following", following).where(F.col("following").isNull() | (F.col("following") - F.col("millis") >= quiet_ms)).select(*events.columns)


class Newest(StatefulProcessor):
    """Lets responses through that answer their key's newest request. State: that request's number, until the watermark is ``idle`` beyond the key's last event."""

    def __init__(self, fields: StructType, idle: int):
        self.fields, self.idle = fields, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "sequence long, until long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        sequence, until = tuple(self.newest.get()) if self.newest.exists() else (None, 0)
        if until <= timerValues.getCurrentWatermarkInMs():
            sequence, until = None, 0  # its timer is due, and fires after the rows of this batch
        out = []
        for micros, is_response, number, *rest in _in_order([tuple(r) for r in rows]):
            until = max(until, micros // 1000 + self.idle)
            if not is_response:
                sequence = number if sequence is None else max(sequence, number)
            elif number == sequence:
                out.append(_named(self.fields, rest))
        if sequence is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.newest.update((sequence, until))
            self.handle.registerTimer(until)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        return iter(())


def _numbered(events: DataFrame, key: str, kind: str, sequence: str, at: str) -> DataFrame:
    fine = F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(sequence).isNotNull() & F.col(kind).isin(REQUEST, RESPONSE)
    return events.where(fine).withColumn("micros", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("is_response", F.col(kind) == RESPONSE).withColumn("number", F.col(sequence).cast("long"))


def fresh_responses(events: DataFrame, key: str, kind: str, sequence: str, at: str, idle_ms: int = IDLE_MS, late: str = "10 seconds") -> DataFrame:
    """Of a stream of requests and responses the responses to their key's newest request so far; a response without a known request is dropped.

    Rows of a batch count by their exact time, at the same time requests before responses; only idleness is counted in whole milliseconds. Append mode. A key that is idle for ``idle_ms`` is forgotten, so state holds active keys only.
    """
    _with_provider(events.sparkSession)
    rows = _numbered(events.withWatermark(at, late), key, kind, sequence, at).select("micros", "is_response", "number", *events.columns)
    fields = StructType([f for f in rows.schema if f.name in events.columns])
    return rows.groupBy(key).transformWithState(Newest(fields, idle_ms), fields, "append", "EventTime")


def fresh_of(events: DataFrame, key: str, kind: str, sequence: str, at: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """The same rows from a table, in which all events came in the order of their times."""
    rows = _numbered(events, key, kind, sequence, at)
    rows = rows.withColumn("millis", _millis(at))
    order = Window.partitionBy(key).orderBy("micros", "is_response")
    # a stretch without events for ``idle_ms`` ends what was known; rows of one time are all in the new one
    rows = rows.withColumn("apart", (F.col("millis") - F.lag("millis").over(order) > idle_ms).cast("int"))
    rows = rows.withColumn("stretch", F.coalesce(F.sum("apart").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)))
    newest = F.max(F.when(~F.col("is_response"), F.col("number"))).over(Window.partitionBy(key, "stretch").orderBy("micros", "is_response"))
    return rows.withColumn("newest", newest).where(F.col("is_response") & (F.col("number") == F.col("newest"))).select(*events.columns)
