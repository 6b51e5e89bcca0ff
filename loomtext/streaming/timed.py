"""State with timers: a cache whose entries live for a time from their fetch, and a registry of sessions that end when they were idle.

Rows of a key wait in its state until the watermark has passed them, are then taken in the order of their time, and leave only what the rule needs
(the time of the fetch; the begin, the last row and the number of rows). One timer for each key stands at the next thing that is due: a row that
waits, or the end of an entry; so an entry ends on time without any further row. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ordered(StatefulProcessor):
    """Takes rows in the order of their time (microseconds). take() and due() give output rows without their key; state is a tuple or None."""

    fields = ""
    names: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, since each question to the state goes from this process to Spark's and back: waiting rows, the timer, the rule's own fields
        self.value = handle.getValueState("value", f"waiting array<long>, timer long, {self.fields}")

    def take(self, state: tuple | None, at: int) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def ends(self, state: tuple) -> int:
        """When what is held ends, if no row comes before."""
        raise NotImplementedError

    def ended(self, state: tuple) -> list[tuple]:
        raise NotImplementedError

    def _advance(self, key, new: list[int], watermark_ms: int, gone_off: bool = False) -> Iterator[Row]:
        passed, named = watermark_ms * 1000, Row(*self.names)
        known = self.value.get()
        waiting, timer, *held = known if known is not None else ((), None, None)
        state = None if held[0] is None else tuple(held)
        rows = sorted([*waiting, *new])
        due = rows[: bisect_right(rows, passed)]
        for at in due:
            if state is not None and self.ends(state) <= at:
                yield from (named(*key, *x) for x in self.ended(state))
                state = None
            state, out = self.take(state, at)
            yield from (named(*key, *x) for x in out)
        if state is not None and self.ends(state) <= passed:
            yield from (named(*key, *x) for x in self.ended(state))
            state = None
        rest = rows[len(due) :]
        following = [*rest[:1], *([] if state is None else [self.ends(state)])]
        at = -(-min(following) // 1000) if following else None
        timer = None if gone_off else timer
        if timer != at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        if at is not None:
            self.value.update((rest, at, *(state or (None,) * len(self.fields.split(",")))))
        elif known is not None:
            self.value.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._advance(key, [r["at"] for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


class Cache(Ordered):
    """A row within the time to live of the fetch is a hit; any other fetches anew. An entry that no row has renewed expires."""

    fields = "fetched long"

    def __init__(self, live: int):
        self.live = live

    def ends(self, state):
        return state[0] + self.live

    def ended(self, state):
        return [(self.ends(state), "expired")]

    def take(self, state, at):
        return (state, [(at, "hit")]) if state is not None else ((at,), [(at, "miss")])


class Sessions(Ordered):
    """A session goes on while its key's rows follow each other in less than the idle time; then it is given out."""

    fields = "begin long, last long, n long"

    def __init__(self, idle: int):
        self.idle = idle

    def ends(self, state):
        return state[1] + self.idle

    def ended(self, state):
        return [tuple(state)]

    def take(self, state, at):
        return ((at, at, 1) if state is None else (state[0], at, state[2] + 1)), []


def _stream(events: DataFrame, key: str, ts: str, late: str, processor: Ordered, fields: str) -> DataFrame:
    rows = events.withColumn("_at", F.col(ts).cast("timestamp")).where("_at IS NOT NULL").withWatermark("_at", late)
    rows = rows.select(F.col(key).alias("key"), "_at", F.unix_micros("_at").alias("at"))
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), *T._parse_datatype_string(fields).fields])
    processor.names = tuple(schema.names)
    return rows.groupBy("key").transformWithState(processor, schema, "append", "eventTime")


def cache_stream(events: DataFrame, key: str, ts: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """key, at (microseconds), outcome: hit, miss or expired. Rows without a time are left out; a null key is one."""
    return _stream(events, key, ts, late, Cache(seconds * 1_000_000), "at long, outcome string")


def session_registry(events: DataFrame, key: str, ts: str, idle_seconds: int, late: str = "10 minutes") -> DataFrame:
    """key, begin, last (microseconds), n: each session once it was idle for so long."""
    return _stream(events, key, ts, late, Sessions(idle_seconds * 1_000_000), "begin long, last long, n long")


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Takes what there is, appends the outcome to a Parquet table, and stops; run again with the same folders, it goes on where it was. State with
    timers needs the RocksDB provider, which holds for this query alone."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
    return q
