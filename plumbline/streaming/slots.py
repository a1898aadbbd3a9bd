"""The slot state as a stream: changes wait until the watermark has passed them and are then taken in order of event time.

Every session keeps, in state stores of its own: the changes that wait, an entry for each slot, and a head (category, the last
change's time, a running number). A timer at the earliest waiting change wakes the session when the watermark gets there, so a
batch touches only sessions with new rows or ripe ones, and of those only the slots that change. What comes out is a log of
changes; `current` reads the slots from it, in batch, as `operators.sessions.category_slots` has them.

Defined cases: changes are taken by (ts, at). Of waiting rows with one `at` the least counts, so repeats do nothing. Rows
with a null session, `at`, attribute or value change nothing, yet their ts moves the watermark: such a row closes a stream
that is to end. Rows with a null ts change nothing. A row older than the watermark is dropped by Spark and counted in the query's
progress (`numRowsDroppedByWatermark`). A null confidence is less than any other. With `idle`, a session whose last
change is that much older than the watermark is forgotten: the log says `expired`, and later changes start anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOG = "session long, seq long, at long, change string, category string, attribute string, value string, confidence double, set_at long, superseded array<string>"
_NAMES = [c.split()[0] for c in LOG.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """The state store that keyed states and timers need, for the streams that are started inside."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _greater(a: float | None, b: float | None) -> float | None:
    return a if b is None else b if a is None else max(a, b)


class _Slots(StatefulProcessor):
    def __init__(self, idle_us: int | None):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "category string, last_us long, seq long")
        self.waiting = handle.getListState("waiting", "at long, us long, attribute string, value string, confidence double")
        self.slots = handle.getMapState("slots", "attribute string", "value string, confidence double, set_at long, superseded array<string>")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))  # timers are in milliseconds; not before `us`

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for batch in rows:
            batch = batch[batch["whole"]]
            for at, us, attribute, value, confidence in zip(*[batch[c] for c in ("at", "us", "attribute", "value", "confidence")]):
                new.append((int(at), int(us), attribute, value, None if pd.isna(confidence) else float(confidence)))
        if new:
            self.waiting.appendList(new)
            self._wake(min(r[1] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        by_at: dict[int, tuple] = {}
        for row in self.waiting.get() if self.waiting.exists() else ():
            by_at[row[0]] = min(by_at.get(row[0], row), row, key=_order)
        waiting = sorted(by_at.values(), key=_order)
        ripe = [w for w in waiting if w[1] <= upto]
        category, last, seq = self.head.get() if self.head.exists() else (None, None, 0)
        out: list[tuple] = []
        held: dict[str, tuple | None] = {}  # slots that are read or changed here; each goes back once

        def clear() -> None:
            self.slots.clear()
            held.clear()

        def forget(at: int | None) -> None:
            nonlocal category, last, seq
            seq += 1
            out.append((key[0], seq, at, "expired", None, None, None, None, None, None))
            clear()
            category = last = None

        for at, us, attribute, value, confidence in ripe:
            if self.idle_us is not None and last is not None and us - last >= self.idle_us:
                forget(at)
            seq += 1
            if attribute == "category":
                cleared = category is not None and category != value
                if cleared:
                    clear()
                category = value
                out.append((key[0], seq, at, "cleared" if cleared else "category", category, None, None, None, None, None))
            else:
                if attribute not in held:
                    held[attribute] = self.slots.getValue((attribute,)) if self.slots.containsKey((attribute,)) else None
                old = held[attribute]
                if old is None:
                    slot = (value, confidence, at, [])
                elif old[0] == value:
                    slot = (value, _greater(old[1], confidence), at, list(old[3]))
                else:
                    slot = (value, confidence, at, sorted({*old[3], old[0]}))
                held[attribute] = slot
                out.append((key[0], seq, at, "set", category, attribute, *slot))
            last = us
        rest = waiting[len(ripe) :]
        if not rest and self.idle_us is not None and last is not None and last + self.idle_us <= upto:
            forget(None)
        if ripe and rest:
            self.waiting.put(rest)
        elif ripe:
            self.waiting.clear()
        for attribute, slot in held.items():
            self.slots.updateValue((attribute,), slot)
        if rest:
            self._wake(rest[0][1])
        elif self.idle_us is not None and last is not None:
            self._wake(last + self.idle_us)
        self.head.update((category, last, seq))
        yield pd.DataFrame(out, columns=_NAMES).astype({"at": "Int64", "set_at": "Int64"})

    def close(self) -> None:
        pass


def _order(row: tuple) -> tuple:
    """Rows (at, us, attribute, value, confidence) by time, `at`, attribute, value and confidence, a null confidence first."""
    return (row[1], row[0], *row[2:4], row[4] is not None, row[4] or 0.0)


def logged(changes: DataFrame, delay: str, idle: str | None = None) -> DataFrame:
    """changes (session long, at long, ts timestamp, attribute, value, confidence double), a stream: the log of changes, each
    once the watermark (`delay` behind the greatest ts) has passed it. Start it within `rocks`."""
    whole = reduce(Column.__and__, [F.col(c).isNotNull() for c in ("session", "at", "ts", "attribute", "value")])
    # no null in integers: pandas would read a batch's keys and times as floats
    filled = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = changes.withWatermark("ts", delay).select(
        filled(F.col("session")).alias("session"), filled(F.col("at")).alias("at"), "ts", "attribute", "value", "confidence", filled(F.unix_micros("ts")).alias("us"), whole.alias("whole"),
    )
    idle_us = int(pd.Timedelta(idle).total_seconds() * 1_000_000) if idle else None
    return rows.groupBy("session").transformWithStateInPandas(_Slots(idle_us), LOG, "append", "EventTime")


def current(log: DataFrame) -> DataFrame:
    """(session, category, attribute, value, confidence, set_at, superseded) after all changes of a log: a slot's last row after
    the session's last `cleared` or `expired`."""
    by = Window.partitionBy("session")
    rows = log.withColumn("from_", F.coalesce(F.max(F.when(F.col("change").isin("cleared", "expired"), F.col("seq"))).over(by), F.lit(0)))
    rows = rows.withColumn("category_", F.max(F.when((F.col("seq") >= F.col("from_")) & F.col("change").isin("cleared", "category"), F.struct("seq", "category"))).over(by)["category"])
    last = F.max_by(F.struct("value", "confidence", "set_at", "superseded"), "seq").alias("s")
    return rows.where("change = 'set' and seq > from_").groupBy("session", "attribute").agg(F.first("category_").alias("category"), last).select("session", "category", "attribute", "s.*")
