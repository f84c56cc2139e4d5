"""State by key that ends by timers of event time: runs put off and coalesced, and what a session waits for.

Rows of a key wait until the watermark has passed them and are then taken in order, so that what comes out does not depend on how
rows were dealt to batches or the order in which they came. What is as old as the watermark when it comes is late and dropped by Spark. A key that
nothing waits for has no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyrook.operators import store
from tallyrook.streaming import capture

c = F.col
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = ("opened_ms", "ended_ms", "n", "how")


class Held(NamedTuple):
    """What is open for a key: since when, and how many rows it has seen."""

    ms: int
    n: int


class Ended(NamedTuple):
    opened_ms: int
    ended_ms: int
    n: int
    how: str


class _Ordered(StatefulProcessor):
    """Rows in order of time; subclasses say what a row does, and what an open thing is when its time is over."""

    def __init__(self, after_ms: int, key: str) -> None:
        self.after_ms, self.key = after_ms, key

    def took(self, held: Held | None, ms: int, kind: str | None) -> tuple[Held | None, Ended | None]:
        raise NotImplementedError

    def over(self, held: Held) -> Ended:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, seq long, kind string")
        self.held = handle.getValueState("held", "ms long, n long")
        self.wake = handle.getValueState("wake", "ms long")

    def _wake_at(self, ms: int | None) -> None:
        """One timer a key: the earliest time at which something is to be done."""
        if self.wake.exists():
            self.handle.deleteTimer(self.wake.get()[0])
            self.wake.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.wake.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        least = None
        for batch in rows:
            self.waiting.appendList([(int(ms), int(seq), kind) for ms, seq, kind in zip(batch["ms"], batch["seq"], batch["kind"], strict=True)])
            first = int(batch["ms"].min())
            least = first if least is None else min(least, first)
        if least is not None and (not self.wake.exists() or least < self.wake.get()[0]):
            self._wake_at(least)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1], r[2] or "")) if self.waiting.exists() else []
        held = Held(*self.held.get()) if self.held.exists() else None
        out: list[Ended] = []
        ready = [r for r in rows if r[0] <= now]
        for ms, _, kind in ready:
            if held and held.ms + self.after_ms < ms:
                out.append(self.over(held))
                held = None
            held, ended = self.took(held, ms, kind)
            out += [ended] if ended else []
        if held and held.ms + self.after_ms <= now:
            out.append(self.over(held))
            held = None
        left = [tuple(r) for r in rows[len(ready) :]]
        if ready:
            self.waiting.put(left) if left else self.waiting.clear()
        self.held.update(tuple(held)) if held else self.held.clear()
        due = [x for x in (left[0][0] if left else None, held.ms + self.after_ms if held else None) if x is not None]
        self._wake_at(min(due, default=None))
        if out:
            frame = pd.DataFrame(out, columns=list(_OUT))
            frame.insert(0, self.key, key[0])
            yield frame

    def close(self) -> None:
        pass


class Debounced(_Ordered):
    """A row asks for a run; it starts so long after the first that asked, for all that asked until then."""

    def took(self, held: Held | None, ms: int, kind: str | None) -> tuple[Held | None, Ended | None]:
        return (held._replace(n=held.n + 1) if held else Held(ms, 1)), None

    def over(self, held: Held) -> Ended:
        return Ended(held.ms, held.ms + self.after_ms, held.n, "run")


class Recalls(_Ordered):
    """A recall is open until a row closes or discards it, another replaces it, or its time is over. n counts the rows that it saw, its own included."""

    def __init__(self, after_ms: int, key: str, opens: tuple[str, ...], closes: tuple[str, ...], discards: tuple[str, ...]) -> None:
        super().__init__(after_ms, key)
        self.opens, self.ends = opens, dict.fromkeys(closes, "closed") | dict.fromkeys(discards, "discarded")

    def took(self, held: Held | None, ms: int, kind: str | None) -> tuple[Held | None, Ended | None]:
        how = "replaced" if kind in self.opens else self.ends.get(kind)
        ended = Ended(held.ms, ms, held.n, how) if held and how else None
        if kind in self.opens:
            return Held(ms, 1), ended
        return (held._replace(n=held.n + 1) if held and not how else None), ended

    def over(self, held: Held) -> Ended:
        return Ended(held.ms, held.ms + self.after_ms, held.n, "expired")


def ended(spark: SparkSession, stream: DataFrame, processor: _Ordered, ms: Column, seq: Column, kind: Column, late: str, at: str | None = None) -> DataFrame:
    """What ended in a stream that is run to its end: key, opened_ms, ended_ms, n and how. What is open when the watermark stops stays in the state
    below `at`, a folder of the shared ones, where a later run goes on.

    ms: milliseconds of a row's time, seq: its place among those of one time; rows without key or time are left out. A key's waiting rows, those of
    the time that the watermark is behind, are in memory when its timer goes.
    """
    at = at or store.fresh_path(spark, "stream")
    rows = stream.select(c(processor.key), ms.cast("long").alias("ms"), seq.cast("long").alias("seq"), kind.cast("string").alias("kind")).filter(c(processor.key).isNotNull() & c("ms").isNotNull())
    timed = rows.withColumn("at", F.timestamp_millis("ms")).withWatermark("at", late)
    schema = StructType([StructField(processor.key, rows.schema[processor.key].dataType)]).add("opened_ms", "long").add("ended_ms", "long").add("n", "long").add("how", "string")
    told = timed.groupBy(processor.key).transformWithStateInPandas(processor, schema, "append", "eventTime")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # timers need a store with column families
    try:
        capture.to_end(told, at, each)
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(f"{at}/out").drop("batch")
