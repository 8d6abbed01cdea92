"""The collectors' queues: bounded, flushed in batches after a pause in activity, kept while a source is offline.

Signals of a source wait in a queue. It is flushed when no signal has come for ``debounce_ms``, at the latest at the
next multiple of ``every_ms``; a batch holds ``size`` signals at most. A flush that is due while the source is
offline, or behind the begin of an outage, waits for its end. A queue that outgrows ``bound`` drops its oldest signal.

``batches`` says so by windows over a table; ``queued`` is the same as a state machine of a stream, whose
queue never holds more than ``bound`` signals. Outages are half open and apart from each other. Rows are (source, id,
flush_ms, batch, place): ``flush_ms`` is when the queue of the signal was flushed, ``batch`` and ``place`` count
from one; all three are null for signals that were dropped.

Defined results: equal times are in the order of their ids; rows that repeat are signals of their own; signals
without source or time are left out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from loomtrace import constants as C
from loomtrace.streaming.stateful import Ordered

QUEUED = "source string, id long, flush_ms long, batch long, place long"


@dataclass(frozen=True)
class Pace:
    """How a collector flushes."""

    debounce_ms: int = C.DEBOUNCE_MS
    every_ms: int = C.FLUSH_MS
    size: int = C.BATCH_SIGNALS
    bound: int = C.QUEUED_SIGNALS


def batches(signals: DataFrame, outages: DataFrame, pace: Pace = Pace()) -> DataFrame:
    """Flush, batch and place of every signal (source, ts_ms, id) of a table; ``outages`` are (source, from_ms, until_ms).

    Bursts are windows of one source and slot of ``every_ms``. An outage may hold any number of signals: they are
    counted by slot, and only the slot in which the bound falls is ranked; what is numbered is at most ``bound`` rows.
    """
    spans = outages.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("from_ms", "until_ms"))).alias("spans"))
    known = signals.where("source is not null and ts_ms is not null").select("source", "ts_ms", "id").join(spans, "source", "left")
    begun = F.filter("spans", lambda x: x["from_ms"] <= F.col("ts_ms"))
    ended = F.get(F.filter("spans", lambda x: (x["from_ms"] <= F.col("ts_ms")) & (F.col("ts_ms") < x["until_ms"])), F.lit(0))["until_ms"]
    following = F.get(F.filter("spans", lambda x: x["from_ms"] > F.col("ts_ms")), F.lit(0))
    marked = known.select("source", "ts_ms", "id", F.floor(F.col("ts_ms") / pace.every_ms).alias("slot"), F.coalesce(F.size(begun), F.lit(0)).alias("era"), ended.alias("until_ms"), following.alias("following"))
    order = Window.partitionBy("source", "slot", "era").orderBy("ts_ms", "id")
    online = marked.where("until_ms is null")
    pause = F.coalesce((F.col("ts_ms") - F.lag("ts_ms").over(order) > pace.debounce_ms).cast("int"), F.lit(0))
    bursts = online.withColumn("pause", pause).withColumn("burst", F.sum("pause").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("ts_ms").over(Window.partitionBy("source", "slot", "era", "burst"))
    due = F.least(last + pace.debounce_ms, (F.col("slot") + 1) * pace.every_ms)
    waits = F.when(F.col("following.from_ms") <= F.col("due"), F.col("following.until_ms"))
    sent = bursts.withColumn("due", due).select("source", "ts_ms", "id", "slot", F.coalesce(waits, "due").cast("long").alias("flush_ms"))
    grouped = sent.unionByName(marked.where("until_ms is not null").select("source", "ts_ms", "id", "slot", F.col("until_ms").alias("flush_ms")))
    newer = Window.partitionBy("source", "flush_ms").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    counts = grouped.groupBy("source", "flush_ms", "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0))).drop("n")
    judged = grouped.join(counts, ["source", "flush_ms", "slot"])
    near = judged.where(F.col("newer") < pace.bound)
    rank = F.row_number().over(Window.partitionBy("source", "flush_ms", "slot").orderBy(F.desc("ts_ms"), F.desc("id")))
    ranked = near.withColumn("kept", F.col("newer") + rank <= pace.bound)
    nth = F.row_number().over(Window.partitionBy("source", "flush_ms").orderBy("ts_ms", "id")).cast("long") - 1
    kept = ranked.where("kept").withColumn("nth", nth).select("source", "id", "flush_ms", (F.floor(F.col("nth") / pace.size) + 1).alias("batch"), (F.col("nth") % pace.size + 1).alias("place"))
    gone = ranked.where("not kept").select("source", "id").unionByName(judged.where(F.col("newer") >= pace.bound).select("source", "id"))
    none = F.lit(None).cast("long")
    return kept.unionByName(gone.select("*", none.alias("flush_ms"), none.alias("batch"), none.alias("place")))


class Queue(Ordered):
    """``batches`` for one source, signal by signal."""

    WAITING = "ts_ms long, id long"

    def __init__(self, outages: dict[str, list[tuple[int, int]]], pace: Pace):
        self.outages, self.pace = {source: sorted(spans) for source, spans in outages.items()}, pace

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.queue = handle.getListState("queue", "ts_ms long, id long")
        # the end of the outage in which the last signal came; null if the source was online
        self.until = handle.getValueState("until", "until_ms long")

    def held(self) -> tuple[list[tuple], int | None]:
        queue = [tuple(q) for q in self.queue.get()] if self.queue.exists() else []
        return queue, self.until.get()[0] if self.until.exists() else None

    def due(self, source: str, last: int, until: int | None) -> int:
        """When a queue is flushed that no further signal joins."""
        if until is not None:
            return until
        due = min(last + self.pace.debounce_ms, (last // self.pace.every_ms + 1) * self.pace.every_ms)
        return next((e for b, e in self.outages.get(source, ()) if last < b <= due), due)

    def joins(self, source: str, last: int, until: int | None, ts_ms: int, end: int | None) -> bool:
        """Whether a signal goes out with those that wait."""
        if end is not None:
            return self.due(source, last, until) == end
        alone = until is not None or any(last < b <= ts_ms for b, _ in self.outages.get(source, ()))
        return not alone and ts_ms - last <= self.pace.debounce_ms and ts_ms // self.pace.every_ms == last // self.pace.every_ms

    def flushed(self, source: str, queue: list[tuple], due: int) -> Iterator[Row]:
        for k, (_, signal) in enumerate(queue):
            yield Row(source=source, id=signal, flush_ms=due, batch=k // self.pace.size + 1, place=k % self.pace.size + 1)

    def take(self, key: tuple, ready: list[tuple]) -> Iterator[Row]:
        (source,), (queue, until) = key, self.held()
        for ts_ms, signal in ready:
            end = next((e for b, e in self.outages.get(source, ()) if b <= ts_ms < e), None)
            if queue and not self.joins(source, queue[-1][0], until, ts_ms, end):
                yield from self.flushed(source, queue, self.due(source, queue[-1][0], until))
                queue = []
            until = end
            queue.append((ts_ms, signal))
            if len(queue) > self.pace.bound:
                yield Row(source=source, id=queue.pop(0)[1], flush_ms=None, batch=None, place=None)
        self.until.update((until,))
        self.queue.put(queue)
        self.handle.registerTimer(self.due(source, queue[-1][0], until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        queue, until = self.held()
        if queue and self.due(key[0], queue[-1][0], until) <= timerValues.getCurrentWatermarkInMs():
            yield from self.flushed(key[0], queue, self.due(key[0], queue[-1][0], until))
            self.queue.clear()


def queued(signals: DataFrame, outages: dict[str, list[tuple[int, int]]], late: str, pace: Pace = Pace()) -> DataFrame:
    """``batches`` of a stream (source, ts, id), each flush as the watermark passes it."""
    rows = signals.where("source is not null and ts is not null").withWatermark("ts", late).select("source", "ts", F.unix_millis("ts").alias("ts_ms"), "id")
    return rows.groupBy("source").transformWithState(Queue(outages, pace), QUEUED, "append", "eventTime")
