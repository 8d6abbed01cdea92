"""Stateful streams: sessions by all rules, the feed of the trust ladder, and its enforcement run by run.

Each is a state machine of one key (``transformWithState``). What has to be seen in order waits in the state
until the watermark has passed it, so results don't depend on how events are cut into batches; what does not
is kept as the few newest rows. State of a key is bounded by the lateness or by a constant. The RocksDB
state store that these need is set for the start of a query only (``drained``).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtrace import constants as C
from loomtrace.operators import governance as G
from loomtrace.streaming import flows as S

#: The state store of these operators.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

STEP = "instance_id string, user_id string, pos long, id long, ts_ms long"
FEED = "automation_id string, trust_level string, version long, n long, average double, criticals long, late_criticals long"
HISTORY = "automation_id string, sequence long, trust_level string, reason string"


def drained(stream: DataFrame, name: str) -> DataFrame:
    """``flows.drained`` with the state store that state machines need."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        return S.drained(stream, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Ordered(StatefulProcessor):
    """Hands rows to ``take`` in the order of (ts_ms, ...), each once the watermark has passed it.

    Subclasses name the fields that wait (``WAITING``, the time first) and read them off a row. What comes in
    one batch waits as one value: each value of a list is encoded, sent and read back on its own.
    """

    WAITING = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def still_waiting(self) -> list[tuple]:
        """All rows that wait."""
        return [f for (rows,) in self.waiting.get() for f in pickle.loads(rows)]

    def wait(self, rows: list[tuple]) -> None:
        """Lets these rows wait and no others."""
        self.waiting.put([(pickle.dumps(rows),)])

    def fields(self, row: Row) -> tuple:
        return tuple(row[c.split()[0]] for c in self.WAITING.split(", "))

    def take(self, key: tuple, ready: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = [self.fields(r) for r in rows]
        self.waiting.appendValue((pickle.dumps(arrived),))
        # one timer a batch: at its expiry everything up to the watermark is final
        self.handle.registerTimer(max(f[0] for f in arrived))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        held = self.still_waiting()
        ready = sorted((f for f in held if f[0] <= until), key=lambda f: f[:2])
        if not ready:
            return
        later = [f for f in held if f[0] > until]
        if later:
            self.wait(later)
        else:
            self.waiting.clear()
        yield from self.take(key, ready)


class Sessions(Ordered):
    """``sessions.sessionise`` as a state machine: idle gaps, declared sessions and resets."""

    WAITING = "ts_ms long, id long, token string, duration_ms long, session_id string"

    def __init__(self, gap_ms: int, least: int):
        self.gap_ms, self.least = gap_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "first_id long, n long, ended long, session_id string, reset boolean")
        self.first = handle.getListState("first", "id long, ts_ms long")

    def take(self, key: tuple, ready: list[tuple]) -> Iterator[Row]:
        first_id, n, ended, session, reset = self.open.get() if self.open.exists() else (None, 0, None, None, False)
        # the first events of a task wait until it has enough of them
        first = [tuple(f) for f in self.first.get()] if self.first.exists() else []
        for ts_ms, event, token, duration_ms, declared in ready:
            if declared is None and token in C.RESET_TOKENS:
                reset = True
                continue
            apart = declared is not None and session is not None and declared != session
            if n == 0 or reset or apart or (ended is not None and ts_ms - ended > self.gap_ms):
                first_id, n, first = event, 0, []
            n, ended, session, reset = n + 1, ts_ms + duration_ms if duration_ms is not None else None, declared, False
            first.append((event, ts_ms))
            if n >= self.least:
                name = f"{key[0]}#{first_id}"
                for k, (held, at) in enumerate(first):
                    yield Row(instance_id=name, user_id=key[0], pos=n - len(first) + k + 1, id=held, ts_ms=at)
                first = []
        self.open.update((first_id, n, ended, session, reset))
        if first:
            self.first.put(first)
        else:
            self.first.clear()


def sessionised(events: DataFrame, late: str, gap_ms: int = C.SESSION_GAP_MS, least: int = 2) -> DataFrame:
    """The steps of ``sessions.sessionise`` (instance_id, user_id, pos, id, ts_ms) as the watermark passes them.

    ``events`` is a stream with the column ``ts`` beside those of canonical events.
    """
    token = F.concat_ws(":", "app", "action").alias("token")
    rows = events.withWatermark("ts", late).select("user_id", "ts", "ts_ms", "id", token, "duration_ms", "session_id")
    return rows.groupBy("user_id").transformWithState(Sessions(gap_ms, least), STEP, "append", "eventTime")


class Feed(StatefulProcessor):
    """The newest runs of an automation, and a row whenever what they say changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getListState("runs", "sequence long, score double, critical boolean")
        self.shown = handle.getValueState("shown", "version long, n long, average double, criticals long, late_criticals long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = {tuple(r) for r in self.runs.get()} if self.runs.exists() else set()
        for row in rows:
            level = row["trust_level"]
            newest.add((row["sequence"], row["score"], row["critical"]))
        kept = sorted(newest, key=lambda r: r[0], reverse=True)[: C.SHADOW_WINDOW]
        self.runs.put(kept)
        says = (len(kept), sum(r[1] for r in kept) / len(kept), sum(bool(r[2]) for r in kept), sum(bool(r[2]) for r in kept[: C.DEMOTE_LOOKBACK]))
        version, *before = self.shown.get() if self.shown.exists() else (0,)
        if tuple(before) != says:
            self.shown.update((version + 1, *says))
            yield Row(automation_id=key[0], trust_level=level, version=version + 1, n=says[0], average=says[1], criticals=says[2], late_criticals=says[3])


def newest_of_part(runs: DataFrame) -> DataFrame:
    """Only the newest runs of each automation in a part of a batch: others can't be among the newest of all.

    An automation with a third of all runs then sends a few rows from each part to its state.
    """

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            nth = frame.groupby("automation_id", dropna=False)["sequence"].rank(method="first", ascending=False)
            yield pa.RecordBatch.from_pandas(frame[nth <= C.SHADOW_WINDOW], schema=batch.schema, preserve_index=False)

    return runs.mapInArrow(few, runs.schema)


def trust_feed(runs: DataFrame) -> DataFrame:
    """Change feed of ``governance.trust_state``: rows of automations whose evaluation changed, numbered by ``version``.

    ``runs`` is a stream (automation_id, trust_level, sequence, score, critical) in any order. The enforced
    level is one rung lower while a recent run has a critical mismatch.
    """
    few = newest_of_part(runs.select("automation_id", "trust_level", "sequence", "score", "critical"))
    sums = few.groupBy("automation_id").transformWithState(Feed(), FEED, "update", "none")
    return G.evaluated(sums, "version")


def latest(feed: DataFrame) -> DataFrame:
    """The last row of each automation in a feed."""
    columns = [c for c in feed.columns if c not in ("automation_id", "version")]
    return feed.groupBy("automation_id").agg(F.max_by(F.struct(*columns), "version").alias("x")).select("automation_id", "x.*")


#: Critical runs after which an automation stands on the lowest rung, whatever its first level was.
RUNGS = len(C.TRUST_LEVELS) - 1
#: Rows that a part may hold back before it sends them on.
HELD = 100_000


def decisive_of_part(runs: DataFrame) -> DataFrame:
    """Runs of a part of a batch that can still change a level: every critical one takes a rung, so none after the last rung's.

    The newest run of a part stays for the watermark, which is the same as that of all runs.
    """

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            frame = rows.select(["automation_id", "ts_ms", "sequence", "critical"]).to_pandas().sort_values(["ts_ms", "sequence"], kind="stable")
            critical = (frame["critical"] == True).astype(int)  # noqa: E712 (null is not critical)
            before = critical.groupby(frame["automation_id"], dropna=False).cumsum() - critical
            kept = (before < RUNGS) | (frame.index == frame["ts_ms"].idxmax())
            held = rows.take(pa.array(frame.index[kept].to_numpy()))
            if held.num_rows > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return runs.mapInArrow(few, runs.schema)


class Ladder(Ordered):
    """Demotes by one rung after every run that leaves a critical mismatch among the last ones, and remembers the level.

    Runs after the last rung's critical one change nothing and don't wait.
    """

    WAITING = "ts_ms long, sequence long, critical boolean, trust_level string"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived = [self.fields(r) for r in rows]
        held = self.still_waiting() if self.waiting.exists() else []
        kept, criticals = [], 0
        for run in sorted(held + arrived, key=lambda f: f[:2]):
            kept.append(run)
            criticals += bool(run[2])
            if criticals == RUNGS:
                break
        self.wait(kept)
        self.handle.registerTimer(max(f[0] for f in arrived))
        return iter(())

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.at = handle.getValueState("at", "level long, since long")

    def take(self, key: tuple, ready: list[tuple]) -> Iterator[Row]:
        # ``since``: runs since the last critical one
        level, since = self.at.get() if self.at.exists() else (C.TRUST_LEVELS.index(ready[0][3]), C.DEMOTE_LOOKBACK)
        for _, sequence, critical, _ in ready:
            since = 0 if critical else since + 1
            if since < C.DEMOTE_LOOKBACK and level > 0:
                level -= 1
                yield Row(automation_id=key[0], sequence=sequence, trust_level=C.TRUST_LEVELS[level], reason=C.DEMOTED)
        self.at.update((level, min(since, C.DEMOTE_LOOKBACK)))


def enforced(runs: DataFrame, late: str) -> DataFrame:
    """History of automatic demotions, run by run in order, from a stream (automation_id, trust_level, ts, sequence, critical)."""
    rows = decisive_of_part(runs.select("automation_id", "ts", F.unix_millis("ts").alias("ts_ms"), "sequence", "critical", "trust_level")).withWatermark("ts", late)
    return rows.groupBy("automation_id").transformWithState(Ladder(), HISTORY, "append", "eventTime")
