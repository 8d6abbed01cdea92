"""Queries that run the streaming operators over the events as files that have arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.plans.adapters import activity
from loomtrace.queries import governance, joins, logs, sql
from loomtrace.sources import export
from loomtrace.sources.shared import new_path
from loomtrace.operators import governance as G
from loomtrace.streaming import detection
from loomtrace.streaming import flows as S
from loomtrace.streaming import queues as Q
from loomtrace.streaming import stateful as T

WINDOW = "6 hours"


def _arrived(spark, rows, times: int = 1):
    """``rows`` as a stream of files, delivered so many times."""
    folder = new_path(spark, "arrived")
    for _ in range(times):
        rows.write.mode("append").parquet(folder)
    return S.signals(spark, folder, rows.schema)


def _timed(spark, sf_dir):
    return activity(spark, sf_dir).withColumn("ts", F.timestamp_millis("ts_ms"))


def stream_sessions(spark, sf_dir):
    """Sessions by an idle gap of four hours; a later event of nobody lets the watermark pass the last of them."""
    events = _timed(spark, sf_dir).select("user_id", "session_id", "ts")
    tick = events.agg(F.max("ts").alias("ts")).select(F.lit("nobody").alias("user_id"), F.lit(None).cast("string").alias("session_id"), (F.col("ts") + F.expr("interval 2 days")).alias("ts"))
    found = S.drained(S.sessions(_arrived(spark, events.unionByName(tick)), "240 minutes", "1 hour"), "sessions").where("user_id <> 'nobody'")
    return found.select("user_id", F.unix_millis("started").alias("started_ms"), F.unix_millis("ended").alias("ended_ms"), "n_events")


def stream_transfers(spark, sf_dir):
    """Transfers linked as both sides arrive."""
    log = _timed(spark, sf_dir).select("id", "user_id", "app", "ts", (F.col("k") % 10).alias("key"), F.col("event_type").isin("view", "purchase").alias("is_copy"), F.col("event_type").isin("click", "purchase").alias("is_paste"))
    pairs = S.drained(S.transfers(_arrived(spark, log), ["user_id", "key"], WINDOW, "1 hour"), "pairs")
    after = F.unix_millis("pasted") - F.unix_millis("copied")
    return S.last_copies(pairs).select("paste_id", "copy_id", "from_app", "to_app", after.alias("after_ms"))


def stream_resync(spark, sf_dir):
    """Events by application after the same sync ran twice."""
    log = _timed(spark, sf_dir).select("id", "app", "ts")
    once = S.drained(S.once(_arrived(spark, log, times=2), ["app", "id"], "40 days"), "once")
    return once.groupBy("app").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_distinct"))


def stream_counters(spark, sf_dir):
    """Running totals and the latest time by application."""
    found = S.drained(S.high_water(_arrived(spark, _timed(spark, sf_dir).select("app", "ts"))), "counters", "complete")
    return found.select("app", F.unix_millis("high_water").alias("high_ms"), "n", (F.col("n") >= 30).alias("detection_suggested"))


def stream_increment(spark, sf_dir):
    """What the next sync takes after the marks of the first half were kept."""
    log = _timed(spark, sf_dir).select("id", "app", "ts")
    early = log.where("ts < timestamp '2024-01-15 00:00:00' and app <> 'crm'")
    marks = S.drained(S.high_water(_arrived(spark, early)), "marks", "complete")
    return S.since(log, marks).groupBy("app").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def stream_export(spark, sf_dir):
    """What the second sync of an account's recorded export takes, by application, and what both took: the first half's pages came first."""
    log = activity(spark, sf_dir).select("app", "id", "user_id", "ts_ms", "action")
    folder, table, state = (new_path(spark, f"export-{part}") for part in ("pages", "table", "state"))
    taken = None
    for run, pages in enumerate((log.where("ts_ms < 1705276800000 and app <> 'crm'"), log)):
        export.written_pages(pages, folder)
        taken = export.synced(export.exported(spark, folder).withColumn("run", F.lit(run)), table, state)
    later = F.col("run") == 1
    return taken.groupBy("app").agg(F.count_if(later).alias("n"), F.min(F.when(later, F.col("id"))).alias("first_id"), F.count(F.lit(1)).alias("n_both"), F.count_distinct("id").alias("n_distinct"))


#: Files that rows of the state machines are dealt to at random, and files of a micro-batch.
DEALT, TAKEN = 12, 4


def _shuffled(spark, rows, by: str, tick=None, taken: int = TAKEN):
    """``rows`` as a stream in several micro-batches without order; then ``tick`` of their latest ``ts``, which lets the watermark pass all of them."""
    folder = new_path(spark, "arrived")
    rows.repartition(DEALT, F.xxhash64(by)).write.parquet(folder)
    if tick is not None:
        # of the rows as they were written: what made them is not run again
        last = spark.read.schema(rows.schema).parquet(folder).agg(F.max("ts").alias("ts"))
        tick(last.withColumn("ts", F.col("ts") + F.expr("interval 400 days"))).coalesce(1).write.mode("append").parquet(folder)
    return S.signals(spark, folder, rows.schema, taken)


def stream_steps(spark, sf_dir):
    """Task instances by all rules of sessions, from events that come in any order."""
    events = _timed(spark, sf_dir).select("user_id", "ts", "ts_ms", "id", "app", "action", "duration_ms", "session_id")

    def tick(last):
        return last.select(F.lit("nobody").alias("user_id"), "ts", F.unix_millis("ts").alias("ts_ms"), F.lit(-1).cast("long").alias("id"), F.lit("x").alias("app"), F.lit("x").alias("action"), F.lit(0).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("session_id"))

    return T.drained(T.sessionised(_shuffled(spark, events, "id", tick), "200 days", logs.GAP), "steps").where("user_id <> 'nobody'")


#: A collector's pace, with a quarter of an hour for its second and a small queue, and two applications that were offline for days.
PACE = Q.Pace(debounce_ms=900_000, every_ms=18_000_000, size=4, bound=40)
OUTAGES = {"gmail": [(1704412800000, 1705104000000), (1705363200000, 1705449600000)], "sheets": [(1704844800000, 1706140800000)]}


def flush_batches(spark, sf_dir):
    """Flush, batch and place of every event as a collector's signal, by application."""
    outages = spark.createDataFrame([(source, *span) for source, spans in OUTAGES.items() for span in spans], "source string, from_ms long, until_ms long")
    return Q.batches(activity(spark, sf_dir).withColumnRenamed("app", "source"), outages, PACE)


def stream_flush(spark, sf_dir):
    """``flush_batches`` from signals that come in any order, through bounded queues."""
    signals = _timed(spark, sf_dir).select(F.col("app").alias("source"), "ts", "id")

    def tick(last):
        return last.select(F.lit("nobody").alias("source"), "ts", F.lit(-1).cast("long").alias("id"))

    return T.drained(Q.queued(_shuffled(spark, signals, "id", tick), OUTAGES, "200 days", PACE), "flush").where("source <> 'nobody'")


def _runs(spark, sf_dir):
    return governance._shadow(spark, sf_dir).join(governance._automations(spark, sf_dir).select("automation_id", "trust_level"), "automation_id")


def stream_trust(spark, sf_dir):
    """Moves on the ladder by the last row of each automation in the change feed; shadow runs come in any order."""
    feed = T.drained(T.trust_feed(_shuffled(spark, _runs(spark, sf_dir), "sequence")), "feed")
    requests = governance._automations(spark, sf_dir).where("parts % 2 = 0").select("automation_id", (F.col("parts") % 3 == 0).alias("force"))
    return G.moved(T.latest(feed), requests)


def stream_detection(spark, sf_dir):
    """Steps that detection keeps up to date as events arrive in any order, and the batch of the findings."""
    events = _timed(spark, sf_dir)
    kept = detection.Detector(new_path(spark, "detector"), logs.GAP, buckets=16)
    kept.run(_shuffled(spark, events, "id", taken=8).drop("ts"))
    last = kept.steps(spark).crossJoin(F.broadcast(kept.counts(spark).agg(F.sum("n").alias("seen"))))
    return last.select("instance_id", "user_id", "pos", "id", "ts_ms", "seen")


def stream_ladder(spark, sf_dir):
    """Every automatic demotion, enforced run by run though runs come in any order; a run's time is its number."""
    runs = _runs(spark, sf_dir).select("automation_id", "trust_level", F.timestamp_seconds("sequence").alias("ts"), "sequence", "critical")

    def tick(last):
        return last.select(F.lit("nobody").alias("automation_id"), F.lit(C.TRUST_LEVELS[0]).alias("trust_level"), "ts", F.lit(0).cast("long").alias("sequence"), F.lit(False).alias("critical"))

    return T.drained(T.enforced(_shuffled(spark, runs, "sequence", tick), "200 days"), "ladder")


QUERIES = {f.__name__: f for f in (stream_steps, stream_detection, stream_trust, stream_ladder, stream_sessions, stream_transfers, stream_resync, stream_counters, stream_increment, stream_export, flush_batches, stream_flush)}

_OUTAGES = ", ".join(f"('{source}', {b}, {e})" for source, spans in OUTAGES.items() for b, e in spans)
#: Signals one after another: what a pause, a slot, an outage or its end keeps apart; a flush that is due in an outage waits.
_FLUSHES = f"""with {sql.ACTIVITY}, outages(source, b, e) as (values {_OUTAGES}),
        s as (select a.app as source, id, ts_ms, o.e as until_ms, ts_ms // {PACE.every_ms} as slot, (select count(*) from outages x where x.source = a.app and x.b <= ts_ms) as era
              from activity a left join outages o on o.source = a.app and ts_ms >= o.b and ts_ms < o.e),
        c as (select *, coalesce((ts_ms - lag(ts_ms) over w > {PACE.debounce_ms} or slot <> lag(slot) over w or era <> lag(era) over w or until_ms is distinct from lag(until_ms) over w)::int, 1) as cut from s window w as (partition by source order by ts_ms, id)),
        g as (select *, sum(cut) over (partition by source order by ts_ms, id rows unbounded preceding) as burst from c),
        d as (select *, least(max(ts_ms) over (partition by source, burst) + {PACE.debounce_ms}, (slot + 1) * {PACE.every_ms}) as due from g),
        f as (select source, id, ts_ms, coalesce(until_ms, (select min(e) from outages x where x.source = d.source and x.b > d.ts_ms and x.b <= d.due), due) as flush_ms from d),
        r as (select *, row_number() over (partition by source, flush_ms order by ts_ms desc, id desc) as back from f),
        k as (select *, row_number() over (partition by source, flush_ms order by ts_ms, id) - 1 as nth from r where back <= {PACE.bound})
        select source, id, flush_ms, nth // {PACE.size} + 1 as batch, nth % {PACE.size} + 1 as place from k
        union all select source, id, null, null, null from r where back > {PACE.bound}"""

ORACLES = {
    "flush_batches": _FLUSHES,
    "stream_flush": _FLUSHES,
    "stream_steps": logs.ORACLES["sessionise_240"],
    "stream_detection": f"with {sql.ACTIVITY}, {sql.steps(logs.GAP)} select instance_id, user_id, pos, id, ts_ms, (select count(*) from activity) as seen from steps",
    "stream_trust": governance.ORACLES["trust_moves"],
    "stream_ladder": f"""with {governance._SHADOW}, c as (select *, max(case when critical then sequence end) over (partition by automation_id order by sequence rows unbounded preceding) as last from shadow),
        d as (select c.automation_id, sequence, rank - row_number() over (partition by c.automation_id order by sequence) as left_ from c join autos using (automation_id) where sequence - last < 3)
        select automation_id, sequence, (['OBSERVE', 'SUGGEST', 'SHADOW', 'ASSIST', 'AUTONOMOUS'])[left_ + 1] as trust_level, 'critical field mismatch detected' as reason from d where left_ >= 0""",
    "stream_sessions": f"""with {sql.ACTIVITY}, g as (select *, coalesce((ts_ms - lag(ts_ms) over (partition by user_id order by ts_ms) > 14400000)::int, 0) as cut from activity),
        s as (select *, sum(cut) over (partition by user_id order by ts_ms rows unbounded preceding) as task from g)
        select user_id, min(ts_ms) as started_ms, max(ts_ms) as ended_ms, count(*) as n_events from s group by user_id, task""",
    "stream_transfers": joins.ORACLES["transfer_links"],
    "stream_resync": f"with {sql.ACTIVITY} select app, count(*) as n, count(distinct id) as n_distinct from activity group by 1",
    "stream_counters": f"with {sql.ACTIVITY} select app, max(ts_ms) as high_ms, count(*) as n, count(*) >= 30 as detection_suggested from activity group by 1",
    "stream_increment": f"""with {sql.ACTIVITY}, m as (select app, max(ts_ms) as mark from activity where ts_ms < 1705276800000 and app <> 'crm' group by 1)
        select app, count(*) as n, min(id) as first_id from activity left join m using (app) where mark is null or ts_ms > mark group by 1""",
    "stream_export": f"""with {sql.ACTIVITY}, m as (select app, max(ts_ms) as mark from activity where ts_ms < 1705276800000 and app <> 'crm' group by 1)
        select app, count(*) filter (where mark is null or ts_ms > mark) as n, min(id) filter (where mark is null or ts_ms > mark) as first_id, count(*) as n_both, count(distinct id) as n_distinct
        from activity left join m using (app) group by 1""",
}
