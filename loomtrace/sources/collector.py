"""Batches of browser signals into events: gates, denylist, interpretation, registry and counters.

Works on a batch and on a stream alike and keeps no state, but for ``throttled``, which looks at a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions import normalise as N
from loomtrace.functions import web as W


def admitted(signals: DataFrame, sources: DataFrame) -> DataFrame:
    """Signals with their source's columns, for connected sources with consent; ``denied`` marks excluded addresses.

    ``sources`` (source_id, user_id, team, kind, status, consented, with_values, denylist) is a small table.
    """
    open_sources = sources.where((F.col("status") == "connected") & F.col("consented"))
    joined = signals.join(F.broadcast(open_sources.select("source_id", "user_id", "team", "kind", "with_values", "denylist")), "source_id")
    return joined.withColumn("denied", F.coalesce(W.denied(F.col("url"), F.col("denylist")), F.lit(False)))


def events_of(marked: DataFrame) -> DataFrame:
    """Canonical events of the admitted signals; a clock that can't be read counts as the time of arrival (``received_at``)."""
    kept = marked.where(~F.col("denied"))
    when = F.coalesce(N.parse_timestamp(F.col("occurred_at")), F.col("received_at"))
    told = W.interpret(kept.withColumn("ts", when), with_values=True)
    extra = F.map_filter(F.create_map(F.lit("interaction"), F.col("interaction"), F.lit("tab"), F.col("tab_id")), lambda _, v: v.isNotNull() & (v != ""))
    shown = F.map_filter("payload", lambda k, _: F.col("with_values") | (k != "title"))
    return told.select(
        "signal_id", "source_id", F.col("kind").alias("source"), "user_id", "team", "ts", "app", "action", "object_type", "object_id",
        F.coalesce(F.col("duration_ms").cast("long"), F.lit(0)).alias("duration_ms"), F.map_concat(shown, extra).alias("payload"), "session_id",
    )


def counters(marked: DataFrame) -> DataFrame:
    """Accepted and rejected signals, the last time and whether detection is worth a run, by source (a batch or a running total)."""
    when = F.coalesce(N.parse_timestamp(F.col("occurred_at")), F.col("received_at"))
    sums = marked.groupBy("source_id").agg(F.count_if(~F.col("denied")).alias("accepted"), F.count_if("denied").alias("rejected"), F.max(F.when(~F.col("denied"), when)).alias("last_event_at"))
    return sums.withColumn("detection_suggested", F.col("accepted") >= C.DETECTION_EVENTS)


def unregistered(events: DataFrame, registry: DataFrame) -> DataFrame:
    """(key, label, category) of the applications that were observed and are in no registry (key)."""
    fresh = events.select(F.col("app").alias("key")).distinct().join(registry.select("key"), "key", "left_anti")
    return fresh.select("key", F.initcap(F.translate("key", "-_", "  ")).alias("label"), F.lit("discovered").alias("category"))


def coverage(events: DataFrame, sources: DataFrame, tiers: DataFrame) -> DataFrame:
    """What is connected and seen: sources, the best connected tier (kind, estimate), applications and events."""
    connected = sources.where("status = 'connected'")
    best = tiers.join(connected.select("kind").distinct(), "kind", "left_semi").agg(F.round(F.coalesce(F.max("estimate"), F.lit(0.0)), 2).alias("estimated_coverage"))
    named = sources.agg(
        F.count(F.lit(1)).alias("total_sources"), F.count_if(F.col("status") == "connected").alias("connected_sources"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "connected", F.col("kind")))), ",").alias("kinds_connected"),
    )
    seen = events.agg(F.countDistinct("app").alias("distinct_apps"), F.count(F.lit(1)).alias("total_events"), F.count("source_id").alias("observed_events"))
    return seen.crossJoin(F.broadcast(named)).crossJoin(F.broadcast(best))


def throttled(signals: DataFrame, tab: list[str], key: list[str], order: list[str], least_ms: int = C.THROTTLE_MS) -> DataFrame:
    """Signals that a tab sends: one that equals the last one sent in all ``key`` columns within ``least_ms`` is dropped.

    A dropped signal doesn't start the interval anew, so what is sent follows from what was sent before. That chain is
    only followed inside a run of equal signals that are all closer than ``least_ms`` to the one before: any other
    signal is sent whatever came before it. ``order`` are columns that order a tab's signals, ``ts_ms`` the first.
    Nulls are equal to each other in ``key``; signals without a time are dropped; an empty table gives no rows.
    """
    timed = signals.where("ts_ms is not null")
    window = Window.partitionBy(*tab).orderBy(*order)
    # there is no signal before a tab's first one
    same = F.lag(F.lit(True)).over(window).isNotNull()
    for k in key:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(window))
    near = same & (F.col("ts_ms") - F.lag("ts_ms").over(window) < least_ms)
    runs = timed.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    # the times at which a run sends, and what it sends at each: the first signal of that time
    times = runs.groupBy(*tab, "_run").agg(F.array_sort(F.collect_set("ts_ms")).alias("_times"))
    empty = F.array().cast("array<bigint>")
    later = F.aggregate("_times", empty, lambda sent, t: F.when((F.size(sent) == 0) | (t - F.element_at(sent, -1) >= least_ms), F.concat(sent, F.array(t))).otherwise(sent))
    sent = times.select(*(F.col(c).alias(f"_{c}") for c in tab), F.col("_run").alias("_of"), F.explode(later).alias("_at"))
    nth = F.row_number().over(Window.partitionBy(*tab, "_run", "ts_ms").orderBy(*order))
    on = (F.col("_run") == F.col("_of")) & (F.col("ts_ms") == F.col("_at"))
    for c in tab:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return runs.withColumn("_nth", nth).where("_nth = 1").join(sent, on, "left_semi").drop("_new", "_run", "_nth")
