"""Queries over the event log: pages and facets, payload schema, sessions, signatures and switches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.functions.sequences import signature_text
from loomtrace.operators.sessions import instances, sessionise
from loomtrace.plans.adapters import activity, chats, table
from loomtrace.queries import sql

GAP = 240 * 60_000


def events_page(spark, sf_dir):
    """Second page of the newest error events."""
    found = activity(spark, sf_dir).where("event_type = 'error'").orderBy(F.desc("ts_ms"), F.desc("id"))
    return found.offset(100).limit(100).select("id", "user_id", "ts_ms", "app", "action")


def events_facets(spark, sf_dir):
    """Counts by application and action, with subtotals (grouping sets)."""
    return activity(spark, sf_dir).rollup("app", "action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


def filtered_counts(spark, sf_dir):
    """Conditional counts in one pass."""
    return activity(spark, sf_dir).agg(F.count_if(F.col("app") == "gmail").alias("mail"), F.count_if(F.col("value") > 50).alias("large"), F.count_if(F.col("k").isNull()).alias("unkeyed"), F.count(F.lit(1)).alias("n"))


def tumbling_counts(spark, sf_dir):
    """Events and value by day and application."""
    day = F.floor(F.col("ts_ms") / 86_400_000).cast("long")
    return activity(spark, sf_dir).groupBy(day.alias("day"), "app").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def payload_keys(spark, sf_dir):
    """Observed payload keys by event type, with first and last sight."""
    raw = table(spark, sf_dir, "events")
    keys = raw.select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def observed_schema(spark, sf_dir):
    """Keys per application seen in the last 20 days, and seen before the last 40 hours only."""
    log = activity(spark, sf_dir)
    now = log.agg(F.max("ts_ms").alias("as_of"))
    seen = log.crossJoin(F.broadcast(now)).withColumn("key", F.concat(F.lit("k"), F.coalesce(F.col("k") % 10, F.lit(0)).cast("string")))
    recent = F.col("ts_ms") >= F.col("as_of") - 20 * 86_400_000
    return seen.groupBy("app").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(recent, F.col("key")))), ",").alias("recent_keys"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("ts_ms") < F.col("as_of") - 40 * 3_600_000, F.col("key")))), ",").alias("earlier_keys"),
    )


def _sessions(source, gap):
    def run(spark, sf_dir):
        return sessionise(source(spark, sf_dir), gap).select("instance_id", "user_id", "pos", "id", "ts_ms")

    return run


def instance_stats(spark, sf_dir):
    """Times, durations, switches and sizes of all instances."""
    found = instances(sessionise(activity(spark, sf_dir), GAP))
    return found.select("instance_id", "user_id", "started_ms", "ended_ms", "duration_ms", "n_events", "context_switches")


def signatures(spark, sf_dir):
    """Raw and collapsed signatures and their hashes."""
    found = instances(sessionise(activity(spark, sf_dir), GAP))
    return found.select("instance_id", F.array_join("raw_signature", "|").alias("raw"), signature_text(F.col("signature")).alias("text"), "signature_hash")


def sessions_declared(spark, sf_dir):
    """Declared sessions of conversations."""
    found = instances(sessionise(chats(spark, sf_dir)))
    return found.select("instance_id", "user_id", "n_events", "signature_hash", "duration_ms")


def user_streaks(spark, sf_dir):
    """Run-length encoding of each user's applications: switch to a new one begins a streak."""
    order = Window.partitionBy("user_id").orderBy("ts_ms", "id")
    marked = activity(spark, sf_dir).withColumn("new", F.coalesce((F.lag("app").over(order) != F.col("app")).cast("int"), F.lit(1)))
    streaks = marked.withColumn("streak", F.sum("new").over(order)).groupBy("user_id", "streak").agg(F.first("app").alias("app"), F.min("ts_ms").alias("started_ms"), F.count(F.lit(1)).alias("n"))
    return streaks.withColumn("lasted_ms", F.lead("started_ms").over(Window.partitionBy("user_id").orderBy("streak")) - F.col("started_ms"))


def throttled(spark, sf_dir):
    """Events without those that repeat the user's last event type within an hour."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts_ms", "id")
    since = F.col("ts_ms") - F.lag("ts_ms").over(order)
    return activity(spark, sf_dir).withColumn("since", since).where("since is null or since >= 3600000").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("since").alias("waited_ms"))


QUERIES = {
    "events_page": events_page,
    "events_facets": events_facets,
    "filtered_counts": filtered_counts,
    "tumbling_counts": tumbling_counts,
    "payload_keys": payload_keys,
    "observed_schema": observed_schema,
    "sessionise_default": _sessions(activity, 15 * 60_000),
    "sessionise_240": _sessions(activity, GAP),
    "instance_stats": instance_stats,
    "signatures": signatures,
    "sessions_declared": sessions_declared,
    "user_streaks": user_streaks,
    "throttled": throttled,
}

ORACLES = {
    "events_page": f"with {sql.ACTIVITY} select id, user_id, ts_ms, app, action from activity where event_type = 'error' order by ts_ms desc, id desc limit 100 offset 100",
    "events_facets": f"with {sql.ACTIVITY} select app, action, count(*) as n, count(distinct user_id) as users from activity group by rollup (app, action)",
    "filtered_counts": f"""with {sql.ACTIVITY} select count(*) filter (where app = 'gmail') as mail, count(*) filter (where value > 50) as large,
        count(*) filter (where k is null) as unkeyed, count(*) as n from activity""",
    "tumbling_counts": f"with {sql.ACTIVITY} select ts_ms // 86400000 as day, app, count(*) as n, round(sum(value), 4) as total from activity group by 1, 2",
    "payload_keys": """select event_type, key, count(*) as n, min((epoch_us(ts) // 1000)) as first_ms, max((epoch_us(ts) // 1000)) as last_ms
        from (select event_type, ts, unnest(json_keys(props)) as key from events) group by 1, 2""",
    "observed_schema": f"""with {sql.ACTIVITY}, seen as (select *, 'k' || coalesce(k % 10, 0) as key, max(ts_ms) over () as as_of from activity)
        select app, coalesce(string_agg(distinct key, ',' order by key) filter (where ts_ms >= as_of - 20 * 86400000::bigint), '') as recent_keys,
               coalesce(string_agg(distinct key, ',' order by key) filter (where ts_ms < as_of - 40 * 3600000::bigint), '') as earlier_keys
        from seen group by app""",
    "sessionise_default": f"with {sql.ACTIVITY}, {sql.steps(15 * 60_000)} select instance_id, user_id, pos, id, ts_ms from steps",
    "sessionise_240": f"with {sql.ACTIVITY}, {sql.steps(GAP)} select instance_id, user_id, pos, id, ts_ms from steps",
    "instance_stats": f"""with {sql.ACTIVITY}, {sql.steps(GAP)}, {sql.INSTANCES}
        select instance_id, user_id, started_ms, ended_ms, duration_ms, n_events, context_switches from instances""",
    "signatures": f"""with {sql.ACTIVITY}, {sql.steps(GAP)}, {sql.INSTANCES}
        select instance_id, array_to_string(raw_signature, '|') as raw, array_to_string(signature, ' -> ') as text,
               substr(sha1(array_to_string(signature, '|')), 1, 16) as signature_hash from instances""",
    "sessions_declared": f"""with {sql.CHATS}, {sql.steps(15 * 60_000)}, {sql.INSTANCES}
        select instance_id, user_id, n_events, substr(sha1(array_to_string(signature, '|')), 1, 16) as signature_hash, duration_ms from instances""",
    "user_streaks": f"""with {sql.ACTIVITY}, marked as (
            select *, coalesce((lag(app) over (partition by user_id order by ts_ms, id) <> app)::int, 1) as new from activity
        ), streaks as (
            select *, sum(new) over (partition by user_id order by ts_ms, id rows unbounded preceding) as streak from marked
        ), grouped as (select user_id, streak, min(app) as app, min(ts_ms) as started_ms, count(*) as n from streaks group by 1, 2)
        select *, lead(started_ms) over (partition by user_id order by streak) - started_ms as lasted_ms from grouped""",
    "throttled": f"""with {sql.ACTIVITY}, s as (select *, ts_ms - lag(ts_ms) over (partition by user_id, event_type order by ts_ms, id) as since from activity)
        select event_type, count(*) as n, sum(since)::bigint as waited_ms from s where since is null or since >= 3600000 group by 1""",
}
