"""Sessionisation: cutting each user's events into task instances, and what is derived per instance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions.normalise import step_token
from loomtrace.functions.sequences import collapse, signature_hash


def sessionise(events: DataFrame, gap_ms: int = C.SESSION_GAP_MS, least: int = 2) -> DataFrame:
    """Events (user_id, ts_ms, id, app, action, object_type, duration_ms, session_id) with instance_id and pos.

    A task ends at an idle gap counted from the end of the previous event, at a change between two
    declared sessions, and at a reset event outside sessions, which belongs to no task. One shuffle by
    user serves every window. Instances are named by user and first event.
    """
    by_user = Window.partitionBy("user_id").orderBy("ts_ms", "id")
    reset = F.col("session_id").isNull() & F.concat_ws(":", "app", "action").isin(*C.RESET_TOKENS)
    marked = events.withColumn("resets", F.sum(reset.cast("int")).over(by_user)).where(~reset)
    before_end, before_session = F.lag(F.col("ts_ms") + F.col("duration_ms")).over(by_user), F.lag("session_id").over(by_user)
    cut = (
        before_end.isNull()
        | (F.col("ts_ms") - before_end > gap_ms)
        | F.coalesce(F.col("session_id") != before_session, F.lit(False))
        | (F.col("resets") != F.lag("resets").over(by_user))
    )
    numbered = marked.withColumn("cut", cut.cast("int")).withColumn("task", F.sum("cut").over(by_user))
    task = Window.partitionBy("user_id", "task")
    ordered = task.orderBy("ts_ms", "id")
    whole = numbered.withColumns({"pos": F.row_number().over(ordered), "first_id": F.min_by("id", F.struct("ts_ms", "id")).over(task), "n": F.count(F.lit(1)).over(task)})
    return whole.where(F.col("n") >= least).withColumn("instance_id", F.concat_ws("#", "user_id", F.col("first_id").cast("string"))).drop("resets", "cut", "task", "first_id", "n")


def switches(steps: DataFrame, window_ms: int = C.SWITCH_WINDOW_MS) -> DataFrame:
    """context_switches per instance: an application left and come back to within the window."""
    order = Window.partitionBy("instance_id").orderBy("pos")
    back = (F.lead("app", 2).over(order) == F.col("app")) & (F.lead("app", 1).over(order) != F.col("app")) & (F.lead("ts_ms", 2).over(order) - F.col("ts_ms") <= window_ms)
    return steps.withColumn("back", F.coalesce(back, F.lit(False)).cast("long")).groupBy("instance_id").agg(F.sum("back").alias("context_switches"))


def instances(steps: DataFrame) -> DataFrame:
    """One row per instance: times, duration, raw and collapsed signature, hash, events and switches."""
    order = Window.partitionBy("instance_id").orderBy("pos")
    back = (F.lead("app", 2).over(order) == F.col("app")) & (F.lead("app", 1).over(order) != F.col("app")) & (F.lead("ts_ms", 2).over(order) - F.col("ts_ms") <= C.SWITCH_WINDOW_MS)
    named = steps.withColumns({"token": step_token(), "back": F.coalesce(back, F.lit(False)).cast("long")})
    grouped = named.groupBy("instance_id", "user_id").agg(
        F.min("ts_ms").alias("started_ms"),
        F.max_by(F.col("ts_ms") + F.col("duration_ms"), "pos").alias("ended_ms"),
        F.sum("duration_ms").alias("busy_ms"),
        F.count(F.lit(1)).alias("n_events"),
        F.array_sort(F.collect_list(F.struct("pos", "id", "token"))).alias("steps"),
        F.sum("back").alias("context_switches"),
    )
    shaped = grouped.select(
        "instance_id",
        "user_id",
        "started_ms",
        "ended_ms",
        F.greatest(F.col("ended_ms") - F.col("started_ms"), F.col("busy_ms")).alias("duration_ms"),
        "n_events",
        F.transform("steps", lambda s: s["token"]).alias("raw_signature"),
        F.transform("steps", lambda s: s["id"]).alias("event_ids"),
        "context_switches",
    )
    return shaped.withColumn("signature", collapse(F.col("raw_signature"))).withColumn("signature_hash", signature_hash(F.col("signature")))
