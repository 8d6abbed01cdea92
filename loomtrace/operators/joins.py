"""Joins of the workflow engine: transfers, idempotent imports, relinking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace import constants as C


def transfer_links(events: DataFrame, keys: list[str], window_ms: int = C.TRANSFER_WINDOW_MS) -> DataFrame:
    """Pastes with the latest copy of the same key before them; rejected afterwards if of the same app or too old.

    ``events`` has ``is_copy`` and ``is_paste``. One window over the union of both sides replaces an
    as-of join: one shuffle by key, no pairs.
    """
    order = Window.partitionBy(*keys).orderBy("ts_ms", F.desc("is_copy"), "id").rowsBetween(Window.unboundedPreceding, 0)
    copy = F.when(F.col("is_copy"), F.struct("id", "app", "ts_ms"))
    linked = events.where("is_copy or is_paste").withColumn("copy", F.last(copy, ignorenulls=True).over(order))
    found = linked.where("is_paste and copy is not null").where((F.col("copy.app") != F.col("app")) & (F.col("ts_ms") - F.col("copy.ts_ms") <= window_ms))
    return found.select(F.col("id").alias("paste_id"), F.col("copy.id").alias("copy_id"), F.col("copy.app").alias("from_app"), F.col("app").alias("to_app"), (F.col("ts_ms") - F.col("copy.ts_ms")).alias("after_ms"))


def new_rows(incoming: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key is neither present nor earlier in the batch."""
    first = Window.partitionBy(*keys).orderBy("id")
    once = incoming.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return once.join(present.select(*keys).distinct(), keys, "left_anti")


def relink(orphans: DataFrame, clusters: DataFrame) -> DataFrame:
    """Best cluster of each orphan by number of common tokens; the most important cluster if none has any.

    Orphans (automation_id, tokens) and clusters (cluster_id, tokens, priority) meet on exploded tokens,
    so only pairs with a common token exist.
    """
    shared = orphans.select("automation_id", F.explode(F.array_distinct("tokens")).alias("token")).join(clusters.select("cluster_id", F.explode(F.array_distinct("tokens")).alias("token")), "token")
    best = shared.groupBy("automation_id", "cluster_id").agg(F.count(F.lit(1)).alias("overlap")).groupBy("automation_id").agg(F.min_by(F.struct("cluster_id", "overlap"), F.struct(-F.col("overlap"), F.col("cluster_id"))).alias("b"))
    top = clusters.agg(F.min_by("cluster_id", F.struct(-F.col("priority"), F.col("cluster_id"))).alias("fallback"))
    return orphans.select("automation_id").join(best, "automation_id", "left").crossJoin(F.broadcast(top)).select("automation_id", F.coalesce("b.cluster_id", "fallback").alias("cluster_id"), F.coalesce("b.overlap", F.lit(0)).cast("long").alias("overlap"))
