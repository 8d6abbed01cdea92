"""Structured Streaming over the event log: micro-batches, sessions, transfers, idempotent imports, counters.

Every operator turns a stream into a stream; ``drained`` runs one over what a folder holds and returns the
table it wrote. Watermarks bound all state: a session is given out once the watermark has passed its
end, a copy is kept for the transfer window, a key of an import for the time within which it can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from loomtrace.sources.shared import new_path

#: A collector's flush: how often a batch is due, and how many files it takes at most.
FLUSH, FILES = "20 seconds", 200


def signals(spark: SparkSession, folder: str, schema: StructType, files: int = FILES) -> DataFrame:
    """The files of a folder as a stream, so many a micro-batch; new files are picked up as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def flushed(stream: DataFrame, path: str, checkpoint: str, every: str = FLUSH) -> StreamingQuery:
    """Appends the stream to a table at the collector's pace, exactly once by its checkpoint."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime=every).start(path)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that the stream gives for the files that are there now, as a table."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    query = writer.option("checkpointLocation", new_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Activity of each user without an idle gap, whatever batch its events came in; declared sessions stay apart."""
    marked = events.withWatermark("ts", late)
    grouped = marked.groupBy("user_id", F.coalesce("session_id", F.lit("")).alias("session_id"), F.session_window("ts", gap).alias("w"))
    sums = grouped.agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return sums.select("user_id", "session_id", "started", "ended", "n_events")


def transfers(events: DataFrame, keys: list[str], window: str, late: str) -> DataFrame:
    """Pairs of a copy and a paste of the same key at most ``window`` apart, in event time, however late they arrive.

    ``last_copies`` picks the copy of each paste.
    """
    copies = events.where("is_copy").select(*(F.col(k).alias(f"copy_{k}") for k in keys), F.col("id").alias("copy_id"), F.col("app").alias("from_app"), F.col("ts").alias("copied")).withWatermark("copied", late)
    pastes = events.where("is_paste").select(*keys, F.col("id").alias("paste_id"), F.col("app").alias("to_app"), F.col("ts").alias("pasted")).withWatermark("pasted", late)
    same = F.expr(f"pasted >= copied and pasted <= copied + interval {window}")
    for k in keys:
        same = same & (F.col(k) == F.col(f"copy_{k}"))
    return pastes.join(copies, same).select(*keys, "paste_id", "to_app", "pasted", "copy_id", "from_app", "copied")


def last_copies(pairs: DataFrame) -> DataFrame:
    """The latest copy of each paste; rejected afterwards if both are of one application."""
    best = pairs.groupBy("paste_id").agg(F.max_by(F.struct("copy_id", "from_app", "to_app", "copied", "pasted"), F.struct("copied", "copy_id")).alias("b"))
    return best.select("paste_id", "b.*").where("from_app <> to_app")


def once(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first of rows with the same key within the watermark: a sync that runs again adds nothing."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def high_water(events: DataFrame) -> DataFrame:
    """Latest time and number of events by application, as running totals."""
    return events.groupBy("app").agg(F.max("ts").alias("high_water"), F.count(F.lit(1)).alias("n"))


def since(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Events later than their application's mark (app, high_water); all of an application without one."""
    return events.join(F.broadcast(marks.select("app", "high_water")), "app", "left").where("high_water is null or ts > high_water").drop("high_water")
