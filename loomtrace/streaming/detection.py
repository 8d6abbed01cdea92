"""Detection that follows arriving events: only what they touch is cut into tasks again, and findings follow enough new events.

Tables of a detector (one folder for one stream):

* ``log/batch=.../bucket=...``: events as they came, in a folder for each batch; users are dealt to buckets.
* ``steps/batch=.../bucket=...``: the steps of all instances of the buckets that a batch touched, written once. Those of a
  bucket's newest batch count; older ones go once the newer batch is through.
* ``counts/batch=...``: number of new events of a batch.
* ``findings/batch=...``: findings after the batches that completed ``LEAST_NEW`` new events.

A batch writes the same folders whenever it is delivered, so one that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from loomtrace import constants as C
from loomtrace.operators.sessions import sessionise
from loomtrace.plans.detection import findings
from loomtrace.sources.shared import new_path

#: New events after which detection runs, and parts that users are dealt to (the driver knows which parts a batch touches).
LEAST_NEW = 30
BUCKETS = 256


def _with(schema: StructType, **more: DataType) -> StructType:
    return StructType([*schema.fields, *(StructField(n, t) for n, t in more.items())])


class Detector:
    """Keeps steps and findings of a stream of canonical events below ``folder``."""

    def __init__(self, folder: str, gap_ms: int = C.SESSION_GAP_MS, least_new: int = LEAST_NEW, buckets: int = BUCKETS):
        self.folder, self.gap_ms, self.least_new, self.buckets = folder, gap_ms, least_new, buckets

    def _exists(self, spark: SparkSession, name: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")

    def _folders(self, spark: SparkSession, name: str) -> set[tuple[int, int]]:
        """(batch, bucket) of the folders of a table."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/batch=*/bucket=*")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return {tuple(int(part.split("=")[1]) for part in str(f.getPath()).rsplit("/", 2)[1:]) for f in found}

    def _versions(self, spark: SparkSession) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Folders of ``steps`` that count, and those that a newer batch replaced, maybe by no instance at all."""
        came, cut = self._folders(spark, "log"), self._folders(spark, "steps")
        whole = {batch for batch in {b for b, _ in came} if self._exists(spark, f"steps/batch={batch}/_SUCCESS")}
        newest: dict[int, int] = {}
        for batch, bucket in came:
            if batch in whole:
                newest[bucket] = max(batch, newest.get(bucket, batch))
        return sorted(x for x in cut if x[0] == newest.get(x[1])), sorted(x for x in cut if x[0] < newest.get(x[1], -1))

    def steps(self, spark: SparkSession) -> DataFrame:
        paths = [f"{self.folder}/steps/batch={b}/bucket={k}" for b, k in self._versions(spark)[0]]
        return spark.read.option("basePath", f"{self.folder}/steps").parquet(*paths).drop("batch", "bucket")

    def counts(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "counts")

    def found(self, spark: SparkSession) -> DataFrame:
        """The newest findings, with the ``batch`` they are of; there are some once ``least_new`` events have come."""
        every = self._table(spark, "findings")
        return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0])

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: ``foreachBatch`` calls this."""
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")
        came = f"{self.folder}/log/batch={batch_id}"
        # few files of a bucket, and more of one that has many rows
        batch.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(came)
        sizes = spark.read.schema(_with(batch.schema, bucket=IntegerType())).parquet(came).groupBy("bucket").count().collect()
        new = sum(r["count"] for r in sizes)
        spark.createDataFrame([(new,)], StructType().add("n", LongType())).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counts/batch={batch_id}")
        if not new:
            return
        schema = _with(batch.schema, batch=LongType(), bucket=IntegerType())
        touched = spark.read.schema(schema).parquet(f"{self.folder}/log").where(F.col("bucket").isin([r["bucket"] for r in sizes]))
        # written once: a batch has folders of its own, so what it reads and what findings are made of is not replaced under them
        sessionise(touched.drop("batch"), self.gap_ms).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/steps/batch={batch_id}")
        valid, replaced = self._versions(spark)
        if valid and self._due(spark, batch_id):
            findings(self.steps(spark)).write.mode("overwrite").parquet(f"{self.folder}/findings/batch={batch_id}")
        for batch, bucket in replaced:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/steps/batch={batch}/bucket={bucket}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _due(self, spark: SparkSession, batch_id: int) -> bool:
        """Whether enough events came since the last findings before this batch, by folders alone: a batch that comes again decides alike."""
        last = -1
        if self._exists(spark, "findings"):
            last = self._table(spark, "findings").where(F.col("batch") < batch_id).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
        new = self.counts(spark).where((F.col("batch") > last) & (F.col("batch") <= batch_id)).agg(F.sum("n")).first()[0]
        return (new or 0) >= self.least_new

    def run(self, events: DataFrame, checkpoint: str | None = None) -> None:
        """All events that the stream has now, in its micro-batches."""
        state = checkpoint or new_path(events.sparkSession, "detector-state")
        events.writeStream.foreachBatch(self.take).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
