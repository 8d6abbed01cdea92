"""The set of clusters and instances that detection found last, replaced as a whole.

A set is written in folders of its own; then a version that names them is added. Readers take the newest
version, so they see the old set or the new one, never parts of both, and a job that dies in between leaves
the old one. A cluster is known by the hash of its signature; flags that people set on one are carried
over as long as it is found again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version long, clusters string, instances string"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All versions of the store; none before the first set."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], VERSION)
    return spark.read.schema(VERSION).parquet(f"{root}/versions")


def current(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The ``clusters`` or ``instances`` of the newest version."""
    last = versions(spark, root).orderBy(F.desc("version"), "clusters").select(name).first()
    return spark.read.parquet(last[0]) if last else None


def _added(spark: SparkSession, root: str, clusters: str, instances: str) -> None:
    last = versions(spark, root).agg(F.max("version")).first()[0] or 0
    spark.createDataFrame([(last + 1, clusters, instances)], VERSION).coalesce(1).write.mode("append").parquet(f"{root}/versions")


def _written(df: DataFrame, root: str, name: str) -> str:
    path = f"{root}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def replace(root: str, clusters: DataFrame, instances: DataFrame) -> None:
    """Replaces the set by clusters (cluster_id, ...) and instances (instance_id, cluster_id, ...); ``dismissed`` is carried over."""
    spark = clusters.sparkSession
    before = current(spark, root, "clusters")
    flagged = clusters.select("cluster_id").limit(0) if before is None else before.where("dismissed").select("cluster_id").distinct()
    carried = clusters.drop("dismissed").join(flagged.withColumn("dismissed", F.lit(True)), "cluster_id", "left").withColumn("dismissed", F.coalesce("dismissed", F.lit(False)))
    kept = instances.join(clusters.select("cluster_id").distinct(), "cluster_id", "left_semi")
    _added(spark, root, _written(carried, root, "clusters"), _written(kept, root, "instances"))


def dismiss(root: str, ids: DataFrame, dismissed: bool = True) -> None:
    """Sets the flag of clusters (cluster_id): a version with the same instances."""
    spark = ids.sparkSession
    last = versions(spark, root).orderBy(F.desc("version"), "clusters").first()
    chosen = ids.select("cluster_id").distinct().withColumn("chosen", F.lit(dismissed))
    flagged = spark.read.parquet(last["clusters"]).join(chosen, "cluster_id", "left").withColumn("dismissed", F.coalesce("chosen", "dismissed")).drop("chosen")
    _added(spark, root, _written(flagged, root, "clusters"), last["instances"])
