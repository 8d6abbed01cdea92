"""Tables that jobs of this engine write between their steps, in the folder the session names for it."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set as checkpoint folder.

    If neither is set, a session on one machine uses a folder below the working directory; others raise, because
    executors would write where nobody else reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + os.path.abspath("spark-warehouse/checkpoints"))
    return shared_dir(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that goes when the application ends."""
    path = f"{shared_dir(spark)}/loomtrace-{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: cuts the lineage at something that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
