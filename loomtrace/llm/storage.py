"""Where the operators of this subpackage keep intermediate tables.

A cluster names a folder that driver and executors share in ``spark.checkpoint.dir``. Only when that
setting is absent, a session on one machine (tests) uses a folder below the working directory; others raise.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids are broadcast to filter a table up to this many (some 16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; sets one only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + os.path.abspath("spark-warehouse/checkpoints")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage at a durable table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomtrace-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # results that read the table are lazy: it goes when the application ends
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of Parquet files with nothing but projections on it, so that a row's file and place are known."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() == "Project":
        plan = plan.children().apply(0)
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().lower()


#: Bits of a row number for the place in a file, and for the file; hashes of file names that are tried.
PLACE_BITS, FILE_BITS, SEEDS = 32, 31, 8


def file_number(path: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), path).bitwiseAND((1 << FILE_BITS) - 1)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row in the column ``name``, the same whenever and wherever it is read.

    Rows of a Parquet scan are numbered by their file's name and their place in it, whatever the splits, and
    need no copy. Names are hashed with a seed that keeps all files of this scan apart. Where no seed does
    (many files), and for rows of any other plan, the rows are written with their numbers: a shuffle or a
    scan that runs again may deal them out otherwise.
    """
    if is_scan(df):
        path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        files = df.select(path.alias("path")).distinct()
        told = files.agg(F.count("*"), *(F.count_distinct(file_number(F.col("path"), k)) for k in range(SEEDS))).first()
        seed = next((k for k in range(SEEDS) if told[k + 1] == told[0]), None)
        if seed is not None:
            number = F.shiftleft(file_number(path, seed), PLACE_BITS) + place
            return df.select("*", number.alias(name))
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


#: Estimates above this are those of plans whose size the optimizer doesn't know.
UNKNOWN_BYTES = 1 << 50


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """Size of the files behind ``df`` as the optimizer sees it, used to choose numbers of partitions.

    Where it sees no files (rows from the driver or an RDD), the bytes of the column ``text`` are summed.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else int(df.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def small(df: DataFrame, rows: int = BROADCAST_IDS) -> DataFrame:
    """``df``, marked for a broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def filter_ids(documents: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Documents whose doc_id is (``left_anti``: is not) in ``ids``, by broadcast only up to a checked size."""
    return documents.join(small(ids), "doc_id", how)
