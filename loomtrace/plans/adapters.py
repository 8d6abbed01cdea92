"""Views of the test tables as activity logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str, variety: bool = False) -> DataFrame:
    """``events`` as canonical events; ``variety`` gives three object types instead of one."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u_"), F.col("user_id").cast("string")).alias("user_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.when(kind == "click", "sheets").when(kind == "view", "gmail").when(kind == "purchase", "erp").when(kind == "signup", "crm").otherwise("slack").alias("app"),
        F.when(kind == "click", "update").when(kind.isin("view", "error"), "read").otherwise("create").alias("action"),
        (F.concat(F.lit("k"), (k % 3).cast("string")) if variety else F.lit("item")).alias("object_type"),
        F.floor(F.col("value") * 1000).cast("long").alias("duration_ms"),
        F.lit(None).cast("string").alias("session_id"),
        k.alias("k"),
        F.col("value"),
        "event_type",
    )


#: Where the log renames some fields, in milliseconds.
RENAMED_MS = 1705276800000


def payloads(log: DataFrame) -> DataFrame:
    """``activity`` with a payload of JSON literals; some fields change their name in the course of the log."""
    late = F.col("ts_ms") >= RENAMED_MS
    named = {
        "k": (F.when(late & (F.col("app") == "gmail"), "item k").otherwise("k"), F.col("k").cast("string")),
        "amount": (F.lit("amount"), F.when(F.col("app").isin("erp", "sheets"), F.round(F.col("value") * 10_000).cast("long").cast("string"))),
        "status": (F.when(late & (F.col("app") == "crm"), "state").otherwise("status"), F.concat(F.lit('"'), "event_type", F.lit('"'))),
        "vendor": (F.when(late, "Supplier Name").otherwise("Vendor"), F.when(F.col("app").isin("erp", "crm"), F.concat(F.lit('"v'), (F.col("k") % 5).cast("string"), F.lit('"')))),
        "note": (F.lit("remark"), F.when(F.col("k") % 7 == 0, F.concat(F.lit('"case '), F.col("id").cast("string"), F.lit(' waits for a word of the person who owns it"')))),
    }
    entries = F.filter(F.array(*(F.struct(k.alias("key"), v.alias("value")) for k, v in named.values())), lambda e: e["value"].isNotNull())
    return log.withColumn("payload", F.map_from_entries(entries))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as declared sessions."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        (conv * 1000 + turn).alias("id"),
        F.concat(F.lit("c"), (conv % 7).cast("string")).alias("user_id"),
        (F.lit(1704067200000) + conv * 86_400_000 + turn * 60_000).alias("ts_ms"),
        F.lit("chat").alias("app"),
        F.col("role").alias("action"),
        F.lit("turn").alias("object_type"),
        F.lit(0).cast("long").alias("duration_ms"),
        conv.cast("string").alias("session_id"),
        "text",
    )


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as instances and their lines as steps, in line order; orders of one line are none."""
    lines = table(spark, sf_dir, "lineitem")
    heads = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    many = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("l_orderkey")
    return lines.join(many, "l_orderkey").join(heads, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("instance_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_returnflag").alias("token"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts_ms"),
        (F.floor(F.col("l_quantity")) * 60_000).cast("long").alias("duration_ms"),
        "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_partkey", "o_orderpriority", "l_shipdate",
    )
