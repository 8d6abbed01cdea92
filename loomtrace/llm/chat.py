"""Chat formatting with cumulative-snapshot collapse.

Loggers write a conversation again after every turn, so that many logged conversations are prefixes of
longer ones. Every turn gets a hash of its position, role and text; the running sum of these hashes
identifies the prefix up to that turn. Conversations whose last prefix is an inner prefix of another
one are removed by an anti-join, of equal ones the smallest conv_id stays, and what is left is
rendered. All steps are DataFrame functions; prefixes are made distinct before they are joined, so a
first turn that a third of all conversations share is one row of the join.

Defined results of the edge cases: turns are ordered by (turn, role, text) with nulls first, so ties
and repeated rows have one order; a null role renders and compares as ``user``, a null text as empty;
rows without conv_id are no conversation; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rendered format.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1..n), role, text, with nulls replaced."""
    clean = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return clean.withColumn("pos", F.row_number().over(order))


def _running(column: Column) -> Column:
    window = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(column.cast("decimal(20,0)")).over(window)


def prefixes(numbered: DataFrame) -> DataFrame:
    """conv_id, pos, and two sums that identify the prefix of the conversation up to ``pos``."""
    last = Window.partitionBy("conv_id")
    return numbered.select(
        "conv_id",
        "pos",
        F.count(F.lit(1)).over(last).alias("n_turns"),
        _running(F.xxhash64(F.lit("a"), "pos", "role", "text")).alias("sum_a"),
        _running(F.xxhash64("text", "role", "pos", F.lit("b"))).alias("sum_b"),
    )


def maximal(numbered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of the conversations that are no proper prefix of another one."""
    every = prefixes(numbered)
    key = ["pos", "sum_a", "sum_b"]
    whole = every.where("pos = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = every.where("pos < n_turns").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of every maximal conversation."""
    numbered = turns(conversations)
    kept = maximal(numbered)
    line = F.concat(F.lit(TURN_START), "role", F.lit("\n"), "text", F.lit(TURN_END))
    # only what is left is rendered: snapshots repeat a conversation's text once for every turn
    lines = numbered.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return lines.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
