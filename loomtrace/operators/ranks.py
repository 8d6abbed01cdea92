"""Exact medians and places in an order, for groups and tables of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.sources.shared import written

#: Ranges that the values of a group are counted in at a time, and rows that are broadcast at most.
RANGES = 1024
SENT = 1_000_000
#: A range of at most so many rows is sorted in one task.
FEW = 10_000


def once(value: Column) -> Column:
    """``explode`` of one value: later expressions read the result instead of computing the value again each."""
    return F.explode(F.array(value))


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def _same(by: list[str], suffix: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}{suffix}")) for c in by))


def medians(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by..., name): the exact median (a double) of the whole numbers of each group; null for groups without any.

    Values of a group are counted by ranges of equal width; the one that holds the middle rank is counted
    by finer ranges, until it holds few rows or a single value. Counts are added up before they are
    shuffled, so a task holds at most ``RANGES`` counts or ``FEW`` rows of a group, however many it has.
    """
    own = written(rows.select(*by, F.col(value).cast("long").alias("v")), "values")
    groups = own.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    asks = written(groups.select(*by, F.explode_outer(F.when(F.col("n") > 0, ranks)).alias("rank"), "low", "high", "n"), "asks")
    renamed = [F.col(c).alias(f"{c}_") for c in by]

    def inside(ranges: DataFrame) -> DataFrame:
        wide = ranges.select(*renamed, "low", "high").distinct()
        return own.join(_sent(wide), _same(by, "_") & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))

    many = (F.col("low") < F.col("high")) & (F.col("n") > FEW)
    while not asks.where(many).isEmpty():
        width = F.call_function("div", F.col("high") - F.col("low"), F.lit(RANGES)) + 1
        counts = inside(asks.where(many)).groupBy(*by, "low", "high", F.call_function("div", F.col("v") - F.col("low"), width).alias("bin")).agg(F.count(F.lit(1)).alias("held"))
        below = Window.partitionBy(*by, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        ranged = counts.select(*renamed, F.col("low").alias("low_"), F.col("high").alias("high_"), "bin", "held", F.coalesce(F.sum("held").over(below), F.lit(0)).alias("before"))
        holds = _same([*by, "low", "high"], "_") & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("held"))
        first = F.col("low") + F.col("bin") * width
        found = asks.where(many).join(ranged, holds).select(*by, (F.col("rank") - F.col("before")).alias("rank"), first.alias("low"), F.least(first + width - 1, "high").alias("high"), F.col("held").alias("n"))
        asks = written(found.unionByName(asks.where(~F.coalesce(many, F.lit(False)))), "asks")

    # what is left is one value, or a range of few rows, which are sorted
    some = asks.where("low < high")
    order = Window.partitionBy(*by, "low", "high").orderBy("v")
    sorted_ = inside(some).select(*renamed, F.col("low").alias("low_"), F.col("high").alias("high_"), "v", (F.row_number().over(order) - 1).alias("place"))
    picked = some.join(sorted_, _same([*by, "low", "high"], "_") & (F.col("rank") == F.col("place"))).select(*by, F.col("v").alias("low"))
    alone = asks.where("low is null or low = high").select(*by, "low")
    return picked.unionByName(alone).groupBy(*by).agg(F.avg("low").alias(name))


def placed(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``rows`` with their place from 1 in an order that leaves no ties: sorted by ranges, then counted on from range to range."""
    number = F.monotonically_increasing_id()
    own = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(number, 33).alias("part_"), number.bitwiseAND((1 << 33) - 1).alias("nth_")), "placed")
    # one row for each partition
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy("part_").agg(F.count(F.lit(1)).alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    return own.join(F.broadcast(starts), "part_").withColumn(name, (F.col("start_") + F.col("nth_") + 1).cast("int")).drop("part_", "nth_", "start_")
