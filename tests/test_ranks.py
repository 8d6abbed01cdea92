"""Medians and places against plain sorting, with groups that are refined and ones that are sorted."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import ranks


@pytest.mark.parametrize("few", [1, 5, 10_000])
@pytest.mark.parametrize("ranges", [3, 1024])
def test_medians(spark, monkeypatch, few, ranges):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "RANGES", ranges)
    rng = random.Random(few)
    rows = [("hot", "x", rng.randrange(-50, 10**9)) for _ in range(301)] + [("hot", None, 7)] * 40 + [(None, "x", v) for v in (5, 6)] + [("none", "y", None), ("one", "y", 3), ("ties", "y", 1), ("ties", "y", 1), ("ties", "y", 9), ("ties", "y", 9)]
    df = spark.createDataFrame(rows, "a string, b string, ms long")
    got = {(r["a"], r["b"]): r["m"] for r in ranks.medians(df, ["a", "b"], "ms", "m").collect()}
    groups = {}
    for a, b, v in rows:
        groups.setdefault((a, b), []).extend([] if v is None else [v])
    assert got == {k: statistics.median(v) if v else None for k, v in groups.items()}


def test_medians_of_nothing(spark):
    df = spark.createDataFrame([], "a string, ms long")
    assert ranks.medians(df, ["a"], "ms", "m").collect() == []


def test_places(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("k")).repartition(6)
    got = ranks.placed(df, "place", F.desc("k"), F.asc("id")).collect()
    expected = sorted(((r["k"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["place"])] == expected
    assert sorted(r["place"] for r in got) == list(range(1, 501))


def test_a_value_is_computed_once(spark):
    df = spark.createDataFrame([('{"a": "1"}',)], "value string").select(ranks.once(F.from_json("value", "map<string,string>")).alias("m"))
    plan = df.select(*(F.col("m")[k].alias(k) for k in "abcdefgh"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") <= 2
