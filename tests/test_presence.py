"""Presence of fields from one row of each instance."""

from pyspark.sql import functions as F

from loomtrace.operators import scoring


def test_presence_counts_instances_once(spark):
    rows = [("c", "i", "t", ["a", "b"]), ("c", "i", "t", ["b", "d"]), ("c", "i", "u", ["a"]), ("c", "j", "t", ["b"]), ("d", "j", "t", ["b"]), ("c", "k", "t", []), ("c", "l", None, ["a"])]
    steps = spark.createDataFrame(rows, "cluster_id string, instance_id string, token string, keys array<string>")
    got = scoring.presence(steps)
    assert {(r["cluster_id"], r["token"], r["key"]): r["present"] for r in got.collect()} == {("c", "t", "a"): 1, ("c", "t", "b"): 2, ("c", "t", "d"): 1, ("c", "u", "a"): 1, ("d", "t", "b"): 1, ("c", None, "a"): 1}
    observed = steps.select("cluster_id", "instance_id", "token", F.explode("keys").alias("key"), F.lit("x").alias("value"))
    runs = spark.createDataFrame([("c", 4), ("d", 1)], "cluster_id string, runs long")
    assert sorted(scoring.variables_and_constants(observed, runs, present=got).collect()) == sorted(scoring.variables_and_constants(observed, runs).collect())
