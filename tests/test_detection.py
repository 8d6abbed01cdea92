"""Detection from events to findings, and the flagship entry."""

from pyspark.sql import functions as F

import __spark_entry__

from loomtrace.plans.detection import detect

STEPS = [("gmail", "read", "email"), ("erp", "create", "invoice"), ("sheets", "update", "row")]


def test_entry_returns_findings(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_repeated_tasks_are_one_finding(spark):
    rows, n = [], 0
    for run in range(6):
        for at, (app, action, kind) in enumerate(STEPS):
            rows.append((n, f"u{run % 2}", (run * 86_400 + at * 60) * 1000, app, action, kind, 1000, None, run))
            n += 1
    rows.append((n, "u9", 0, "gmail", "read", "email", 1000, None, 1))
    events = spark.createDataFrame(rows, "id long, user_id string, ts_ms long, app string, action string, object_type string, duration_ms long, session_id string, k long")
    (found,) = detect(events).collect()
    assert found["signature"] == [":".join(s) for s in STEPS]
    assert (found["n_instances"], found["n_variants"], found["users"], found["similarity"], found["entropy"]) == (6, 1, 2, 1.0, 0.0)
    assert found["n_variables"] == 3 and found["branches"] == 0
    assert (found["name"], found["judgement"], found["reasoning"]) == ("Email to row", 0.0, "the steps repeat consistently")
    assert found["description"] == "3 steps across gmail → erp → sheets. Observed 6 times by 2 employee(s)."
    long = F.when(F.col("app") == "gmail", F.lit('"' + "why this one is different " * 4 + '"')).otherwise('"short"')
    (judged,) = detect(events.withColumn("payload", F.create_map(F.lit("note"), long))).collect()
    assert abs(judged["judgement"] - 1.4 / 3) < 1e-9 and judged["reasoning"] == "the steps repeat consistently"
    assert judged["automatability"] < found["automatability"] and judged["potential"] < found["potential"]
