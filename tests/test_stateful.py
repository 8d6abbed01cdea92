"""State machines of streams against their batch operators, however events are cut into batches."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import governance as G
from loomtrace.operators.sessions import sessionise
from loomtrace.sources.shared import new_path
from loomtrace.streaming import flows as S
from loomtrace.streaming import stateful as T
from tests.tables import rows_of

EVENT = "user_id string, ts timestamp, ts_ms long, id long, app string, action string, object_type string, duration_ms long, session_id string"


def events(spark, seed, n=160):
    rng, rows = random.Random(seed), []
    at = 1_700_000_000_000
    for i in range(n):
        at += rng.choice([0, 1_000, 60_000, 3_000_000])
        app, action = rng.choice([("crm", "read"), ("slack", "read"), ("browser", "navigate"), ("erp", "create")])
        rows.append((f"u{rng.randrange(3)}", at, i, app, action, "item", rng.choice([0, 5_000, 900_000]), rng.choice([None, None, "a", "b"])))
    df = spark.createDataFrame(rows, "user_id string, ts_ms long, id long, app string, action string, object_type string, duration_ms long, session_id string")
    return df.withColumn("ts", F.timestamp_millis("ts_ms")).select(*(c.split()[0] for c in EVENT.split(", ")))


def stream_of(spark, batches, schema):
    folder = new_path(spark, "batches")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(folder)
    return S.signals(spark, folder, schema, 1)


def tick(df, ts):
    return df.limit(1).withColumns({"user_id": F.lit("nobody"), "ts": F.lit(ts).cast("timestamp"), "ts_ms": F.lit(0).cast("long")})


@pytest.mark.parametrize("parts", [1, 4])
def test_sessions_by_all_rules(spark, parts):
    df = events(spark, parts).cache()
    cuts = [df.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k) for k in range(parts)]
    stream = stream_of(spark, [*cuts, tick(df, "2030-01-01")], df.schema)
    got = T.drained(T.sessionised(stream, "300 days", 1_800_000), "steps").where("user_id <> 'nobody'")
    columns = ["instance_id", "user_id", "pos", "id", "ts_ms"]
    expected = sessionise(df, 1_800_000).select(*columns)
    assert rows_of(columns, got.select(*columns).collect()) == rows_of(columns, expected.collect())


def test_sessions_whose_batches_close_one_after_another(spark):
    """Batches in order with a short lateness: state is carried over closed parts."""
    df = events(spark, 9).cache()
    cuts = [df.where((F.col("id") >= 40 * k) & (F.col("id") < 40 * k + 40)) for k in range(4)]
    stream = stream_of(spark, [*cuts, tick(df, "2030-01-01")], df.schema)
    got = T.drained(T.sessionised(stream, "1 second", 1_800_000), "steps").where("user_id <> 'nobody'")
    columns = ["instance_id", "user_id", "pos", "id", "ts_ms"]
    assert rows_of(columns, got.select(*columns).collect()) == rows_of(columns, sessionise(df, 1_800_000).select(*columns).collect())


def test_rows_of_a_batch_wait_as_one_value():
    """Each call of the state store is a round trip to the JVM, and each value of a list is encoded on its own."""
    from types import SimpleNamespace

    class Listed(list):
        def appendValue(self, value):
            self.append(value)

        def get(self):
            return iter(self)

        def put(self, values):
            self[:] = values

    class Taken(T.Ordered):
        WAITING = "ts_ms long, id long"

        def take(self, key, ready):
            yield from ready

    machine, waiting, timers = Taken(), Listed(), []
    machine.init(SimpleNamespace(getListState=lambda name, schema: waiting, registerTimer=timers.append))
    for batch in ([(5, 1), (3, 2), (9, 3)], [(4, None), (3, 0)]):
        list(machine.handleInputRows(("u",), [{"ts_ms": t, "id": i} for t, i in batch], None))
    assert len(waiting) == 2 and timers == [9, 4]
    assert list(machine.handleExpiredTimer(("u",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 5), None)) == [(3, 0), (3, 2), (4, None), (5, 1)]
    assert len(waiting) == 1 and machine.still_waiting() == [(9, 3)]


def test_feed_speaks_on_change_only(spark):
    schema = "automation_id string, trust_level string, sequence long, score double, critical boolean"
    batches = [[(7, 0.9, False), (3, 1.0, False)], [(1, 1.0, False), (2, 1.0, False), (4, 1.0, False)], [(0, 0.1, True)], [(8, 1.0, True)], [(8, 1.0, True)]]
    runs = [spark.createDataFrame([("a", "ASSIST", *r) for r in b], schema) for b in batches]
    feed = T.drained(T.trust_feed(stream_of(spark, runs, runs[0].schema)), "feed")
    rows = sorted(feed.collect(), key=lambda r: r["version"])
    # the old run 0 is below the newest five and the run that comes twice is one: neither says anything new
    assert [(r["version"], r["n"], r["can_promote"], r["enforced_level"]) for r in rows] == [(1, 2, False, "ASSIST"), (2, 5, True, "ASSIST"), (3, 5, False, "SHADOW")]
    every = runs[0].unionByName(runs[1]).unionByName(runs[2]).unionByName(runs[3])
    (batch,) = G.trust_state(every, spark.createDataFrame([("a", "ASSIST")], "automation_id string, trust_level string")).collect()
    assert T.latest(feed).collect()[0].asDict() == batch.asDict()


def test_ladder_remembers_its_level(spark):
    schema = "automation_id string, trust_level string, ts timestamp, sequence long, critical boolean"
    runs = spark.range(12).select(F.lit("a").alias("automation_id"), F.lit("ASSIST").alias("trust_level"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("sequence"), F.col("id").isin(2, 9).alias("critical"))
    last = spark.createDataFrame([("z", "OBSERVE", None, 0, False)], schema).withColumn("ts", F.lit("2031-01-01").cast("timestamp"))
    cuts = [runs.where("sequence < 4"), runs.where("sequence between 4 and 7"), runs.where("sequence > 7"), last]
    got = T.drained(T.enforced(stream_of(spark, cuts, runs.schema), "1 second"), "ladder").orderBy("sequence").collect()
    assert [(r["sequence"], r["trust_level"]) for r in got] == [(2, "SHADOW"), (3, "SUGGEST"), (4, "OBSERVE")]


def test_ladder_runs_that_can_change_nothing_do_not_wait(spark):
    """Of a part's runs those up to the last rung's critical one go on, and the newest; an automation without a critical run sends all."""
    day = 1_704_067_200
    runs = [("a", "AUTONOMOUS", day + k, k, k % 10 == 5) for k in range(2000)] + [("b", "ASSIST", day + k, k, None) for k in range(30)]
    frame = spark.createDataFrame(runs, "automation_id string, trust_level string, at long, sequence long, critical boolean").coalesce(1)
    rows = frame.select("automation_id", "trust_level", F.timestamp_seconds("at").alias("ts"), (F.col("at") * 1000).alias("ts_ms"), "sequence", "critical")
    kept = T.decisive_of_part(rows).collect()
    assert sorted(r["sequence"] for r in kept if r["automation_id"] == "a") == [*range(36), 1999]
    assert sorted(r["sequence"] for r in kept if r["automation_id"] == "b") == list(range(30))
