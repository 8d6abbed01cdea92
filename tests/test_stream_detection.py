"""Detection along a stream equals detection over all events so far, also when a batch is delivered again."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.operators.sessions import sessionise
from loomtrace.plans.adapters import activity
from loomtrace.plans.detection import GAP_MS, detect
from loomtrace.sources.shared import new_path
from loomtrace.streaming.detection import Detector
from tests.tables import SF_DIR, rows_of


def test_findings_follow_the_stream(spark):
    events = activity(spark, SF_DIR).where("user_id < 'u_3'").cache()
    kept = Detector(new_path(spark, "detector"), GAP_MS, buckets=8)
    some = F.pmod(F.xxhash64("id"), F.lit(40))
    cuts = [some == 0, (some > 0) & (some < 25), some >= 25]
    few = events.where(cuts[0]).limit(12).cache()
    rest = events.where(cuts[0]).join(few.select("id"), "id", "left_anti").select(*events.columns).unionByName(events.where(cuts[1])).cache()
    kept.take(few, 0)
    assert not kept._exists(spark, "findings")  # fewer than thirty
    columns = None
    for batch_id, batch in ((1, rest), (1, rest), (2, events.where(cuts[2])), (2, events.where(cuts[2]))):
        kept.take(batch, batch_id)
        so_far = few.unionByName(rest) if batch_id == 1 else events
        expected = detect(so_far, GAP_MS)
        columns = expected.columns
        found = kept.found(spark)
        assert {r["batch"] for r in found.select("batch").collect()} <= {batch_id}
        assert rows_of(columns, found.select(*columns).collect()) == rows_of(columns, expected.collect())
    assert kept.counts(spark).agg(F.sum("n")).first()[0] == events.count()
    kept.take(events.limit(0), 3)
    assert kept.found(spark).select("batch").distinct().count() <= 1


def test_a_batch_writes_its_steps_once(spark, monkeypatch):
    """No copies beside the table, and of a bucket only what its newest batch cut, even if that is nothing."""
    from loomtrace.sources import shared

    named = []
    plain = shared.new_path
    monkeypatch.setattr(shared, "new_path", lambda session, name: named.append(name) or plain(session, name))
    two = activity(spark, SF_DIR).orderBy("id").limit(2)
    minute = F.lit(60_000).cast("long") * (F.row_number().over(Window.orderBy("id")) - 1)
    first = two.withColumns({"user_id": F.lit("u_1"), "ts_ms": minute, "app": F.lit("gmail"), "action": F.lit("read"), "duration_ms": F.lit(0).cast("long")}).cache()
    other = activity(spark, SF_DIR).where("user_id = 'u_2'").cache()
    kept = Detector(new_path(spark, "detector"), GAP_MS, least_new=1 << 40, buckets=1 << 20)
    kept.take(first.unionByName(other), 0)
    assert kept.steps(spark).where("user_id = 'u_1'").count() == 2
    app, action = C.RESET_TOKENS[0].split(":")
    # a late reset between the two leaves them alone
    late = first.limit(1).withColumns({"id": F.lit(-1).cast("long"), "ts_ms": F.lit(30_000).cast("long"), "app": F.lit(app), "action": F.lit(action)})
    kept.take(late, 1)
    assert kept.steps(spark).where("user_id = 'u_1'").isEmpty()
    assert rows_of(["instance_id", "pos", "id"], kept.steps(spark).select("instance_id", "pos", "id").collect()) == rows_of(["instance_id", "pos", "id"], sessionise(other, GAP_MS).select("instance_id", "pos", "id").collect())
    assert {b for b, _ in kept._folders(spark, "steps")} == {0} and len(kept._folders(spark, "steps")) == 1
    assert not named
