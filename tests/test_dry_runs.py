"""Dry runs, ranges of days, patch proposals and names on small cases."""

from loomtrace.operators import governance as G
from loomtrace.operators import replay as R

FLOW = "automation_id string, pos int, step_id string, connector string, type string, outputs array<string>, depends_on array<string>, irreversible boolean"
STEP = "instance_id string, pos int, token string, object_type string, payload map<string,string>"


def dry(spark, flow, guard, steps, cases=(("f", "i"),)):
    guards = spark.createDataFrame(guard, "automation_id string, field string, op string, literal string")
    got = R.rehearsed(spark.createDataFrame(flow, FLOW), guards, spark.createDataFrame(list(cases), "automation_id string, instance_id string"), spark.createDataFrame(steps, STEP))
    return [tuple(r)[2:4] + tuple(r)[6:] for r in got.orderBy("automation_id", "pos").collect()]


FIRST = ("f", 1, "s1", "browser", "read", ["priority", "gone"], [], False)


def test_fields_by_the_names_of_flows(spark):
    steps = [("i", 1, "browser:read:priority", "priority", {"value": '"high"', "amount": "5"}), ("i", 2, "browser:read:priority", "priority", {"value": '"low"'}), ("other", 1, "browser:read:x", "x", {"missing": "1"})]
    flow = [FIRST, ("f", 2, "s2", "erp", "send", ["amount"], ["flow.Priority"], True), ("f", 3, "s3", "erp", "read", [], ["missing", "lost"], False), ("f", 4, "s4", "erp", "read", [], [], False)]
    got = dry(spark, flow, [("f", None, None, None)], steps)
    assert got == [
        (1, "s1", "ok", 'priority="high"', None, False, "failed"),
        (2, "s2", "ok", "amount=5", None, True, "failed"),
        (3, "s3", "failed", "", "unresolved: lost, missing", False, "failed"),
    ]
    # a guard that holds stops before the first step with an effect, even one that would fail
    held = dry(spark, [FIRST, ("f", 2, "s2", "erp", "send", [], ["lost"], True), ("f", 3, "s3", "erp", "read", [], [], False)], [("f", "amount", ">", "4")], steps)
    assert [(r[0], r[2], r[5], r[6]) for r in held] == [(1, "ok", False, "needs_approval"), (2, "needs_approval", False, "needs_approval")]


def test_cases_without_steps_and_fields(spark):
    steps = [("i", 1, "erp:read:x", "x", {})]
    assert dry(spark, [FIRST, ("g", 1, "s1", "erp", "read", [], [], False)], [], steps, [("f", "i"), ("g", "nothing"), ("h", "i")]) == [(1, "s1", "ok", "", None, False, "ok")]


def test_ranges_of_days(spark):
    day = 86_400_000
    log = spark.createDataFrame([(k, k * day) for k in range(10)], "id long, ts_ms long")

    def ids(df):
        return sorted(r["id"] for r in df.collect())

    assert ids(R.since(log, 2)) == [7, 8, 9] and ids(R.since(log, 2, 5 * day)) == [3, 4, 5] and ids(R.since(log.limit(0), 2)) == []


def test_patches_under_review_are_not_proposed_again(spark):
    steps = spark.createDataFrame([("a", 1, "s1", "erp", "read", [], ["Vendor", "k"]), ("a", 2, "s2", "erp", "send", ["k"], ["Vendor"]), ("b", 1, "s1", "erp", "read", [], ["Vendor"])], "automation_id string, pos int, step_id string, connector string, type string, outputs array<string>, depends_on array<string>")
    readable = spark.createDataFrame([("erp", "Supplier Name"), ("erp", "item k")], "app string, candidate string")
    existing = spark.createDataFrame([("a", "s1", "Vendor", "proposed"), ("a", "s1", "Vendor", "proposed"), ("b", "s1", "Vendor", "rejected"), ("b", "s1", "k", "proposed")], "automation_id string, step_id string, field string, status string")
    got = {tuple(r)[:4] + (r["auto_applicable"],) for r in G.proposals(steps, readable, existing).collect()}
    assert got == {("a", "s1", "k", "item k", True), ("a", "s2", "Vendor", "Supplier Name", False), ("b", "s1", "Vendor", "Supplier Name", True)}
    assert G.proposals(steps, readable, existing.limit(0)).count() == 4


def test_names_of_automations_that_are_gone(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "automation_id string")
    names = spark.createDataFrame([("a", "Invoices"), ("c", "x")], "automation_id string, name string")
    assert sorted(r["name"] for r in G.named(rows, names).collect()) == ["", "", "", "Invoices"]
