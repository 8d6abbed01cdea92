"""Flows run on cases of instances, not on instances: few rows are judged, and each instance still has its own."""

from loomtrace.operators import flows, governance, replay

FLOW = "automation_id string, pos int, step_id string, outputs array<string>, depends_on array<string>, irreversible boolean"
GUARD = "automation_id string, trigger_object string, field string, op string, literal string"


def data(spark, many: int):
    """Three flows; invoices of four cases (two amounts below and above the limit, a wrong one, one without a vendor) and mails."""
    steps = [(a, pos, f"s{pos}", outputs, needs, last) for a in ("a", "b") for pos, outputs, needs, last in ((1, ["amount", "vendor"], [], False), (2, ["status"], ["flow.Vendor"], True))]
    steps += [("c", 1, "s1", ["amount"], [None, "gone"], False)]
    guards = [("a", "invoice", "amount", ">", "100"), ("b", "invoice", None, None, None), ("c", "mail", "nothing", "==", "1")]
    first, found = [], []
    for k in range(many):
        name, kind = f"i{k:04d}", k % 5
        first.append((name, "mail" if kind == 4 else "invoice"))
        found.append((name, 1, "amount", str(500 + k if kind == 1 else 1 + k % 90)))
        if kind != 3:
            found.append((name, 1, "Vendor", f'"v{k}"'))
        if kind == 2:
            found.append((name, 2, "amount", str(90_000 + k)))
    make = spark.createDataFrame
    return make(steps, FLOW), make(guards, GUARD), make(first, "instance_id string, object_type string"), make(found, "instance_id string, pos int, key string, value string")


def test_cases_do_not_grow_with_instances(spark):
    sizes = []
    for many in (50, 500):
        outcomes, members = replay.by_case(*data(spark, many))
        sizes.append(outcomes.count())
        assert members.count() == many and outcomes.where("automation_id = 'a'").agg({"n": "sum"}).first()[0] == many * 4 // 5
        totals = {r["automation_id"]: tuple(r)[1:] for r in flows.replay_summary(outcomes, "automation_id", "n").collect()}
        assert totals == {"a": (many * 4 // 5, many * 2 // 5, many // 5, 0, 0.5), "b": (many * 4 // 5, many * 2 // 5, many // 5, 0, 0.5), "c": (many // 5, 0, many // 5, 0, 0.0)}
    assert sizes == [9, 9]


def test_each_instance_has_the_outcome_of_its_case(spark):
    steps, guards, first, found = data(spark, 50)
    outcomes, members = replay.by_case(steps, guards, first, found)
    got = {(r["automation_id"], r["instance_id"]): (r["status"], r["correct"], r["reason"]) for r in replay.run(steps, guards, first, found).collect()}
    wrong = "amount extracted differs from the amount the human recorded"
    of = {0: ("ok", True, None), 1: ("held", True, None), 2: ("ok", False, wrong), 3: ("failed", False, "unresolved: vendor")}
    want = {("a", f"i{k:04d}"): of[k % 5] for k in range(50) if k % 5 != 4}
    want |= {("b", i): ("ok", True, None) if v[0] == "held" else v for (_, i), v in want.items()}
    want |= {("c", f"i{k:04d}"): ("failed", False, "unresolved: gone") for k in range(4, 50, 5)}
    assert got == want
    first_two = [(r["automation_id"], r["nth"], r["instance_id"]) for r in replay.failures(outcomes, members, 2).orderBy("automation_id", "nth").collect()]
    assert first_two == [("a", 1, "i0002"), ("a", 2, "i0003"), ("b", 1, "i0002"), ("b", 2, "i0003"), ("c", 1, "i0004"), ("c", 2, "i0009")]
    seeds = governance.seeded_cases(outcomes, members, replay.source_payload(found), 3)
    assert sorted((r["automation_id"], r["instance_id"], r["amount"], r["vendor"]) for r in seeds.collect()) == [("a", f"i{k:04d}", str(500 + k), f"v{k}") for k in (1, 6, 11)]
    modes = [tuple(r) for r in replay.failure_modes(outcomes).where("automation_id = 'a'").orderBy("rank").collect()]
    assert modes == [("a", wrong, 10, 1), ("a", "unresolved: vendor", 10, 2)]


def test_flows_read_the_log_once(spark):
    """What flows are made of is cut into instances once: plans of steps, runs and clusters read written tables."""
    import os

    from loomtrace.queries import workflows
    from tests.tables import SF_DIR

    flow, guards, steps, runs, clusters, toks = workflows._flows(spark, SF_DIR)
    for table in (flow, guards, steps, runs, clusters, toks):
        assert not [f for f in table.inputFiles() if os.path.basename(os.path.dirname(f)) == "events.parquet" or f.endswith("events.parquet")]
