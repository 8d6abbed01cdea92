"""Operators on small tables: worked examples, nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from loomtrace.functions import normalise as N
from loomtrace.functions import sequences as Q
from loomtrace.functions import web as W
from loomtrace.operators import flows, generator, governance, replay, reports, scoring, sessions, vectors
from loomtrace.sources import files

EVENT = "id long, user_id string, ts_ms long, app string, action string, object_type string, duration_ms long, session_id string"


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def strings(values):
    return F.array(*map(F.lit, values)).cast("array<string>")


def test_collapse(spark):
    cases = {"aab": "ab", "aba": "a", "abab": "a", "abcb": "ab", "": "", "abc": "abc", "abcacb": "abcacb"}
    got = one(spark, *(F.array_join(Q.collapse(strings(list(k))), "") for k in cases))
    assert [g if k != "abab" else g for k, g in zip(cases, got, strict=True)] == [brute_collapse(k) for k in cases]


def brute_collapse(text):
    changed = True
    while changed:
        changed = False
        for i in range(len(text) - 2):
            if text[i] == text[i + 2]:
                text, changed = text[: i + 1] + text[i + 3 :], True
                break
        for i in range(len(text) - 1):
            if text[i] == text[i + 1]:
                text, changed = text[:i] + text[i + 1 :], True
                break
    return text


def test_sequence_similarity_counts_tokens(spark):
    alphabet = strings(["a:b:c", "d:e:f", "g:h:i"])
    code = lambda tokens: Q.encoded(strings(tokens), alphabet)
    got = one(spark, Q.sequence_similarity(code(["a:b:c", "d:e:f"]), code(["a:b:c", "g:h:i"])), Q.sequence_similarity(code([]), code([])), Q.sequence_similarity(code(["a:b:c"]), code([])))
    assert got == (0.5, 1.0, 0.0)


def test_long_alphabets_are_told_apart(spark):
    # a column of a row: as one constant expression the alphabet would be made anew for every token
    many = spark.createDataFrame([([f"t{i:06d}" for i in range(1, 20_001)],)], "many array<string>")
    code = Q.encoded(F.col("many"), F.col("many"))
    assert tuple(many.select(F.length(code), F.size(F.array_distinct(F.split(code, ""))) >= 20_000).first()) == (20_000, True)


def test_entropy_of_variants(spark):
    found = spark.createDataFrame([("x", "h1")] * 5 + [("x", "h2")] * 5 + [("y", "h1")] * 10, "cluster_id string, signature_hash string")
    assert {r["cluster_id"]: (r["entropy"], r["n_variants"]) for r in scoring.step_entropy(found).collect()} == {"x": (1.0, 2), "y": (0.0, 1)}
    assert scoring.step_entropy(found.where("1 = 0")).count() == 0


def test_context_switches(spark):
    minute = 60_000
    near = [(1, "u", 0, "gmail", "read", "x", 0, "s"), (2, "u", minute, "sheets", "read", "x", 0, "s"), (3, "u", 2 * minute, "gmail", "read", "x", 0, "s")]
    far = [(4, "v", 0, "gmail", "read", "x", 0, "s"), (5, "v", minute, "sheets", "read", "x", 0, "s"), (6, "v", 99 * minute, "gmail", "read", "x", 0, "s")]
    steps = sessions.sessionise(spark.createDataFrame(near + far, EVENT), 1000 * minute)
    assert rows(sessions.instances(steps), "user_id", "context_switches") == [("u", 1), ("v", 0)]


def test_sessions_end_at_gaps_resets_and_other_sessions(spark):
    minute = 60_000
    log = [
        (1, "a", 0, "erp", "create", "x", 5 * minute, None), (2, "a", 20 * minute, "erp", "create", "x", 0, None),  # 15 minutes after the end: together
        (3, "a", 35 * minute + 1, "erp", "create", "x", 0, None), (4, "a", 36 * minute, "erp", "create", "y", 0, None),
        (5, "b", 0, "erp", "create", "x", 0, None), (6, "b", 1, "slack", "read", "x", 0, None), (7, "b", 2, "erp", "create", "x", 0, None),  # a reset leaves two single steps
        (8, "c", 0, "erp", "create", "x", 0, "s1"), (9, "c", 1, "erp", "create", "x", 0, "s1"), (10, "c", 2, "erp", "create", "x", 0, "s2"),
        (11, "d", 5, "erp", "create", "x", 0, None), (12, "d", 5, "erp", "create", "z", 0, None),
    ]
    found = sessions.sessionise(spark.createDataFrame(log, EVENT))
    assert rows(found, "instance_id", "pos", "id") == sorted([("a#1", 1, 1), ("a#1", 2, 2), ("a#3", 1, 3), ("a#3", 2, 4), ("c#8", 1, 8), ("c#8", 2, 9), ("d#11", 1, 11), ("d#11", 2, 12)], key=repr)
    assert sessions.instances(sessions.sessionise(spark.createDataFrame([], EVENT))).count() == 0


def test_durations_actions_and_hosts(spark):
    assert one(spark, *(N.duration_ms(F.lit(x)) for x in ("3 min", "90", "junk", "1.5 h", "")), N.duration_ms(F.lit("250"), 1), N.duration_ms(F.lit(None).cast("string"))) == (180_000, 90_000, 0, 5_400_000, 0, 250, 0)
    told = one(spark, *(N.split_action(F.lit(x)) for x in ("Review resume", "copy_customer_information", "open_create_issue", "juggle")))
    assert [tuple(t) for t in told] == [("read", "resume"), ("extract", "customer"), ("navigate", "create_issue"), ("juggle", "")]
    assert one(spark, *(W.app_for_host(F.lit(x)) for x in ("https://app.acme-erp.co.in/x", "https://northwind.com.au/", "https://docs.google.com/spreadsheets/d/1", "https://team.atlassian.net/browse", "", None))) == ("acme-erp", "northwind", "sheets", "jira", "browser", "browser")
    assert one(spark, N.slug(F.lit("  My Tool! 2 ")), N.slug(F.lit("--")), F.lit(N.plain_key(" Record ID? "))) == ("my_tool_2", "unknown", "record_id")


def test_interpretation_keeps_names_not_values(spark):
    signal = spark.createDataFrame([("click", "https://erp.example.org/vendors/4711?amount=5&x=", "Vendor 4711", "Save", "button", "amount", "abc"), ("pageview", None, None, None, None, None, None)], "interaction string, url string, title string, label string, role string, field_name string, payload_digest string")
    told = W.interpret(signal).select("action", "object_type", "object_id", "payload").collect()
    assert tuple(told[0]) == ("update", "vendor_record", "4711", {"field": "amount", "control": "Save", "transfer_digest": "abc"})
    assert (told[1]["action"], told[1]["object_type"], told[1]["payload"]) == ("read", "page", {})
    assert W.interpret(signal, with_values=True).first()["payload"]["title"] == "Vendor 4711"


def test_csv_rows_and_rejects(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('Timestamp,Performed By,Activity,Application,Duration,Record ID,payload,Mood\n2026-08-24 09:12,ann,Review resume,Excel,3 min,R-1,"{""a"": 1, ""b"": ""x""}",ok\n\n,,,,,,,\n2026-08-24 09:13,,open,SAP,5,,,\nlater,bob,open,SAP,5,,,\n2026-08-24T09:14:00Z,bob,set priority,SAP,90,,,"two\nlines"\n2026-08-24 09:15,bob,send,slack,,,plain text,\n')
    events, rejects = files.read_log(spark, f"file://{path}")
    assert rows(events, "user_id", "app", "action", "object_type", "object_id", "duration_ms") == sorted([("ann", "sheets", "read", "resume", "R-1", 180_000), ("bob", "erp", "update", "priority", None, 90_000), ("bob", "slack", "send", "unknown", None, 0)], key=repr)
    assert {r["action"]: r["payload"] for r in events.collect()} == {"read": {"a": "1", "b": "x"}, "update": {"mood": "two\nlines"}, "send": {"raw": "plain text"}}
    assert sorted(r["message"] for r in rejects.collect()) == ["line 4: missing user_id: no column named user_id, employee, person or role", "line 5: unreadable timestamp: 'later'"]
    summary = files.upload_summary(events, rejects.select("file", F.lit(1).alias("line"), "message")).first()
    assert (summary["accepted"], summary["rejected"], summary["apps"]) == (3, 2, 3)


def test_csv_without_a_person_is_of_the_local_user(spark, tmp_path):
    path = tmp_path / "own.csv"
    path.write_text("when,event\n2026/08/24 09:12:00,open\n")
    events, rejects = files.read_log(spark, f"file://{path}")
    assert rows(events, "user_id", "team", "app", "object_type") == [("u_local", "unknown", "browser", "unknown")]
    assert rejects.count() == 0


def test_json_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"user": "ann", "ts": "2026-01-01T00:00:00Z", "action": "open", "payload": "[1, 2]"}\n\n[1]\nnot json\n{"ts": "2026-01-01 10:00", "action": "send", "Object Type": "Bill", "amount": 5}\n{"user": "", "ts": "2026-01-01 10:00"}\n')
    events, rejects = files.read_log(spark, f"file://{path}")
    assert rows(events, "user_id", "object_type") == [("ann", "unknown"), ("u_local", "bill")]
    assert {r["user_id"]: r["payload"] for r in events.collect()} == {"ann": {"value": "[1,2]"}, "u_local": {"amount": "5"}}
    messages = sorted(r["message"] for r in rejects.collect())
    assert [m.split(":")[0] for m in messages] == ["line 3", "line 4", "line 6"]


def test_log_is_written_exported_and_renamed(spark, tmp_path):
    events = spark.createDataFrame([(1, "s1", {"amount": "5", "k": "1"}), (2, "s2", {"k": "2"}), (3, None, None)], "id long, source_id string, payload map<string,string>").withColumn("ts", F.to_timestamp(F.lit("2026-01-02 03:04:05")))
    files.append_events(events, f"file://{tmp_path}/log")
    files.append_events(events.limit(1), f"file://{tmp_path}/log")
    assert spark.read.parquet(f"file://{tmp_path}/log").count() == 4
    files.export_csv(events, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 3
    files.export_jsonl(events, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 3
    renamed = {r["id"]: r["payload"] for r in files.renamed_field(events, "amount", "net").collect()}
    assert renamed == {1: {"k": "1", "net": "5"}, 2: {"k": "2"}, 3: None}
    assert rows(files.without_source(events, spark.createDataFrame([("s1",)], "source_id string")), "id") == [(2,), (3,)]
    assert files.listing(spark, f"file://{tmp_path}/csv", "*.csv").count() >= 1


def test_values_match(spark):
    pairs = {("100.0", "100.005"): True, ("100", "200"): False, ('" Acme "', '"acme"'): True, ('"1"', "1"): False, ("null", "null"): True, ("null", "0"): False, ("0", "0.005"): True, ('"1.0"', '"1"'): False}
    assert one(spark, *(replay.values_match(F.lit(a), F.lit(b)) for a, b in pairs)) == tuple(pairs.values())
    assert one(spark, flows.values_match(F.lit(100.0), F.lit(100.005), True), flows.values_match(F.lit(" A"), F.lit("a"), False), flows.values_match(F.lit(None).cast("string"), F.lit("a"), False)) == (True, True, False)


def test_comparison_by_field(spark):
    predicted = spark.createDataFrame([("a", "i1", "amount", "100"), ("a", "i1", "note", '"x"'), ("a", "i1", "only", "1"), ("a", "i2", "title", '"T"')], "automation_id string, instance_id string, key string, value string")
    observed = spark.createDataFrame([("i1", "amount", "250"), ("i1", "note", '"X "'), ("i2", "title", '"t"'), ("i3", "title", '"t"')], "instance_id string, key string, value string")
    got = {r["instance_id"]: (r["score"], r["critical_mismatch"], r["compared"], r["diff_fields"]) for r in replay.compare(predicted, observed, ["automation_id", "instance_id"]).collect()}
    assert got == {"i1": (0.3333, True, 2, ["amount"]), "i2": (1.0, False, 1, [])}
    assert replay.compare(predicted.where("1 = 0"), observed, ["automation_id", "instance_id"]).count() == 0


def test_payload_folds(spark):
    found = spark.createDataFrame([("i", 1, "Vendor", '"a"'), ("i", 1, "amount", "1"), ("i", 2, "Supplier Name", '"b"'), ("i", 2, "amount", "2"), ("i", 2, "status", '"ok"'), ("i", 3, "amount_inr", "9"), ("j", 1, "amount_inr", "null"), ("j", 1, "amount", "4")], "instance_id string, pos int, key string, value string")
    assert rows(replay.observed_outcome(found), "instance_id", "key", "value") == sorted([("i", "vendor", '"b"'), ("i", "amount", "9"), ("i", "status", '"ok"'), ("i", "amount_inr", "9"), ("j", "amount_inr", "null"), ("j", "amount", "4")], key=repr)
    assert rows(replay.source_payload(found).where("instance_id = 'i'"), "key", "value") == sorted([("vendor", '"a"'), ("Vendor", '"a"'), ("Supplier Name", '"b"'), ("amount", "1")], key=repr)
    first = spark.createDataFrame([("i", "invoice"), ("k", "mail")], "instance_id string, object_type string")
    assert dict(rows(replay.trigger_payload(found, first).where("instance_id = 'i'"), "key", "value")) == {"Vendor": '"a"', "vendor": '"a"', "amount": "1", "body": '"invoice received"', "recipient": '"finance-ap@northwind.example"'}
    assert replay.trigger_payload(found, first).where("instance_id = 'k'").count() == 2


def test_guards(spark):
    held = [("5", ">", "3", True), ("5", ">", "5", False), ('"High"', "!=", "High", False), ('"Low"', "!=", "High", True), (None, "!=", "High", False), ('"5"', ">", "3", False), ('"5"', "==", "5", False), ("5", "~", "3", False), ("5", "<=", "x", False)]
    assert one(spark, *(replay.guard_holds(F.lit(a).cast("string"), F.lit(op), F.lit(x)) for a, op, x, _ in held)) == tuple(h[3] for h in held)
    assert flows.inverted("amount > 5") == "amount <= 5"
    for text in ("amount > 5", "a.b != x", "n >= 1"):
        assert flows.inverted(flows.inverted(text)) == text


def test_reasons(spark):
    told = one(spark, replay.explain(strings(["amount"]), F.lit('"USD"')), replay.explain(strings(["amount", "status"]), F.lit('"INR"')), replay.explain(strings(["colour"]), F.lit(None).cast("string")), replay.explain(strings([]), F.lit(None).cast("string")))
    assert told[0] == "invoice denominated in USD; the flow has no currency-conversion rule"
    assert told[1].startswith("amount extracted differs") and told[1].endswith("judgement call")
    assert told[2:] == ("disagreement on colour", "no field disagreement")


RUNS = "automation_id string, sequence long, score double, critical boolean"


def test_trust_ladder(spark):
    runs = [("up", i, 1.0, False) for i in range(1, 6)] + [("down", i, 1.0, i == 4) for i in range(1, 6)] + [("old", i, 1.0, i == 1) for i in range(1, 8)] + [("few", 1, 0.5, False)]
    levels = spark.createDataFrame([("up", "SHADOW"), ("down", "ASSIST"), ("old", "AUTONOMOUS"), ("few", "OBSERVE"), ("none", "SUGGEST")], "automation_id string, trust_level string")
    state = governance.trust_state(spark.createDataFrame(runs, RUNS), levels)
    got = {r["automation_id"]: (r["can_promote"], r["must_demote"], r["blockers"]) for r in state.collect()}
    assert got["up"] == (True, False, "") and got["down"][:2] == (False, True)
    assert got["old"] == (False, False, "already at the top of the ladder")
    assert got["few"][2] == "needs 4 more shadow run(s); rolling average is 50%, needs 90%"
    assert got["none"][:2] == (False, False)
    requests = spark.createDataFrame([("up", False), ("few", True), ("none", False)], "automation_id string, force boolean")
    moved = {r["automation_id"]: (r["new_level"], r["reason"]) for r in governance.moved(state, requests).collect()}
    assert moved == {"up": ("ASSIST", "policy satisfied"), "down": ("SHADOW", "critical field mismatch detected"), "old": ("AUTONOMOUS", None), "few": ("SUGGEST", "manual override by operator"), "none": ("SUGGEST", None)}


def test_trend_across_stretches(spark):
    runs = spark.createDataFrame([("a", i, i / 10, False) for i in range(1, 11)] + [("b", 1, None, False)], RUNS)
    got = {(r["automation_id"], r["sequence"]): r["trend"] for r in governance.score_trend(runs, stretch=3).collect()}
    assert got == {("a", i): round(sum(range(1, i + 1)) / 10 / i, 6) for i in range(1, 11)} | {("b", 1): None}


def test_coverage_counts_held_runs_and_learned_rules(spark):
    automations = spark.createDataFrame([("a", 773, 113, 0), ("b", 0, 0, 4), ("c", 0, 0, 0)], "automation_id string, replay_total long, replay_human long, shadow_runs long")
    cases = spark.createDataFrame([("b", "k", "open"), ("b", "k", "resolved")], "automation_id string, signature_key string, status string")
    rules = "automation_id string, source string, action string, signature_key string"
    assert {r["automation_id"]: r["coverage"] for r in governance.coverage(automations, cases, spark.createDataFrame([], rules)).collect()} == {"a": round(1 - 113 / 773, 4), "b": 0.75, "c": 0.0}
    learned = spark.createDataFrame([("b", "learned", "file", "k"), ("b", "learned", "route_to_manager", "k"), ("b", "author", "file", "k")], rules)
    assert {r["automation_id"]: r["coverage"] for r in governance.coverage(automations, cases, learned).collect()}["b"] == 1.0


def test_exception_keys_and_rules(spark):
    keys = one(spark, *(governance.signature_key(F.lit(a).cast("double"), F.lit(c), F.lit(u), F.lit(s)) for a, c, u, s in ((2e6, "inr", False, ""), (6e5, "USD", True, "open"), (-1.0, "", False, ""), (None, "", False, "x"))))
    assert keys == ("amount_over_10k", "amount_500k_to_1m|foreign_currency|unresolved_dependency|status_open", "unclassified", "status_x")
    cases = [("a", "k1", "resolved", "file", 10.5, "INR")] * 2 + [("a", "k1", "resolved", "hold", 12.0, "INR"), ("a", "k2", "resolved", "file", None, "USD")] + [("a", "k2", "resolved", None, None, "USD")] * 2 + [("a", "k3", "open", "file", 1.0, "INR")] * 9
    got = rows(governance.rule_proposals(spark.createDataFrame(cases, "automation_id string, signature_key string, status string, decision string, amount double, currency string"), spark.createDataFrame([], "automation_id string, signature_key string")), "signature_key", "condition", "action", "evidence")
    assert got == [("k1", "amount > 9", "file", 3), ("k2", 'currency != "INR"', "file", 3)]
    assert one(spark, *(governance.routes_to_human(F.lit(x)) for x in ("Route_to_manager", "file", "HOLD it"))) == (True, False, True)


@pytest.mark.parametrize(("a", "b", "least", "most"), [("vendor", "vendor legal name", 1, 1), ("net amount", "amount net", 1, 1), ("status", "state", 0.7, 0.8), ("abc", "xyz", 0, 0), ("", "x", 0, 0)])
def test_token_set_ratio(a, b, least, most):
    assert least <= governance.token_set_ratio(a, b) <= most
    assert governance.token_set_ratio(a, b) == governance.token_set_ratio(b, a)


def test_remap_by_synonym_words_and_likeness(spark):
    missing = spark.createDataFrame([("s", "read", "Vendor"), ("s", "send", "Vendor"), ("s", "read", "net price"), ("s", "read", "customer"), ("t", "read", "Vendor")], "app string, step_type string, field string")
    seen = spark.createDataFrame([("s", "Supplier Name"), ("s", "net price total"), ("s", "total net price of it"), ("s", "custmer"), ("u", "payee")], "app string, candidate string")
    got = {(r["step_type"], r["field"]): (r["candidate"], r["confidence"], r["auto_applicable"]) for r in governance.remap(missing, seen, ["app"]).collect()}
    assert got[("read", "Vendor")] == ("Supplier Name", 0.94, True) and got[("send", "Vendor")] == ("Supplier Name", 0.94, False)
    assert got[("read", "net price")] == ("net price total", 0.92, True)
    assert got[("read", "customer")] == ("custmer", 0.88, False)
    assert len(got) == 4


def test_heal_applies_what_is_safe(spark):
    steps = spark.createDataFrame([("f", 1, "s1", "erp", "read", ["id"], ["Vendor", "colour"]), ("f", 2, "s2", "erp", "send", [], ["Vendor", "id"])], "automation_id string, pos int, step_id string, connector string, type string, outputs array<string>, depends_on array<string>")
    readable = spark.createDataFrame([("erp", "Supplier Name"), ("erp", "color")], "app string, candidate string")
    healed, patches = governance.heal(steps, readable)
    assert rows(healed, "step_id", "depends_on") == [("s1", ["Supplier Name", "colour"]), ("s2", ["Vendor", "id"])]
    assert rows(patches, "step_id", "field", "candidate", "applied") == [("s1", "Vendor", "Supplier Name", True), ("s1", "colour", "color", False), ("s2", "Vendor", "Supplier Name", False)]


FLOW = "automation_id string, pos int, step_id string, connector string, type string, outputs array<string>, depends_on array<string>, irreversible boolean"


def test_replay_statuses(spark):
    steps = spark.createDataFrame([("a", 1, "s1", "gmail", "read", ["amount", "vendor"], [], False), ("a", 2, "s2", "erp", "create", ["status"], ["vendor"], True)], FLOW)
    guards = spark.createDataFrame([("a", "invoice", "amount", ">", "100")], "automation_id string, trigger_object string, field string, op string, literal string")
    first = spark.createDataFrame([("ok", "invoice"), ("held", "invoice"), ("failed", "invoice"), ("bad", "invoice"), ("other", "mail")], "instance_id string, object_type string")
    found = spark.createDataFrame(
        [("ok", 1, "amount", "5"), ("ok", 1, "Vendor", '"v"'), ("held", 1, "amount", "500"), ("held", 1, "Vendor", '"v"'), ("failed", 1, "amount", "5"), ("bad", 1, "amount", "5"), ("bad", 1, "Vendor", '"v"'), ("bad", 2, "amount", "80")],
        "instance_id string, pos int, key string, value string",
    )
    got = {r["instance_id"]: (r["status"], r["correct"], r["reason"]) for r in replay.run(steps, guards, first, found).collect()}
    assert got == {"ok": ("ok", True, None), "held": ("held", True, None), "failed": ("failed", False, "unresolved: vendor"), "bad": ("ok", False, "amount extracted differs from the amount the human recorded")}
    assert flows.replay_summary(replay.run(steps, guards, first, found), "automation_id").first()["accuracy"] == 0.5
    assert replay.run(steps, guards, first.where("1 = 0"), found).count() == 0


def test_flows_from_signatures(spark):
    clusters = spark.createDataFrame([("c", ["gmail:read:mail", "pdf:extract:bill", "jira:create:issue", "gmail:send:note"])], "cluster_id string, signature array<string>")
    fields = spark.createDataFrame([("c", "gmail:read:mail", ["body", "sender"]), ("c", "pdf:extract:bill", ["body", "priority"]), ("c", "jira:create:issue", ["priority", "status"])], "cluster_id string, token string, fields array<string>")
    steps = generator.steps_of(clusters, fields)
    assert rows(steps, "step_id", "outputs", "depends_on", "irreversible") == [
        ("s1", ["body", "sender"], [], False), ("s2", ["body", "priority"], ["body"], False), ("s3", ["priority", "status"], ["priority"], True), ("s4", ["message_id"], [], True),
    ]
    guard = generator.guards_of(steps, spark.createDataFrame([("c", "priority_2", "High"), ("c", "name", "x"), ("c", "status", "")], "cluster_id string, name string, value string")).first()
    assert (guard["trigger_type"], guard["irreversible_steps"], guard["field"], guard["op"], guard["literal"]) == ("email_received", ["s3", "s4"], "priority", "!=", "High")
    assert generator.choose_method(steps).first()["method"] == "n8n"
    nodes = [(r["node"], r["next_node"]) for r in generator.graph(steps, generator.guards_of(steps, spark.createDataFrame([("c", "priority", "High")], "cluster_id string, name string, value string"))).orderBy("nth").collect()]
    assert nodes == [("trigger", "s1"), ("s1", "s2"), ("s2", "guard"), ("guard", "s3"), ("s3", "s4"), ("s4", None)]


def test_validation_findings(spark):
    steps = spark.createDataFrame([("f", 1, "s1", "gmail", "read", ["a"], [], False), ("f", 2, "s1", "fax", "read", [], ["a", "z"], False), ("f", 3, "", "gmail", "send", [], [], True), ("f", 4, "s4", None, "read", [], [], False)], FLOW)
    guards = spark.createDataFrame([("f", "", ["s1", "s9"]), ("empty", "", [])], "automation_id string, guard string, irreversible_steps array<string>")
    tokens = spark.createDataFrame([("f", "gmail", "read")], "automation_id string, connector string, type string")
    expected = spark.createDataFrame([("f", "p != High")], "automation_id string, guard string")
    methods = spark.createDataFrame([("f", "n8n")], "automation_id string, method string")
    got = {(r["automation_id"], r["step_id"], r["check"]) for r in generator.validate(steps, guards, tokens, expected, methods).collect()}
    assert {("empty", "", "schema"), ("f", "", "schema"), ("f", "s4", "schema"), ("f", "s1", "schema"), ("f", "s1", "connector_not_observed"), ("f", "", "action_not_observed"), ("f", "s1", "dependency_unresolved"), ("f", "", "guard_weakened"), ("f", "s9", "guard_orphaned"), ("f", "", "executor_infeasible")} <= got
    whole = generator.sanitise(steps, spark.createDataFrame([("f", 1, "s1", "gmail", "read", ["a"], [], False), ("f", 2, "s2", "erp", "read", ["b"], ["a"], False)], FLOW))
    assert rows(whole, "step_id", "connector", "depends_on") == [("s1", "gmail", []), ("s2", "erp", ["a"]), ("s3", "gmail", []), ("s4", "browser", [])]


def test_templates(spark):
    samples = [("ABC", "customer"), ("ABC Corp", "company"), ("Login failure", "issue"), ("", "nothing")]
    text = F.lit("ABC - Login failure of ABC Corp.")
    assert one(spark, generator.templatise(text, samples), generator.template_parts(text, samples), generator.template_parts(F.lit("plain"), samples)) == (
        "{{customer}} - {{issue}} of {{company}}.", "values['customer'] + ' - ' + values['issue'] + ' of ' + values['company'] + '.'", "'plain'",
    )
    nothing = F.lit(None).cast("string")
    assert one(spark, generator.note(F.lit("7"), F.lit(123456), nothing), generator.note(nothing, F.lit(None).cast("long"), nothing)) == ("Filed invoice 7 — total INR 1,234.56 (filed automatically)", None)


def test_names_and_majority(spark):
    signature = strings(["gmail:read:support_mail", "jira:create:issue"])
    told = one(spark, reports.name(signature, F.lit(0.1), F.lit("x"), F.lit("none")), reports.name(signature, F.lit(0.9), F.lit("escalation"), F.lit("none")), reports.name(signature, F.lit(0.9), F.lit(None).cast("string"), F.lit("none")), reports.name(strings([]), F.lit(0.1), F.lit("x"), F.lit("none")))
    assert told == ("Support Mail to issue", "Escalation handling", "none", "none")
    labels = spark.createDataFrame([("i", "b"), ("i", "a"), ("j", None), ("k", "a"), ("k", "b"), ("k", "b")], "instance_id string, label_ string")
    assert rows(reports.majority(labels, "instance_id", "label_"), "instance_id", "label") == [("i", "a"), ("j", None), ("k", "b")]
    objects = spark.createDataFrame([("c", "escalation_mail"), ("c", "escalation_reply"), ("c", "tracker"), ("d", "x")], "cluster_id string, object_type string")
    assert rows(reports.subjects(objects), "cluster_id", "subject") == [("c", "escalation")]


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng_rows = [(i, i % 3, [float((i * k) % 7) - 3 for k in range(1, 5)]) for i in range(40)] + [(40, 0, [0.0] * 4)]
    table = spark.createDataFrame(rng_rows, "vec_id long, label int, embedding array<float>")
    got = {}
    for r in vectors.nearest(table.where("vec_id % 20 = 0"), table, 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["cosine"]))

    def cosine(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 5) if n else None

    for q in (0, 20):
        ranked = sorted(((-cosine(rng_rows[q][2], v), i) for i, _, v in rng_rows if i != q and cosine(rng_rows[q][2], v) is not None))[:3]
        assert [(i, c) for _, i, c in sorted(got[q])] == [(i, -c) for c, i in ranked]
    assert 40 not in got


def test_csv_files_are_split_unless_a_cell_has_a_line_break(spark, tmp_path):
    head = "Timestamp,Performed By,Activity,Application\n"
    (tmp_path / "plain.csv").write_text(head + "".join(f'2026-08-24 09:{k:02d},ann,"say ""hi""",SAP\n' for k in range(50)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    plain = files.csv_rows(spark, f"file://{tmp_path}/plain.csv")
    assert sorted(r["line"] for r in plain.collect()) == list(range(2, 52))
    (tmp_path / "broken.csv").write_text(head + '2026-08-24 09:00,ann,"one\ntwo ""x""",SAP\n2026-08-24 09:01,bob,open,SAP\n')
    broken = files.csv_rows(spark, f"file://{tmp_path}/broken.csv")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["cells"]["activity"] for r in broken.collect()) == ['one\ntwo "x"', "open"]
