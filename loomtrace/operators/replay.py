"""Replaying flows against recorded instances: payload folds, comparison field by field, failures and their reasons.

Fields are rows (instance_id, key, value), so folds are aggregations by instance and key, and a comparison is
one join. Flows then run on cases, which are instances that no flow can tell apart. Values are JSON literals:
text is quoted, so that the text "1" and the number 1 stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions.normalise import lookup
from loomtrace.operators.generator import field_name
from loomtrace.sources.shared import written


def fields(steps: DataFrame) -> DataFrame:
    """(instance_id, pos, key, value) of every payload field of every step."""
    return steps.select("instance_id", "pos", F.explode("payload").alias("key", "value")).where(F.col("key") != C.HINT_KEY)


def stable(key: Column) -> Column:
    """The name of a field, whatever its source called it."""
    return F.coalesce(lookup(C.FIELD_ALIASES, key), key)


def observed_outcome(found: DataFrame) -> DataFrame:
    """What the human left behind: the last value of every field; a converted amount counts as the amount."""
    named = found.select("instance_id", "pos", stable(F.col("key")).alias("key"), "value", F.lit(0).alias("over"))
    converted = found.where("key = 'amount_inr' and value <> 'null'").select("instance_id", "pos", F.lit("amount").alias("key"), "value", F.lit(1).alias("over"))
    return named.unionByName(converted).groupBy("instance_id", "key").agg(F.max_by("value", F.struct("over", "pos", "value")).alias("value"))


def trigger_payload(found: DataFrame, first: DataFrame) -> DataFrame:
    """What is known when an instance begins: the fields of its first step, with two defaults.

    ``first`` has (instance_id, object_type) of all instances, those without any field included.
    """
    own = found.where("pos = 1").select("instance_id", "key", "value")
    alias = own.where(F.col("key").isin(*C.FIELD_ALIASES)).groupBy("instance_id").agg(F.max_by("value", F.when(F.col("key") == "Supplier Name", 1).otherwise(0)).alias("value")).select("instance_id", F.lit("vendor").alias("key"), "value")
    body = first.select("instance_id", F.lit("body").alias("key"), F.concat(F.lit('"'), "object_type", F.lit(' received"')).alias("value"))
    to = first.select("instance_id", F.lit("recipient").alias("key"), F.lit('"finance-ap@northwind.example"').alias("value"))
    ranked = own.withColumn("over", F.lit(1)).unionByName(alias.withColumn("over", F.lit(2))).unionByName(body.unionByName(to).withColumn("over", F.lit(0)))
    return ranked.groupBy("instance_id", "key").agg(F.max_by("value", "over").alias("value"))


def source_payload(found: DataFrame) -> DataFrame:
    """What a flow may read: the first value of every field that no decision has made; renamed columns also as they are, last value."""
    readable = found.where(~F.col("key").isin(*C.DECISION_FIELDS))
    renamed = F.col("key").isin(*C.FIELD_ALIASES)
    first = readable.select("instance_id", stable(F.col("key")).alias("key"), "value", F.col("pos").alias("turn"))
    raw = readable.where(renamed).select("instance_id", "key", "value", (-F.col("pos")).alias("turn"))
    return first.unionByName(raw).groupBy("instance_id", "key").agg(F.min_by("value", F.struct("turn", "value")).alias("value"))


def available(source: DataFrame, trigger: DataFrame) -> DataFrame:
    """Both payloads as one; the trigger's values count."""
    ranked = source.withColumn("over", F.lit(0)).unionByName(trigger.withColumn("over", F.lit(1)))
    return ranked.groupBy("instance_id", "key").agg(F.max_by("value", "over").alias("value"))


def values_match(a: Column, b: Column) -> Column:
    """Whether two JSON literals agree: numbers within the tolerance, text without case and blanks around, null only with null."""
    def number(x: Column) -> Column:
        return F.when(~x.startswith('"'), x.try_cast("double"))

    def text(x: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(x, '^"|"$', "")))

    x, y = number(a), number(b)
    numeric = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) <= C.NUMERIC_TOLERANCE
    none = (a == "null") | (b == "null")
    return F.when(none, (a == "null") & (b == "null")).when(x.isNotNull() & y.isNotNull(), numeric).when(x.isNotNull() | y.isNotNull(), F.lit(False)).otherwise(text(a) == text(b))


def known(found: DataFrame, first: DataFrame) -> DataFrame:
    """(instance_id, object_type, entries): one row for each instance, with what it offers and how that ended.

    An entry (key, value, recorded, seen) is a field that a flow may read; ``recorded`` tells whether the
    person left that field behind, and ``seen`` what it was then.
    """
    have = available(source_payload(found), trigger_payload(found, first))
    outcome = observed_outcome(found).select("instance_id", "key", F.lit(True).alias("recorded"), F.col("value").alias("seen"))
    entries = have.join(outcome, ["instance_id", "key"], "left").groupBy("instance_id").agg(F.collect_list(F.struct("key", "value", F.coalesce("recorded", F.lit(False)).alias("recorded"), "seen")).alias("entries"))
    return first.join(entries, "instance_id", "left")


def cases(known: DataFrame, guards: DataFrame) -> DataFrame:
    """(instance_id, case_id, object_type, keys, marks, currency, held): all that runs see of each instance.

    ``keys`` are fields that it offers in lower case, ``marks`` (key, same) those that are compared, ``held`` the
    guards that hold. Instances with the same of all these are one case, and every flow runs on them alike.
    """
    asked = guards.where("field is not null").select("field", "op", "literal").distinct().agg(F.collect_list(F.struct("field", "op", "literal")).alias("asked"))
    nothing = F.array().cast("array<string>")

    def holds(g: Column) -> Column:
        at = F.get(F.filter("entries", lambda e: e["key"] == g["field"]), F.lit(0))["value"]
        return guard_holds(at, g["op"], g["literal"])

    marks = F.transform(F.filter("entries", lambda e: e["recorded"]), lambda e: F.struct(e["key"].alias("key"), values_match(e["value"], e["seen"]).alias("same")))
    # a currency is no decision, so an instance offers the one that it ended in
    currency = F.get(F.filter("entries", lambda e: e["recorded"] & (e["key"] == "currency")), F.lit(0))["seen"]
    told = known.crossJoin(F.broadcast(asked)).select(
        "instance_id", "object_type", F.coalesce(F.array_sort(F.array_distinct(F.transform("entries", lambda e: F.lower(e["key"])))), nothing).alias("keys"),
        F.array_sort(marks).alias("marks"), currency.alias("currency"), F.array_sort(F.filter("asked", holds)).alias("held"),
    )
    seen = F.to_json(F.struct("object_type", "keys", "marks", "currency", "held"), {"ignoreNullFields": "false"})
    return told.withColumn("case_id", F.sha2(seen, 256))


def explain(diff_fields: Column, currency: Column) -> Column:
    """Why a run disagreed, by the fields that differ; ``currency`` is a JSON literal or null."""
    bare = F.regexp_replace(currency, '^"|"$', "")
    foreign = bare.isNotNull() & (bare != "") & (F.upper(bare) != "INR")

    def has(*names: str) -> Column:
        return F.arrays_overlap(diff_fields, F.array(*map(F.lit, names)))

    amount = F.when(foreign, F.concat(F.lit("invoice denominated in "), bare, F.lit("; the flow has no currency-conversion rule"))).otherwise("amount extracted differs from the amount the human recorded")
    reasons = [
        F.when(has("amount", "amount_inr"), amount),
        *(F.when(has(n), F.lit(f"{n} name resolved differently (likely a renamed source column)")) for n in ("vendor", "supplier")),
        F.when(has("po_number"), F.lit("purchase order number did not match the human's entry")),
        F.when(has("system"), F.lit("access was granted at a reduced level; the flow has no rule for privileged systems")),
        F.when(has("status"), F.lit("outcome status differs; this instance likely required a judgement call")),
    ]
    told = F.concat_ws("; ", *reasons)
    return F.when(F.size(diff_fields) == 0, F.lit("no field disagreement")).when(told != "", told).otherwise(F.concat(F.lit("disagreement on "), F.array_join(diff_fields, ", ")))


def plans(flows: DataFrame, guards: DataFrame) -> DataFrame:
    """One row for each guard of a flow: its trigger, what its steps need and make, and where it would stop."""
    need = F.lower(F.substring_index("need", ".", -1))
    needs = flows.select("automation_id", "pos", F.explode("depends_on").alias("need")).groupBy("automation_id").agg(F.collect_list(F.struct("pos", need.alias("need"))).alias("needs"))
    makes = flows.select("automation_id", F.explode("outputs").alias("key")).groupBy("automation_id").agg(F.collect_set("key").alias("makes"))
    stop = flows.where("irreversible").groupBy("automation_id").agg(F.min("pos").alias("stop_at"))
    own = guards.select("automation_id", "trigger_object", "field", "op", "literal")
    return own.join(needs, "automation_id", "left").join(makes, "automation_id", "left").join(stop, "automation_id", "left")


def judged(plans: DataFrame, cases: DataFrame) -> DataFrame:
    """One row for each automation and each case (case_id, object_type, keys, marks, ..., n) that its trigger fits."""
    both = plans.join(cases, F.col("trigger_object") == F.col("object_type"))
    unmet = F.filter("needs", lambda x: ~F.coalesce(F.array_contains(F.col("keys"), x["need"]), F.lit(False)))
    matched = F.filter("marks", lambda m: F.array_contains(F.col("makes"), m["key"]))
    sums = both.withColumns({"unmet": unmet, "matched": matched}).withColumns({
        "broken_at": F.array_min(F.transform("unmet", lambda x: x["pos"])),
        "unresolved": F.array_sort(F.array_distinct(F.array_compact(F.transform("unmet", lambda x: x["need"])))),
        "compared": F.when(F.size("matched") > 0, F.size("matched").cast("long")),
    })

    def weighed(counts) -> Column:
        weights = F.transform("matched", lambda m: F.when(counts(m), F.when(m["key"].isin(*C.CRITICAL_FIELDS), F.lit(C.CRITICAL_WEIGHT)).otherwise(1)).otherwise(0))
        return F.aggregate(weights, F.lit(0), lambda a, b: a + b)

    some = F.col("compared").isNotNull()
    holds = F.col("stop_at").isNotNull() & F.exists("held", lambda h: h["field"].eqNullSafe(F.col("field")) & h["op"].eqNullSafe(F.col("op")) & h["literal"].eqNullSafe(F.col("literal")))
    diff = sums.withColumns({
        "score": F.when(some, F.round(weighed(lambda m: m["same"]) / weighed(lambda m: F.lit(True)), 4)),
        "critical_mismatch": F.when(some, F.array_max(F.transform("matched", lambda m: ~m["same"] & m["key"].isin(*C.CRITICAL_FIELDS)))),
        "diff_fields": F.when(some, F.array_sort(F.transform(F.filter("matched", lambda m: ~m["same"]), lambda m: m["key"]))),
        "holds": holds,
    })
    status = (
        F.when(F.col("broken_at").isNotNull() & (~F.col("holds") | (F.col("broken_at") < F.col("stop_at"))), "failed")
        .when(F.col("holds"), "held")
        .when(~some, "not_comparable")
        .otherwise("ok")
    )
    told = diff.withColumn("status", status)
    correct = (F.col("status") == "held") | ((F.col("status") == "ok") & (F.col("score") >= 0.999) & ~F.col("critical_mismatch"))
    reason = F.when(F.col("status") == "failed", F.concat(F.lit("unresolved: "), F.array_join("unresolved", ", "))).when((F.col("status") == "ok") & ~correct, explain(F.col("diff_fields"), F.col("currency")))
    return told.select("automation_id", "case_id", "n", "status", "score", "critical_mismatch", "compared", F.array_join("diff_fields", ",").alias("diff_fields"), correct.alias("correct"), reason.alias("reason"))


def by_case(flows: DataFrame, guards: DataFrame, first: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, members): one row for each automation and each case of ``n`` instances that its trigger fits, and (instance_id, case_id).

    ``flows`` are steps (automation_id, pos, step_id, outputs, depends_on, irreversible); ``guards``
    (automation_id, trigger_object, field, op, literal); ``first`` (instance_id, object_type) of the
    instances; ``found`` their ``fields``. Steps make what is available; a step that needs what nothing
    gives fails, and a guard that holds stops the run before the first irreversible step. Automations grow with
    the log as instances do, so their product is judged by case: its rows are no more than automations
    times distinct cases.
    """
    every = written(cases(known(found, first), guards), "cases")
    content = ["object_type", "keys", "marks", "currency", "held"]
    alike = every.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in content))
    return written(judged(plans(flows, guards), alike), "judged"), every.select("instance_id", "case_id")


def run(flows: DataFrame, guards: DataFrame, first: DataFrame, found: DataFrame) -> DataFrame:
    """``by_case`` with one row for each automation and each instance: the rows of a case are written out last."""
    return expanded(*by_case(flows, guards, first, found))


def expanded(outcomes: DataFrame, members: DataFrame) -> DataFrame:
    """Outcomes by case as outcomes by instance."""
    return members.join(outcomes, "case_id").select("automation_id", "instance_id", "status", "score", "critical_mismatch", "compared", "diff_fields", "correct", "reason")


def first_of(outcomes: DataFrame, members: DataFrame, shown: int) -> DataFrame:
    """The first ``shown`` instances of every automation (``nth``) with their outcomes; only the first of a case can be among them."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("instance_id"))
    early = members.join(outcomes.select("case_id").distinct(), "case_id", "left_semi").withColumn("place", place).where(F.col("place") <= shown)
    nth = F.row_number().over(Window.partitionBy("automation_id").orderBy("instance_id"))
    return expanded(outcomes, early).withColumn("nth", nth).where(F.col("nth") <= shown)


def guard_holds(at: Column, op: Column, literal: Column) -> Column:
    """Whether a guard on a field holds; never for an absent field, another kind of value or an unknown operator."""
    number, wanted = F.when(~at.startswith('"'), at.try_cast("double")), literal.try_cast("double")
    text = F.regexp_replace(at, '^"|"$', "")
    both = number.isNotNull() & wanted.isNotNull()
    same_text = number.isNull() & wanted.isNull()
    told = (
        F.when(op == "==", F.when(both, number == wanted).when(same_text, text == literal).otherwise(False))
        .when(op == "!=", F.when(both, number != wanted).when(same_text, text != literal).otherwise(True))
        .when(op == ">", F.when(both, number > wanted).when(same_text, text > literal))
        .when(op == ">=", F.when(both, number >= wanted).when(same_text, text >= literal))
        .when(op == "<", F.when(both, number < wanted).when(same_text, text < literal))
        .when(op == "<=", F.when(both, number <= wanted).when(same_text, text <= literal))
    )
    return F.when(at.isNull(), F.lit(False)).otherwise(F.coalesce(told, F.lit(False)))


def failure_modes(outcomes: DataFrame) -> DataFrame:
    """Reasons of failed and disagreeing runs (outcomes by case) by automation, most frequent first (``rank``)."""
    counts = outcomes.where("reason is not null").groupBy("automation_id", "reason").agg(F.sum("n").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("automation_id").orderBy(F.desc("n"), "reason")))


def failures(outcomes: DataFrame, members: DataFrame, shown: int = 25) -> DataFrame:
    """The first failures of every automation, by instance."""
    return first_of(outcomes.where("reason is not null"), members, shown).select("automation_id", "nth", "instance_id", "reason", "diff_fields")


def since(log: DataFrame, days: int, as_of: int | None = None) -> DataFrame:
    """Events of the last ``days`` before ``as_of`` (milliseconds; the log's latest event if none is given), which is included."""
    end = as_of if as_of is not None else log.agg(F.max("ts_ms")).first()[0]
    return log.where(F.lit(False)) if end is None else log.where((F.col("ts_ms") >= end - days * 86_400_000) & (F.col("ts_ms") <= end))


def rehearsed(flows: DataFrame, guards: DataFrame, cases: DataFrame, steps: DataFrame) -> DataFrame:
    """A dry run of each flow on one recorded instance, step by step as far as it would come; nothing is done.

    ``flows`` and ``guards`` are those of ``run``, with ``connector`` and ``type`` of a step; ``cases`` have (automation_id,
    instance_id), one for each flow; ``steps`` are those of the log with payload and token. Beside what ``run`` reads,
    fields may be read by the name that flows give them. Rows: status of the step (ok, failed,
    needs_approval), what it would give, its error, whether it would have had an effect (``would_have``), and the
    status of the whole. A flow whose case has no steps has no rows.
    """
    kept = steps.join(cases.select("instance_id").distinct(), "instance_id", "left_semi")
    found = fields(kept)
    first = kept.where("pos = 1").select("instance_id", "object_type")
    called = field_name(F.col("token"), F.col("key"))
    renamed = found.join(kept.select("instance_id", "pos", "token"), ["instance_id", "pos"]).select("instance_id", "pos", "key", called.alias("name"), "value").where("name <> key and value not in ('null', '\"\"')")
    by_name = renamed.groupBy("instance_id", F.col("name").alias("key")).agg(F.min_by("value", F.struct("pos", "key")).alias("value"), F.lit(0).alias("over"))
    read = available(source_payload(found), trigger_payload(found, first)).withColumn("over", F.lit(1))
    have = written(by_name.unionByName(read).groupBy("instance_id", "key").agg(F.max_by("value", "over").alias("value")), "have")
    plan = flows.join(cases, "automation_id").join(first.select("instance_id"), "instance_id", "left_semi")
    needs = plan.select("automation_id", "instance_id", "pos", F.explode("depends_on").alias("need")).withColumn("need", F.lower(F.substring_index("need", ".", -1)))
    unmet = needs.join(have.select("instance_id", F.lower("key").alias("need")).distinct(), ["instance_id", "need"], "left_anti")
    broken = unmet.groupBy("automation_id", "pos").agg(F.array_sort(F.collect_set("need")).alias("unresolved"))
    gives = plan.select("automation_id", "instance_id", "pos", F.explode("outputs").alias("key")).distinct().join(have.where("value <> 'null'"), ["instance_id", "key"])
    given = gives.groupBy("automation_id", "pos").agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), "value"))), ",").alias("outputs"))
    at = guards.join(cases, "automation_id").join(have.withColumnRenamed("key", "field").withColumnRenamed("value", "at"), ["instance_id", "field"], "left")
    held = at.select("automation_id", guard_holds(F.col("at"), F.col("op"), F.col("literal")).alias("holds"))
    joined = plan.drop("outputs").join(broken, ["automation_id", "pos"], "left").join(given, ["automation_id", "pos"], "left").join(held, "automation_id", "left")
    status = F.when(F.col("irreversible") & F.coalesce("holds", F.lit(False)), "needs_approval").when(F.col("unresolved").isNotNull(), "failed").otherwise("ok")
    told = joined.withColumn("status", status)
    flow = Window.partitionBy("automation_id")
    end = F.min(F.when(F.col("status") != "ok", F.struct("pos", "status"))).over(flow)
    reached = told.withColumn("end", end).where("end is null or pos <= end.pos")
    done = F.col("status") == "ok"
    return reached.select(
        "automation_id", "instance_id", "pos", "step_id", "connector", F.col("type").alias("action"), "status",
        F.when(done, F.coalesce("outputs", F.lit(""))).otherwise("").alias("outputs"),
        F.when(F.col("status") == "failed", F.concat(F.lit("unresolved: "), F.array_join("unresolved", ", "))).alias("error"),
        (done & F.col("irreversible")).alias("would_have"), F.coalesce("end.status", F.lit("ok")).alias("run_status"),
    )
