"""Governance: the trust ladder, coverage, exceptions and learned rules, drift remapping, returns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomtrace import constants as C
from loomtrace.operators.replay import first_of
from loomtrace.sources.shared import written


#: Parts of one automation's runs that are ranked apart before they are ranked together.
SALTS = 64


def rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, C.TRUST_LEVELS)), level).cast("int") - 1


def level(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, C.TRUST_LEVELS)), F.greatest(F.lit(0), F.least(F.lit(len(C.TRUST_LEVELS) - 1), number)).cast("int") + 1)


def trust_state(shadow_runs: DataFrame, automations: DataFrame) -> DataFrame:
    """Evaluation of each automation's last runs: promotion, demotion, confidence and what blocks it.

    ``shadow_runs`` (automation_id, sequence, score, critical), ``automations`` (automation_id, trust_level).
    """
    # the newest few runs of a salted part, then of the automation: no task sorts all runs of one automation
    salted = shadow_runs.withColumn("part", F.pmod(F.xxhash64("sequence", "score", "critical"), F.lit(SALTS)))
    recent = salted
    for by in (["automation_id", "part"], ["automation_id"]):
        newest = Window.partitionBy(*by).orderBy(F.desc("sequence"))
        recent = recent.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= C.SHADOW_WINDOW)
    sums = recent.groupBy("automation_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("score").alias("average"),
        F.count_if("critical").alias("criticals"),
        F.count_if(F.col("critical") & (F.col("nth") <= C.DEMOTE_LOOKBACK)).alias("late_criticals"),
    )
    return evaluated(automations.join(sums, "automation_id", "left").fillna(0, ["n", "average", "criticals", "late_criticals"]))


def evaluated(sums: DataFrame, *more: str) -> DataFrame:
    """What the policy says of automations (automation_id, trust_level, n, average, criticals, late_criticals), with ``more`` columns."""
    ready = (F.col("n") >= C.PROMOTE_RUNS) & (F.col("average") >= C.PROMOTE_SCORE) & (F.col("criticals") == 0)
    at = rank(F.col("trust_level"))
    percent = F.concat(F.bround(F.round("average", 9) * 100).cast("long").cast("string"), F.lit("%"))
    blockers = F.array_compact(
        F.array(
            F.when(F.col("n") < C.PROMOTE_RUNS, F.concat(F.lit("needs "), (C.PROMOTE_RUNS - F.col("n")).cast("string"), F.lit(" more shadow run(s)"))),
            F.when(F.col("average") < C.PROMOTE_SCORE, F.concat(F.lit("rolling average is "), percent, F.lit(f", needs {C.PROMOTE_SCORE:.0%}"))),
            F.when(F.col("criticals") > 0, F.concat(F.col("criticals").cast("string"), F.lit(" critical field mismatch(es) in the last "), F.col("n").cast("string"), F.lit(" run(s)"))),
        )
    )
    top = F.when(at == len(C.TRUST_LEVELS) - 1, F.lit("already at the top of the ladder"))
    down = (F.col("late_criticals") > 0) & (at > 0)
    return sums.select(
        "automation_id", *more, "trust_level", "n",
        F.round("average", 6).alias("average"),
        (ready & (at < len(C.TRUST_LEVELS) - 1)).alias("can_promote"),
        down.alias("must_demote"),
        F.when(down, level(at - 1)).otherwise(F.col("trust_level")).alias("enforced_level"),
        F.round(F.col("average") * F.least(F.lit(1.0), F.col("n") / C.PROMOTE_RUNS), 6).alias("confidence"),
        F.coalesce(top, F.array_join(blockers, "; ")).alias("blockers"),
    )


def moved(state: DataFrame, requests: DataFrame) -> DataFrame:
    """One rung up or down: demotion always, promotion where it was asked for and is earned or forced.

    ``state`` is a ``trust_state``, ``requests`` (automation_id, force) of operators. The reason is the
    line of the audit trail; null where nothing moves.
    """
    asked = state.join(requests.groupBy("automation_id").agg(F.max("force").alias("force")), "automation_id", "left")
    at = rank(F.col("trust_level"))
    up = ~F.col("must_demote") & F.col("force").isNotNull() & (at < len(C.TRUST_LEVELS) - 1) & (F.col("can_promote") | F.col("force"))
    reason = F.when(F.col("must_demote"), C.DEMOTED).when(up & F.col("can_promote"), "policy satisfied").when(up, "manual override by operator")
    return asked.select("automation_id", "trust_level", F.when(F.col("must_demote"), level(at - 1)).when(up, level(at + 1)).otherwise(F.col("trust_level")).alias("new_level"), reason.alias("reason"))


def score_trend(shadow_runs: DataFrame, stretch: int = 4096) -> DataFrame:
    """Running mean of scores in order of sequence (1, 2, ...).

    Sums inside stretches of the sequence and sums of whole stretches before them: a task sorts one
    stretch, not all runs of an automation. Decimals, so that sums are exact in whatever order.
    """
    runs = shadow_runs.select("*", F.col("score").cast("decimal(18,6)").alias("exact"), F.floor((F.col("sequence") - 1) / stretch).alias("stretch"))
    whole = runs.groupBy("automation_id", "stretch").agg(F.sum("exact").alias("total"), F.count("exact").alias("n"))
    earlier = Window.partitionBy("automation_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("automation_id", "stretch", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("total_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"))
    order = Window.partitionBy("automation_id", "stretch").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    running = runs.join(before, ["automation_id", "stretch"]).select("*", F.sum("exact").over(order).alias("own"), F.count("exact").over(order).alias("own_n"))
    mean = (F.col("total_before") + F.col("own")).cast("double") / (F.col("n_before") + F.col("own_n"))
    return running.withColumn("trend", F.round(mean, 6)).drop("exact", "stretch", "total_before", "n_before", "own", "own_n")


def signature_key(amount: Column, currency: Column, unresolved: Column, status: Column) -> Column:
    """Features of an exception as one key; ``unclassified`` if there are none."""
    bucket = F.when(amount > 1_000_000, "amount_over_10k").when(amount > 500_000, "amount_500k_to_1m").when(amount > 0, "amount_under_500k")
    foreign = F.when((currency != "") & (F.upper(currency) != "INR"), "foreign_currency")
    key = F.concat_ws("|", bucket, foreign, F.when(unresolved, "unresolved_dependency"), F.when(status != "", F.concat(F.lit("status_"), status)))
    return F.when(key == "", "unclassified").otherwise(key)


def routes_to_human(action: Column) -> Column:
    """Whether an action still hands the case to a person."""
    return F.lower(action).rlike("|".join(C.HUMAN_WORDS))


def rule_proposals(cases: DataFrame, known: DataFrame) -> DataFrame:
    """For keys with enough resolved cases and no rule yet: condition, modal decision, evidence and confidence.

    ``cases`` (automation_id, signature_key, status, decision, amount, currency); the condition is on the
    least amount, without amounts on a foreign currency, else on an unresolved dependency.
    """
    resolved = cases.where("status = 'resolved'")
    counts = resolved.groupBy("automation_id", "signature_key", "decision").agg(F.count(F.lit(1)).alias("n"), F.min("amount").alias("least"), F.max((F.col("currency") != "") & ~F.upper("currency").isin("INR", "NONE")).alias("foreign"))
    groups = counts.groupBy("automation_id", "signature_key").agg(
        F.sum("n").alias("evidence"), F.min("least").alias("least"), F.max("foreign").alias("foreign"),
        F.coalesce(F.min_by("decision", F.when(F.col("decision").isNotNull(), F.struct(-F.col("n"), F.col("decision")))), F.lit("route_to_manager")).alias("action"),
    )
    by_amount, by_currency = F.col("least").isNotNull(), F.coalesce("foreign", F.lit(False))
    condition = F.when(by_amount, F.concat(F.lit("amount > "), (F.col("least").cast("long") - 1).cast("string"))).when(by_currency, 'currency != "INR"').otherwise("unresolved == true")
    found = groups.where(F.col("evidence") >= C.RULE_SAMPLES).join(known, ["automation_id", "signature_key"], "left_anti")
    return found.select("automation_id", "signature_key", "evidence", condition.alias("condition"), "action", F.when(by_amount, 0.82).when(by_currency, 0.85).otherwise(0.6).alias("confidence"))


def with_rules(rules: DataFrame, accepted: DataFrame) -> DataFrame:
    """The rules of flows (automation_id, condition, action, source, signature_key, evidence) with accepted proposals, one a condition."""
    learned = accepted.select("automation_id", "condition", "action", F.lit("learned").alias("source"), "signature_key", "evidence")
    first = Window.partitionBy("automation_id", "condition").orderBy("signature_key", "action")
    once = learned.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return rules.unionByName(once.join(rules.select("automation_id", "condition"), ["automation_id", "condition"], "left_anti"))


def matching_rules(rules: DataFrame, values: DataFrame, by: str) -> DataFrame:
    """(automation_id, by, condition, action) of the rules (automation_id, condition, action, field, op, literal) that hold for the values (automation_id, by, key, value)."""
    from loomtrace.operators.replay import guard_holds

    joined = rules.join(values.select("automation_id", by, F.col("key").alias("field"), "value"), ["automation_id", "field"])
    return joined.where(guard_holds(F.col("value"), F.col("op"), F.col("literal"))).select("automation_id", by, "condition", "action")


def coverage(automations: DataFrame, cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Share of the triggers that need no person: held runs less the part that learned rules finish by themselves.

    ``automations`` (automation_id, replay_total, replay_human, shadow_runs), ``cases`` (automation_id,
    signature_key, status), ``rules`` (automation_id, source, action, signature_key).
    """
    encoded = rules.where((F.col("source") == "learned") & ~routes_to_human(F.col("action")) & (F.coalesce("signature_key", F.lit("")) != "")).select("automation_id", "signature_key", F.lit(True).alias("encoded")).distinct()
    marked = cases.join(encoded, ["automation_id", "signature_key"], "left")
    resolved = F.col("status") == "resolved"
    sums = marked.groupBy("automation_id").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(resolved).alias("resolved"), F.count_if(resolved & F.col("encoded")).alias("done"))
    joined = automations.join(sums, "automation_id", "left").fillna(0, ["cases", "open", "resolved", "done"])
    replayed = F.col("replay_total") > 0
    sample = F.when(replayed, F.col("replay_total")).otherwise(F.greatest("shadow_runs", "cases"))
    human = F.when(replayed, F.col("replay_human")).otherwise(F.col("open"))
    remaining = F.greatest(F.lit(0.0), human - human * F.least(F.lit(1.0), F.col("done") / F.greatest(F.col("resolved"), F.lit(1))))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - remaining / sample))
    return joined.select("automation_id", sample.alias("sample"), remaining.alias("remaining"), F.when(sample > 0, F.round(share, 4)).otherwise(0.0).alias("coverage"))


def seeded_cases(outcomes: DataFrame, members: DataFrame, readable: DataFrame, count: int = 4) -> DataFrame:
    """Exceptions from the first instances of each automation that a guard held, with the fields a person decides on.

    ``outcomes`` and ``members`` are those of ``replay.by_case``.
    """
    held = first_of(outcomes.where("status = 'held'"), members, count).select("automation_id", "instance_id")
    wanted = readable.where(F.col("key").isin("amount", "currency", "vendor")).groupBy("instance_id").agg(*(F.max(F.when(F.col("key") == k, F.regexp_replace("value", '^"|"$', ""))).alias(k) for k in ("amount", "currency", "vendor")))
    cases = held.join(wanted, "instance_id", "left")
    key = signature_key(F.col("amount").try_cast("double"), F.coalesce("currency", F.lit("")), F.lit(False), F.lit(""))
    return cases.select("automation_id", "instance_id", "amount", "currency", "vendor", key.alias("signature_key"), F.lit("open").alias("status"))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def _ratio(a: str, b: str) -> float:
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """Likeness of two names by the words they share and the rest of each; 1 if one has all words of the other."""
    x, y = set(a.lower().split()), set(b.lower().split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 1.0
    first, second = (f"{both} {rest}".strip() for rest in (left, right))
    return max(_ratio(first, second), _ratio(both, first) if both else 0.0, _ratio(both, second) if both else 0.0)


@F.pandas_udf(DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)])


def remap(missing: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """The best of the fields now seen for each missing one of the same ``by``, with confidence and whether it may be applied unattended.

    A known synonym, else a name with all its words (the shortest), else the likest, which is never certain
    enough. ``missing`` has (by..., step_type, field), ``seen`` (by..., candidate): pairs are of one system.
    """
    lower, other = F.lower("field"), F.lower("candidate")
    pairs = missing.join(seen, by)
    ranks = [F.when(lower.isin(*group) & other.isin(*group), F.lit(100 * g) + F.array_position(F.array(*map(F.lit, group)), other)) for g, group in enumerate([k, *v] for k, v in C.FIELD_SYNONYMS.items())]
    words = [F.filter(F.split(x, "[^a-z0-9]+"), lambda w: w != "") for x in (lower, other)]
    contained = (F.size(words[0]) > 0) & (F.size(F.array_except(words[0], words[1])) == 0)
    ranked = pairs.select(*by, "step_type", "field", "candidate", F.coalesce(*ranks).alias("synonym"), contained.alias("contained"), F.size(F.array_distinct(words[1])).alias("words"), _likeness("field", "candidate").alias("alike"))
    kind = F.when(F.col("synonym").isNotNull(), 0).when(F.col("contained"), 1).otherwise(2)
    place = F.when(kind == 0, F.col("synonym").cast("double")).when(kind == 1, F.col("words").cast("double")).otherwise(-F.col("alike"))
    sure = F.when(kind == 0, C.SYNONYM_CONFIDENCE).when(kind == 1, C.CONTAINED_CONFIDENCE).otherwise(F.least(F.lit(C.FUZZY_CONFIDENCE), F.col("alike")))
    best = ranked.groupBy(*by, "step_type", "field").agg(F.min_by(F.struct("candidate", F.round(sure, 3).alias("confidence")), F.struct(kind, place, F.col("candidate"))).alias("b"))
    safe = ~F.col("step_type").isin(*C.IRREVERSIBLE_ACTIONS)
    return best.select(*by, "step_type", "field", "b.candidate", "b.confidence", ((F.col("b.confidence") >= C.AUTO_APPLY) & safe).alias("auto_applicable"))


def patched(steps: DataFrame, patches: DataFrame) -> DataFrame:
    """Steps (automation_id, step_id, depends_on, ...) that depend on the new names of patches (automation_id, step_id, field, candidate)."""
    names = patches.groupBy("automation_id", "step_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "candidate"))).alias("names"))
    renamed = F.transform("depends_on", lambda d: F.coalesce(F.try_element_at(F.col("names"), d), d))
    return steps.join(names, ["automation_id", "step_id"], "left").withColumn("depends_on", F.when(F.col("names").isNull(), F.col("depends_on")).otherwise(renamed)).drop("names")


def unresolved(steps: DataFrame, readable: DataFrame) -> DataFrame:
    """(automation_id, step_id, app, step_type, field): what steps depend on that neither an earlier step makes nor the system (app, candidate) has."""
    earlier = Window.partitionBy("automation_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    made = F.coalesce(F.flatten(F.collect_list("outputs").over(earlier)), F.array().cast("array<string>"))
    asked = steps.withColumn("made", made).select("automation_id", "step_id", F.col("connector").alias("app"), F.col("type").alias("step_type"), F.explode(F.array_except("depends_on", "made")).alias("field"))
    return asked.join(readable.select("app", F.col("candidate").alias("field")), ["app", "field"], "left_anti")


def proposals(steps: DataFrame, readable: DataFrame, existing: DataFrame) -> DataFrame:
    """Patches for what steps depend on and their system no longer has, but for those that are already up for review.

    ``existing`` are patches (automation_id, step_id, field, status). An applied or rejected patch of the same field
    doesn't hold a new one back: the field went missing again.
    """
    queued = existing.where("status = 'proposed'").select("automation_id", "step_id", "field").distinct()
    open_ = unresolved(steps, readable).join(queued, ["automation_id", "step_id", "field"], "left_anti")
    best = remap(open_.select("app", "step_type", "field").distinct(), readable, ["app"])
    return open_.join(best, ["app", "step_type", "field"]).select("automation_id", "step_id", "field", "candidate", "confidence", "auto_applicable")


def named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows with the name of their automation (automation_id, name); empty where there is none, any longer."""
    return rows.join(names.select("automation_id", "name"), "automation_id", "left").withColumn("name", F.coalesce("name", F.lit("")))


def heal(steps: DataFrame, readable: DataFrame, passes: int = C.HEAL_PASSES) -> tuple[DataFrame, DataFrame]:
    """(healed steps, all patches with ``applied``): safe patches are applied until nothing is left that one could heal."""
    applied = None
    open_ = unresolved(steps, readable)
    for _ in range(passes):
        proposed = written(open_.join(remap(open_.select("app", "step_type", "field").distinct(), readable, ["app"]), ["app", "step_type", "field"]), "patches")
        safe = proposed.where("auto_applicable")
        if safe.isEmpty():
            break
        applied = safe if applied is None else applied.unionByName(safe)
        steps = written(patched(steps, safe), "healed")
        open_ = unresolved(steps, readable)
    left = proposed.where("not auto_applicable").withColumn("applied", F.lit(False))
    return steps, left if applied is None else applied.withColumn("applied", F.lit(True)).unionByName(left)
