"""Flows from observed workflows: steps, dependencies, guards, repair, validation, runtime and export graph.

A flow is rows, one for each step, and everything about its steps is a projection or a window over them;
what spans a flow is an aggregation by ``automation_id``. Flows are short, so a window holds a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions.normalise import lookup

STRINGS = "array<string>"


def _names(values) -> Column:
    return F.array(*map(F.lit, values)).cast(STRINGS)


def _table(table: dict[str, tuple[str, ...]], key: Column, otherwise: tuple[str, ...]) -> Column:
    """The list of a small literal table, or another one."""
    out = _names(otherwise)
    for name, values in table.items():
        out = F.when(key == name, _names(values)).otherwise(out)
    return out


def _before(column: str) -> Column:
    """All values of an array column in the earlier steps of the flow."""
    earlier = Window.partitionBy("automation_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.flatten(F.collect_list(column).over(earlier)), F.array().cast(STRINGS))


def field_name(token: Column, key: Column) -> Column:
    """What a field is called: collectors' ``value`` and ``target`` by the step's object, renamed columns by their field."""
    kind = F.split(token, ":")[2]
    generic = key.isin("value", "target") & F.coalesce(kind != "", F.lit(False))
    return F.coalesce(lookup(C.FIELD_ALIASES, key), F.when(generic, kind), key)


def observed_fields(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """(cluster_id, token, fields): sorted names of the fields seen on a token, without those of the observation itself.

    ``found`` are payload fields (instance_id, pos, key, value), ``tokens`` (cluster_id, instance_id, pos, token).
    """
    named = found.where(~F.col("key").isin(*C.METADATA_KEYS)).join(tokens, ["instance_id", "pos"])
    return named.groupBy("cluster_id", "token").agg(F.array_sort(F.collect_set(field_name(F.col("token"), F.col("key")))).alias("fields"))


def irreversible(kind: Column, connector: Column) -> Column:
    return kind.isin(*C.IRREVERSIBLE_ACTIONS) | ((kind == "create") & ~connector.isin(*C.LOCAL_CONNECTORS))


def steps_of(clusters: DataFrame, fields: DataFrame) -> DataFrame:
    """A step for each token of each cluster's representative (cluster_id, signature), which makes what was seen on it.

    It depends on what it was seen to use and an earlier step has made, else on what its action usually needs
    of that; decisions are made, never read.
    """
    tokens = clusters.select(F.col("cluster_id").alias("automation_id"), F.posexplode("signature").alias("at", "token"))
    parts = F.split("token", ":")
    seen = tokens.join(fields.select(F.col("cluster_id").alias("automation_id"), "token", "fields"), ["automation_id", "token"], "left")
    drawn = seen.select(
        "automation_id", (F.col("at") + 1).alias("pos"), "token", F.concat(F.lit("s"), (F.col("at") + 1).cast("string")).alias("step_id"),
        parts[0].alias("connector"), F.coalesce(parts[1], F.lit("read")).alias("type"), F.coalesce(parts[2], F.lit("unknown")).alias("object_type"),
        F.coalesce("fields", F.array().cast(STRINGS)).alias("seen"),
    )
    made = drawn.withColumn("outputs", F.when(F.size("seen") > 0, F.col("seen")).otherwise(_table(C.ACTION_OUTPUTS, F.col("type"), ("result",))))
    known = made.withColumn("before", _before("outputs"))
    used = F.array_except(F.array_intersect("seen", "before"), _names(C.DECISION_FIELDS))
    usual = F.array_intersect(_table(C.ACTION_NEEDS, F.col("type"), ()), F.col("before"))
    depends = F.when(F.col("pos") == 1, F.array().cast(STRINGS)).when(F.size(used) > 0, used).otherwise(usual)
    return known.select(
        "automation_id", "pos", "step_id", "connector", "type", "object_type",
        F.concat("type", F.lit(" "), F.translate("object_type", "_", " "), F.lit(" in "), "connector").alias("description"),
        "outputs", depends.alias("depends_on"), irreversible(F.col("type"), F.col("connector")).alias("irreversible"),
    )


def constants_guard(constants: DataFrame) -> DataFrame:
    """(cluster_id, field, literal): the first decision-like field that had one value in every run (cluster_id, name, value)."""
    base = F.regexp_replace("name", "[_0-9]+$", "")
    order = F.array_position(_names(C.GUARD_FIELDS), base)
    found = constants.where((F.coalesce("value", F.lit("")) != "") & (order > 0))
    return found.groupBy("cluster_id").agg(F.min_by(F.struct(base.alias("field"), F.col("value").alias("literal")), F.struct(order, "name", "value")).alias("g")).select("cluster_id", "g.*")


def guards_of(steps: DataFrame, constants: DataFrame) -> DataFrame:
    """Trigger, irreversible steps and approval guard of each flow (field, op, literal; null without one).

    Money that the flow makes is guarded by a limit; else a constant of the observed runs must hold.
    """
    made = steps.groupBy("automation_id").agg(
        F.array_distinct(F.flatten(F.collect_list("outputs"))).alias("makes"),
        F.min_by(F.struct("connector", "object_type"), "pos").alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("irreversible"), F.struct("pos", "step_id")))).alias("held"),
    )
    money = F.get(F.filter(_names(C.MONEY_FIELDS), lambda m: F.array_contains(F.col("makes"), m)), F.lit(0))
    joined = made.join(constants_guard(constants).withColumnRenamed("cluster_id", "automation_id"), "automation_id", "left").withColumn("money", money)
    field, literal = F.coalesce("money", "field"), F.when(F.col("money").isNotNull(), F.lit(str(C.MONEY_LIMIT))).otherwise(F.col("literal"))
    op = F.when(F.col("money").isNotNull(), ">").when(F.col("field").isNotNull(), "!=")
    return joined.select(
        "automation_id", F.coalesce(lookup(C.TRIGGERS, F.col("first.connector")), F.lit("manual")).alias("trigger_type"), F.col("first.object_type").alias("trigger_object"),
        F.transform("held", lambda h: h["step_id"]).alias("irreversible_steps"), field.alias("field"), op.alias("op"), literal.alias("literal"),
    )


def guard_text(field: Column, op: Column, literal: Column) -> Column:
    return F.concat_ws(" ", field, op, literal)


def sanitise(raw: DataFrame, fallback: DataFrame) -> DataFrame:
    """Steps as someone proposed them, repaired so that they can run.

    Ids are places; the system a step works on is the observed one; observed fields join what a step makes; a
    step may depend only on fields that the log has and an earlier step makes, else on what the observed
    flow depends on there.
    """
    own = fallback.select("automation_id", "pos", F.col("connector").alias("real"), F.col("outputs").alias("seen"), F.col("depends_on").alias("usual"))
    vocabulary = fallback.groupBy("automation_id").agg(F.array_distinct(F.flatten(F.collect_list("outputs"))).alias("vocabulary"))
    joined = raw.join(own, ["automation_id", "pos"], "left").join(vocabulary, "automation_id", "left")
    nothing = F.array().cast(STRINGS)
    kind = F.coalesce("type", F.lit("read"))
    listed = F.when(F.size(F.coalesce("outputs", nothing)) > 0, F.col("outputs")).otherwise(_table(C.ACTION_OUTPUTS, kind, ("result",)))
    filled = joined.withColumns({"outputs": F.array_union(listed, F.coalesce("seen", nothing)), "connector": F.coalesce("real", "connector", F.lit("browser")), "type": kind})
    known = filled.withColumn("before", _before("outputs"))

    def grounded(d: Column) -> Column:
        last = F.substring_index(d, ".", -1)
        return F.array_contains(F.col("before"), last) & F.array_contains(F.col("vocabulary"), last)

    kept = F.filter(F.coalesce("depends_on", nothing), grounded)
    usual = F.filter(F.coalesce("usual", nothing), lambda d: F.array_contains(F.col("before"), d))
    depends = F.when(F.col("pos") == 1, nothing).when(F.size(kept) > 0, kept).otherwise(usual)
    return known.select(
        "automation_id", "pos", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("step_id"), "connector", "type", "outputs",
        depends.alias("depends_on"), irreversible(F.col("type"), F.col("connector")).alias("irreversible"),
    )


def _finding(rows: DataFrame, check: str, message: Column, blocking: bool = True) -> DataFrame:
    return rows.select("automation_id", F.coalesce("step_id", F.lit("")).alias("step_id"), F.lit(check).alias("check"), message.alias("message"), F.lit(blocking).alias("blocking"))


def validate(steps: DataFrame, guards: DataFrame, tokens: DataFrame, expected: DataFrame, methods: DataFrame) -> DataFrame:
    """All findings about flows (automation_id, step_id, check, message, blocking): what the log contradicts or can't run.

    ``guards`` (automation_id, guard, irreversible_steps) as proposed; ``tokens`` (automation_id, connector,
    type) of the observed signatures; ``expected`` (automation_id, guard) by the observation; ``methods``
    (automation_id, method) chosen.
    """
    absent = guards.join(steps, "automation_id", "left_anti").withColumn("step_id", F.lit(""))
    nameless = steps.where("coalesce(step_id, '') = ''")
    bare = steps.where("coalesce(step_id, '') <> '' and (coalesce(connector, '') = '' or coalesce(type, '') = '')")
    double = steps.where("coalesce(step_id, '') <> ''").groupBy("automation_id", "step_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = steps.select("automation_id", "pos", "step_id", "connector", "type", "outputs", "depends_on")
    strange = known.join(tokens.select("automation_id", "connector").distinct(), ["automation_id", "connector"], "left_anti")
    unseen = known.join(tokens.select("automation_id", "connector").distinct(), ["automation_id", "connector"], "left_semi").join(tokens.distinct(), ["automation_id", "connector", "type"], "left_anti")
    unmet = known.withColumn("before", _before("outputs")).select("automation_id", "step_id", F.explode(F.filter("depends_on", lambda d: ~F.array_contains(F.col("before"), F.substring_index(d, ".", -1)))).alias("need"))
    both = guards.select("automation_id", F.trim(F.coalesce("guard", F.lit(""))).alias("guard")).join(expected.select("automation_id", F.trim(F.coalesce("guard", F.lit(""))).alias("wanted")), "automation_id").withColumn("step_id", F.lit(""))
    weak = both.where("wanted <> '' and guard <> wanted")
    held = guards.select("automation_id", F.explode("irreversible_steps").alias("step_id"))
    lost = held.join(steps.select("automation_id", "step_id"), ["automation_id", "step_id"], "left_anti")
    cannot = feasibility(steps, methods).where("why is not null").withColumn("step_id", F.lit(""))
    parts = [
        _finding(absent, "schema", F.lit("the flow has no steps")),
        _finding(nameless, "schema", F.concat(F.lit("step "), F.col("pos").cast("string"), F.lit(" has no id"))),
        _finding(bare, "schema", F.lit("a connector or an action is missing")),
        _finding(double, "schema", F.lit("the step id is used more than once")),
        _finding(strange, "connector_not_observed", F.concat(F.lit("nothing was observed in "), "connector")),
        _finding(unseen, "action_not_observed", F.concat(F.lit("never observed: "), "connector", F.lit(":"), "type"), blocking=False),
        _finding(unmet, "dependency_unresolved", F.concat(F.lit("no earlier step makes "), "need")),
        _finding(weak, "guard_weakened", F.concat(F.lit("observed guard "), "wanted", F.lit(" against "), F.when(F.col("guard") == "", "none").otherwise(F.col("guard")))),
        _finding(lost, "guard_orphaned", F.lit("the guard names a step that does not exist")),
        _finding(cannot, "executor_infeasible", F.col("why")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def connector_counts(steps: DataFrame) -> DataFrame:
    """By flow: steps, those without an API, with local work, with a workflow node, and with both an API and a node."""
    no_api, node = F.col("connector").isin(*C.NO_API_CONNECTORS), F.col("connector").isin(*C.NODE_TYPES)
    return steps.groupBy("automation_id").agg(
        F.count(F.lit(1)).alias("n_steps"), F.count_if(no_api).alias("no_api"), F.count_if(F.col("connector").isin(*C.LOCAL_WORK_CONNECTORS)).alias("local"),
        F.count_if(node).alias("nodes"), F.count_if(node & ~no_api).alias("api"),
    )


def choose_method(steps: DataFrame) -> DataFrame:
    """The runtime of each flow by what its connectors allow, before what is convenient, and how sure that is."""
    n, no_api, local, nodes, api = (F.col(c) for c in ("n_steps", "no_api", "local", "nodes", "api"))
    both, browser, script, graph = (no_api > 0) & (api > 0), no_api > 0, local * 2 >= n, nodes == n
    method = F.when(both, "hybrid").when(browser, "playwright").when(script, "python").when(graph, "n8n").otherwise("python")
    sure = F.when(both, 0.87).when(browser, 0.9).when(script, 0.85).when(graph, 0.88).otherwise(0.7)
    return connector_counts(steps).select("automation_id", method.alias("method"), sure.alias("confidence"), "n_steps", "no_api", "local", "nodes", "api")


def feasibility(steps: DataFrame, methods: DataFrame) -> DataFrame:
    """(automation_id, method, why): why a chosen runtime can't run a flow; null if it can."""
    m, browser = F.col("method"), F.col("no_api") > 0
    why = (
        F.when((m == "n8n") & browser, F.lit("a step needs a browser, which a workflow graph has not"))
        .when((m == "python") & browser, F.lit("a script can't drive a user interface"))
        .when((m == "hybrid") & ~browser, F.lit("no step needs a browser"))
        .when((m == "hybrid") & (F.col("api") == 0), F.lit("every step needs a browser"))
        .when((m == "n8n") & (F.col("nodes") < F.col("n_steps")), F.concat((F.col("n_steps") - F.col("nodes")).cast("string"), F.lit(" step(s) map to no node")))
        .when(~m.isin("python", "playwright", "n8n", "hybrid"), F.lit("unknown runtime"))
    )
    return methods.join(connector_counts(steps), "automation_id").select("automation_id", "method", why.alias("why"))


def graph(steps: DataFrame, guards: DataFrame) -> DataFrame:
    """Nodes of the exported workflow in order with the one that follows: trigger, steps, and the guard before the first irreversible step."""
    rank = F.row_number().over(Window.partitionBy("automation_id").orderBy("place"))
    trigger = guards.select("automation_id", F.lit(0.0).alias("place"), F.lit("trigger").alias("node"), F.lit("trigger").alias("kind"))
    own = steps.select("automation_id", F.col("pos").cast("double").alias("place"), F.col("step_id").alias("node"), F.coalesce(lookup(C.NODE_TYPES, F.col("connector")), F.lit("noOp")).alias("kind"))
    first = steps.where("irreversible").groupBy("automation_id").agg((F.min("pos") - 0.5).alias("place"))
    hold = guards.where("field is not null").join(first, "automation_id").select("automation_id", "place", F.lit("guard").alias("node"), F.lit("if").alias("kind"))
    nodes = trigger.unionByName(own).unionByName(hold).withColumn("nth", rank)
    after = F.lead("node").over(Window.partitionBy("automation_id").orderBy("nth"))
    account = F.exists(_names(C.ACCOUNT_NODES), lambda a: F.endswith(F.col("kind"), a))
    return nodes.select("automation_id", "nth", "node", "kind", after.alias("next_node"), account.alias("needs_account"), (F.col("kind") == "noOp").alias("placeholder"))


def _longest_first(samples: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted((p for p in samples if p[0]), key=lambda p: -len(p[0]))


def templatise(text: Column, samples: list[tuple[str, str]]) -> Column:
    """Observed values of (sample, name) replaced by ``{{name}}``, the longest first; the samples of one flow are few."""
    for sample, name in _longest_first(samples):
        text = F.replace(text, F.lit(sample), F.lit("{{" + name + "}}"))
    return text


def template_parts(text: Column, samples: list[tuple[str, str]]) -> Column:
    """The text from left to right as literals and ``values['name']``, joined by `` + ``; the quoted text if no sample is in it.

    At each place the longest sample that begins there counts: one alternation, longest first, cuts the text.
    """
    import re

    ranked = _longest_first(samples)
    if not ranked:
        return F.concat(F.lit("'"), text, F.lit("'"))
    pattern = "|".join(re.escape(sample) for sample, _ in ranked)
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    named = F.transform(hits, lambda h: F.concat(F.lit("values['"), lookup({s: n for s, n in reversed(ranked)}, h), F.lit("']")))
    quoted = F.transform(between, lambda b: F.when(b != "", F.concat(F.lit("'"), b, F.lit("'"))))
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.size(between) - 1), lambda i: F.array(F.get(quoted, i), F.get(named, i))))
    return F.when(F.size(hits) == 0, F.concat(F.lit("'"), text, F.lit("'"))).otherwise(F.array_join(F.array_compact(pieces), " + "))


def note(number: Column, amount: Column, filed: Column) -> Column:
    """What a run did, from the fields it resolved (amount in minor units); null if there is nothing to say."""
    parts = F.concat_ws(
        " — ",
        F.when(number != "", F.concat(F.lit("Filed invoice "), number)),
        F.when(amount.isNotNull(), F.concat(F.lit("total INR "), F.format_number(amount / 100, 2))),
        F.when(filed != "", F.concat(F.lit("saved to "), filed)),
    )
    return F.when(parts != "", F.concat(parts, F.lit(" (filed automatically)")))
