"""Queries over recorded workflows: payload folds, generated flows, validation, runtimes, export and replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions.normalise import step_token
from loomtrace.operators import generator as G
from loomtrace.operators import governance as V
from loomtrace.operators import replay as R
from loomtrace.operators.flows import replay_summary
from loomtrace.operators.sessions import instances, sessionise
from loomtrace.plans.adapters import RENAMED_MS, activity, payloads, table
from loomtrace.queries import sql
from loomtrace.sources.shared import written


def recorded(spark, sf_dir):
    """(steps, runs, clusters): the log cut into instances, and those of a frequent signature as clusters."""
    steps = written(sessionise(payloads(activity(spark, sf_dir)), sql.GAP).withColumn("token", step_token()), "steps")
    runs = instances(steps.drop("payload", "token")).withColumn("cluster_id", F.col("signature_hash"))
    return steps, runs, frequent(runs)


def frequent(runs):
    """Runs of one frequent signature as clusters."""
    found = runs.groupBy("cluster_id").agg(F.first("signature").alias("signature"), F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return found.where((F.col("n") >= C.STRONG_INSTANCES) & (F.size("signature") >= C.MIN_STEPS))


def tokens(steps, runs, clusters):
    """(cluster_id, instance_id, pos, token, ...) of the steps of all clusters' instances."""
    kept = runs.select("instance_id", "cluster_id").join(clusters.select("cluster_id"), "cluster_id", "left_semi")
    return steps.join(kept, "instance_id").select("cluster_id", "instance_id", "pos", "token", "app", "action", "object_type", "id", "ts_ms")


def payload_folds(spark, sf_dir):
    """What each instance began with, may be read of it, and ended in, field by field."""
    steps, _, _ = recorded(spark, sf_dir)
    found = R.fields(steps)
    first = steps.where("pos = 1").select("instance_id", "object_type")
    folds = {"outcome": R.observed_outcome(found), "trigger": R.trigger_payload(found, first), "source": R.source_payload(found)}
    out = None
    for name, fold in folds.items():
        part = fold.select(F.lit(name).alias("fold"), "instance_id", "key", "value")
        out = part if out is None else out.unionByName(part)
    return out


def _flows(spark, sf_dir):
    """(steps, guards, fields, recorded...) of the flows generated for all clusters."""
    steps, runs, _ = recorded(spark, sf_dir)
    runs = written(runs, "runs")
    clusters = frequent(runs)
    found, toks = R.fields(steps), tokens(steps, runs, clusters)
    flow = written(G.steps_of(clusters, G.observed_fields(found, toks)), "flow")
    values = found.join(toks.select("cluster_id", "instance_id", "pos", "token"), ["instance_id", "pos"]).groupBy("cluster_id", G.field_name(F.col("token"), F.col("key")).alias("name")).agg(F.min("value").alias("value"), F.max("value").alias("high"))
    constants = values.where("value = high").select("cluster_id", "name", F.regexp_replace("value", '^"|"$', "").alias("value"))
    return flow, G.guards_of(flow, constants), steps, runs, clusters, toks


def flow_steps(spark, sf_dir):
    """The generated flow of every cluster, step by step."""
    flow = _flows(spark, sf_dir)[0]
    return flow.select("automation_id", "pos", "step_id", "description", F.array_join("outputs", ",").alias("outputs"), F.array_join("depends_on", ",").alias("depends_on"), "irreversible")


def flow_guards(spark, sf_dir):
    """Trigger, approval guard and irreversible steps of every flow."""
    guards = _flows(spark, sf_dir)[1]
    return guards.select("automation_id", "trigger_type", "trigger_object", F.array_join("irreversible_steps", ",").alias("irreversible_steps"), G.guard_text(F.col("field"), F.col("op"), F.col("literal")).alias("guard"))


def _proposed(flow):
    """Flows as a careless author would hand them in: other systems, echoed ids, made-up fields, by the hash of the flow."""
    n = F.conv(F.substring("automation_id", 1, 2), 16, 10).cast("int") % 4
    odd = F.col("pos") % 2 == 0
    return flow.select(
        "automation_id", "pos",
        F.when((n == 0) & (F.col("pos") == 3), F.lit("s2")).otherwise(F.col("step_id")).alias("step_id"),
        F.when((n == 1) & odd, F.lit("fax")).otherwise(F.col("connector")).alias("connector"),
        F.when((n == 2) & odd, F.lit("delete")).otherwise(F.col("type")).alias("type"),
        F.when(n == 3, F.array(F.lit("page_data"))).otherwise(F.col("outputs")).alias("outputs"),
        F.when(odd, F.array(F.lit("flow.k"), F.lit("page_data"))).otherwise(F.col("depends_on")).alias("depends_on"),
    )


def flow_repair(spark, sf_dir):
    """Proposed flows repaired against what was observed."""
    flow = _flows(spark, sf_dir)[0]
    fixed = G.sanitise(_proposed(flow), flow)
    return fixed.select("automation_id", "pos", "step_id", "connector", "type", F.array_join(F.array_sort("outputs"), ",").alias("outputs"), F.array_join("depends_on", ",").alias("depends_on"), "irreversible")


def validate_findings(spark, sf_dir):
    """What the log contradicts in the proposed flows, and what can't run as a workflow graph."""
    flow, guards, _, _, clusters, _ = _flows(spark, sf_dir)
    text = G.guard_text(F.col("field"), F.col("op"), F.col("literal"))
    n = F.conv(F.substring("automation_id", 1, 2), 16, 10).cast("int") % 4
    handed = guards.select("automation_id", F.when(n == 2, F.lit("")).otherwise(text).alias("guard"), F.when(n == 0, F.concat("irreversible_steps", F.array(F.lit("s99")))).otherwise(F.col("irreversible_steps")).alias("irreversible_steps"))
    observed = clusters.select(F.col("cluster_id").alias("automation_id"), F.explode("signature").alias("t")).select("automation_id", F.split("t", ":")[0].alias("connector"), F.split("t", ":")[1].alias("type")).distinct()
    methods = guards.select("automation_id", F.when(n == 0, F.lit("hybrid")).otherwise(F.lit("n8n")).alias("method"))
    return G.validate(_proposed(flow), handed, observed, guards.select("automation_id", text.alias("guard")), methods).distinct()


def plan_method(spark, sf_dir):
    """The runtime of every flow by what its systems offer."""
    return G.choose_method(_flows(spark, sf_dir)[0])


def flow_graph(spark, sf_dir):
    """Nodes and edges of every flow as a workflow graph."""
    flow, guards, *_ = _flows(spark, sf_dir)
    return G.graph(flow, guards)


_SAMPLES = [("1-URGENT", "priority"), ("5-LOW", "priority"), ("URGENT", "tone"), ("3-MEDIUM", "priority"), ("Customer", "role")]


def _letter():
    return F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit(" asked: "), "o_orderpriority", F.lit(", customer URGENT"))


def templated_text(spark, sf_dir):
    """Written sentences with observed values as placeholders, as expressions, and as notes of what was filed."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _letter().alias("text"), "o_totalprice", "o_orderstatus")
    number = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")))
    amount, filed = F.when(F.col("o_orderkey") % 5 != 0, F.floor("o_totalprice") * 100), F.when(F.col("o_orderstatus") == "F", F.lit("archive/2024"))
    return orders.select("o_orderkey", G.templatise(F.col("text"), _SAMPLES).alias("template"), G.template_parts(F.col("text"), _SAMPLES).alias("expression"), G.note(number, amount, filed).alias("note"))


def _replayed(spark, sf_dir):
    """(outcomes of the flows of all workflows by case, instances of the cases, fields of the steps); the fields are written, since every fold reads them."""
    flow, guards, steps, _, _, _ = _flows(spark, sf_dir)
    first = steps.where("pos = 1").select("instance_id", "object_type")
    found = written(R.fields(steps), "fields")
    return *R.by_case(flow, guards.select("automation_id", "trigger_object", "field", "op", "literal"), first, found), found


def replay_runs(spark, sf_dir):
    """Every run of all flows against all instances: status, score, differing fields and reason."""
    return R.expanded(*_replayed(spark, sf_dir)[:2])


def replay_totals(spark, sf_dir):
    """The backtest of each automation."""
    return replay_summary(_replayed(spark, sf_dir)[0], "automation_id", "n")


def replay_modes(spark, sf_dir):
    """Why runs failed, most frequent reasons first."""
    return R.failure_modes(_replayed(spark, sf_dir)[0])


def replay_failures(spark, sf_dir):
    """The first 25 failures of each automation."""
    return R.failures(*_replayed(spark, sf_dir)[:2])


def exception_seeds(spark, sf_dir):
    """Exceptions from the first runs of each automation that its guard held."""
    outcomes, members, found = _replayed(spark, sf_dir)
    return V.seeded_cases(outcomes, members, R.source_payload(found))


#: Days that a replay looks back.
DAYS = 10


def replay_range(spark, sf_dir):
    """Every run of all flows against the instances of the log's last ten days."""
    flow, guards, *_ = _flows(spark, sf_dir)
    steps = sessionise(R.since(payloads(activity(spark, sf_dir)), DAYS), sql.GAP)
    found = written(R.fields(steps), "fields")
    return R.run(flow, guards.select("automation_id", "trigger_object", "field", "op", "literal"), steps.where("pos = 1").select("instance_id", "object_type"), found)


def dry_runs(spark, sf_dir):
    """A dry run of each flow on the first recorded instance of its workflow."""
    flow, guards, steps, runs, clusters, _ = _flows(spark, sf_dir)
    cases = runs.join(clusters.select("cluster_id"), "cluster_id", "left_semi").groupBy(F.col("cluster_id").alias("automation_id")).agg(F.min("instance_id").alias("instance_id"))
    return R.rehearsed(flow, guards.select("automation_id", "field", "op", "literal"), cases, steps)


def _old_names(flow, log):
    """Steps that depend on every field that their system had in the early log, and the fields that it has now."""
    keys = log.select("app", "ts_ms", F.explode(F.map_keys("payload")).alias("key"))
    early, late = keys.where(F.col("ts_ms") < RENAMED_MS), keys.where(F.col("ts_ms") >= RENAMED_MS)
    asked = early.groupBy(F.col("app").alias("connector")).agg(F.array_sort(F.collect_set("key")).alias("depends_on"))
    nothing = F.array().cast("array<string>")
    steps = flow.select("automation_id", "pos", "step_id", "connector", "type", nothing.alias("outputs")).join(asked, "connector")
    return steps, late.select("app", F.col("key").alias("candidate")).distinct()


def drift_patches(spark, sf_dir):
    """Patches for the fields that were renamed, but for those under review: first steps have an open patch of Vendor, second ones an applied one."""
    flow = _flows(spark, sf_dir)[0]
    steps, readable = _old_names(flow, payloads(activity(spark, sf_dir)))
    existing = steps.where("pos <= 2").select("automation_id", "step_id", F.lit("Vendor").alias("field"), F.when(F.col("pos") == 1, "proposed").otherwise("applied").alias("status"))
    return V.proposals(steps, written(readable, "schema"), existing).select("automation_id", "step_id", "field", "candidate", "auto_applicable")


def rule_matches(spark, sf_dir):
    """How often each learned rule holds for what instances offer, and whether it still needs a person."""
    steps, _, _ = recorded(spark, sf_dir)
    offered = R.source_payload(R.fields(steps)).withColumn("automation_id", F.lit("a1"))
    rules = spark.createDataFrame([("a1", "amount > 900000", "route_to_manager", "amount", ">", "900000"), ("a1", "vendor == v3", "file", "vendor", "==", "v3"), ("a1", "k != 5", "Escalate", "k", "!=", "5"), ("a1", "nothing >= 1", "file", "nothing", ">=", "1")], "automation_id string, condition string, action string, field string, op string, literal string")
    hits = V.matching_rules(rules, offered, "instance_id").groupBy("condition", "action").agg(F.count(F.lit(1)).alias("n"))
    return hits.withColumn("human", V.routes_to_human(F.col("action")))


def drift_remap(spark, sf_dir):
    """Fields that the early log has and the recent one lacks, by application, with what replaces them."""
    log = payloads(activity(spark, sf_dir))
    keys = log.select("app", "ts_ms", F.explode(F.map_keys("payload")).alias("key")).groupBy("app", "key").agg(F.min("ts_ms").alias("low"), F.max("ts_ms").alias("high"))
    recent = keys.where(F.col("high") >= 1705276800000).select("app", F.col("key").alias("candidate"))
    gone = keys.where(F.col("high") < 1705276800000).select("app", F.lit("read").alias("step_type"), F.col("key").alias("field"))
    return V.remap(gone, recent, ["app"])


def healed_flows(spark, sf_dir):
    """Flows that depend on fields by their old names, healed against the recent schema."""
    log = payloads(activity(spark, sf_dir)).where("ts_ms >= 1705276800000")
    readable = written(log.select("app", F.explode(F.map_keys("payload")).alias("candidate")).distinct(), "schema")
    nothing = F.array().cast("array<string>")
    apps = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "purchase", "erp").when(F.col("event_type") == "signup", "crm").when(F.col("event_type") == "view", "gmail").otherwise("sheets").alias("connector")).distinct()
    flow = apps.select(F.concat(F.lit("f_"), "connector").alias("automation_id"), F.lit(1).alias("pos"), F.lit("s1").alias("step_id"), "connector", F.when(F.col("connector") == "erp", "send").otherwise("read").alias("type"), nothing.alias("outputs"), F.array(F.lit("Vendor"), F.lit("k"), F.lit("status")).alias("depends_on"))
    steps, patches = V.heal(flow, readable)
    told = patches.groupBy("automation_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("field", F.lit(">"), "candidate", F.when(F.col("applied"), F.lit("")).otherwise(F.lit("?"))))), ",").alias("patches"))
    return steps.join(told, "automation_id", "left").select("automation_id", F.array_join("depends_on", ",").alias("depends_on"), F.coalesce("patches", F.lit("")).alias("patches"))


QUERIES = {f.__name__: f for f in (payload_folds, flow_steps, flow_guards, flow_repair, validate_findings, plan_method, flow_graph, templated_text, replay_runs, replay_totals, replay_modes, replay_failures, exception_seeds, replay_range, dry_runs, drift_patches, rule_matches, drift_remap, healed_flows)}

_WITH = f"with {sql.RECORDED}, {sql.FLOWS}"
_STABLE = "case when key in ('Vendor', 'Supplier Name') then 'vendor' else key end"
_FOLDS = f"""first as (select instance_id, object_type from steps where pos = 1),
    outcome as (select instance_id, {_STABLE} as key, arg_max(value, pos) as value from fields group by 1, 2),
    trig0 as (select instance_id, key, value, 1 as over from fields where pos = 1
              union all select instance_id, 'vendor', value, 2 from fields where pos = 1 and key in ('Vendor', 'Supplier Name')
              union all select instance_id, 'body', '"' || object_type || ' received"', 0 from first union all select instance_id, 'recipient', '"finance-ap@northwind.example"', 0 from first),
    trig as (select instance_id, key, arg_max(value, over) as value from trig0 group by 1, 2),
    readable as (select * from fields where key not in ('status', 'amount_inr', 'approval', 'note')),
    src as (select instance_id, key, arg_min(value, turn) as value from (
                select instance_id, {_STABLE} as key, value, pos as turn from readable union all select instance_id, key, value, -pos from readable where key in ('Vendor', 'Supplier Name')) group by 1, 2)"""
_N = "(('0x' || left(automation_id, 2))::int % 4)"
_PROPOSED = f"""prop as (
        select automation_id, pos, case when {_N} = 0 and pos = 3 then 's2' else step_id end as step_id, case when {_N} = 1 and pos % 2 = 0 then 'fax' else connector end as connector,
               case when {_N} = 2 and pos % 2 = 0 then 'delete' else type end as type, case when {_N} = 3 then ['page_data'] else outputs end as outputs,
               case when pos % 2 = 0 then ['flow.k', 'page_data'] else depends_on end as depends_on from flow)"""
_RUNS = f"""{_FOLDS}, have as (select instance_id as iid, key, arg_max(value, over) as value from (select *, 0 as over from src union all select *, 1 from trig) group by 1, 2),
    chosen as (select cluster_id as automation_id from groups),
    r as (select automation_id, instance_id, field, op, literal from first join guard on object_type = trigger_object where automation_id in (select automation_id from chosen)),
    needs as (select automation_id, pos, unnest(depends_on) as need from flow),
    unmet as (select r.automation_id, r.instance_id, min(pos) as broken_at, list_sort(list(distinct lower(need))) as unresolved from r join needs using (automation_id)
              where not exists (select 1 from have h where h.iid = r.instance_id and lower(h.key) = lower(need)) group by 1, 2),
    stops as (select automation_id, min(pos) as stop_at from flow where irreversible group by 1),
    pred as (select r.automation_id, r.instance_id, h.key, h.value from r join (select distinct automation_id, unnest(outputs) as key from flow) m using (automation_id) join have h on h.iid = r.instance_id and h.key = m.key),
    judged as (select p.automation_id, p.instance_id, p.key, p.key in ('amount', 'amount_inr', 'vendor', 'supplier', 'po_number', 'recipient', 'status', 'requester', 'system') as crit,
                      case when try_cast(p.value as double) is not null and try_cast(o.value as double) is not null
                               then abs(try_cast(p.value as double) - try_cast(o.value as double)) / greatest(abs(try_cast(p.value as double)), abs(try_cast(o.value as double)), 1.0) <= 0.01
                           else lower(trim(p.value)) = lower(trim(o.value)) end as same
               from pred p join outcome o using (instance_id, key)),
    diff as (select automation_id, instance_id, round(sum(case when same then case when crit then 2 else 1 end else 0 end) / sum(case when crit then 2 else 1 end), 4) as score, bool_or(not same and crit) as critical_mismatch,
                    count(*) as compared, coalesce(list_sort(list(key) filter (where not same)), []) as wrong from judged group by 1, 2),
    j as (select r.*, h.value as cur, broken_at, unresolved, stop_at, score, critical_mismatch, compared, wrong from r left join have h on h.iid = r.instance_id and h.key = r.field
          left join unmet using (automation_id, instance_id) left join stops using (automation_id) left join diff using (automation_id, instance_id)),
    g as (select *, stop_at is not null and cur is not null and coalesce(case op when '>' then try_cast(cur as double) > try_cast(literal as double) when '!=' then trim(cur, '"') <> literal end, false) as holds from j),
    st as (select *, case when broken_at is not null and (not holds or broken_at < stop_at) then 'failed' when holds then 'held' when coalesce(compared, 0) = 0 then 'not_comparable' else 'ok' end as status from g),
    ok as (select *, status = 'held' or (status = 'ok' and score >= 0.999 and not critical_mismatch) as correct from st),
    ran as (select automation_id, instance_id, status, score, critical_mismatch, compared, array_to_string(wrong, ',') as diff_fields, correct,
                   case when status = 'failed' then 'unresolved: ' || array_to_string(unresolved, ', ')
                        when status = 'ok' and not correct then case when len(wrong) = 0 then 'no field disagreement' else coalesce(nullif(concat_ws('; ',
                             case when list_contains(wrong, 'amount') then 'amount extracted differs from the amount the human recorded' end,
                             case when list_contains(wrong, 'vendor') then 'vendor name resolved differently (likely a renamed source column)' end,
                             case when list_contains(wrong, 'status') then 'outcome status differs; this instance likely required a judgement call' end), ''), 'disagreement on ' || array_to_string(wrong, ', ')) end end as reason from ok)"""

ORACLES = {
    "payload_folds": f"""with {sql.RECORDED}, {_FOLDS} select 'outcome' as fold, * from outcome union all select 'trigger', * from trig union all select 'source', * from src""",
    "flow_steps": f"{_WITH} select automation_id, pos, step_id, description, array_to_string(outputs, ',') as outputs, array_to_string(depends_on, ',') as depends_on, irreversible from flow",
    "flow_guards": f"""{_WITH} select automation_id, trigger_type, trigger_object, array_to_string(irreversible_steps, ',') as irreversible_steps, concat_ws(' ', field, op, literal) as guard from guard""",
    "flow_repair": f"""{_WITH}, {_PROPOSED}, v as (select automation_id, list_distinct(flatten(list(outputs))) as vocabulary from flow group by 1),
        f as (select p.automation_id, p.pos, f.connector, p.type, list_distinct(list_concat(p.outputs, f.outputs)) as outputs, p.depends_on, f.depends_on as usual, vocabulary from prop p join flow f using (automation_id, pos) join v using (automation_id)),
        k as (select *, coalesce(flatten(list(outputs) over (partition by automation_id order by pos rows between unbounded preceding and 1 preceding)), []) as before from f),
        d as (select *, list_filter(depends_on, lambda x: list_contains(before, split_part(x, '.', -1)) and list_contains(vocabulary, split_part(x, '.', -1))) as kept from k)
        select automation_id, pos, 's' || pos as step_id, connector, type, array_to_string(list_sort(outputs), ',') as outputs,
               array_to_string(case when pos = 1 then [] when len(kept) > 0 then kept else list_filter(usual, lambda x: list_contains(before, x)) end, ',') as depends_on,
               type in ('send', 'delete') or (type = 'create' and connector not in ('files', 'pdf', 'git', 'desktop', 'browser')) as irreversible from d""",
    "validate_findings": f"""{_WITH}, {_PROPOSED}, seen_t as (select distinct automation_id, connector, type from flow),
        made2 as (select *, coalesce(flatten(list(outputs) over (partition by automation_id order by pos rows between unbounded preceding and 1 preceding)), []) as before from prop),
        gt as (select automation_id, concat_ws(' ', field, op, literal) as wanted, case when {_N} = 2 then '' else concat_ws(' ', field, op, literal) end as has, case when {_N} = 0 then list_concat(irreversible_steps, ['s99']) else irreversible_steps end as held from guard),
        cnt as (select automation_id, count(*) as n, count(*) filter (where connector in ('browser', 'desktop')) as no_api, count(*) filter (where connector in ('gmail', 'sheets', 'erp', 'crm', 'slack')) as nodes from prop group by 1)
        select distinct * from (
        select automation_id, step_id, 'schema' as "check", 'the step id is used more than once' as message, true as blocking from prop group by automation_id, step_id having count(*) > 1
        union all select automation_id, step_id, 'connector_not_observed', 'nothing was observed in ' || connector, true from prop p where not exists (select 1 from seen_t s where s.automation_id = p.automation_id and s.connector = p.connector)
        union all select automation_id, step_id, 'action_not_observed', 'never observed: ' || connector || ':' || type, false from prop p where exists (select 1 from seen_t s where s.automation_id = p.automation_id and s.connector = p.connector)
            and not exists (select 1 from seen_t s where s.automation_id = p.automation_id and s.connector = p.connector and s.type = p.type)
        union all select automation_id, step_id, 'dependency_unresolved', 'no earlier step makes ' || need, true from (select automation_id, step_id, unnest(list_filter(depends_on, lambda d: not list_contains(before, split_part(d, '.', -1)))) as need from made2)
        union all select automation_id, '', 'guard_weakened', 'observed guard ' || wanted || ' against ' || case when has = '' then 'none' else has end, true from gt where wanted <> '' and has <> wanted
        union all select g.automation_id, sid, 'guard_orphaned', 'the guard names a step that does not exist', true from (select automation_id, unnest(held) as sid from gt) g where not exists (select 1 from prop p where p.automation_id = g.automation_id and p.step_id = sid)
        union all select automation_id, '', 'executor_infeasible', case when {_N} = 0 then 'no step needs a browser' else (n - nodes) || ' step(s) map to no node' end, true from cnt where {_N} = 0 or nodes < n)""",
    "plan_method": f"""{_WITH}, c as (select automation_id, count(*) as n_steps, count(*) filter (where connector in ('browser', 'desktop')) as no_api, count(*) filter (where connector in ('files', 'pdf', 'git')) as local,
            count(*) filter (where connector in ({", ".join(f"'{c}'" for c in C.NODE_TYPES)})) as nodes from flow group by 1)
        select automation_id, case when no_api > 0 then 'hybrid' when local * 2 >= n_steps then 'python' when nodes = n_steps then 'n8n' else 'python' end as method,
               case when no_api > 0 then 0.87 when local * 2 >= n_steps then 0.85 when nodes = n_steps then 0.88 else 0.7 end as confidence, n_steps, no_api, local, nodes, nodes as api from c""",
    "flow_graph": f"""{_WITH}, nodes as (select automation_id, 0.0 as place, 'trigger' as node, 'trigger' as kind from guard
            union all select automation_id, pos, step_id, case connector when 'gmail' then 'gmail' when 'sheets' then 'googleSheets' when 'erp' then 'httpRequest' when 'crm' then 'httpRequest' when 'slack' then 'slack' else 'noOp' end from flow
            union all select automation_id, min(pos) - 0.5, 'guard', 'if' from flow join guard using (automation_id) where irreversible and field is not null group by 1),
        n as (select *, row_number() over (partition by automation_id order by place) as nth from nodes)
        select automation_id, nth, node, kind, lead(node) over (partition by automation_id order by nth) as next_node, kind in ('gmail', 'googleSheets', 'slack') as needs_account, kind = 'noOp' as placeholder from n""",
    "templated_text": """with t as (select *, 'Customer ' || o_custkey || ' asked: ' || o_orderpriority || ', customer URGENT' as text from orders),
        p as (select *, case o_orderpriority when '1-URGENT' then 'priority' when '5-LOW' then 'priority' when '3-MEDIUM' then 'priority' end as hit from t)
        select o_orderkey, '{{role}} ' || o_custkey || ' asked: ' || case when hit is null then o_orderpriority else '{{priority}}' end || ', customer {{tone}}' as template,
               'values[''role''] + '' ' || o_custkey || ' asked: ' || case when hit is null then o_orderpriority else ''' + values[''priority''] + ''' end || ', customer '' + values[''tone'']' as expression,
               nullif(concat_ws(' — ', case when o_orderkey % 3 <> 0 then 'Filed invoice INV-' || o_orderkey end, case when o_orderkey % 5 <> 0 then 'total INR ' || format('{:,.2f}', floor(o_totalprice)) end,
                      case when o_orderstatus = 'F' then 'saved to archive/2024' end), '') || ' (filed automatically)' as note from p""",
    "replay_runs": f"{_WITH}, {_RUNS} select * from ran",
    "replay_totals": f"""{_WITH}, {_RUNS} select automation_id, count(*) as total, count(*) filter (where correct) as correct, count(*) filter (where status = 'failed') as errored, count(*) filter (where status = 'not_comparable') as not_comparable,
        case when count(*) filter (where status <> 'not_comparable') > 0 then floor(count(*) filter (where correct) / count(*) filter (where status <> 'not_comparable') * 10000) / 10000 else 0 end as accuracy from ran group by 1""",
    "replay_modes": f"{_WITH}, {_RUNS} select *, row_number() over (partition by automation_id order by n desc, reason) as rank from (select automation_id, reason, count(*) as n from ran where reason is not null group by 1, 2)",
    "replay_failures": f"{_WITH}, {_RUNS} select automation_id, nth, instance_id, reason, diff_fields from (select *, row_number() over (partition by automation_id order by instance_id) as nth from ran where reason is not null) where nth <= 25",
    "exception_seeds": f"""{_WITH}, {_RUNS}, h as (select automation_id, instance_id from (select *, row_number() over (partition by automation_id order by instance_id) as nth from ran where status = 'held') where nth <= 4),
        w as (select instance_id, max(case when key = 'amount' then trim(value, '"') end) as amount, max(case when key = 'currency' then trim(value, '"') end) as currency, max(case when key = 'vendor' then trim(value, '"') end) as vendor from src group by 1)
        select automation_id, instance_id, amount, currency, vendor, case when amount::double > 1000000 then 'amount_over_10k' when amount::double > 500000 then 'amount_500k_to_1m' when amount::double > 0 then 'amount_under_500k' else 'unclassified' end as signature_key,
               'open' as status from h left join w using (instance_id)""",
    "rule_matches": f"""with {sql.RECORDED}, {_FOLDS} select * from (select 'amount > 900000' as condition, 'route_to_manager' as action, count(*) as n, true as human from src where key = 'amount' and try_cast(value as double) > 900000
        union all select 'vendor == v3', 'file', count(*), false from src where key = 'vendor' and value = '"v3"' union all select 'k != 5', 'Escalate', count(*), true from src where key = 'k' and try_cast(value as double) <> 5) where n > 0""",
    "replay_range": f"""{_WITH}, late as (select * from activity where ts_ms >= (select max(ts_ms) from activity) - {DAYS} * 86400000::bigint)
        select * from (with {sql.RECORDED.replace(sql.ACTIVITY, " activity as (select * from late)")}, {_RUNS.replace("from groups)", "from (select automation_id as cluster_id from guard))")} select * from ran)""",
    "dry_runs": f"""{_WITH}, {_RUNS}, picked as (select cluster_id as automation_id, min(instance_id) as instance_id from runs where cluster_id in (select cluster_id from groups) group by 1),
        lack as (select automation_id, pos, list_sort(list(distinct lower(need))) as unresolved from picked join needs using (automation_id)
                 where not exists (select 1 from have h where h.iid = picked.instance_id and lower(h.key) = lower(need)) group by 1, 2),
        gives as (select automation_id, pos, string_agg(entry, ',' order by entry) as outputs from (select distinct f.automation_id, f.pos, h.key || '=' || h.value as entry
                  from (select automation_id, pos, unnest(outputs) as key from flow) f join picked p using (automation_id) join have h on h.iid = p.instance_id and h.key = f.key) group by 1, 2),
        st2 as (select p.automation_id, p.instance_id, f.pos, step_id, connector, type, irreversible, unresolved, gives.outputs as given,
                  case when irreversible and cur is not null and coalesce(case op when '>' then try_cast(cur as double) > try_cast(literal as double) when '!=' then trim(cur, '"') <> literal end, false) then 'needs_approval'
                       when unresolved is not null then 'failed' else 'ok' end as status
                from picked p join flow f using (automation_id) left join lack on lack.automation_id = p.automation_id and lack.pos = f.pos left join gives on gives.automation_id = p.automation_id and gives.pos = f.pos
                left join (select automation_id, op, literal, h.value as cur from picked join guard using (automation_id) left join have h on h.iid = instance_id and h.key = field) q on q.automation_id = p.automation_id),
        ends as (select automation_id, min(pos) as last, arg_min(status, pos) as run_status from st2 where status <> 'ok' group by 1)
        select automation_id, instance_id, pos, step_id, connector, type as action, status, case when status = 'ok' then coalesce(given, '') else '' end as outputs,
               case when status = 'failed' then 'unresolved: ' || array_to_string(unresolved, ', ') end as error, status = 'ok' and irreversible as would_have, coalesce(run_status, 'ok') as run_status
        from st2 left join ends using (automation_id) where last is null or pos <= last""",
    "drift_patches": f"""{_WITH}, every as (select app, unnest([case when ts_ms >= 1705276800000 and app = 'gmail' then 'item k' else 'k' end, 'amount', case when ts_ms >= 1705276800000 and app = 'crm' then 'state' else 'status' end,
                  case when ts_ms >= 1705276800000 then 'Supplier Name' else 'Vendor' end, 'remark']) as key,
                unnest([k is not null, app in ('erp', 'sheets') and value is not null, true, app in ('erp', 'crm') and k is not null, k % 7 = 0]) as there, ts_ms >= 1705276800000 as late from activity),
        schema as (select app, key, bool_or(late) as now, bool_or(not late) as before from every where there group by 1, 2),
        gone as (select app, key as field from schema where before and not now),
        best as (select app, field, arg_min(key, (kind, -alike, key)) as candidate, min(kind) as kind from (
                 select g.app, field, s.key, case when field = 'Vendor' and s.key = 'Supplier Name' then 0 when list_contains(string_split(s.key, ' '), field) then 1 else 2 end as kind, jaro_similarity(field, s.key) as alike
                 from gone g join schema s on s.app = g.app and s.now) group by 1, 2)
        select automation_id, step_id, field, candidate, kind < 2 and type not in ('send', 'delete') as auto_applicable from flow join best on app = connector where not (pos = 1 and field = 'Vendor')""",
}
