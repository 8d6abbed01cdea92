"""Queries for lists and reports over the clusters found in the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.operators import governance as V
from loomtrace.operators import replay as R
from loomtrace.operators import reports as P
from loomtrace.operators import scoring as S
from loomtrace.operators.ranks import placed
from loomtrace.plans.adapters import activity, table
from loomtrace.queries import sql
from loomtrace.queries.workflows import recorded, tokens


def clusters(spark, sf_dir):
    """Every cluster with its measures: effort, free text, branches, scores, priority and whether it was dismissed before."""
    steps, runs, found = recorded(spark, sf_dir)
    kept = runs.join(found.select("cluster_id"), "cluster_id", "left_semi")
    toks = tokens(steps, runs, found)
    text = P.free_text(R.fields(steps), toks)
    measured = found.join(S.effort(kept).select("cluster_id", "median_ms", "weekly", "annual_hours", "tax_hours"), "cluster_id").join(text, "cluster_id")
    none = F.lit(0.0)
    scored = measured.withColumn("steps", F.size("signature")).withColumn("automatability", S.automatability(none, none, F.lit(0), F.col("steps"), P.judgement(F.col("ratio"))))
    effort = S.build_effort(F.col("steps"), F.lit(0))
    return scored.select(
        "cluster_id", "signature", "n", "users", "median_ms", "annual_hours", "tax_hours", "ratio", "automatability", effort.alias("build_effort"),
        S.confidence(F.col("n"), F.lit(1.0), F.col("automatability")).alias("confidence"),
        ((F.col("annual_hours") + F.col("tax_hours")) * F.col("automatability") / effort).alias("priority"),
        (F.col("automatability") < C.DO_NOT_AUTOMATE).alias("do_not_automate"), (F.substring("cluster_id", 1, 1) < "4").alias("dismissed"),
    )


def automations(spark, sf_dir):
    """An automation for clusters above the median count, named and graded by what the log says of them."""
    found = recorded(spark, sf_dir)[2]
    return found.where("n >= 10").select(
        F.concat(F.lit("auto_"), "cluster_id").alias("automation_id"), "cluster_id", F.concat(F.lit("Automate "), F.element_at(F.split(F.get("signature", F.lit(0)), ":"), 1)).alias("name"),
        V.level(F.col("n") % 5).alias("trust_level"), F.round(1 / (1 + F.col("users") / F.col("n")), 4).alias("coverage"),
    )


def cluster_list(spark, sf_dir):
    """Clusters by falling priority with their rank by hours and count, their automation (if any) and whether they are recommended."""
    own = automations(spark, sf_dir).groupBy("cluster_id").agg(F.max("automation_id").alias("automation_id"))
    found = clusters(spark, sf_dir).withColumn("annual", F.round("annual_hours", 6))
    by_hours = placed(found, "hours_rank", F.desc("annual"), F.desc("n"), F.asc("cluster_id"))
    ranked = placed(by_hours, "priority_rank", F.asc("do_not_automate"), F.desc(F.round("priority", 6)), F.asc("cluster_id"))
    joined = ranked.join(own, "cluster_id", "left")
    passes = P.passes_gate(F.col("n"), F.lit(1.0), F.col("confidence"))
    return joined.select("cluster_id", "n", "annual", F.round("priority", 6).alias("priority"), "hours_rank", "priority_rank", "automation_id", (passes & ~F.col("dismissed") & ~F.col("do_not_automate")).alias("recommended"))


def cluster_totals(spark, sf_dir):
    """Sums over all clusters."""
    found = P.totals(clusters(spark, sf_dir))
    return found.select("clusters", "automatable", "recommended", F.round("annual_hours", 4).alias("annual_hours"), F.round("tax_hours", 4).alias("tax_hours"))


def cluster_names(spark, sf_dir):
    """Name, description and written procedure of each cluster."""
    steps, runs, found = recorded(spark, sf_dir)
    subject = P.subjects(tokens(steps, runs, found).select("cluster_id", "object_type"), C.NAME_STOPWORDS)
    # two in three are named by their order, the rest by their subject
    entropy = F.when(F.length(F.translate("cluster_id", "0123456789", "")) % 3 == 0, 0.9).otherwise(0.1)
    titled = found.join(subject, "cluster_id", "left").withColumn("name", P.name(F.col("signature"), entropy, F.col("subject"), F.lit("Workflow")))
    return titled.select("cluster_id", "name", P.describe(F.col("signature"), F.col("n"), F.col("users")).alias("description"), P.procedure(F.col("signature"), F.col("name"), F.lit(0.8)).alias("procedure"))


def free_text_clusters(spark, sf_dir):
    """Share of steps with long text in each cluster, the judgement it stands for, and the reason given."""
    steps, runs, found = recorded(spark, sf_dir)
    text = P.free_text(R.fields(steps), tokens(steps, runs, found))
    return text.select("cluster_id", F.round("ratio", 9).alias("ratio"), F.round(P.judgement(F.col("ratio")), 9).alias("judgement"), P.reasoning(F.col("ratio"), F.lit(0), F.lit(0.0)).alias("reasoning"))


def text_samples(spark, sf_dir):
    """The first eight long texts of each cluster."""
    steps, runs, found = recorded(spark, sf_dir)
    return P.text_samples(R.fields(steps), tokens(steps, runs, found))


def global_constants(spark, sf_dir):
    """Fields that have one value in all steps of one application."""
    steps, _, _ = recorded(spark, sf_dir)
    found = R.fields(steps).join(steps.select("instance_id", "pos", "app"), ["instance_id", "pos"])
    return P.global_constants(found.select("instance_id", "pos", F.concat_ws(".", "app", "key").alias("key"), "value"))


def majority_labels(spark, sf_dir):
    """The event type that most steps of each instance have, the first by name of ties."""
    steps, _, _ = recorded(spark, sf_dir)
    return P.majority(steps, "instance_id", "event_type")


def first_last(spark, sf_dir):
    """First and last step of each instance."""
    steps, _, _ = recorded(spark, sf_dir)
    return steps.groupBy("instance_id").agg(F.min_by("token", "pos").alias("first_token"), F.max_by("token", "pos").alias("last_token"), F.min_by("id", "pos").alias("first_id"), F.max_by("id", "pos").alias("last_id"))


def domain_effort(spark, sf_dir):
    """Burden and what automation gives back, by the application that workflows begin in."""
    found = clusters(spark, sf_dir).withColumn("domain", F.substring_index(F.get("signature", F.lit(0)), ":", 1))
    return P.effort_by_group(found, "domain")


def roi_summary(spark, sf_dir):
    """Projected and realised hours over all clusters and automations."""
    return P.roi(clusters(spark, sf_dir), automations(spark, sf_dir))[0]


def roi_rows(spark, sf_dir):
    """Automations with the hours of their cluster, by falling hours."""
    rows = P.roi(clusters(spark, sf_dir), automations(spark, sf_dir))[1]
    return rows.select("automation_id", "trust_level", "coverage", F.round("annual_hours", 6).alias("annual_hours"), F.round("tax_hours", 6).alias("tax_hours"))


def automation_list(spark, sf_dir):
    """Automations by falling coverage and name, with the level distribution beside them."""
    found = automations(spark, sf_dir)
    return placed(found, "place", F.desc("coverage"), F.asc("name"), F.asc("automation_id")).join(found.groupBy("trust_level").agg(F.count(F.lit(1)).alias("at_level")), "trust_level")


def next_sequences(spark, sf_dir):
    """The number of the next shadow run of each brand's automation."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    runs = lines.groupBy(F.col("p_brand").alias("automation_id"), "l_shipdate").agg(F.count(F.lit(1)).alias("sequence"))
    return P.next_sequence(runs, table(spark, sf_dir, "part").select(F.col("p_brand").alias("automation_id")).distinct())


def vocabulary_unions(spark, sf_dir):
    """Per application the fields seen early and late: together, early only, and whether a name repeats."""
    log = activity(spark, sf_dir)
    early = F.col("ts_ms") < 1705276800000
    key = F.concat(F.lit("k"), (F.col("k") % 40).cast("string"))
    sets = log.groupBy("app").agg(F.array_sort(F.collect_set(F.when(early, key))).alias("early"), F.array_sort(F.collect_set(F.when(~early, key))).alias("late"))
    both = F.concat("early", "late")
    return sets.select("app", F.array_join(F.array_sort(F.array_union("early", "late")), ",").alias("together"), F.array_join(F.array_except("early", "late"), ",").alias("early_only"), F.size(F.array_distinct(both)).alias("n_distinct"), (F.size(both) != F.size(F.array_distinct(both))).alias("repeats"))


QUERIES = {f.__name__: f for f in (cluster_list, cluster_totals, cluster_names, free_text_clusters, text_samples, global_constants, majority_labels, first_last, domain_effort, roi_summary, roi_rows, automation_list, next_sequences, vocabulary_unions)}

_CLUSTERS = f"""with {sql.RECORDED}, kept as (select * from runs where cluster_id in (select cluster_id from groups)),
    e0 as (select cluster_id, count(*) as n, count(distinct user_id) as users, trunc(quantile_cont(duration_ms, 0.5))::bigint as median_ms, greatest((max(started_ms) - min(started_ms)) // 86400000, 1) as days, sum(context_switches) as switches from kept group by 1),
    e1 as (select *, n / users / (days / 7.0) as weekly from e0),
    long as (select distinct instance_id, pos from fields where value like '"%' and length(value) - 2 > 40),
    txt as (select cluster_id, count(l.instance_id) / count(*) as ratio from toks t left join long l using (instance_id, pos) group by 1),
    c0 as (select g.cluster_id, g.signature, g.n, g.users, median_ms, median_ms / 3600000.0 * weekly * 48 * e1.users as annual_hours, switches / e1.n * weekly * 48 * e1.users * 4.0 / 60.0 as tax_hours, ratio,
                  greatest(0, least(1, 1 - 0.25 * least(1.0, ratio * 1.4))) as automatability, greatest(1, least(5, 1 + len(g.signature) // 3)) as build_effort
           from groups g join e1 using (cluster_id) join txt using (cluster_id)),
    cl as (select *, (annual_hours + tax_hours) * automatability / build_effort as priority, automatability < 0.4 as do_not_automate, left(cluster_id, 1) < '4' as dismissed from c0),
    auto as (select 'auto_' || cluster_id as automation_id, cluster_id, 'Automate ' || split_part(signature[1], ':', 1) as name, (['OBSERVE', 'SUGGEST', 'SHADOW', 'ASSIST', 'AUTONOMOUS'])[n % 5 + 1] as trust_level,
                    round(1 / (1 + users / n), 4) as coverage from groups where n >= 10)"""
_START, _END = "replace(coalesce(nullif(split_part(signature[1], ':', 3), ''), split_part(signature[1], ':', 1)), '_', ' ')", "replace(coalesce(nullif(split_part(signature[-1], ':', 3), ''), split_part(signature[-1], ':', 1)), '_', ' ')"
_CAP = "upper(left({0}, 1)) || substr({0}, 2)"

ORACLES = {
    "cluster_list": f"""{_CLUSTERS} select cluster_id, n, round(annual_hours, 6) as annual, round(priority, 6) as priority, row_number() over (order by round(annual_hours, 6) desc, n desc, cluster_id) as hours_rank,
        row_number() over (order by do_not_automate, round(priority, 6) desc, cluster_id) as priority_rank, automation_id, not dismissed and not do_not_automate as recommended
        from cl left join (select cluster_id, automation_id from auto) using (cluster_id)""",
    "cluster_totals": f"{_CLUSTERS} select count(*) as clusters, count(*) filter (where not do_not_automate) as automatable, count(*) filter (where not do_not_automate and not dismissed) as recommended, round(sum(annual_hours), 4) as annual_hours, round(sum(tax_hours), 4) as tax_hours from cl",
    "cluster_names": f"""with {sql.RECORDED}, titled as (select *, case when length(regexp_replace(cluster_id, '[0-9]', '', 'g')) % 3 = 0 then 'Workflow' when {_START} = {_END} then {_CAP.format(_START)} || ' handling'
            else {_CAP.format(_START)} || ' to ' || {_END} end as name from groups)
        select cluster_id, name, len(signature) || ' steps across ' || array_to_string(list_transform(list_filter(list_transform(signature, lambda t, i: struct_pack(a := split_part(t, ':', 1), i := i)),
                   lambda e: list_position(list_transform(signature, lambda t: split_part(t, ':', 1)), e.a) = e.i), lambda e: e.a), ' → ') || '. Observed ' || n || ' times by ' || users || ' employee(s).' as description,
               '# ' || name || chr(10) || chr(10) || array_to_string(list_transform(signature, lambda t, i: i || '. ' || {_CAP.format("split_part(t, ':', 2)")} || ' ' || replace(split_part(t, ':', 3), '_', ' ') || ' in ' || split_part(t, ':', 1)), chr(10))
               || chr(10) || chr(10) || 'Recommended for automation.' as procedure from titled""",
    "free_text_clusters": f"""{_CLUSTERS} select cluster_id, round(ratio, 9) as ratio, round(least(1.0, ratio * 1.4), 9) as judgement,
        case when ratio > 0.35 then round(ratio * 100)::bigint || '% of the observed steps carry substantial free text' else 'the steps repeat consistently' end as reasoning from txt""",
    "text_samples": f"""with {sql.RECORDED} select cluster_id, nth, sample from (select cluster_id, substr(value[2:length(value) - 1], 1, 200) as sample, row_number() over (partition by cluster_id order by instance_id, pos, key) as nth
        from fields join toks using (instance_id, pos) where value like '"%' and length(value) - 2 > 40) where nth <= 8""",
    "global_constants": f"with {sql.RECORDED} select app || '.' || key as key, min(fields.value) as value from fields join steps using (instance_id, pos) group by 1 having min(fields.value) = max(fields.value)",
    "majority_labels": f"""with {sql.RECORDED} select instance_id, arg_min(event_type, (-n, event_type)) as label, max(n) as n from (select instance_id, event_type, count(*) as n from steps group by 1, 2) group by 1""",
    "first_last": f"""with {sql.RECORDED} select instance_id, arg_min(token, pos) as first_token, arg_max(token, pos) as last_token, arg_min(id, pos) as first_id, arg_max(id, pos) as last_id
        from (select *, app || ':' || action || ':' || object_type as token from steps) group by 1""",
    "domain_effort": f"""{_CLUSTERS}, d as (select split_part(signature[1], ':', 1) as domain, sum(annual_hours) as a, sum(tax_hours) as t, sum(case when not do_not_automate then (annual_hours + tax_hours) * automatability else 0 end) as r, bool_and(do_not_automate) as none_automatable from cl group by 1)
        select domain, round(a, 1) as annual_hours, round(t, 1) as tax_hours, round(r, 1) as reclaimable_hours, case when a + t > 0 then round(r / (a + t), 3) else 0.0 end as reduction, none_automatable from d""",
    "roi_summary": f"""{_CLUSTERS}, p as (select sum(annual_hours) filter (where not do_not_automate) as projected, sum(tax_hours) filter (where not do_not_automate) as tax, count(*) as clusters, count(*) filter (where not do_not_automate) as automatable from cl),
        r as (select sum(case when trust_level in ('ASSIST', 'AUTONOMOUS') then annual_hours * coverage else 0 end) as realised, sum(case when trust_level in ('ASSIST', 'AUTONOMOUS') then tax_hours * coverage else 0 end) as tax_recovered,
                     count(*) as automations, count(*) filter (where trust_level = 'AUTONOMOUS') as autonomous, avg(coverage) as average_coverage from auto join cl using (cluster_id))
        select round(coalesce(projected, 0), 1) as projected, round(coalesce(tax, 0), 1) as tax, round(coalesce(realised, 0), 1) as realised, round(coalesce(tax_recovered, 0), 1) as tax_recovered, clusters, automatable, automations, autonomous, round(coalesce(average_coverage, 0), 4) as average_coverage from p, r""",
    "roi_rows": f"{_CLUSTERS} select automation_id, trust_level, coverage, round(annual_hours, 6) as annual_hours, round(tax_hours, 6) as tax_hours from auto join cl using (cluster_id)",
    "automation_list": f"{_CLUSTERS} select *, row_number() over (order by coverage desc, name, automation_id) as place, count(*) over (partition by trust_level) as at_level from auto",
    "next_sequences": """with r as (select p_brand as automation_id, l_shipdate, count(*) as sequence from lineitem join part on l_partkey = p_partkey group by 1, 2)
        select automation_id, coalesce(max(sequence), 0) + 1 as next_sequence from (select distinct p_brand as automation_id from part) left join r using (automation_id) group by 1""",
    "vocabulary_unions": f"""with {sql.ACTIVITY}, s as (select app, list_sort(list(distinct 'k' || (k % 40)) filter (where ts_ms < 1705276800000)) as e, list_sort(list(distinct 'k' || (k % 40)) filter (where ts_ms >= 1705276800000)) as l from activity group by 1)
        select app, array_to_string(list_sort(list_distinct(list_concat(e, l))), ',') as together, coalesce(array_to_string(list_filter(e, lambda x: not list_contains(l, x)), ','), '') as early_only,
               len(list_distinct(list_concat(e, l))) as n_distinct, len(list_concat(e, l)) <> len(list_distinct(list_concat(e, l))) as repeats from s""",
}
