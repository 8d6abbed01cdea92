"""Queries around flows and governance: guards, comparison, replay, trust, coverage, rules, drift, returns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.operators import flows as W
from loomtrace.operators import governance as G
from loomtrace.operators import reports
from loomtrace.plans.adapters import table
from loomtrace.queries import sql

GUARDS = ["amount > 25000", "priority == 1-URGENT", "flow.discount <= 0.05", "missing != 1", "returnflag != A", "quantity >= 10", "not a guard"]


def _facts(spark, sf_dir):
    """Each line as a map of what a flow would see."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    seen = F.create_map(
        F.lit("amount"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), F.lit("priority"), F.col("o_orderpriority"),
        F.lit("discount"), F.format_string("%.2f", "l_discount"), F.lit("returnflag"), F.col("l_returnflag"), F.lit("quantity"), F.col("l_quantity").cast("long").cast("string"),
    )
    return lines.withColumn("seen", seen)


def guard_eval(spark, sf_dir):
    """How many lines each guard holds back."""
    rows = _facts(spark, sf_dir)
    sums = rows.agg(*(F.count_if(W.guard(g, F.col("seen"))).alias(f"g{i}") for i, g in enumerate(GUARDS)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("guard"), F.col(f"g{i}").alias("n")) for i in range(len(GUARDS))))).alias("x")).select("x.*")


def _predictions(spark, sf_dir):
    """What a flow predicts for each line, compared with what happened."""
    rows = _facts(spark, sf_dir)
    money = "decimal(18,2)"
    flag = F.when(F.col("l_linestatus") == "O", " n ").otherwise(F.col("l_returnflag"))
    fields = {
        "amount": ((F.col("l_extendedprice") * (1 + F.col("l_tax") / 10)).cast(money).cast("double"), F.col("l_extendedprice").cast(money).cast("double"), True),
        "returnflag": (flag, F.col("l_returnflag"), False),
        "quantity": (F.col("l_quantity").cast("long"), F.col("l_quantity").cast("long"), True),
    }
    return W.compare(rows, fields)


def diff_compare(spark, sf_dir):
    """Distribution of comparison outcomes."""
    return _predictions(spark, sf_dir).groupBy("score", "critical_mismatch", "compared", "diff_fields").agg(F.count(F.lit(1)).alias("n"))


def _outcomes(spark, sf_dir):
    held = F.col("l_extendedprice").cast("decimal(18,2)") > 60000
    status = F.when(held, "held").when(F.col("l_quantity") >= 49, "failed").when(F.col("l_linenumber") == 7, "not_comparable").otherwise("ok")
    return _predictions(spark, sf_dir).select(F.col("o_orderpriority").alias("automation_id"), status.alias("status"), ((F.col("score") >= 0.999) & ~F.col("critical_mismatch")).alias("correct"), "diff_fields")


def replay_summary(spark, sf_dir):
    return W.replay_summary(_outcomes(spark, sf_dir), "automation_id")


def run_tallies(spark, sf_dir):
    """Runs of each automation by how they ended."""
    return reports.tallies(_outcomes(spark, sf_dir))


def failure_modes(spark, sf_dir):
    """Most frequent reasons of replay failures."""
    reason = F.when(F.col("status") == "failed", "error").otherwise(F.concat(F.lit("differs: "), "diff_fields"))
    failures = _outcomes(spark, sf_dir).where("status = 'failed' or (status = 'ok' and not correct)").groupBy("automation_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("automation_id").orderBy(F.desc("n"), "reason"))
    return failures.withColumn("rank", rank).where("rank <= 3")


def _shadow(spark, sf_dir):
    """Shadow runs: one automation per brand, its lines in order of date."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    # numbers inside a day, and the runs of the days before: no task sorts all lines of a brand
    order = Window.partitionBy("p_brand", "l_shipdate").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    earlier = Window.partitionBy("p_brand").orderBy("l_shipdate").rowsBetween(Window.unboundedPreceding, -1)
    days = lines.groupBy("p_brand", "l_shipdate").agg(F.count(F.lit(1)).alias("n")).select("p_brand", "l_shipdate", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = lines.join(days, ["p_brand", "l_shipdate"]).withColumn("sequence", (F.col("before") + F.row_number().over(order)).cast("long"))
    return numbered.select(F.col("p_brand").alias("automation_id"), "sequence", (1 - F.col("l_discount")).alias("score"), ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08)).alias("critical"))


def _automations(spark, sf_dir):
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("automation_id")).agg(F.count(F.lit(1)).alias("parts"))
    return brands.withColumn("trust_level", G.level(F.col("parts") % 5))


def trust_state(spark, sf_dir):
    return G.trust_state(_shadow(spark, sf_dir), _automations(spark, sf_dir).select("automation_id", "trust_level"))


def trust_moves(spark, sf_dir):
    """Rungs up and down: demotions, earned promotions that were asked for, and forced ones."""
    requests = _automations(spark, sf_dir).where("parts % 2 = 0").select("automation_id", (F.col("parts") % 3 == 0).alias("force"))
    return G.moved(trust_state(spark, sf_dir), requests)


def score_trend(spark, sf_dir):
    """Running mean of scores at every run of each automation."""
    return G.score_trend(_shadow(spark, sf_dir)).select("automation_id", "sequence", "trend")


def roi_report(spark, sf_dir):
    """Projected and realised hours by trust level, levels without automations included."""
    spread = spark.createDataFrame([(x,) for x in C.TRUST_LEVELS], "trust_level string")
    hours = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("automation_id")).agg(F.round(F.sum("p_retailprice") / 100, 4).alias("hours"), (F.count_if(F.col("p_size") > 25) / F.count(F.lit(1))).alias("coverage"))
    joined = _automations(spark, sf_dir).join(hours, "automation_id")
    live = G.rank(F.col("trust_level")) >= 3
    sums = joined.groupBy("trust_level").agg(F.count(F.lit(1)).alias("automations"), F.sum("hours").alias("projected"), F.sum(F.when(live, F.col("hours") * F.col("coverage")).otherwise(0.0)).alias("realised"))
    return spread.join(sums, "trust_level", "left").select("trust_level", F.coalesce("automations", F.lit(0)).alias("automations"), F.round(F.coalesce("projected", F.lit(0.0)), 4).alias("projected"), F.round(F.coalesce("realised", F.lit(0.0)), 4).alias("realised"))


def _cases(spark, sf_dir):
    """Exceptions: large or heavily taxed lines."""
    lines = table(spark, sf_dir, "lineitem").where("l_tax >= 0.07 or l_extendedprice > 60000")
    currency = F.when(F.col("l_suppkey") % 9 == 0, "USD").otherwise("inr")
    key = G.signature_key(F.col("l_extendedprice") * 20, currency, F.col("l_discount") == 0, F.when(F.col("l_linestatus") == "O", "open").otherwise(""))
    amount = F.when(F.col("l_partkey") % 7 < 4, F.col("l_extendedprice"))
    return lines.select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("day"), F.concat(F.lit("a"), (F.col("l_partkey") % 7).cast("string")).alias("automation_id"), key.alias("signature_key"),
        F.when(F.col("l_quantity") < 40, "resolved").otherwise("open").alias("status"), F.when(F.col("l_returnflag") == "A", "route_to_manager").when(F.col("l_returnflag") == "N", "file").otherwise("correct").alias("decision"), amount.alias("amount"), currency.alias("currency"),
    )


def exception_groups(spark, sf_dir):
    """Open and resolved exceptions by key."""
    return _cases(spark, sf_dir).groupBy("signature_key").agg(F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "resolved").alias("resolved"))


def newest_exceptions(spark, sf_dir):
    """The fifty newest open exceptions."""
    return _cases(spark, sf_dir).where("status = 'open'").orderBy(F.desc("day"), "l_orderkey", "l_linenumber").limit(50).select("day", "l_orderkey", "l_linenumber", "automation_id", "signature_key")


def exception_names(spark, sf_dir):
    """Open exceptions by automation, by name; automations a5 and a6 were deleted."""
    key = F.col("p_partkey") % 7
    names = table(spark, sf_dir, "part").where(key < 5).groupBy(F.concat(F.lit("a"), key.cast("string")).alias("automation_id")).agg(F.min("p_name").alias("name"))
    return G.named(_cases(spark, sf_dir), names).groupBy("automation_id", "name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "open").alias("open"))


def _proposals(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    known = cases.where("automation_id = 'a3' and decision = 'file'").select("automation_id", "signature_key").distinct()
    return G.rule_proposals(cases, known)


def rule_proposals(spark, sf_dir):
    """Branch rules for groups of resolved exceptions that have none yet."""
    return _proposals(spark, sf_dir)


def _rules(spark, sf_dir):
    own = spark.createDataFrame([("a0", "amount > 17", "file", "author", "x", 1)], "automation_id string, condition string, action string, source string, signature_key string, evidence long")
    return G.with_rules(own, _proposals(spark, sf_dir).where("evidence >= 20"))


def learned_rules(spark, sf_dir):
    """Rules of the flows after proposals with enough evidence were accepted, one a condition."""
    return _rules(spark, sf_dir).withColumn("human", G.routes_to_human(F.col("action")))


def coverage(spark, sf_dir):
    """Coverage of automations from replay totals, open cases and what learned rules finish by themselves."""
    cases = _cases(spark, sf_dir)
    sizes = cases.groupBy("automation_id").agg(F.count(F.lit(1)).alias("n"))
    automations = sizes.select("automation_id", F.when(F.substring("automation_id", 2, 1) < "5", F.col("n") * 4).otherwise(0).alias("replay_total"), F.col("n").alias("replay_human"), F.lit(5).alias("shadow_runs"))
    return G.coverage(automations, cases, _rules(spark, sf_dir)).select("automation_id", "sample", F.round("remaining", 6).alias("remaining"), "coverage")


QUERIES = {f.__name__: f for f in (guard_eval, diff_compare, replay_summary, run_tallies, failure_modes, trust_state, trust_moves, score_trend, roi_report, exception_groups, newest_exceptions, exception_names, rule_proposals, learned_rules, coverage)}

_FACTS = """facts as (select l.*, o_orderpriority, round(l_extendedprice::decimal(18,2), 2)::double as amount from lineitem l join orders on l_orderkey = o_orderkey)"""
_DIFF = f"""{_FACTS}, cmp as (
        select *, round((l_extendedprice * (1 + l_tax / 10))::decimal(18,2), 2)::double as pa from facts
    ), same as (
        select *, abs(pa - amount) <= 0.01 * greatest(pa, amount, 1) as sa, case when l_linestatus = 'O' then l_returnflag = 'N' else true end as sr from cmp
    ), d as (
        select *, round((case when sa then 2 else 0 end + case when sr then 1 else 0 end + 1) / 4, 4) as score, not sa as critical_mismatch,
               concat_ws(',', case when not sa then 'amount' end, case when not sr then 'returnflag' end) as diff_fields from same
    ), outcomes as (
        select o_orderpriority as automation_id, diff_fields, score >= 0.999 and not critical_mismatch as correct,
               case when amount > 60000 then 'held' when l_quantity >= 49 then 'failed' when l_linenumber = 7 then 'not_comparable' else 'ok' end as status from d
    )"""
_SHADOW = """shadow as (
        select p_brand as automation_id, 1 - l_discount as score, l_returnflag = 'R' and l_discount > 0.08 as critical,
               row_number() over (partition by p_brand order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as sequence
        from lineitem join part on l_partkey = p_partkey
    ), autos as (
        select p_brand as automation_id, (['OBSERVE', 'SUGGEST', 'SHADOW', 'ASSIST', 'AUTONOMOUS'])[count(*) % 5 + 1] as trust_level, (count(*) % 5)::int as rank, count(*) as parts from part group by 1
    )"""
_TRUST = """r as (select *, row_number() over (partition by automation_id order by sequence desc) as nth from shadow qualify nth <= 5),
        s as (select automation_id, count(*) as n, avg(score) as average, count(*) filter (where critical) as crit, count(*) filter (where critical and nth <= 3) as late from r group by 1),
        j as (select a.*, coalesce(n, 0) as n, coalesce(average, 0) as average, coalesce(crit, 0) as crit, coalesce(late, 0) as late from autos a left join s using (automation_id))"""
_CASES = """cases as (
        select l_orderkey, l_linenumber, l_shipdate as day, 'a' || (l_partkey % 7) as automation_id, case l_returnflag when 'A' then 'route_to_manager' when 'N' then 'file' else 'correct' end as decision,
               case when l_partkey % 7 < 4 then l_extendedprice end as amount, case when l_suppkey % 9 = 0 then 'USD' else 'inr' end as currency, case when l_quantity < 40 then 'resolved' else 'open' end as status,
               coalesce(nullif(concat_ws('|', case when l_extendedprice * 20 > 1000000 then 'amount_over_10k' when l_extendedprice * 20 > 500000 then 'amount_500k_to_1m' when l_extendedprice * 20 > 0 then 'amount_under_500k' end,
                   case when l_suppkey % 9 = 0 then 'foreign_currency' end, case when l_discount = 0 then 'unresolved_dependency' end, case when l_linestatus = 'O' then 'status_open' end), ''), 'unclassified') as signature_key
        from lineitem where l_tax >= 0.07 or l_extendedprice > 60000
    ), dec as (select automation_id, signature_key, decision, count(*) as n, min(amount) as low, bool_or(currency = 'USD') as fx from cases where status = 'resolved' group by 1, 2, 3
    ), grp as (select automation_id, signature_key, sum(n)::bigint as evidence, min(low) as low, bool_or(fx) as fx, arg_min(decision, (-n, decision)) as action from dec group by 1, 2 having sum(n) >= 3
    ), props as (
        select automation_id, signature_key, evidence, case when low is not null then 'amount > ' || (trunc(low)::bigint - 1) when fx then 'currency != "INR"' else 'unresolved == true' end as condition, action,
               case when low is not null then 0.82 when fx then 0.85 else 0.6 end as confidence
        from grp where not (automation_id = 'a3' and signature_key in (select signature_key from cases where automation_id = 'a3' and decision = 'file'))
    ), rules as (
        select 'a0' as automation_id, 'amount > 17' as condition, 'file' as action, 'author' as source, 'x' as signature_key, 1::bigint as evidence union all
        select automation_id, condition, action, 'learned', signature_key, evidence from props where evidence >= 20 and (automation_id, condition) <> ('a0', 'amount > 17')
        qualify row_number() over (partition by automation_id, condition order by signature_key, action) = 1
    )"""

ORACLES = {
    "guard_eval": f"""with {_FACTS}, s as (select count(*) filter (where amount > 25000) as g0, count(*) filter (where o_orderpriority = '1-URGENT') as g1, count(*) filter (where printf('%.2f', l_discount)::double <= 0.05) as g2,
            0::bigint as g3, count(*) filter (where l_returnflag <> 'A') as g4, count(*) filter (where l_quantity::bigint >= 10) as g5, 0::bigint as g6 from facts)
        select unnest(range(0, 7)) as guard, unnest([g0, g1, g2, g3, g4, g5, g6]) as n from s""",
    "diff_compare": f"with {_DIFF} select score, critical_mismatch, 3::bigint as compared, diff_fields, count(*) as n from d group by 1, 2, 4",
    "replay_summary": f"""with {_DIFF} select automation_id, count(*) as total, count(*) filter (where status = 'held' or (status = 'ok' and correct)) as correct, count(*) filter (where status = 'failed') as errored,
        count(*) filter (where status = 'not_comparable') as not_comparable, floor(count(*) filter (where status = 'held' or (status = 'ok' and correct)) / count(*) filter (where status <> 'not_comparable') * 10000) / 10000 as accuracy from outcomes group by 1""",
    "run_tallies": """with o as (select o_orderpriority as automation_id, case when l_extendedprice::decimal(18,2) > 60000 then 'held' when l_quantity >= 49 then 'failed' when l_linenumber = 7 then 'not_comparable' else 'ok' end as status
            from lineitem join orders on l_orderkey = o_orderkey),
        t as (select automation_id, count(*) as runs, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'held') as held from o group by 1)
        select *, ok || ' filed, ' || held || ' held for a person, ' || failed || ' failed' as summary from t""",
    "failure_modes": f"""with {_DIFF}, f as (select automation_id, case when status = 'failed' then 'error' else 'differs: ' || diff_fields end as reason, count(*) as n from outcomes where status = 'failed' or (status = 'ok' and not correct) group by 1, 2)
        select * from (select *, row_number() over (partition by automation_id order by n desc, reason) as rank from f) where rank <= 3""",
    "trust_state": f"""with {_SHADOW}, {_TRUST}
        select automation_id, trust_level, n, round(average, 6) as average, n >= 5 and average >= 0.9 and crit = 0 and rank < 4 as can_promote, late > 0 and rank > 0 as must_demote,
               case when late > 0 and rank > 0 then (['OBSERVE', 'SUGGEST', 'SHADOW', 'ASSIST', 'AUTONOMOUS'])[rank] else trust_level end as enforced_level, round(average * least(1.0, n / 5), 6) as confidence,
               case when rank = 4 then 'already at the top of the ladder' else concat_ws('; ', case when n < 5 then 'needs ' || (5 - n) || ' more shadow run(s)' end, case when average < 0.9 then 'rolling average is ' || round_even(round(average, 9) * 100, 0)::bigint || '%, needs 90%' end,
                   case when crit > 0 then crit || ' critical field mismatch(es) in the last ' || n || ' run(s)' end) end as blockers from j""",
    "score_trend": f"""with {_SHADOW} select automation_id, sequence, round(sum(score::decimal(18,6)) over w::double / count(score) over w, 6) as trend
        from shadow window w as (partition by automation_id order by sequence rows unbounded preceding)""",
    "roi_report": f"""with {_SHADOW}, h as (select p_brand as automation_id, round(sum(p_retailprice) / 100, 4) as hours, count(*) filter (where p_size > 25) / count(*) as coverage from part group by 1),
        l as (select unnest(['OBSERVE', 'SUGGEST', 'SHADOW', 'ASSIST', 'AUTONOMOUS']) as trust_level)
        select l.trust_level, count(automation_id) as automations, round(coalesce(sum(hours), 0), 4) as projected, round(coalesce(sum(case when rank >= 3 then hours * coverage else 0 end), 0), 4) as realised
        from l left join (select * from autos join h using (automation_id)) a on a.trust_level = l.trust_level group by 1""",
    "newest_exceptions": f"with {_CASES} select day, l_orderkey, l_linenumber, automation_id, signature_key from cases where status = 'open' order by day desc, l_orderkey, l_linenumber limit 50",
    "exception_names": f"""with {_CASES} select automation_id, coalesce(name, '') as name, count(*) as total, count(*) filter (where status = 'open') as open
        from cases left join (select 'a' || (p_partkey % 7) as automation_id, min(p_name) as name from part where p_partkey % 7 < 5 group by 1) using (automation_id) group by 1, 2""",
    "rule_proposals": f"with {_CASES} select * from props",
    "learned_rules": f"with {_CASES} select *, regexp_matches(lower(action), 'route|escalate|manual|review|approval|hold|manager|human') as human from rules",
    "coverage": f"""with {_CASES}, enc as (select distinct automation_id, signature_key from rules where source = 'learned' and not regexp_matches(lower(action), 'route|escalate|manual|review|approval|hold|manager|human')),
        n as (select automation_id, count(*) as n, count(*) filter (where status = 'open') as open, count(*) filter (where status = 'resolved') as res, count(*) filter (where status = 'resolved' and (automation_id, signature_key) in (select (automation_id, signature_key) from enc)) as done from cases group by 1),
        s as (select automation_id, case when automation_id < 'a5' then n * 4 else greatest(5, n) end as sample, case when automation_id < 'a5' then n else open end as human, done / greatest(res, 1) as part from n)
        select automation_id, sample, round(greatest(0.0, human - human * least(1.0, part)), 6) as remaining, round(greatest(0.0, least(1.0, 1 - greatest(0.0, human - human * least(1.0, part)) / sample)), 4) as coverage from s""",
    "trust_moves": f"""with {_SHADOW}, {_TRUST} select automation_id, trust_level, case when down then (['OBSERVE', 'SUGGEST', 'SHADOW', 'ASSIST', 'AUTONOMOUS'])[rank] when up then (['OBSERVE', 'SUGGEST', 'SHADOW', 'ASSIST', 'AUTONOMOUS'])[rank + 2] else trust_level end as new_level,
        case when down then 'critical field mismatch detected' when up and ready then 'policy satisfied' when up then 'manual override by operator' end as reason
        from (select *, not down and parts % 2 = 0 and rank < 4 and (ready or parts % 3 = 0) as up from (select *, late > 0 and rank > 0 as down, n >= 5 and average >= 0.9 and crit = 0 and rank < 4 as ready from j))""",
    "exception_groups": f"with {_CASES} select signature_key, count(*) filter (where status = 'open') as open, count(*) filter (where status = 'resolved') as resolved from cases group by 1",
}
