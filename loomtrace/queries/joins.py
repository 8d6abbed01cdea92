"""Queries around joins: transfers, imports, coverage of tools and domains, relinking, triggers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrace.operators import joins as J
from loomtrace.operators.sessions import instances, sessionise
from loomtrace.plans.adapters import activity
from loomtrace.queries import sql
from loomtrace.queries.logs import GAP
from loomtrace.queries.scores import runs

WINDOW = 6 * 3_600_000
TOOLS = [("gmail", "mail"), ("sheets", "office"), ("erp", "finance"), ("crm", "sales"), ("slack", "mail"), ("jira", "delivery"), ("zendesk", "support")]


def transfer_links(spark, sf_dir):
    """Clicks (pastes) linked to the latest view or purchase (copy) of the same key and user."""
    log = activity(spark, sf_dir).withColumns({"is_copy": F.col("event_type").isin("view", "purchase"), "is_paste": F.col("event_type").isin("click", "purchase"), "key": F.col("k") % 10})
    return J.transfer_links(log, ["user_id", "key"], WINDOW)


def import_dedupe(spark, sf_dir):
    """Events of the second half of the month not known from the first, once each."""
    log = activity(spark, sf_dir).withColumns({"hour": F.pmod(F.floor(F.col("ts_ms") / 3_600_000), F.lit(24)).cast("long"), "late": F.col("ts_ms") >= 1705276800000})
    return J.new_rows(log.where("late"), log.where("not late"), ["app", "k", "hour"]).select("id", "app", "k", "hour")


def _tools(spark):
    return spark.createDataFrame(TOOLS, "tool string, domain string")


def unwatched_tools(spark, sf_dir):
    """Catalogue tools without any event."""
    return _tools(spark).join(activity(spark, sf_dir).select(F.col("app").alias("tool")).distinct(), "tool", "left_anti")


def domain_coverage(spark, sf_dir):
    """Per domain its tools, watched tools and events, domains without events included."""
    counts = activity(spark, sf_dir).groupBy(F.col("app").alias("tool")).agg(F.count(F.lit(1)).alias("events"))
    joined = _tools(spark).join(counts, "tool", "left")
    return joined.groupBy("domain").agg(F.count(F.lit(1)).alias("tools"), F.count("events").alias("watched"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


def trigger_candidates(spark, sf_dir):
    """Instances whose first step is an automation's trigger; the last one per trigger."""
    found = instances(sessionise(activity(spark, sf_dir), GAP)).withColumn("trigger", F.get("raw_signature", F.lit(0)))
    wanted = spark.createDataFrame([("gmail:read:item", "answer mail"), ("erp:create:item", "book purchase")], "trigger string, automation string")
    newest = F.row_number().over(Window.partitionBy("automation").orderBy(F.desc("started_ms"), "instance_id"))
    return found.join(F.broadcast(wanted), "trigger").withColumn("nth", newest).where("nth <= 3").select("automation", "nth", "instance_id", "started_ms")


def instance_events(spark, sf_dir):
    """Events of all instances, by their lists of event ids."""
    log = activity(spark, sf_dir)
    ids = instances(sessionise(log, GAP)).select("instance_id", F.posexplode("event_ids").alias("pos", "id"))
    return log.join(ids, "id").select("instance_id", "pos", "id", "event_type", "ts_ms")


def orphan_relink(spark, sf_dir):
    """Rare signatures relinked to the frequent signature with most common steps."""
    counts = runs(spark, sf_dir).groupBy("signature_hash").agg(F.count(F.lit(1)).alias("n"), F.first("signature").alias("signature"))
    tokens = F.transform("signature", lambda t, i: F.concat(t, F.lit("@"), F.least(i, F.lit(3)).cast("string")))
    shaped = counts.select("signature_hash", "n", tokens.alias("tokens"))
    rare = shaped.where("n < 50").select(F.col("signature_hash").alias("automation_id"), "tokens")
    frequent = shaped.where("n >= 50").select(F.col("signature_hash").alias("cluster_id"), "tokens", F.col("n").alias("priority"))
    return J.relink(rare, frequent)


def dismissed_carry(spark, sf_dir):
    """Signature totals with flags carried over from an earlier run by content hash."""
    found = runs(spark, sf_dir)
    now = found.groupBy("signature_hash").agg(F.count(F.lit(1)).alias("n"))
    before = found.where("instance_id % 4 = 0").select("signature_hash").distinct().where(F.substring("signature_hash", 1, 1) < "8").withColumn("dismissed", F.lit(True))
    return now.join(before, "signature_hash", "left").select("signature_hash", "n", F.coalesce("dismissed", F.lit(False)).alias("dismissed"))


QUERIES = {f.__name__: f for f in (transfer_links, import_dedupe, unwatched_tools, domain_coverage, trigger_candidates, instance_events, orphan_relink, dismissed_carry)}

_TOOLS = "tools(tool, domain) as (values " + ", ".join(f"('{t}', '{d}')" for t, d in TOOLS) + ")"

ORACLES = {
    "transfer_links": f"""with {sql.ACTIVITY}, e as (select *, k % 10 as key from activity),
        c as (select p.id as paste_id, p.app as to_app, p.ts_ms as pasted_ms, arg_max(struct_pack(id := c.id, app := c.app, ts_ms := c.ts_ms), (c.ts_ms, c.event_type = 'view', c.id)) as copy
              from e p join e c on p.user_id = c.user_id and p.key is not distinct from c.key and c.event_type in ('view', 'purchase') and p.event_type in ('click', 'purchase')
                               and (c.ts_ms < p.ts_ms or (c.ts_ms = p.ts_ms and (p.event_type = 'click' or c.id <= p.id))) group by 1, 2, 3)
        select paste_id, copy.id as copy_id, copy.app as from_app, to_app, pasted_ms - copy.ts_ms as after_ms from c where copy.app <> to_app and pasted_ms - copy.ts_ms <= {WINDOW}""",
    "import_dedupe": f"""with {sql.ACTIVITY}, e as (select *, (ts_ms // 3600000) % 24 as hour, ts_ms >= 1705276800000 as late from activity)
        select id, app, k, hour from (select *, row_number() over (partition by app, k, hour order by id) as nth from e where late)
        where nth = 1 and (app, k, hour) not in (select (app, k, hour) from e where not late)""",
    "unwatched_tools": f"with {sql.ACTIVITY}, {_TOOLS} select * from tools where tool not in (select app from activity)",
    "domain_coverage": f"""with {sql.ACTIVITY}, {_TOOLS}, c as (select app as tool, count(*) as events from activity group by 1)
        select domain, count(*) as tools, count(events) as watched, coalesce(sum(events), 0)::bigint as events from tools left join c using (tool) group by 1""",
    "trigger_candidates": f"""with {sql.ACTIVITY}, {sql.steps(GAP)}, {sql.INSTANCES}, w(trigger, automation) as (values ('gmail:read:item', 'answer mail'), ('erp:create:item', 'book purchase'))
        select automation, nth, instance_id, started_ms from (select automation, instance_id, started_ms, row_number() over (partition by automation order by started_ms desc, instance_id) as nth
            from instances join w on trigger = raw_signature[1]) where nth <= 3""",
    "instance_events": f"""with {sql.ACTIVITY}, {sql.steps(GAP)}, l as (select instance_id, count(*) as n from steps group by 1)
        select instance_id, pos - 1 as pos, id, event_type, ts_ms from steps join l using (instance_id)""",
    "orphan_relink": f"""with {sql.ORDERS}, c as (select signature_hash, count(*) as n, any_value(signature) as signature from keyed group by 1),
        t as (select signature_hash, n, list_distinct(list_transform(signature, lambda x, i: x || '@' || least(i - 1, 3))) as tokens from c),
        p as (select a.signature_hash as automation_id, b.signature_hash as cluster_id, len(list_intersect(a.tokens, b.tokens)) as overlap, b.n as priority from t a, t b where a.n < 50 and b.n >= 50)
        select automation_id, arg_min(cluster_id, (case when overlap > 0 then -overlap else 0 end, case when overlap > 0 then 0 else -priority end, cluster_id)) as cluster_id, max(overlap)::bigint as overlap from p group by 1""",
    "dismissed_carry": f"""with {sql.ORDERS}, b as (select distinct signature_hash from keyed where instance_id % 4 = 0 and left(signature_hash, 1) < '8')
        select signature_hash, count(*) as n, signature_hash in (select signature_hash from b) as dismissed from keyed group by 1""",
}
