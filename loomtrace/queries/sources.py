"""Queries that read logs from files and signals of collectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions import web as W
from loomtrace.plans.adapters import activity, payloads, table
from loomtrace.queries import scalars, sql
from loomtrace.sources import collector, described, files
from loomtrace.sources.shared import new_path

_SAYINGS = ["Check the inbox daily", "monthly, extract each invoice", "Look up the customer", "post it to the ledger", "notify the team on slack", "nothing special", "Every Monday summarise the sheet"]
_LABELS = {"click": ("Google Sheets", "set priority"), "view": ("google mail", "Open"), "purchase": ("SAP", "create invoice"), "signup": ("CRM", "Review resume"), "error": ("Slack", "send")}


def _by_type(at: int):
    out = F.lit(None).cast("string")
    for kind, pair in _LABELS.items():
        out = F.when(F.col("event_type") == kind, pair[at]).otherwise(out)
    return out


def _sheet(spark, sf_dir):
    """The events as a hand-kept sheet: its own headings, written durations, some persons and times missing."""
    user = F.when(F.col("event_id") % 97 != 0, F.concat(F.lit("u_"), F.col("user_id").cast("string")))
    when = F.when(F.col("event_id") % 89 == 0, "some day").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    spent = F.concat(F.floor("value").cast("long").cast("string"), F.when(F.col("event_id") % 2 == 0, " min").otherwise(""))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("Record_ID"), user.alias("Performed By"), when.alias("Start Time"), _by_type(0).alias("Application"), _by_type(1).alias("Activity"),
        spent.alias("Time Spent"), F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string")).alias("Mood"),
    )


def _scanned(spark, sf_dir):
    path = new_path(spark, "sheet.csv")
    _sheet(spark, sf_dir).write.option("header", True).csv(path)
    return files.normalise(files.csv_rows(spark, path))


def scan_csv(spark, sf_dir):
    """The sheet written as CSV and read back as canonical events."""
    found = _scanned(spark, sf_dir).where("reject_reason is null")
    return found.select("object_id", "user_id", "team", F.unix_seconds("ts").alias("seconds"), "app", "action", "object_type", "duration_ms", F.to_json("payload").alias("payload"), "source")


def scan_rejects(spark, sf_dir):
    """Why rows of the sheet were rejected."""
    found = _scanned(spark, sf_dir).where("reject_reason is not null")
    return found.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("line") > 1).alias("numbered"))


def scan_jsonl(spark, sf_dir):
    """Events as JSON lines with nested payloads, read back; lines that name no person are of the local user."""
    path = new_path(spark, "log.jsonl")
    user = F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("u_"), F.col("user_id").cast("string")))
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("Reference"), user.alias("employee"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), _by_type(0).alias("tool"), F.lit("save").alias("action"), F.lit("Order Form").alias("Object Type"),
        F.floor("value").cast("long").alias("duration_ms"), F.struct(F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("amount")).alias("payload"),
    )
    rows.write.json(path)
    events = files.normalise(files.jsonl_rows(spark, path)).where("reject_reason is null")
    return events.select("object_id", "user_id", F.unix_seconds("ts").alias("seconds"), "app", "action", "object_type", "duration_ms", F.element_at("payload", "kind").alias("kind"), F.element_at("payload", "amount").alias("amount"))


def upload_summary(spark, sf_dir):
    """What an upload of the sheet reports."""
    found = _scanned(spark, sf_dir)
    rejects = found.where("reject_reason is not null").select("file", "line", F.col("reject_reason").alias("message"))
    return files.upload_summary(found.where("reject_reason is null"), rejects).select("accepted", "rejected", "sessions", "apps", F.size(F.split("messages", "\n")).alias("shown"))


def _said(spark, sf_dir):
    parts = [F.element_at(F.array(*map(F.lit, _SAYINGS)), (F.col(c) % len(_SAYINGS) + 1).cast("int")) for c in ("o_orderkey", "o_custkey")]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(parts[0], F.lit(". Then "), parts[1]).alias("text"))


def described_steps(spark, sf_dir):
    """Steps and cadence of workflows described in words made from the orders."""
    found = described.described(_said(spark, sf_dir).select(F.col("o_orderkey").alias("description_id"), F.lit("u").alias("user_id"), "text"))
    return found.select("description_id", "name", "per_week", F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["app"], s["action"], s["object_type"])), ",").alias("steps"))


def described_runs(spark, sf_dir):
    """Events that the different descriptions give over ten weeks, by step: how many, and of how many runs."""
    texts = _said(spark, sf_dir).groupBy("text").agg(F.min("o_orderkey").alias("description_id"), F.lit("u").alias("user_id"))
    events = described.events_of(described.described(texts), 10, 1735689600000)
    return events.groupBy("app", "action", "object_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("runs"))


def desktop_stays(spark, sf_dir):
    """Stays in desktop applications from samples of the window in front."""
    kind = F.col("event_type")
    name = F.when(kind == "click", "Google Chrome").when(kind == "view", "Slack").when(kind == "purchase", "Numbers").when(kind == "signup", "My Tool! 2").otherwise("Safari")
    title = F.when(kind == "click", F.concat(F.lit("Item "), F.col("k").cast("string"), F.lit(" - Shop Portal"))).when(kind == "purchase", "Budget (2024)")
    samples = activity(spark, sf_dir).select("user_id", "ts_ms", name.alias("app_name"), title.alias("title"))
    return files.desktop_events(samples.groupBy("user_id", "ts_ms").agg(F.min_by(F.struct("app_name", "title"), "app_name").alias("s")).select("user_id", "ts_ms", "s.*"), 6 * 3_600_000)


def commit_log(spark, sf_dir):
    """Commits by author of a written log with broken lines."""
    line = F.when(F.col("s_suppkey") % 7 == 0, F.lit("merge without an author")).otherwise(F.concat_ws("\t", F.hex("s_suppkey"), F.concat(F.lit("dev"), (F.col("s_nationkey") % 5).cast("string")), F.concat(F.lit("fix "), "s_name")))
    found = files.commits(table(spark, sf_dir, "supplier").select(line.alias("value")))
    return found.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"))


_SOURCES = [("s0", "u_a", "ops", "extension", "connected", True, True, [" example.ORG "]), ("s1", "u_b", "ops", "desktop", "connected", True, False, []), ("s2", "u_c", "finance", "import", "paused", True, True, []), ("s3", "u_d", "sales", "import", "connected", False, True, [])]


def _sources(spark):
    return spark.createDataFrame(_SOURCES, "source_id string, user_id string, team string, kind string, status string, consented boolean, with_values boolean, denylist array<string>")


def _signals(spark, sf_dir):
    """Page visits as raw browser signals of four sources."""
    label = F.element_at(F.array(*map(F.lit, ["Save draft", "Send", "Add new", "Export", "plain", ""])), (F.col("page_id") % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ["click", "pageview", "submit", "paste", "focus"])), (F.col("page_id") % 5 + 1).cast("int"))
    nothing = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("signal_id"), F.concat(F.lit("s"), (F.col("page_id") % 4).cast("string")).alias("source_id"), kind.alias("interaction"), "url", F.lit("A page").alias("title"), label.alias("label"), F.lit("button").alias("role"),
        nothing.alias("field_name"), (F.col("page_id") % 9 * 100).alias("duration_ms"), F.when(F.col("page_id") % 5 == 3, F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 16)).alias("payload_digest"),
        F.when(F.col("page_id") % 8 == 0, "soon").otherwise(F.concat(F.lit("2024-05-01T10:"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(":00Z"))).alias("occurred_at"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("t"), (F.col("page_id") % 4).cast("string"))).alias("tab_id"), nothing.alias("session_id"), F.to_timestamp(F.lit("2024-05-02 00:00:00")).alias("received_at"),
    )


def collect_batch(spark, sf_dir):
    """A batch of signals as events of the sources that may send them."""
    found = collector.events_of(collector.admitted(_signals(spark, sf_dir), _sources(spark)))
    return found.select("signal_id", "source_id", "user_id", F.unix_seconds("ts").alias("seconds"), "app", "action", "object_type", "object_id", "duration_ms", F.array_join(F.array_sort(F.map_keys("payload")), ",").alias("fields"))


def collect_counters(spark, sf_dir):
    """What the batch adds to the counters of each source."""
    found = collector.counters(collector.admitted(_signals(spark, sf_dir), _sources(spark)))
    return found.withColumn("last_event_at", F.unix_seconds("last_event_at"))


def source_coverage(spark, sf_dir):
    """What is connected and what it has seen."""
    events = activity(spark, sf_dir).withColumn("source_id", F.when(F.col("k") % 4 != 0, F.lit("s0")))
    tiers = spark.createDataFrame([("extension", 0.6), ("desktop", 0.75), ("import", 0.9), ("recording", 0.95)], "kind string, estimate double")
    return collector.coverage(events, _sources(spark).where("source_id <> 's3'"), tiers)


def registry_gap(spark, sf_dir):
    """Applications seen in events and pages that no registry has."""
    seen = activity(spark, sf_dir).select("app").unionByName(table(spark, sf_dir, "pages").select(W.app_for_host(F.col("url")).alias("app")))
    return collector.unregistered(seen, spark.createDataFrame([(a,) for a in C.APPS], "key string"))


def consent_withdrawn(spark, sf_dir):
    """Events by source after two sources were withdrawn."""
    log = activity(spark, sf_dir).withColumn("source_id", F.concat(F.lit("src_"), (F.substring("user_id", 3, 9).cast("int") % 5).cast("string")))
    gone = spark.createDataFrame([("src_1",), ("src_3",), ("src_3",)], "source_id string")
    return files.without_source(log, gone).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def broken_schema(spark, sf_dir):
    """Payload keys by application after a field was renamed over the whole log."""
    log = files.renamed_field(payloads(activity(spark, sf_dir)), "amount", "Net Amount")
    return log.select("app", F.explode(F.map_keys("payload")).alias("key")).groupBy("app", "key").agg(F.count(F.lit(1)).alias("n"))


#: A tab's interval, a day of the log instead of a blink.
INTERVAL = 86_400_000


def throttle_signals(spark, sf_dir):
    """What is sent of the events as signals of a tab for each user: none that repeats the last one sent within a day."""
    sent = collector.throttled(activity(spark, sf_dir), ["user_id"], ["event_type"], ["ts_ms", "id"], INTERVAL)
    return sent.select("user_id", "id", "event_type", "ts_ms")


QUERIES = {f.__name__: f for f in (scan_csv, scan_rejects, scan_jsonl, upload_summary, described_steps, described_runs, desktop_stays, commit_log, collect_batch, collect_counters, source_coverage, registry_gap, consent_withdrawn, broken_schema, throttle_signals)}

_SHEET = """sheet as (
        select event_id::varchar as object_id, 'u_' || user_id as user_id, epoch_us(date_trunc('second', ts)) // 1000000 as seconds, floor(value)::bigint as spent, event_id, event_type, case event_type when 'click' then 'sheets' when 'view' then 'gmail' when 'purchase' then 'erp' when 'signup' then 'crm' else 'slack' end as app,
               case event_type when 'click' then 'update' when 'view' then 'read' when 'purchase' then 'create' when 'signup' then 'read' else 'send' end as action,
               case event_type when 'click' then 'priority' when 'purchase' then 'invoice' when 'signup' then 'resume' else 'unknown' end as object_type from events
    ), good as (select * from sheet where event_id % 97 <> 0 and event_id % 89 <> 0)"""
_SIGNALS = f"""parts as ({scalars.ORACLES["url_parts"]}), sig as (
        select page_id as signal_id, 's' || (page_id % 4) as source_id, case page_id % 4 when 0 then 'u_a' else 'u_b' end as user_id, contains(lower(url), 'example.org') and page_id % 4 = 0 as denied,
               case when page_id % 8 = 0 then 1714608000 else 1714557600 + (page_id % 60) * 60 end as seconds, app, action, object_type, object_id, page_id % 9 * 100 as duration_ms, page_id
        from pages join parts using (page_id) where page_id % 4 in (0, 1))"""

_DESCRIBED = ", ".join(
    f"""case when {" or ".join(f"contains(t, '{w}')" for w in words)} then struct_pack(p := list_min(list_filter([{", ".join(f"instr(t, '{w}')" for w in words)}], lambda x: x > 0)), s := '{app}:{action}:{kind}') end"""
    for words, app, action, kind in C.DESCRIBED_STEPS
)

_SAID = f"""o as (select o_orderkey, ({scalars._list(_SAYINGS)})[o_orderkey % {len(_SAYINGS)} + 1] || '. Then ' || ({scalars._list(_SAYINGS)})[o_custkey % {len(_SAYINGS)} + 1] as said from orders),
        l as (select o_orderkey, said, lower(said) as t from o), f as (select *, list_sort(list_filter([{_DESCRIBED}], lambda x: x is not null)) as found from l),
        told as (select o_orderkey, said, case {" ".join(f"when contains(t, '{w}') then {n}" for w, n in C.CADENCES)} else 5.0 end::double as per_week,
               case when len(found) >= 2 then list_transform(found, lambda x: x.s) else ['gmail:read:email', 'sheets:create:row'] end as steps from f)"""

ORACLES = {
    "described_steps": f"""with {_SAID} select o_orderkey as description_id, split_part(said, '.', 1) as name, per_week, array_to_string(steps, ',') as steps from told""",
    "described_runs": f"""with {_SAID}, d as (select said, any_value(steps) as steps, any_value(per_week) as per_week from told group by 1),
        e as (select unnest(steps) as step, greatest(12, trunc(greatest(0.25, per_week) * 10)::bigint) as runs from d)
        select split_part(step, ':', 1) as app, split_part(step, ':', 2) as action, split_part(step, ':', 3) as object_type, sum(runs)::bigint as n, sum(runs)::bigint as runs from e group by step""",
    "scan_csv": f"""with {_SHEET} select object_id, user_id, 'unknown' as team, seconds, app, action, object_type, spent * case when event_id % 2 = 0 then 60000 else 1000 end as duration_ms, '{{"mood":"m' || (event_id % 4) || '"}}' as payload, 'upload' as source from good""",
    "scan_rejects": f"""with {_SHEET} select case when event_id % 97 = 0 then 'missing user_id: no column named user_id, employee, person or role' else 'unreadable timestamp: ''some day''' end as reject_reason, count(*) as n, true as numbered from sheet where event_id % 97 = 0 or event_id % 89 = 0 group by 1""",
    "scan_jsonl": f"""with {_SHEET} select object_id, case when event_id % 10 = 0 then 'u_local' else user_id end as user_id, seconds, app, 'update' as action, 'order_form' as object_type, spent as duration_ms, event_type as kind, spent::varchar as amount from sheet""",
    "upload_summary": f"""with {_SHEET}, b as (select count(*) as rejected from sheet where event_id % 97 = 0 or event_id % 89 = 0) select (select count(*) from good) as accepted, rejected, 0 as sessions, (select count(distinct app) from good) as apps, least(rejected, 20) as shown from b""",
    "desktop_stays": f"""with {sql.ACTIVITY}, s0 as (select user_id, ts_ms, case event_type when 'click' then 'Google Chrome' when 'view' then 'Slack' when 'purchase' then 'Numbers' when 'signup' then 'My Tool! 2' else 'Safari' end as app_name,
            case event_type when 'click' then 'shop_portal' when 'purchase' then 'budget_2024' else 'window' end as object_type, case event_type when 'click' then 'browser' when 'view' then 'slack' when 'purchase' then 'sheets' when 'signup' then 'my_tool_2' else 'browser' end as app from activity),
        s1 as (select user_id, ts_ms, min(app_name) as app_name, arg_min(object_type, app_name) as object_type, arg_min(app, app_name) as app from s0 group by 1, 2),
        f as (select *, lag(app_name) over (partition by user_id order by ts_ms) as before from s1),
        e as (select *, lead(ts_ms) over (partition by user_id order by ts_ms) as ends_ms from f where before is null or before <> app_name),
        c as (select *, coalesce((ends_ms - lag(ends_ms) over (partition by user_id order by ts_ms) > 21600000)::int, 0) as cut from e where ends_ms - ts_ms >= 1000)
        select user_id, ts_ms, app, 'navigate' as action, object_type, ends_ms - ts_ms as duration_ms, user_id || '#' || sum(cut) over (partition by user_id order by ts_ms rows unbounded preceding) as session_id from c""",
    "commit_log": "select 'dev' || (s_nationkey % 5) as author, count(*) as n, min('fix ' || s_name) as first_subject from supplier where s_suppkey % 7 <> 0 group by 1",
    "collect_batch": f"""with {_SIGNALS} select signal_id, source_id, user_id, seconds, app, action, object_type, object_id, duration_ms,
        array_to_string(list_sort(list_filter([case when page_id % 6 <> 5 then 'control' end, case when page_id % 5 = 3 then 'transfer_digest' end, case when source_id = 's0' then 'title' end, 'interaction', case when page_id % 3 = 0 then 'tab' end], lambda x: x is not null)), ',') as fields from sig where not denied""",
    "collect_counters": f"with {_SIGNALS} select source_id, count(*) filter (where not denied) as accepted, count(*) filter (where denied) as rejected, max(seconds) filter (where not denied) as last_event_at, count(*) filter (where not denied) >= 30 as detection_suggested from sig group by 1",
    "source_coverage": f"""with {sql.ACTIVITY} select count(distinct app) as distinct_apps, count(*) as total_events, count(*) filter (where k % 4 <> 0) as observed_events, 3 as total_sources, 2 as connected_sources, 'desktop,extension' as kinds_connected, 0.75 as estimated_coverage from activity""",
    "registry_gap": f"""with {sql.ACTIVITY}, parts as ({scalars.ORACLES["url_parts"]}), a as (select distinct app as key from activity union select distinct app from parts)
        select key, array_to_string(list_transform(string_split(translate(key, '-_', '  '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') as label, 'discovered' as category from a where key not in ({", ".join(f"'{x}'" for x in C.APPS)})""",
    "consent_withdrawn": "select 'src_' || (user_id % 5) as source_id, count(*) as n from events where user_id % 5 not in (1, 3) group by 1",
    "broken_schema": f"""with {sql.ACTIVITY}, l as (select app, unnest([case when ts_ms >= 1705276800000 and app = 'gmail' then 'item k' else 'k' end, case when app in ('erp', 'sheets') then 'Net Amount' end, case when ts_ms >= 1705276800000 and app = 'crm' then 'state' else 'status' end,
            case when app in ('erp', 'crm') then case when ts_ms >= 1705276800000 then 'Supplier Name' else 'Vendor' end end, case when k % 7 = 0 then 'remark' end]) as key from activity)
        select app, key, count(*) as n from l where key is not null group by 1, 2""",
    "throttle_signals": f"""with {sql.ACTIVITY}, s as (select *, coalesce((event_type is distinct from lag(event_type) over w or ts_ms - lag(ts_ms) over w >= {INTERVAL})::int, 1) as new from activity window w as (partition by user_id order by ts_ms, id)),
        r as (select *, sum(new) over (partition by user_id order by ts_ms, id rows unbounded preceding) as run from s),
        c as (select user_id, any_value(event_type) as event_type, list_reduce(list([ts_ms, id] order by ts_ms, id), lambda sent, x: case when x[1] - sent[len(sent) - 1] >= {INTERVAL} then list_concat(sent, x) else sent end) as sent from r group by user_id, run)
        select user_id, event_type, unnest(list_filter(sent, lambda x, k: k % 2 = 1)) as ts_ms, unnest(list_filter(sent, lambda x, k: k % 2 = 0)) as id from c""",
}
