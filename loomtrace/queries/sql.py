"""Pieces of DuckDB SQL that several oracles share; they restate the adapters and sessions in SQL."""

ACTIVITY = """
    activity as (
        select event_id as id, 'u_' || user_id as user_id, (epoch_us(ts) // 1000) as ts_ms,
               case event_type when 'click' then 'sheets' when 'view' then 'gmail' when 'purchase' then 'erp' when 'signup' then 'crm' else 'slack' end as app,
               case when event_type = 'click' then 'update' when event_type in ('view', 'error') then 'read' else 'create' end as action,
               'item' as object_type, floor(value * 1000)::bigint as duration_ms, cast(null as varchar) as session_id,
               (props->>'$.k')::bigint as k, value, event_type
        from events
    )"""

CHATS = """
    activity as (
        select conv_id * 1000 + turn as id, 'c' || (conv_id % 7) as user_id, 1704067200000 + conv_id * 86400000 + turn * 60000 as ts_ms,
               'chat' as app, role as action, 'turn' as object_type, 0::bigint as duration_ms, conv_id::varchar as session_id, text
        from conversations
    )"""


def steps(gap_ms: int, least: int = 2) -> str:
    """``steps``: the events of ``activity`` with instance_id and pos."""
    return f"""
    marked as (
        select *, session_id is null and app || ':' || action in ('slack:read', 'browser:navigate', 'browser:read') as reset from activity
    ), counted as (
        select *, sum(reset::int) over (partition by user_id order by ts_ms, id rows unbounded preceding) as resets from marked
    ), lagged as (
        select *, lag(ts_ms + duration_ms) over w as before_end, lag(session_id) over w as before_session, lag(resets) over w as before_resets
        from counted where not reset window w as (partition by user_id order by ts_ms, id)
    ), cut as (
        select *, sum(case when before_end is null or ts_ms - before_end > {gap_ms} or coalesce(session_id <> before_session, false)
                            or resets <> before_resets then 1 else 0 end)
                  over (partition by user_id order by ts_ms, id rows unbounded preceding) as task
        from lagged
    ), steps as (
        select *, user_id || '#' || first_id as instance_id from (
            select *, row_number() over (partition by user_id, task order by ts_ms, id) as pos,
                   first_value(id) over (partition by user_id, task order by ts_ms, id) as first_id,
                   count(*) over (partition by user_id, task) as n
            from cut) where n >= {least}
    )"""


FOLD = """list_reduce(list_transform({0}, lambda t: [t]), lambda s, t:
            case when s[len(s)] = t[1] then s
                 when len(s) > 1 and s[len(s) - 1] = t[1] then s[1:len(s) - 1]
                 else list_concat(s, t) end)"""

INSTANCES = f"""
    named as (
        select *, app || ':' || action || ':' || object_type as token,
               lead(app, 2) over w = app and lead(app, 1) over w <> app and lead(ts_ms, 2) over w - ts_ms <= 600000 as back
        from steps window w as (partition by instance_id order by pos)
    ), grouped as (
        select instance_id, user_id, min(ts_ms) as started_ms, max_by(ts_ms + duration_ms, pos) as ended_ms, sum(duration_ms)::bigint as busy_ms,
               count(*) as n_events, list(token order by pos, token) as raw_signature, count(*) filter (where back) as context_switches
        from named group by instance_id, user_id
    ), instances as (
        select *, greatest(ended_ms - started_ms, busy_ms) as duration_ms, {FOLD.format("raw_signature")} as signature from grouped
    )"""

LINES = """
    lines as (
        select l_orderkey as instance_id, 'c' || o_custkey as user_id, l_linenumber as pos, l_returnflag as token, (epoch_us(o_orderdate) // 1000) as ts_ms,
               (floor(l_quantity)::bigint * 60000) as duration_ms, l_quantity, l_discount, l_tax, l_linestatus, l_partkey, o_orderpriority, l_shipdate
        from lineitem join orders on l_orderkey = o_orderkey
        where l_orderkey in (select l_orderkey from lineitem group by 1 having count(*) >= 2)
    )"""

ORDERS = f"""{LINES}, runs as (
        select instance_id, user_id, min(ts_ms) as started_ms, sum(duration_ms)::bigint as duration_ms, list(token order by pos, token) as raw_signature
        from lines group by instance_id, user_id
    ), folded as (select *, {FOLD.format("raw_signature")} as signature from runs
    ), keyed as (
        select *, array_to_string(signature, '|') as variant, substr(sha1(array_to_string(signature, '|')), 1, 16) as signature_hash from folded
    )"""

GAP = 240 * 60_000
#: ``fields``: payload fields of the steps; ``runs``: instances with cluster_id; ``groups``: their clusters; ``toks``: step tokens.
RECORDED = f"""{ACTIVITY}, {steps(GAP)}, {INSTANCES},
    loose as (
        select instance_id, pos, unnest([case when ts_ms >= 1705276800000 and app = 'gmail' then 'item k' else 'k' end, 'amount', case when ts_ms >= 1705276800000 and app = 'crm' then 'state' else 'status' end,
                      case when ts_ms >= 1705276800000 then 'Supplier Name' else 'Vendor' end, 'remark']) as key,
               unnest([k::varchar, case when app in ('erp', 'sheets') then round(value * 10000)::bigint::varchar end, '"' || event_type || '"', case when app in ('erp', 'crm') then '"v' || (k % 5) || '"' end,
                       case when k % 7 = 0 then '"case ' || id || ' waits for a word of the person who owns it"' end]) as value
        from steps
    ), fields as (select * from loose where value is not null
    ), runs as (select *, substr(sha1(array_to_string(signature, '|')), 1, 16) as cluster_id from instances
    ), groups as (
        select cluster_id, any_value(signature) as signature, count(*) as n, count(distinct user_id) as users from runs group by 1 having count(*) >= 5 and len(any_value(signature)) >= 3
    ), toks as (
        select cluster_id, instance_id, pos, app || ':' || action || ':' || object_type as token, app, action, object_type, id, ts_ms
        from steps join runs using (instance_id, user_id) where cluster_id in (select cluster_id from groups)
    )"""
#: ``flow``: steps of the flows of all clusters; ``pre``: what earlier steps make.
FLOWS = """
    seen as (
        select cluster_id, token, list_sort(list(distinct case when key in ('Vendor', 'Supplier Name') then 'vendor' else key end)) as fields
        from fields join toks using (instance_id, pos) group by 1, 2
    ), unrolled as (
        select cluster_id as automation_id, unnest(signature) as token, generate_subscripts(signature, 1) as pos from groups
    ), drawn as (
        select u.automation_id, u.pos, 's' || u.pos as step_id, split_part(u.token, ':', 1) as connector, split_part(u.token, ':', 2) as type, split_part(u.token, ':', 3) as object_type, coalesce(s.fields, []) as seen
        from unrolled u left join seen s on s.cluster_id = u.automation_id and s.token = u.token
    ), made as (
        select *, case when len(seen) > 0 then seen when type = 'read' then ['subject', 'sender', 'body'] when type = 'update' then ['record_id', 'status'] when type = 'create' then ['row_id'] else ['result'] end as outputs from drawn
    ), pre as (
        select *, coalesce(flatten(list(outputs) over (partition by automation_id order by pos rows between unbounded preceding and 1 preceding)), []) as before from made
    ), flow as (
        select automation_id, pos, step_id, connector, type, object_type, type || ' ' || replace(object_type, '_', ' ') || ' in ' || connector as description, outputs,
               case when pos = 1 then [] when len(list_filter(seen, lambda f: list_contains(before, f) and f not in ('status', 'amount_inr', 'approval', 'note'))) > 0
                         then list_filter(seen, lambda f: list_contains(before, f) and f not in ('status', 'amount_inr', 'approval', 'note'))
                    when type = 'create' then list_filter(['vendor', 'amount'], lambda f: list_contains(before, f)) when type = 'update' then list_filter(['record_id'], lambda f: list_contains(before, f)) else [] end as depends_on,
               type in ('send', 'delete') or (type = 'create' and connector not in ('files', 'pdf', 'git', 'desktop', 'browser')) as irreversible
        from pre
    ), consts as (
        select cluster_id, case when key in ('Vendor', 'Supplier Name') then 'vendor' else key end as name, min(value) as value from fields join toks using (instance_id, pos) group by 1, 2 having min(value) = max(value)
    ), guard as (
        select f.automation_id, any_value(case first_app when 'gmail' then 'email_received' when 'sheets' then 'schedule' when 'erp' then 'record_updated' else 'manual' end) as trigger_type, any_value(first_object) as trigger_object,
               any_value(held) as irreversible_steps, any_value(case when money then 'amount' else c.field end) as field, any_value(case when money then '>' when c.field is not null then '!=' end) as op,
               any_value(case when money then '1000000' else c.literal end) as literal
        from (select automation_id, arg_min(connector, pos) as first_app, arg_min(object_type, pos) as first_object, coalesce(list(step_id order by pos) filter (where irreversible), []) as held, bool_or(list_contains(outputs, 'amount')) as money from flow group by 1) f
        left join (select cluster_id, arg_min(name, p) as field, arg_min(value, p) as literal from (select *, list_position(['priority', 'status', 'state'], name) as p from (select cluster_id, name, trim(value, '"') as value from consts)) where p > 0 group by 1) c on c.cluster_id = f.automation_id
        group by 1
    )"""
