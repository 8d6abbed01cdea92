"""Queries that apply the scalar normalisation and URL functions to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions import normalise as N
from loomtrace.functions import web as W
from loomtrace.plans.adapters import table

# written durations, headings, labels and actions, made from part and supplier columns
_SHAPES = ["{} min", "{}s", "{} hours", "{}", "{}.5 h", "about {} ms", "none"]


def _duration_text(n):
    out = F.lit("none")
    for i, shape in enumerate(_SHAPES[:-1]):
        out = F.when(n % len(_SHAPES) == i, F.format_string(shape.replace("{}", "%d"), n)).otherwise(out)
    return out


def norm_duration(spark, sf_dir):
    """Written durations in milliseconds, with and without a default unit of seconds."""
    parts = table(spark, sf_dir, "part").select("p_partkey", _duration_text(F.col("p_partkey")).alias("raw"))
    return parts.select("p_partkey", "raw", N.duration_ms(F.col("raw")).alias("ms"), N.duration_ms(F.col("raw"), 1).alias("bare_ms"))


def norm_key(spark, sf_dir):
    """Part names and types as comparable keys."""
    return table(spark, sf_dir, "part").select("p_partkey", N.canonical_key(F.concat(F.lit(" --"), "p_type", F.lit(" / "), "p_name", F.lit("? "))).alias("key"))


_RAW_APPS = [*(a for a, _ in C.APP_ALIASES), *C.APPS, "My Google Mail", "SAP GUI", "whatsapp", "Ledger", "", "unknown tool"]


def _labels(n):
    return F.element_at(F.array(*map(F.lit, _RAW_APPS)), (n % len(_RAW_APPS) + 1).cast("int"))


def norm_app(spark, sf_dir):
    """Application labels in the canonical vocabulary."""
    label = _labels(F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", label.alias("raw"), N.canonical_app(F.upper(label)).alias("app"))


_ACTIONS = ["Open", "copy_customer_information", "open_create_issue", "set priority", "Review resume", "email", "approve-invoice", "lookup", "invoice_details_update", "Juggle", "", "send", "goto page data", "file report form"]


def norm_action(spark, sf_dir):
    """Actions as canonical verbs, and compound actions as verb and object."""
    raw = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("p_partkey") % len(_ACTIONS) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    split = rows.select("p_partkey", N.canonical_action(F.col("raw")).alias("action"), N.split_action(F.col("raw")).alias("s"))
    return split.select("p_partkey", "action", F.col("s.verb").alias("verb"), F.col("s.object").alias("object"))


def parse_ts(spark, sf_dir):
    """Times in four written forms and one that is none."""
    form = F.col("o_orderkey") % 5
    when = F.col("o_orderdate")
    text = (
        F.when(form == 0, F.date_format(when, "yyyy-MM-dd HH:mm"))
        .when(form == 1, F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 2, F.date_format(when, "yyyy/MM/dd HH:mm:ss"))
        .when(form == 3, F.date_format(when, "dd-MM-yyyy HH:mm:ss"))
        .otherwise(F.lit("yesterday"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("raw")).select("o_orderkey", F.unix_seconds(N.parse_timestamp(F.col("raw"))).alias("seconds"))


def url_sanitise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.sanitise_url(F.col("url")).alias("url"))


def url_parts(spark, sf_dir):
    """Application, object type, identifier and verb of each page's URL."""
    label = F.element_at(F.array(*map(F.lit, ["Save draft", "Send", "Add new", "Export", "plain", ""])), (F.col("page_id") % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ["click", "pageview", "submit", "paste", "focus"])), (F.col("page_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", label.alias("label"), kind.alias("interaction"))
    return rows.select(
        "page_id",
        W.app_for_host(F.col("url")).alias("app"),
        W.infer_object_type(F.col("url"), F.lit(""), F.lit(""), F.lit("")).alias("object_type"),
        W.object_id(F.col("url")).alias("object_id"),
        W.infer_action(F.col("interaction"), F.col("label"), F.lit("button")).alias("action"),
        W.denied(F.col("url"), F.array(F.lit(" Example.ORG "), F.lit("/de/"))).alias("denied"),
    )


def digests(spark, sf_dir):
    """Digests of document texts: how many texts share each, for those that are shared."""
    return table(spark, sf_dir, "documents").groupBy(N.digest(F.col("text")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def invoice_fields(spark, sf_dir):
    """Fields of a written invoice: number, ISO date, last amount in minor units, first capital line as vendor."""
    text = F.concat(
        F.upper(F.concat(F.lit("acme trading "), "o_orderpriority")), F.lit("\nInvoice No: INV-"), F.col("o_orderkey").cast("string"),
        F.lit("\nDate: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nSubtotal 10.00\nTotal "), F.format_string("%.2f", F.round("o_totalprice", 2)),
    )
    amounts = F.regexp_extract_all("text", F.lit(r"(\d+\.\d{2})"), F.lit(1))
    vendor = F.get(F.filter(F.split("text", "\n"), lambda x: (F.length(x) > 8) & x.rlike("^[^a-z]+$")), F.lit(0))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select(
        "o_orderkey",
        F.regexp_extract("text", r"Invoice No: ([A-Z0-9-]+)", 1).alias("number"),
        F.regexp_extract("text", r"(\d{4}-\d{2}-\d{2})", 1).alias("dated"),
        F.round(F.element_at(amounts, -1).cast("double") * 100).cast("long").alias("minor_units"),
        vendor.alias("vendor"),
    )


QUERIES = {
    "norm_duration": norm_duration,
    "norm_key": norm_key,
    "norm_app": norm_app,
    "norm_action": norm_action,
    "parse_ts": parse_ts,
    "url_sanitise": url_sanitise,
    "url_parts": url_parts,
    "digests": digests,
    "invoice_fields": invoice_fields,
}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(pairs, key: str, test: str = "{key} = '{a}'") -> str:
    return " ".join(f"when {test.format(key=key, a=a)} then '{b}'" for a, b in pairs)


_UNITS = C.DURATION_UNITS
_UNIT_PATTERN = "|".join(sorted(_UNITS, key=lambda u: (-len(u), u)))
_SHAPE_SQL = "case p_partkey % 7 when 0 then p_partkey || ' min' when 1 then p_partkey || 's' when 2 then p_partkey || ' hours' when 3 then p_partkey::varchar when 4 then p_partkey || '.5 h' when 5 then 'about ' || p_partkey || ' ms' else 'none' end"


def _ms(bare: int) -> str:
    scale = " ".join(f"when '{u}' then {s}" for u, s in _UNITS.items())
    number, unit = (f"regexp_extract(raw, '(?i)([0-9]+(?:\\.[0-9]+)?)\\s*({_UNIT_PATTERN})?', {k})" for k in (1, 2))
    return f"case when {number} = '' then 0 else trunc({number}::double * case lower({unit}) {scale} else {bare} end)::bigint end"


_VERBS, _PLAIN = C.SPLIT_VERBS, C.ACTION_ALIASES
_PATH = "regexp_extract(url, '^(?:([^:/?#]+)://)?([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$', {0})"
_HOSTS = sorted(C.HOST_APPS.items(), key=lambda p: (-len(p[0]), p[0]))

ORACLES = {
    "norm_duration": f"with r as (select p_partkey, {_SHAPE_SQL} as raw from part) select p_partkey, raw, {_ms(1000)} as ms, {_ms(1)} as bare_ms from r",
    "norm_key": "select p_partkey, trim(regexp_replace(lower(trim(' --' || p_type || ' / ' || p_name || '? ')), '[^a-z0-9]+', '_', 'g'), '_') as key from part",
    "norm_app": f"""with r as (select p_partkey, ({_list(_RAW_APPS)})[p_partkey % {len(_RAW_APPS)} + 1] as raw from part), k as (select *, lower(trim(raw)) as key from r)
        select p_partkey, raw, case when key in ({_list(C.APPS)[1:-1]}) then key {_case(C.APP_ALIASES, "key")} {_case(C.APP_ALIASES, "key", "contains({key}, '{a}')")} when key = '' then 'browser' else key end as app from k""",
    "norm_action": f"""with r as (select p_partkey, lower(trim(({_list(_ACTIONS)})[p_partkey % {len(_ACTIONS)} + 1])) as raw from part),
        k as (select *, list_filter(string_split(regexp_replace(raw, '[- ]', '_', 'g'), '_'), lambda p: p <> '') as parts from r),
        v as (select *, list_filter(range(1, len(parts) + 1), lambda i: parts[i] in ({_list(_VERBS)[1:-1]})) as places from k),
        a as (select *, case parts[places[1]] {" ".join(f"when '{a}' then '{b}'" for a, b in _VERBS.items())} end as verb0,
                     list_filter(parts[places[1] + 1:], lambda p: p not in ({_list(C.NOISE_WORDS)[1:-1]})) as plain,
                     list_filter(parts[:places[1] - 1], lambda p: p not in ({_list([*C.NOISE_WORDS, *_VERBS])[1:-1]})) as before from v),
        b as (select *, list_filter(plain, lambda p: p not in ({_list(_VERBS)[1:-1]})) as bare,
                     case when raw in ({_list(C.ACTIONS)[1:-1]}) then raw {_case(_PLAIN.items(), "raw")} when raw = '' then 'read' else raw end as action,
                     case when array_to_string(parts, '_') in ({_list(C.ACTIONS)[1:-1]}) then array_to_string(parts, '_') {_case(_PLAIN.items(), "array_to_string(parts, '_')")}
                          when raw = '' then 'read' else regexp_replace(raw, '[- ]', '_', 'g') end as fallback from a)
        select p_partkey, action,
               case when len(places) = 0 then fallback when len(places) > 1 and verb0 = 'read' then 'navigate' else verb0 end as verb,
               case when len(places) = 0 then '' when len(places) > 1 and verb0 = 'read' then array_to_string(plain, '_')
                    when len(bare) > 0 then array_to_string(bare, '_') else coalesce(array_to_string(before, '_'), '') end as object
        from b""",
    "parse_ts": "select o_orderkey, case o_orderkey % 5 when 0 then epoch_us(date_trunc('minute', o_orderdate)) // 1000000 when 4 then null else epoch_us(o_orderdate) // 1000000 end as seconds from orders",
    "url_sanitise": f"""with p as (select page_id, {", ".join(f"{_PATH.format(i)} as {n}" for i, n in enumerate(["scheme", "host", "path", "query", "fragment"], 1))} from pages),
        s as (select *, array_to_string(list_transform(string_split(path, '/'), lambda x: case when length(url_decode(x)) > 40 or regexp_matches(url_decode(x), '[\\s@]') then '_' else x end), '/') as clean from p)
        select page_id, scheme || '://' || host || clean
               || case when query <> '' then '?' || array_to_string(list_transform(list_distinct_ordered, lambda k: k || '='), '&') else '' end
               || case when contains(fragment, '=') then '#' || split_part(fragment, '=', 1) || '=' when fragment <> '' and length(fragment) <= 120 then '#' || fragment else '' end as url
        from (select *, list_transform(list_filter(list_transform(string_split(query, '&'), lambda x, i: struct_pack(k := split_part(x, '=', 1), i := i)),
                        lambda e: e.k <> '' and list_position(list_transform(string_split(query, '&'), lambda x: split_part(x, '=', 1)), e.k) = e.i), lambda e: e.k) as list_distinct_ordered from s)""",
    "url_parts": f"""with p as (select page_id, url, lower({_PATH.format(2)}) as host, {_PATH.format(3)} as path, {_PATH.format(4)} as query,
               (['Save draft', 'Send', 'Add new', 'Export', 'plain', ''])[page_id % 6 + 1] as label, (['click', 'pageview', 'submit', 'paste', 'focus'])[page_id % 5 + 1] as kind from pages),
        q as (select *, string_split(host, '.') as labels, list_filter(string_split(path, '/'), lambda s: s <> '') as segs, concat_ws(' ', nullif(path, ''), nullif(query, '')) as hay from p),
        w as (select *, labels[:len(labels) - case when len(labels) >= 3 and labels[len(labels) - 1] in ({_list(C.SECOND_LEVEL)[1:-1]}) then 2 else 1 end] as kept from q),
        v as (select *, list_filter(kept, lambda x: x not in ({_list(C.GENERIC_SUBDOMAINS)[1:-1]})) as own,
                     list_filter(list_transform(list_filter(list_reverse(segs), lambda s: not regexp_full_match(s, '(?i)[0-9a-f-]{{6,}}|\\d+')), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9_]', '_', 'g'), '_')), lambda s: s <> '') as names from w)
        select page_id,
               case {" ".join(f"when host = '{h}' and starts_with(path, '{x}') then '{a}'" for h, x, a in C.PATH_APPS)} {" ".join(f"when host = '{h}' or ends_with(host, '.{h}') then '{a}'" for h, a in _HOSTS)}
                    when len(labels) < 2 then 'browser' else coalesce(nullif(left(regexp_replace(coalesce(own[len(own)], kept[len(kept)]), '[^a-z0-9_-]', '', 'g'), 40), ''), 'browser') end as app,
               case {" ".join(f"when regexp_matches(hay, '(?i){x}') then '{k}'" for k, x in C.OBJECT_HINTS)} else coalesce(nullif(rtrim(left(names[1], 40), 's'), ''), 'page') end as object_type,
               left(list_filter(list_reverse(segs), lambda s: regexp_full_match(s, '\\d{{2,}}|[0-9a-f]{{8,}}|[A-Z]{{2,}}-\\d+'))[1], 128) as object_id,
               case when kind in ('click', 'submit') and label = 'Save draft' then 'update' when kind in ('click', 'submit') and label = 'Send' then 'send' when kind in ('click', 'submit') and label = 'Add new' then 'create'
                    when kind in ('click', 'submit') and label = 'Export' then 'extract' else case kind when 'click' then 'navigate' when 'pageview' then 'read' when 'submit' then 'create' when 'paste' then 'create' else 'read' end end as action,
               contains(lower(url), 'example.org') or contains(lower(url), '/de/') as denied
        from v""",
    "digests": "select left(sha256(text), 16) as digest, count(*) as n, min(doc_id) as first_doc from documents group by 1 having count(*) > 1",
    "invoice_fields": """select o_orderkey, 'INV-' || o_orderkey as number, strftime(o_orderdate, '%Y-%m-%d') as dated, round(round(o_totalprice, 2) * 100)::bigint as minor_units,
        'ACME TRADING ' || upper(o_orderpriority) as vendor from orders""",
}
