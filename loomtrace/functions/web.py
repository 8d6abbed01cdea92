"""Column functions that interpret browser signals: URL structure, application, action and object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions.normalise import lookup

_URL = r"^(?:([^:/?#]+)://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    """Scheme 1, host with port 2, path 3, query 4 or fragment 5; empty if absent."""
    return F.regexp_extract(url, _URL, group)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), ":[0-9]*$", ""))


def segments(url: Column) -> Column:
    return F.filter(F.split(part(url, 3), "/"), lambda s: s != "")


def _keys(query: Column) -> Column:
    named = F.filter(F.split(query, "&"), lambda p: p != "")
    names = F.array_distinct(F.transform(named, lambda p: F.substring_index(p, "=", 1)))
    return F.array_join(F.transform(names, lambda k: F.concat(k, F.lit("="))), "&")


def sanitise_url(url: Column) -> Column:
    """The structure of a URL without its values: keys of the query, no long or personal path segments."""

    def safe(segment: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(segment), segment)
        return F.when((F.length(plain) > 40) | plain.rlike(r"[\s@]"), F.lit("_")).otherwise(segment)

    path = F.array_join(F.transform(F.split(part(url, 3), "/"), safe), "/")
    query, fragment = part(url, 4), part(url, 5)
    shown = F.when(F.contains(fragment, F.lit("=")), F.concat(F.lit("#"), _keys(fragment))).when((fragment != "") & (F.length(fragment) <= 120), F.concat(F.lit("#"), fragment)).otherwise("")
    scheme = F.when(part(url, 1) == "", F.lit("https")).otherwise(part(url, 1))
    whole = F.concat(scheme, F.lit("://"), part(url, 2), path, F.when(query != "", F.concat(F.lit("?"), _keys(query))).otherwise(""), shown)
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).otherwise(whole)


def app_for_host(url: Column) -> Column:
    """Application of a URL: by path, by host, by longest known suffix, else the registrable label."""
    name = host(url)
    hosts = sorted(C.HOST_APPS.items(), key=lambda p: (-len(p[0]), p[0]))
    by_path = F.coalesce(*(F.when((name == h) & F.startswith(part(url, 3), F.lit(prefix)), F.lit(app)) for h, prefix, app in C.PATH_APPS))
    by_suffix = F.coalesce(*(F.when((name == h) | F.endswith(name, F.lit("." + h)), F.lit(app)) for h, app in hosts))
    labels = F.filter(F.split(name, r"\."), lambda p: p != "")
    double = (F.size(labels) >= 3) & F.get(labels, F.size(labels) - 2).isin(*C.SECOND_LEVEL)
    kept = F.slice(labels, 1, F.greatest(F.size(labels) - F.when(double, 2).otherwise(1), F.lit(0)))
    own = F.filter(kept, lambda p: ~p.isin(*C.GENERIC_SUBDOMAINS))
    last = F.coalesce(F.try_element_at(own, F.lit(-1)), F.try_element_at(kept, F.lit(-1)))
    label = F.substring(F.regexp_replace(last, "[^a-z0-9_-]", ""), 1, 40)
    return F.when(name == "", F.lit("browser")).otherwise(F.coalesce(by_path, by_suffix, F.when((F.size(labels) >= 2) & (label != ""), label), F.lit("browser")))


def infer_action(interaction: Column, label: Column, role: Column) -> Column:
    """A labelled click or submit by its label, a click in a search box, else the interaction."""
    kind = F.lower(F.coalesce(interaction, F.lit("")))
    labelled = F.coalesce(*(F.when(label.rlike(rf"(?i)\b({words})\b"), F.lit(action)) for action, words in C.LABEL_ACTIONS))
    return F.coalesce(
        F.when(kind.isin("click", "submit"), labelled),
        F.when((kind == "click") & role.isin("searchbox", "search"), F.lit("search")),
        lookup(C.INTERACTIONS, kind),
        F.lit("read"),
    )


def infer_object_type(url: Column, title: Column, label: Column, field: Column) -> Column:
    """First matching hint, a form field, else the last path segment that is no identifier."""
    text = F.concat_ws(" ", *(F.when(x != "", x) for x in (part(url, 3), part(url, 4), title, label)))
    hint = F.coalesce(*(F.when(text.rlike("(?i)" + pattern), F.lit(kind)) for kind, pattern in C.OBJECT_HINTS))
    names = F.filter(F.reverse(segments(url)), lambda s: ~s.rlike(r"(?i)^([0-9a-f-]{6,}|\d+)$"))
    cleaned = F.filter(F.transform(names, lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9_]", "_"), "^_+|_+$", "")), lambda s: s != "")
    last = F.regexp_replace(F.substring(F.get(cleaned, F.lit(0)), 1, 40), "s+$", "")
    return F.coalesce(hint, F.when(F.coalesce(field, F.lit("")) != "", F.lit("form_field")), F.when(last != "", last), F.lit("page"))


def object_id(url: Column) -> Column:
    """Last path segment that looks like an identifier."""
    return F.substring(F.get(F.filter(F.reverse(segments(url)), lambda s: s.rlike(r"^(\d{2,}|[0-9a-f]{8,}|[A-Z]{2,}-\d+)$")), F.lit(0)), 1, 128)


def denied(url: Column, denylist: Column) -> Column:
    """Whether any entry of the list is part of the URL, whatever the case."""
    return F.exists(denylist, lambda d: (F.trim(d) != "") & F.contains(F.lower(url), F.lower(F.trim(d))))


def interpret(signals, with_values: bool = False):
    """Canonical app, action, object_type, object_id and payload of raw signals."""
    url = sanitise_url(F.col("url"))
    fields = [("field", F.substring("field_name", 1, 64)), ("control", F.substring("label", 1, 80)), ("transfer_digest", F.col("payload_digest"))]
    if with_values:
        fields.append(("title", F.substring("title", 1, 200)))
    named = F.map_from_arrays(F.array(*(F.lit(k) for k, _ in fields)), F.array(*(v for _, v in fields)))
    return signals.withColumns(
        {
            "app": app_for_host(url),
            "action": infer_action(F.col("interaction"), F.col("label"), F.col("role")),
            "object_type": infer_object_type(url, F.col("title"), F.col("label"), F.col("field_name")),
            "object_id": object_id(url),
            "payload": F.map_filter(named, lambda k, v: v.isNotNull() & (v != "")),
        }
    )
