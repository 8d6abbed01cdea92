"""Column functions that bring fields of raw activity rows into the canonical vocabulary."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace import constants as C


def lookup(table: dict, key: Column) -> Column:
    """The value of a small literal table, null if absent."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def clean(raw: Column) -> Column:
    return F.lower(F.trim(F.coalesce(raw, F.lit(""))))


def canonical_key(name: Column) -> Column:
    """A column heading as a comparable key."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def plain_key(name: str) -> str:
    """``canonical_key`` of a heading the driver knows."""
    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def slug(name: Column) -> Column:
    """Letters and digits of a name, joined by single underscores; ``unknown`` if there are none."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(joined != "", joined).otherwise("unknown")


def duration_ms(raw: Column, bare_unit_ms: int = 1000) -> Column:
    """Milliseconds of a duration as people write it; 0 if there is no number."""
    ranked = "|".join(sorted(C.DURATION_UNITS, key=lambda u: (-len(u), u)))
    pattern = rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*({ranked})?"
    number = F.regexp_extract(raw, pattern, 1)
    unit = F.lower(F.regexp_extract(raw, pattern, 2))
    scale = F.coalesce(lookup(C.DURATION_UNITS, unit), F.lit(bare_unit_ms))
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit(0).cast("long")).otherwise((number.cast("double") * scale).cast("long"))


def canonical_app(raw: Column) -> Column:
    """Known application, else an alias, else the first alias the label contains, else the label."""
    key = clean(raw)
    contained = F.coalesce(*(F.when(F.contains(key, F.lit(alias)), F.lit(target)) for alias, target in C.APP_ALIASES))
    return F.when(key.isin(*C.APPS), key).otherwise(F.coalesce(lookup(dict(C.APP_ALIASES), key), contained, F.when(key != "", key), F.lit("browser")))


def canonical_action(raw: Column) -> Column:
    """Known verb, else an alias, else the word itself; ``read`` if empty."""
    key = clean(raw)
    return F.when(key.isin(*C.ACTIONS), key).otherwise(F.coalesce(lookup(C.ACTION_ALIASES, key), F.when(key != "", key), F.lit("read")))


def split_action(raw: Column) -> Column:
    """struct(verb, object) of a compound action such as ``copy_customer_information``."""
    verbs, noise = C.SPLIT_VERBS, C.NOISE_WORDS
    key = F.regexp_replace(clean(raw), "[- ]", "_")
    parts = F.filter(F.split(key, "_"), lambda p: p != "")

    def chosen(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*verbs), i)), lambda i: i.isNotNull())
        return F.element_at(F.transform(F.array(places), lambda at: built(words, at)), 1)

    def built(words: Column, places: Column) -> Column:
        first = F.get(places, F.lit(0))
        verb = lookup(verbs, F.get(words, first))
        after = F.slice(words, first + 2, F.size(words))
        plain = F.filter(after, lambda w: ~w.isin(*noise))
        bare = F.filter(plain, lambda w: ~w.isin(*verbs))
        before = F.filter(F.slice(words, 1, F.greatest(first, F.lit(0))), lambda w: ~w.isin(*noise) & ~w.isin(*verbs))
        stacked = (F.size(places) > 1) & (verb == "read")
        found = F.struct(
            F.when(stacked, F.lit("navigate")).otherwise(verb).alias("verb"),
            F.array_join(F.when(stacked, plain).when(F.size(bare) > 0, bare).otherwise(before), "_").alias("object"),
        )
        plain_word = F.struct(canonical_action(key).alias("verb"), F.lit("").alias("object"))
        return F.when(F.size(places) > 0, found).otherwise(plain_word)

    return F.element_at(F.transform(F.array(parts), chosen), 1)


def parse_timestamp(raw: Column) -> Column:
    """ISO-8601 or one of three written forms; times without a zone are UTC; null if none fits."""
    text = F.trim(raw)
    forms = ("yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss")
    return F.coalesce(F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in forms))


def step_token(app: str = "app", action: str = "action", object_type: str = "object_type") -> Column:
    return F.concat_ws(":", app, action, object_type)


def digest(text: Column) -> Column:
    """Join key for copied values: the value itself is never kept."""
    return F.substring(F.sha2(text, 256), 1, 16)
