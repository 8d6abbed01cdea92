"""Events of a workflow that someone describes in prose, for those who have no log.

Steps are looked for by their words and follow each other as the words do; how often the work is done
comes from the words for it. Runs are spread evenly over the weeks asked for, with durations that vary by a
hash of run and step, so that the same description gives the same events.

Defined results: a text with fewer than two steps (or none at all) is mail that is entered into a sheet;
nothing is known of a null text but that; equal texts of several persons are described each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.operators.ranks import once

_STEP = "struct<at:int,app:string,action:string,object_type:string>"


def steps_of(text: Column) -> Column:
    """array<struct(at, app, action, object_type)>: the steps a text names, in its order."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    found = []
    for words, app, action, kind in C.DESCRIBED_STEPS:
        # least() passes over nulls: words that are not there
        first = F.least(*(F.nullif(F.instr(lower, w), F.lit(0)) for w in (words if len(words) > 1 else [*words, *words])))
        found.append(F.struct(first.alias("at"), F.lit(app).alias("app"), F.lit(action).alias("action"), F.lit(kind).alias("object_type")))
    ordered = F.array_sort(F.filter(F.array(*found), lambda s: s["at"].isNotNull()))
    usual = F.array(*(F.struct(F.lit(i).alias("at"), *(F.lit(v).alias(n) for n, v in zip(("app", "action", "object_type"), step, strict=True))) for i, step in enumerate(C.USUAL_STEPS)))
    return F.when(F.size(ordered) >= 2, ordered).otherwise(usual).cast(f"array<{_STEP}>")


def per_week(text: Column) -> Column:
    """How often a week, by the first cadence word of the list that the text has; five times without one."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*(F.when(F.contains(lower, F.lit(word)), F.lit(times)) for word, times in C.CADENCES), F.lit(5.0))


def described(texts: DataFrame) -> DataFrame:
    """(description_id, user_id, name, steps, per_week) of (description_id, user_id, text)."""
    # words are looked for once a text, in a row of its own, and not for every run and step
    name = F.substring(F.trim(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\.")[0]), 1, 80)
    return texts.select("description_id", "user_id", F.when(name != "", name).otherwise("Described workflow").alias("name"), once(F.struct(steps_of(F.col("text")).alias("steps"), per_week(F.col("text")).alias("per_week"))).alias("d")).select("description_id", "user_id", "name", "d.*")


def events_of(found: DataFrame, weeks: int, until_ms: int) -> DataFrame:
    """Canonical events of enough runs to be detected: at least twelve, evenly over the ``weeks`` before a time."""
    runs = F.greatest(F.lit(12), (F.greatest(F.lit(0.25), F.col("per_week")) * weeks).cast("int"))
    each = found.withColumn("runs", runs).select("*", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"))
    day = F.floor(F.col("run") * weeks * 7 / F.col("runs"))
    mixed = F.pmod(F.xxhash64("description_id", "run"), F.lit(8 * 60))
    begun = each.withColumn("begin_ms", F.lit(until_ms - weeks * 7 * 86_400_000) + day * 86_400_000 + 9 * 3_600_000 + mixed * 60_000)
    steps = begun.select("description_id", "user_id", "run", "begin_ms", F.posexplode("steps").alias("pos", "s"))
    usual = F.coalesce(*(F.when(F.col("s.action") == a, F.lit(n)) for a, n in C.STEP_SECONDS.items()), F.lit(60))
    seconds = F.greatest(F.lit(5), usual + F.pmod(F.xxhash64("description_id", "run", "pos"), F.lit(25)) - 12)
    # steps of a run stand four minutes apart, which is longer than any of them
    return steps.select(
        F.concat_ws("#", F.col("description_id").cast("string"), F.col("run").cast("string")).alias("session_id"), "user_id", (F.col("begin_ms") + F.col("pos") * 240_000).alias("ts_ms"),
        "s.app", "s.action", "s.object_type", (seconds * 1000).cast("long").alias("duration_ms"), F.lit("describe").alias("source"),
    )
