"""Lists and reports over clusters, automations and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace import constants as C


def majority(rows: DataFrame, by: str, label: str) -> DataFrame:
    """The most frequent label of each group, the first by name of equally frequent ones; null without any label."""
    counts = rows.groupBy(by, label).agg(F.count(label).alias("n"))
    return counts.groupBy(by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("label"), F.max("n").alias("n"))


def cluster_similarity(variants: DataFrame, main: DataFrame, coded: Column) -> DataFrame:
    """Mean edit similarity of a cluster's instances to its representative.

    ``variants`` (cluster_id, signature, n), ``main`` (cluster_id, signature); variants stand for their
    instances, so every distinct signature is compared once. ``coded`` gives a signature one character a step.
    """
    from loomtrace.functions.sequences import sequence_similarity

    shown = variants.select("cluster_id", "n", coded.alias("code")).join(main.select("cluster_id", coded.alias("main")), "cluster_id")
    return shown.groupBy("cluster_id").agg((F.sum(sequence_similarity(F.col("code"), F.col("main")) * F.col("n")) / F.sum("n")).alias("similarity"))


def free_text(found: DataFrame, steps: DataFrame) -> DataFrame:
    """Share of a cluster's steps with a text of more than ``FREE_TEXT_CHARS`` characters in their payload.

    ``found`` (instance_id, pos, key, value) with JSON literals, ``steps`` (cluster_id, instance_id, pos).
    """
    long = found.where(~F.col("key").isin("object_id", "id") & F.col("value").startswith('"') & (F.length("value") - 2 > C.FREE_TEXT_CHARS)).select("instance_id", "pos").distinct().withColumn("long", F.lit(1))
    return steps.join(long, ["instance_id", "pos"], "left").groupBy("cluster_id").agg((F.count("long") / F.count(F.lit(1))).alias("ratio"))


def text_samples(found: DataFrame, steps: DataFrame, shown: int = 8) -> DataFrame:
    """The first long texts of each cluster, by instance, place and key, cut to 200 characters."""
    bare = F.expr("substring(value, 2, length(value) - 2)")
    rows = found.where(F.col("value").startswith('"') & (F.length("value") - 2 > C.FREE_TEXT_CHARS)).select("instance_id", "pos", "key", F.substring(bare, 1, 200).alias("sample"))
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("instance_id", "pos", "key"))
    return rows.join(steps.select("cluster_id", "instance_id", "pos"), ["instance_id", "pos"]).withColumn("nth", nth).where(F.col("nth") <= shown).select("cluster_id", "nth", "sample")


def judgement(ratio: Column) -> Column:
    return F.least(F.lit(1.0), ratio * 1.4)


def reasoning(ratio: Column, branches: Column, entropy: Column) -> Column:
    """The character of a workflow in one sentence."""
    return (
        F.when(ratio > 0.35, F.concat(F.round(ratio * 100).cast("long").cast("string"), F.lit("% of the observed steps carry substantial free text")))
        .when(branches > 3, F.concat(branches.cast("string"), F.lit(" step positions vary between instances")))
        .when(entropy > C.UNSTABLE_ENTROPY, F.lit("no single step order dominates"))
        .otherwise("the steps repeat consistently")
    )


def passes_gate(n: Column, similarity: Column, confidence: Column) -> Column:
    """Whether a cluster of few instances is similar and certain enough; clusters of many always are."""
    return (n >= C.STRONG_INSTANCES) | ((similarity >= C.MIN_SIMILARITY) & (confidence >= C.MIN_CONFIDENCE))


def global_constants(found: DataFrame) -> DataFrame:
    """(key, value) of the fields that have one value everywhere."""
    told = found.where((F.col("key") != C.HINT_KEY) & ~F.col("value").isin("null", '""'))
    return told.groupBy("key").agg(F.min("value").alias("value"), F.max("value").alias("high")).where("value = high").drop("high")


def _shown(part: Column) -> Column:
    return F.translate(part, "_", " ")


def name(signature: Column, entropy: Column, subject: Column, fallback: Column) -> Column:
    """A workflow by where it starts and ends; by its subject (or ``fallback``) if its order is unstable."""
    def last_part(token: Column) -> Column:
        return _shown(F.coalesce(F.get(F.split(token, ":"), F.lit(2)), F.get(F.split(token, ":"), F.lit(0))))

    start, end = last_part(F.get(signature, F.lit(0))), last_part(F.element_at(signature, -1))
    linear = F.when(start == end, F.concat(F.initcap(start), F.lit(" handling"))).otherwise(F.concat(F.initcap(start), F.lit(" to "), end))
    return F.when(F.size(signature) == 0, fallback).when(entropy > C.UNSTABLE_ENTROPY, F.coalesce(F.concat(F.initcap(subject), F.lit(" handling")), fallback)).otherwise(linear)


def subjects(objects: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(cluster_id, subject): the commonest first word of the object types (cluster_id, object_type), if seen twice."""
    head = F.lower(F.substring_index("object_type", "_", 1))
    counts = objects.select("cluster_id", head.alias("head")).where((F.col("head") != "") & ~F.col("head").isin(*ignored)).groupBy("cluster_id", "head").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cluster_id").agg(F.min_by(F.struct("head", "n"), F.struct(-F.col("n"), F.col("head"))).alias("b")).where("b.n >= 2").select("cluster_id", F.col("b.head").alias("subject"))


def describe(signature: Column, n: Column, users: Column) -> Column:
    apps = F.array_join(F.array_distinct(F.transform(signature, lambda t: F.substring_index(t, ":", 1))), " → ")
    return F.concat(F.size(signature).cast("string"), F.lit(" steps across "), apps, F.lit(". Observed "), n.cast("string"), F.lit(" times by "), users.cast("string"), F.lit(" employee(s)."))


def procedure(signature: Column, title: Column, automatable: Column) -> Column:
    """The workflow as a document: a heading, numbered steps and a recommendation."""
    lines = F.transform(signature, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), F.initcap(F.get(F.split(t, ":"), F.lit(1))), F.lit(" "), _shown(F.get(F.split(t, ":"), F.lit(2))), F.lit(" in "), F.get(F.split(t, ":"), F.lit(0))))
    advice = F.when(automatable < C.DO_NOT_AUTOMATE, "Do not automate.").otherwise("Recommended for automation.")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\n"), advice)


def totals(clusters: DataFrame) -> DataFrame:
    """Sums over all clusters, those not to be automated and the dismissed ones included."""
    fit = ~F.col("do_not_automate")
    return clusters.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(fit).alias("automatable"), F.count_if(fit & ~F.col("dismissed")).alias("recommended"),
        F.sum("annual_hours").alias("annual_hours"), F.sum("tax_hours").alias("tax_hours"),
    )


def effort_by_group(clusters: DataFrame, by: str) -> DataFrame:
    """Burden, what automation would give back of it (by how automatable each workflow is), and the share."""
    hours = F.col("annual_hours") + F.col("tax_hours")
    sums = clusters.groupBy(by).agg(
        F.sum("annual_hours").alias("annual"), F.sum("tax_hours").alias("tax"), F.sum(F.when(~F.col("do_not_automate"), hours * F.col("automatability")).otherwise(0.0)).alias("reclaimable"), F.min("do_not_automate").alias("none_automatable")
    )
    burden = F.col("annual") + F.col("tax")
    return sums.select(by, F.round("annual", 1).alias("annual_hours"), F.round("tax", 1).alias("tax_hours"), F.round("reclaimable", 1).alias("reclaimable_hours"), F.when(burden > 0, F.round(F.col("reclaimable") / burden, 3)).otherwise(0.0).alias("reduction"), "none_automatable")


def roi(clusters: DataFrame, automations: DataFrame, by: str = "cluster_id") -> tuple[DataFrame, DataFrame]:
    """(summary of one row, automations by falling hours): what is projected, and what trusted automations have realised."""
    fit = ~F.col("do_not_automate")
    projected = clusters.agg(F.sum(F.when(fit, F.col("annual_hours"))).alias("projected"), F.sum(F.when(fit, F.col("tax_hours"))).alias("tax"), F.count(F.lit(1)).alias("clusters"), F.count_if(fit).alias("automatable"))
    joined = automations.join(clusters.select(by, "annual_hours", "tax_hours"), by, "left").fillna(0.0, ["annual_hours", "tax_hours"])
    trusted = F.col("trust_level").isin("ASSIST", "AUTONOMOUS")
    realised = joined.agg(
        F.sum(F.when(trusted, F.col("annual_hours") * F.col("coverage")).otherwise(0.0)).alias("realised"), F.sum(F.when(trusted, F.col("tax_hours") * F.col("coverage")).otherwise(0.0)).alias("tax_recovered"),
        F.count(F.lit(1)).alias("automations"), F.count_if(F.col("trust_level") == "AUTONOMOUS").alias("autonomous"), F.avg("coverage").alias("average_coverage"),
    )
    names = ("projected", "tax", "realised", "tax_recovered")
    summary = projected.crossJoin(F.broadcast(realised)).select(*(F.round(F.coalesce(c, F.lit(0.0)), 1).alias(c) for c in names), "clusters", "automatable", "automations", "autonomous", F.round(F.coalesce("average_coverage", F.lit(0.0)), 4).alias("average_coverage"))
    return summary, joined.select("automation_id", "trust_level", F.round("coverage", 4).alias("coverage"), "annual_hours", "tax_hours").orderBy(F.desc("annual_hours"), "automation_id")


def tallies(runs: DataFrame, by: str = "automation_id") -> DataFrame:
    """Runs of each automation by how they ended, also told in words."""
    sums = runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "failed", "held")))
    return sums.withColumn("summary", F.format_string("%d filed, %d held for a person, %d failed", "ok", "held", "failed"))


def next_sequence(shadow_runs: DataFrame, automations: DataFrame) -> DataFrame:
    """The number of each automation's next shadow run; 1 for those without any."""
    last = shadow_runs.groupBy("automation_id").agg(F.max("sequence").alias("last"))
    return automations.select("automation_id").join(last, "automation_id", "left").select("automation_id", (F.coalesce("last", F.lit(0)) + 1).alias("next_sequence"))
