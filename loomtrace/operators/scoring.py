"""Scores of clusters of instances: order, spread, effort, automatability, potential and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.operators.ranks import medians


def step_entropy(instances: DataFrame, cluster: str = "cluster_id", variant: str = "signature_hash") -> DataFrame:
    """Normalised entropy of variants, number of variants and share of the dominant one, per cluster."""
    counts = instances.groupBy(cluster, variant).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(cluster)
    share = F.col("n") / F.sum("n").over(total)
    parts = counts.select(cluster, "n", share.alias("share"))
    return parts.groupBy(cluster).agg(
        F.sum("n").alias("n_instances"),
        F.count(F.lit(1)).alias("n_variants"),
        F.when(F.count(F.lit(1)) > 1, -F.sum(F.col("share") * F.log2("share")) / F.log2(F.count(F.lit(1)).cast("double"))).otherwise(0.0).alias("entropy"),
        F.max("share").alias("dominant_share"),
    )


def parameter_spread(values: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Mean over keys with two values or more of (distinct - 1) / (n - 1), per cluster; input (cluster, key, value)."""
    counts = values.where("value is not null").groupBy(cluster, "key", "value").agg(F.count(F.lit(1)).alias("n"))
    per_key = counts.groupBy(cluster, "key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).where("n >= 2")
    return per_key.groupBy(cluster).agg(F.avg((F.col("d") - 1) / (F.col("n") - 1)).alias("spread"))


def branch_count(instances: DataFrame, representative: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Positions at which instances differ, among tokens of the cluster's representative."""
    joined = instances.join(representative.select(cluster, F.col("signature").alias("main")), cluster)
    kept = joined.select(cluster, F.posexplode(F.filter("signature", lambda t: F.array_contains(F.col("main"), t))).alias("pos", "token"))
    at = kept.groupBy(cluster, "pos").agg(F.countDistinct("token").alias("tokens"))
    return at.groupBy(cluster).agg(F.count_if(F.col("tokens") > 1).alias("branches"))


def effort(instances: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Median duration, users, weekly rate, annual hours and interruption tax, per cluster."""
    span_days = F.greatest(F.floor((F.max("started_ms") - F.min("started_ms")) / 86_400_000), F.lit(1))
    base = instances.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("user_id").alias("users"),
        span_days.alias("days"),
        F.sum("context_switches").alias("switches"),
    )
    middle = medians(instances, [cluster], "duration_ms", "median")
    base = base.join(middle, cluster).withColumn("median_ms", F.col("median").cast("long"))
    rated = base.withColumn("weekly", F.col("n") / F.col("users") / (F.col("days") / 7.0))
    yearly = F.col("weekly") * C.WORK_WEEKS * F.col("users")
    return rated.select(
        cluster, "n", "users", "median_ms", "weekly", "switches",
        (F.col("median_ms") / 3_600_000.0 * yearly).alias("annual_hours"),
        (F.col("switches") / F.col("n") * yearly * C.SWITCH_MINUTES / 60.0).alias("tax_hours"),
    )


def clamp(x: Column, high: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(high), x))


def automatability(entropy: Column, spread: Column, branches: Column, steps: Column, judgement: Column) -> Column:
    w = C.VARIANCE_WEIGHTS
    forks = F.least(F.lit(1.0), branches / F.greatest(steps, F.lit(1)))
    return clamp(1 - (w["entropy"] * entropy + w["spread"] * spread + w["branches"] * forks + w["judgement"] * judgement))


def build_effort(steps: Column, branches: Column) -> Column:
    """1 to 5 by length, one more for several branches."""
    return F.greatest(F.lit(1), F.least(F.lit(5), 1 + F.floor(steps / 3) + F.when(branches > 2, 1).otherwise(0))).cast("long")


def potential(similarity: Column, executions: Column, minutes: Column, spread: Column, apps: Column, judgement: Column, branches: Column, steps: Column) -> Column:
    """0 to 100: weighted factors less deductions for judgement and for branches of dissimilar runs."""
    w = C.POTENTIAL_WEIGHTS
    factors = (
        clamp(similarity) * w["similarity"]
        + F.least(F.lit(1.0), executions / C.FREQUENCY_CEILING) * w["frequency"]
        + F.least(F.lit(1.0), minutes / C.EFFORT_CEILING_MINUTES) * w["time_impact"]
        + clamp(1 - spread) * w["predictability"]
        + F.least(F.lit(1.0), apps / C.SYSTEMS_CEILING) * w["systems"]
    )
    off = F.least(F.lit(25.0), judgement * 40) + F.least(F.lit(15.0), branches / F.greatest(steps, F.lit(1)) * 15) * (1 - F.least(F.lit(1.0), similarity))
    return F.bround(clamp(factors * 100 - off, 100.0)).cast("long")


def confidence(occurrences: Column, similarity: Column, automatable: Column) -> Column:
    seen = F.least(F.lit(1.0), occurrences / C.STRONG_INSTANCES)
    return F.round(clamp(0.25 * seen + 0.40 * clamp(similarity) + 0.35 * clamp(automatable)), 3)


def evidence(occurrences: Column, similarity: Column, confident: Column) -> Column:
    strong = (occurrences >= C.STRONG_INSTANCES) & (similarity >= C.STRONG_SIMILARITY) & (confident >= C.STRONG_CONFIDENCE)
    moderate = (occurrences >= C.STRONG_INSTANCES) | ((occurrences >= C.MIN_INSTANCES) & (similarity >= C.STRONG_SIMILARITY))
    return F.when(strong, "strong").when(moderate, "moderate").otherwise("early")


def presence(steps: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """How many instances have a field (cluster, token, key, present), from steps (cluster, instance_id, token, keys).

    An instance is one row with all its fields, and only their names are written out: grouping every field of
    every instance instead took a task's whole memory.
    """
    own = steps.groupBy(cluster, "instance_id").agg(F.collect_set(F.struct("token", "keys")).alias("steps"))
    named = F.flatten(F.transform("steps", lambda s: F.transform(s["keys"], lambda k: F.struct(s["token"].alias("token"), k.alias("key")))))
    fields = own.select(cluster, F.explode(F.array_distinct(named)).alias("f"))
    return fields.groupBy(cluster, "f.token", "f.key").agg(F.count(F.lit(1)).alias("present"))


def variables_and_constants(observed: DataFrame, runs: DataFrame, cluster: str = "cluster_id", present: DataFrame | None = None) -> DataFrame:
    """Fields (cluster, token, key, value, instance_id) as inputs that vary or values that never do.

    A field counts if enough of the cluster's runs have it; in between varying and constant it is neither.
    ``present`` is their ``presence`` where the steps are at hand.
    """
    # values and instances are counted apart: distinct counts of both at once would write every row several times
    field = [cluster, "token", "key"]
    values = observed.groupBy(*field, "value").agg(F.count("value").alias("n")).groupBy(*field).agg(F.sum("n").alias("n_values"), F.count("value").alias("n_distinct"), F.min("value").alias("least_value"))
    if present is None:
        present = observed.groupBy(*field, "instance_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*field).agg(F.count("instance_id").alias("present"))
    joined = values.join(present, field).join(runs, cluster).where(F.col("present") >= F.col("runs") * C.MIN_PRESENCE)
    kind = F.when(F.col("n_distinct") == 1, "constant").when(F.col("n_distinct") >= F.col("n_values") * C.VARIABLE_RATIO, "variable")
    return joined.withColumn("kind", kind).where("kind is not null")
