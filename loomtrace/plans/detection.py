"""Detection end to end: sessions, signatures, fuzzy clusters, scores and findings over a whole event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions.normalise import step_token
from loomtrace.operators import clusters as K
from loomtrace.operators import replay as R
from loomtrace.operators import reports as P
from loomtrace.operators import scoring as S
from loomtrace.operators.sessions import instances, sessionise
from loomtrace.plans.adapters import activity, payloads
from loomtrace.sources.shared import written

#: Idle gap of the test events, which are hours apart.
GAP_MS = 240 * 60_000
#: The name of a workflow without a reliable order or a subject.
UNNAMED = "Repetitive workflow"


def detect(events: DataFrame, gap_ms: int = C.SESSION_GAP_MS) -> DataFrame:
    """One row per finding: a cluster of instances with its name, representative, spread, effort, scores and evidence.

    ``events`` are canonical events with a payload value ``k``. Clusters need ``MIN_INSTANCES`` instances and
    a representative of ``MIN_STEPS`` steps; those of fewer than ``STRONG_INSTANCES`` also similarity and
    confidence. Judgement is that of the steps with a long text in their ``payload``; 0 without such a column.
    """
    return findings(written(sessionise(events, gap_ms), "steps"))


def findings(steps: DataFrame) -> DataFrame:
    """``detect`` from the steps of all instances, a written table."""
    runs = written(instances(steps), "runs")
    variants = written(K.variants(runs), "variants")
    placed, pairs = K.clustered(variants)
    placed = written(placed, "placed")
    medoids = written(K.medoids(variants, pairs, placed), "medoids")
    found = written(runs.join(placed, "signature_hash"), "found")
    main = medoids.join(variants.select("signature_hash", "signature"), "signature_hash").select("cluster_id", F.col("signature_hash").alias("main_hash"), "signature")

    both = pairs.select("a", "b", "sequence").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sequence"))
    near = placed.join(variants.select("signature_hash", "n"), "signature_hash").join(main.select("cluster_id", "main_hash"), "cluster_id")
    near = near.join(both.select(F.col("a").alias("signature_hash"), F.col("b").alias("main_hash"), "sequence"), ["signature_hash", "main_hash"], "left")
    alike = near.groupBy("cluster_id").agg((F.sum(F.coalesce("sequence", F.lit(1.0)) * F.col("n")) / F.sum("n")).alias("similarity"))

    values = steps.join(found.select("instance_id", "cluster_id"), "instance_id").select("cluster_id", "instance_id", step_token().alias("token"), F.lit("k").alias("key"), F.col("k").cast("string").alias("value")).where("value is not null")
    fields = S.variables_and_constants(values, found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("runs")))
    fields = fields.groupBy("cluster_id").agg(F.count_if(F.col("kind") == "variable").alias("n_variables"), F.count_if(F.col("kind") == "constant").alias("n_constants"))

    scored = S.step_entropy(found).join(main, "cluster_id").join(alike, "cluster_id").join(S.effort(found).drop("n"), "cluster_id")
    scored = scored.join(found.groupBy("cluster_id").agg((F.sum("duration_ms") / 60_000.0).alias("minutes")), "cluster_id")
    for part in (S.parameter_spread(values), S.branch_count(found, main), fields):
        scored = scored.join(part, "cluster_id", "left")
    scored = scored.fillna({"spread": 0.0, "branches": 0, "n_variables": 0, "n_constants": 0}).withColumns({"steps": F.size("signature"), "apps": F.size(F.array_distinct(F.transform("signature", lambda t: F.split(t, ":")[0])))})
    placed_steps = steps.join(found.select("instance_id", "cluster_id"), "instance_id")
    scored = scored.join(P.subjects(placed_steps.select("cluster_id", "object_type"), C.NAME_STOPWORDS), "cluster_id", "left")
    if "payload" in steps.columns:
        scored = scored.join(P.free_text(R.fields(steps), placed_steps.select("cluster_id", "instance_id", "pos")), "cluster_id", "left").fillna({"ratio": 0.0})
    else:
        scored = scored.withColumn("ratio", F.lit(0.0))
    judged = P.judgement(F.col("ratio"))
    scored = scored.withColumns({
        "automatability": S.automatability(F.col("entropy"), F.col("spread"), F.col("branches"), F.col("steps"), judged),
        "build_effort": S.build_effort(F.col("steps"), F.col("branches")),
        "potential": S.potential(F.col("similarity"), F.col("n_instances"), F.col("minutes"), F.col("spread"), F.col("apps"), judged, F.col("branches"), F.col("steps")),
    })
    scored = scored.withColumn("confidence", S.confidence(F.col("n_instances"), F.col("similarity"), F.col("automatability")))
    strong = (F.col("n_instances") >= C.STRONG_INSTANCES) | ((F.col("similarity") >= C.MIN_SIMILARITY) & (F.col("confidence") >= C.MIN_CONFIDENCE))
    return scored.where((F.col("n_instances") >= C.MIN_INSTANCES) & (F.col("steps") >= C.MIN_STEPS) & strong).select(
        "cluster_id", P.name(F.col("signature"), F.col("entropy"), F.col("subject"), F.lit(UNNAMED)).alias("name"), P.describe(F.col("signature"), F.col("n_instances"), F.col("users")).alias("description"),
        judged.alias("judgement"), P.reasoning(F.col("ratio"), F.col("branches"), F.col("entropy")).alias("reasoning"), "signature", "n_instances", "n_variants", "users", "median_ms", "entropy", "spread", "branches", "similarity", "n_variables", "n_constants",
        "annual_hours", "tax_hours", "automatability", "build_effort", "potential", "confidence", S.evidence(F.col("n_instances"), F.col("similarity"), F.col("confidence")).alias("evidence"),
        ((F.col("annual_hours") + F.col("tax_hours")) * F.col("automatability") / F.col("build_effort")).alias("priority"), (F.col("automatability") < C.DO_NOT_AUTOMATE).alias("do_not_automate"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection over all events of the test tables."""
    return detect(payloads(activity(spark, sf_dir)), GAP_MS)
