"""Fuzzy clusters of step signatures: a similarity join of variants and average linkage, for any number of them.

Variants that can be similar enough to merge are found by prefixes of their steps in a common order, with a
bound that no pair above the cut can miss (``candidates``). Merges never leave a component of such pairs. A
small component is clustered in one task along chains of nearest neighbours; a large one stays a table of
sums between clusters, in which all pairs of clusters that are nearest to each other merge at once. Average
linkage is reducible: a merge never brings two others' merge nearer, so both give what merging the closest
pair again and again gives (but for ties, which go to the smaller name).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.functions.sequences import encoded, jaccard, sequence_similarity
from loomtrace.sources.shared import written

#: Components of more variants than this are clustered as a table, in rounds.
LOCAL = 1500
#: Similarities are added up as whole multiples of this, so that sums don't depend on their order.
UNIT = 1e-12
#: Added to bounds, which are compared with a sum of rounded products.
SLACK = 1e-9
#: Ids that are broadcast at most; more are joined by a shuffle.
SENT = 1_000_000


def variants(instances: DataFrame) -> DataFrame:
    """Distinct collapsed signatures with their number of instances."""
    return instances.groupBy("signature_hash").agg(F.first("signature").alias("signature"), F.count(F.lit(1)).alias("n"))


def char_ngrams(signature_text: DataFrame) -> DataFrame:
    """(signature_hash, gram, tf) of character 3- to 5-grams inside words padded by one blank each side."""
    words = signature_text.select("signature_hash", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("word"))
    padded = words.select("signature_hash", F.concat(F.lit(" "), "word", F.lit(" ")).alias("word"))
    sizes = padded.select("signature_hash", "word", F.explode(F.sequence(F.lit(3), F.least(F.lit(5), F.length("word")))).alias("n"))
    grams = sizes.select("signature_hash", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("n") + 1), lambda i: F.substring(F.col("word"), i, F.col("n")))).alias("gram"))
    return grams.groupBy("signature_hash", "gram").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(found: DataFrame) -> DataFrame:
    """(signature_hash, gram, weight): unit TF-IDF vectors with smoothed inverse document frequency over all variants."""
    grams = char_ngrams(found.select("signature_hash", F.array_join("signature", " ").alias("text")))
    total = found.agg(F.count(F.lit(1)).alias("total"))
    df = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    weighted = grams.join(df, "gram").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    norm = Window.partitionBy("signature_hash")
    return weighted.select("signature_hash", "gram", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm))).alias("weight"))


def cosine_pairs(vectors: DataFrame) -> DataFrame:
    """Sparse dot products of all vector pairs that share a gram."""
    right = vectors.select(F.col("signature_hash").alias("b"), "gram", F.col("weight").alias("v"))
    return vectors.withColumnRenamed("signature_hash", "a").join(right, "gram").where("a < b").groupBy("a", "b").agg(F.sum(F.col("weight") * F.col("v")).alias("cosine"))


def _combined(sequence: Column, shared: Column, cosine: Column) -> Column:
    return C.SEQUENCE_WEIGHT * sequence + C.SET_WEIGHT * shared + C.COSINE_WEIGHT * F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine))


def coded(found: DataFrame) -> DataFrame:
    """(signature_hash, signature, code) of variants, with a character for each step."""
    alphabet = found.select(F.explode("signature").alias("t")).agg(F.array_sort(F.collect_set("t")).alias("alphabet"))
    # one row of at most ``sequences.POINTS`` steps, which ``encoded`` asserts
    return found.crossJoin(F.broadcast(alphabet)).select("signature_hash", "signature", encoded(F.col("signature"), F.col("alphabet")).alias("code"))


def _measured(pairs: DataFrame) -> DataFrame:
    """Sequence and set similarity of rows (a_signature_hash, a_signature, a_code, b_...)."""
    return pairs.select(
        F.col("a_signature_hash").alias("a"),
        F.col("b_signature_hash").alias("b"),
        sequence_similarity(F.col("a_code"), F.col("b_code")).alias("sequence"),
        jaccard(F.col("a_signature"), F.col("b_signature")).alias("jaccard"),
    )


def _sides(rows: DataFrame) -> list[DataFrame]:
    return [rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns)) for side in ("a", "b")]


def similarity_pairs(found: DataFrame) -> DataFrame:
    """Combined similarity of every pair of variants: as many rows as there are pairs, for reports on few of them."""
    left, right = _sides(coded(found))
    pairs = _measured(left.join(right, F.col("a_signature_hash") < F.col("b_signature_hash")))
    joined = pairs.join(cosine_pairs(tfidf(found)), ["a", "b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    return joined.withColumn("similarity", _combined(F.col("sequence"), F.col("jaccard"), F.col("cosine")))


def candidates(found: DataFrame, cut: float = C.CLUSTER_DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of variants whose combined distance can be below ``cut``, and some others.

    With x common steps (a step's k-th occurrence is a step of its own) of sequences of n and m steps, edit
    similarity is at most x / max(n, m) and set similarity at most x / max of the distinct steps. A variant
    thus shares at least ``least`` steps with whatever it can merge with, and so one of its ``n - least + 1``
    rarest, as the other does: both keep their steps in the same order of rarity.
    """
    occurrence = F.transform("signature", lambda t, i: F.struct(t.alias("t"), F.size(F.filter(F.slice("signature", 1, i + 1), lambda u: u == t)).alias("k")))
    steps = found.select("signature_hash", "signature", F.explode(occurrence).alias("step"))
    rarity = steps.groupBy("step").agg(F.count(F.lit(1)).alias("df"))
    placed = steps.join(rarity, "step").groupBy("signature_hash").agg(F.array_sort(F.collect_list(F.struct("df", "step"))).alias("steps"), F.first("signature").alias("signature"))
    n, distinct = F.size("steps"), F.size(F.array_distinct("signature"))

    def enough(x: Column) -> Column:
        return C.SEQUENCE_WEIGHT * x / n + C.SET_WEIGHT * F.least(F.lit(1.0), x / distinct) + C.COSINE_WEIGHT + SLACK > 1 - cut

    least = F.get(F.filter(F.sequence(F.lit(1), n), enough), 0)
    prefix = placed.where(least.isNotNull()).select("signature_hash", F.explode(F.slice("steps", 1, n - least + 1)).alias("x")).select("signature_hash", "x.step")
    left, right = _sides(prefix)
    met = left.join(right, (F.col("a_step") == F.col("b_step")) & (F.col("a_signature_hash") < F.col("b_signature_hash")))
    return met.select(F.col("a_signature_hash").alias("a"), F.col("b_signature_hash").alias("b")).distinct()


def near_pairs(found: DataFrame, vectors: DataFrame, cut: float = C.CLUSTER_DISTANCE) -> DataFrame:
    """(a, b, similarity) of all pairs whose combined distance is below ``cut``."""
    left, right = _sides(coded(found))
    measured = _measured(candidates(found, cut).join(left, F.col("a") == F.col("a_signature_hash")).join(right, F.col("b") == F.col("b_signature_hash")))
    hopeful = written(measured.where(_combined(F.col("sequence"), F.col("jaccard"), F.lit(1.0)) + SLACK > 1 - cut), "hopeful")
    of_a, of_b = (vectors.select(F.col("signature_hash").alias(side), "gram", F.col("weight").alias(f"w_{side}")) for side in ("a", "b"))
    cosines = hopeful.select("a", "b").join(of_a, "a").join(of_b, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("cosine"))
    joined = hopeful.join(cosines, ["a", "b"], "left")
    similarity = _combined(F.col("sequence"), F.col("jaccard"), F.coalesce("cosine", F.lit(0.0)))
    return joined.select("a", "b", "sequence", "jaccard", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), similarity.alias("similarity")).where(1 - F.col("similarity") < cut)


def inside_pairs(found: DataFrame, vectors: DataFrame, placed: DataFrame) -> DataFrame:
    """(component, a, b, sequence, jaccard, cosine, similarity) of all pairs of variants of one component."""
    left, right = _sides(coded(found).join(placed, "signature_hash"))
    met = left.join(right, (F.col("a_component") == F.col("b_component")) & (F.col("a_signature_hash") < F.col("b_signature_hash")))
    measured = _measured(met)
    own = vectors.join(placed, "signature_hash")
    other = own.select(F.col("signature_hash").alias("b"), "component", "gram", F.col("weight").alias("v"))
    cosines = own.withColumnRenamed("signature_hash", "a").join(other, ["component", "gram"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("weight") * F.col("v")).alias("cosine"))
    joined = measured.join(cosines, ["a", "b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    joined = joined.withColumn("similarity", _combined(F.col("sequence"), F.col("jaccard"), F.col("cosine")))
    return joined.join(placed.withColumnRenamed("signature_hash", "a"), "a")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(signature_hash, component) by spreading the smallest name until nothing changes."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = nodes.select("signature_hash", F.col("signature_hash").alias("component"))
    while True:
        heard = both.join(labels, F.col("b") == F.col("signature_hash")).groupBy("a").agg(F.min("component").alias("heard"))
        spread = written(labels.join(heard, F.col("signature_hash") == F.col("a"), "left").select("signature_hash", F.least("component", F.coalesce("heard", "component")).alias("component"), F.col("component").alias("old")), "labels")
        labels = spread.select("signature_hash", "component")
        if spread.where("component <> old").isEmpty():
            return labels


def average_linkage(names: list[str], distance: np.ndarray, cut: float) -> list[str]:
    """Cluster name (smallest member) of each row, with merges while an average distance is below ``cut``.

    Follows chains of nearest neighbours: time grows with the square of the rows. A cluster whose nearest is
    not below the cut is done, since merges of others never come nearer.
    """
    d, size, owner = distance.astype(float).copy(), np.ones(len(names)), np.arange(len(names))
    np.fill_diagonal(d, np.inf)
    chain: list[int] = []
    active = np.ones(len(names), bool)
    while active.any():
        if not chain:
            chain.append(int(np.flatnonzero(active)[0]))
        at = chain[-1]
        near = int(d[at].argmin())
        # of equally near ones, the one before on the chain: or the chain would turn in a circle
        if len(chain) > 1 and d[at, chain[-2]] == d[at, near]:
            near = chain[-2]
        if not d[at, near] < cut:
            active[at] = False
            chain.pop()
        elif len(chain) > 1 and near == chain[-2]:
            i, j = min(at, near), max(at, near)
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i], d[:, i] = row, row
            d[j], d[:, j] = np.inf, np.inf
            d[i, i] = np.inf
            size[i] += size[j]
            owner[owner == j] = i
            active[j] = False
            del chain[-2:]
        else:
            chain.append(near)
    return [names[own] for own in owner]


def linked_in_rounds(nodes: DataFrame, pairs: DataFrame, cut: float = C.CLUSTER_DISTANCE) -> DataFrame:
    """(signature_hash, cluster_id): average linkage of (signature_hash) by all their pairs (a, b, similarity), as a table.

    Every round merges all pairs of clusters that are each other's nearest below the cut. Clusters are known
    by their smallest member; sums between them are whole numbers, and a round adds up those of merged ones.
    """
    scaled = F.round(F.col("similarity") / UNIT).cast("decimal(38,0)")
    both = [pairs.select(F.col(x).alias("a"), F.col(y).alias("b"), scaled.alias("total"), F.lit(1).cast("long").alias("n")) for x, y in (("a", "b"), ("b", "a"))]
    links = written(both[0].unionByName(both[1]), "links")
    owners = nodes.select("signature_hash", F.col("signature_hash").alias("cluster_id"))
    while True:
        mean = F.col("total").cast("double") * UNIT / F.col("n")
        nearest = links.select("a", "b", mean.alias("mean")).where(1 - F.col("mean") < cut).groupBy("a").agg(F.min_by("b", F.struct(-F.col("mean"), F.col("b"))).alias("b"))
        nearest = written(nearest, "nearest")
        back = nearest.select(F.col("b").alias("a"), F.col("a").alias("b"))
        merged = written(nearest.join(back, ["a", "b"]).where("a < b").select(F.col("b").alias("gone"), F.col("a").alias("into")), "merged")
        size = merged.count()
        if not size:
            return owners
        sent = F.broadcast(merged) if size <= SENT else merged

        def renamed(rows: DataFrame, column: str, sent: DataFrame = sent) -> DataFrame:
            return rows.join(sent, F.col(column) == F.col("gone"), "left").withColumn(column, F.coalesce("into", column)).drop("gone", "into")

        links = written(renamed(renamed(links, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")), "links")
        owners = written(renamed(owners, "cluster_id"), "owners")


def clustered(found: DataFrame, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """((signature_hash, cluster_id), pairs of variants of one component) for any number of variants."""
    vectors = written(tfidf(found), "vectors")
    near = written(near_pairs(found, vectors), "near")
    placed = written(components(near, found), "components")
    pairs = written(inside_pairs(found, vectors, placed), "inside")
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = written(placed.join(sizes, "component"), "sized")
    large = sized.where(F.col("size") > local)
    names = large.select("component").distinct()
    small = pairs.join(names, "component", "left_anti").select("component", "a", "b", "similarity")
    alone = sized.where(F.col("size") <= local).select("component", F.col("signature_hash").alias("a"), F.col("signature_hash").alias("b"), F.lit(1.0).alias("similarity"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sorted(set(pdf["a"]))
        place = {n: i for i, n in enumerate(own)}
        distance = np.full((len(own), len(own)), 1.0)
        for a, b, s in zip(pdf["a"], pdf["b"], pdf["similarity"], strict=True):
            distance[place[a], place[b]] = distance[place[b], place[a]] = 1 - s
        return pd.DataFrame({"signature_hash": own, "cluster_id": average_linkage(own, distance, C.CLUSTER_DISTANCE)})

    done = small.unionByName(alone).groupBy("component").applyInPandas(solve, "signature_hash string, cluster_id string")
    if not large.isEmpty():
        done = done.unionByName(linked_in_rounds(large.select("signature_hash"), pairs.join(names, "component", "left_semi")))
    return done, pairs


def medoids(found: DataFrame, pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, signature_hash): the variant most similar to all instances of its cluster."""
    both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    sized = found.select(F.col("signature_hash").alias("b"), "n").join(clusters.select(F.col("signature_hash").alias("b"), F.col("cluster_id").alias("other")), "b")
    own = found.join(clusters, "signature_hash").select(F.col("signature_hash").alias("a"), "cluster_id", F.col("n").alias("own"))
    sums = own.join(both.join(sized, "b"), "a", "left").groupBy("cluster_id", "a").agg((F.first("own") + F.coalesce(F.sum(F.when(F.col("other") == F.col("cluster_id"), F.col("similarity") * F.col("n"))), F.lit(0.0))).alias("total"))
    return sums.groupBy("cluster_id").agg(F.min_by("a", F.struct(-F.round("total", 9), F.col("a"))).alias("signature_hash"))
