"""The similarity join and the linkage against all pairs and against merging the closest pair again and again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace import constants as C
from loomtrace.operators import clusters as K

CUT = C.CLUSTER_DISTANCE


def greedy(names, distance, cut):
    """Partition by merging the closest pair while it is below the cut."""
    groups = [[i] for i in range(len(names))]
    while len(groups) > 1:
        best = min((np.mean([distance[x, y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if not best[0] < cut:
            break
        _, i, j = best
        groups[i] += groups.pop(j)
    return {frozenset(names[k] for k in g) for g in groups}


def partition(rows):
    groups = {}
    for name, cluster in rows:
        groups.setdefault(cluster, set()).add(name)
    assert all(cluster == min(members) for cluster, members in groups.items())
    return {frozenset(g) for g in groups.values()}


def distances(seed, n):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 3))
    d = np.linalg.norm(points[:, None] - points, axis=2)
    return [f"n{k:03d}" for k in range(n)], d / d.max()


@pytest.mark.parametrize("seed", range(12))
def test_chains_give_the_greedy_merges(seed):
    names, d = distances(seed, 5 + 6 * seed)
    for cut in (0.1, 0.25, 0.4, 1.0):
        assert partition(zip(names, K.average_linkage(names, d, cut), strict=True)) == greedy(names, d, cut)


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_give_the_greedy_merges(spark, seed):
    names, d = distances(seed, 40)
    rows = [(names[i], names[j], float(1 - d[i, j])) for i in range(40) for j in range(i + 1, 40)]
    pairs = spark.createDataFrame(rows, "a string, b string, similarity double")
    nodes = spark.createDataFrame([(n,) for n in names], "signature_hash string")
    got = K.linked_in_rounds(nodes, pairs, 0.3).collect()
    assert partition([tuple(r) for r in got]) == greedy(names, d, 0.3)


def signatures(spark, seed, n, vocabulary):
    rng = random.Random(seed)
    tokens = [f"app{k % 7}:do{k % 5}:thing{k}" for k in range(vocabulary)]
    made = {tuple(rng.choices(tokens, k=rng.randint(1, 14))) for _ in range(n)}
    rows = [(f"h{k:04d}", list(s), 1 + k % 4) for k, s in enumerate(sorted(made))]
    return spark.createDataFrame(rows, "signature_hash string, signature array<string>, n long")


@pytest.mark.parametrize("seed,vocabulary", [(1, 6), (2, 30), (3, 200)])
def test_join_misses_no_near_pair(spark, seed, vocabulary):
    found = signatures(spark, seed, 120, vocabulary).cache()
    every = {(r["a"], r["b"]): r["similarity"] for r in K.similarity_pairs(found).collect() if 1 - r["similarity"] < CUT}
    near = {(r["a"], r["b"]): r["similarity"] for r in K.near_pairs(found, K.tfidf(found)).collect()}
    assert near.keys() == every.keys()
    assert all(abs(near[k] - every[k]) < 1e-9 for k in every)


def test_clusters_of_any_size(spark):
    """The same partition in tasks and in rounds, and the greedy one by all pairs."""
    found = signatures(spark, 5, 90, 40).cache()
    names = sorted(r["signature_hash"] for r in found.collect())
    place = {n: i for i, n in enumerate(names)}
    d = np.full((len(names), len(names)), 1.0)
    for r in K.similarity_pairs(found).collect():
        d[place[r["a"]], place[r["b"]]] = d[place[r["b"]], place[r["a"]]] = 1 - r["similarity"]
    expected = greedy(names, d, CUT)
    for local in (10**6, 1):
        placed, _ = K.clustered(found, local)
        assert partition([tuple(r) for r in placed.collect()]) == expected


def test_many_variants(spark):
    """20,000 variants of many small vocabularies: the number of pairs that are compared grows with them, not with its square."""
    token = F.concat(F.lit("a:b:w"), F.floor(F.col("id") / 4).cast("string"), F.lit("x"), F.pmod(F.col("i"), F.lit(5)).cast("string"))
    rows = spark.range(20_000).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("id", (F.col("id") % 4 + F.col("k")).alias("i")).select("id", "i", token.alias("t"))
    found = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("signature")).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("signature_hash"), "signature", F.lit(1).cast("long").alias("n"))
    assert K.candidates(found).count() <= 6 * 5_000
