"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from loomtrace.llm import exchange, jaccard
from tests.llm.samples import SCHEMA, awkward, empty, passages


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def brute(rows):
    """Rows (doc_id, size, component) by comparing all pairs."""
    sets = [shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], len(sets[i]), least.get(root(i)) if sets[i] else r["doc_id"]) for i, r in enumerate(rows)), key=repr)


def joined(df):
    return sorted((tuple(r) for r in jaccard.join_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def clusters(spark, groups, copies, n_words, seed=5):
    rng, say = passages(seed)
    texts = []
    common = say(n_words // 2)
    for _ in range(groups):
        base = (common + " " + say(n_words // 2)).split()
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = "e%d" % rng.randrange(999)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)


def test_awkward_rows(spark):
    df = awkward(spark)
    assert joined(df) == brute(df.collect())


def test_clashing_and_missing_ids(spark):
    _, say = passages(17)
    t, u, v = say(60), say(40), say(50)
    texts = [(1, t), (5, "short one"), (5, t + " end"), (9, t), (5, u), (7, u + " end"), (None, v), (None, v + " end"), (None, say(30)), (3, v), (3, None)]
    df = spark.createDataFrame([(i, x, "en", "a", 0) for i, x in texts], SCHEMA)
    assert joined(df) == brute(df.collect())
    assert sorted((r["doc_id"] or -1 for r in jaccard.deduplicate(df).collect())) == [-1, 1, 3, 3, 5, 5]


@pytest.mark.parametrize("n_words", [12, 60, 200])
def test_near_copies_that_share_a_passage(spark, n_words):
    df = clusters(spark, 12, 12, n_words)
    assert joined(df) == brute(df.collect())


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 700)
    df = clusters(spark, 5, 14, 60, seed=8)
    assert joined(df) == brute(df.collect())


def test_blocks_without_a_common_representative(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 60)
    df = clusters(spark, 4, 8, 40, seed=9)
    assert joined(df) == brute(df.collect())


def test_counts_through_several_levels_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(exchange, "FAN", 2)
    df = awkward(spark)
    assert joined(df) == brute(df.collect())


def test_empty_table(spark):
    assert joined(empty(spark)) == []
    assert jaccard.deduplicate(empty(spark)).count() == 0


def test_deduplicate_keeps_one_row_a_component(spark):
    df = awkward(spark)
    named = {r[2] for r in brute(df.collect()) if r[0] is not None}
    kept = jaccard.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(named)


def test_trie_links_like_pairs():
    rng = random.Random(1)
    for _ in range(20):
        sets = []
        for _ in range(40):
            base = rng.choice(sets) if sets and rng.random() < 0.7 else np.array(rng.sample(range(10**6), rng.randint(1, 60)), np.uint64)
            keep = [x for x in base.tolist() if rng.random() > 0.05] or base.tolist()
            sets.append(np.unique(np.array(keep + [rng.randrange(10**6) for _ in range(rng.randrange(3))], np.uint64)))
        label = jaccard.link(sets)
        as_sets = [set(s.tolist()) for s in sets]
        for i in range(40):
            for j in range(i):
                common = len(as_sets[i] & as_sets[j])
                if 100 * common >= 85 * len(as_sets[i] | as_sets[j]):
                    assert label[i] == label[j]
