"""The factorisation machine against sums over all pairs of features, finite differences and held-out labels."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomtrace.llm import factorisation as M
from loomtrace.llm.queries import QUERIES, table
from tests.llm.samples import awkward, by_row, empty
from tests.tables import SF_DIR

TEXTS = ["", None, "a b a", "Größe größe!! ### 12", "x " * 500, "One line.\nTwo lines.\n\nOne line.", "LOUD WORDS ARE HERE", "\n \t"]


def machine(seed=3):
    rng = np.random.default_rng(seed)
    return M.Machine(0.3, rng.normal(0, 0.4, (M.FEATURES, M.RANK + 1)).astype(np.float32))


def held(texts=TEXTS):
    row, column, value = M.features(pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64()))
    return row, column, value, np.searchsorted(row, np.arange(len(texts)))


def naive(model, columns, values):
    """Bias, weights, and the product of every pair of features, one by one."""
    total = model.bias + sum(float(model.table[c, 0]) * float(v) for c, v in zip(columns, values, strict=True))
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            total += float(model.table[columns[i], 1:] @ model.table[columns[j], 1:]) * float(values[i]) * float(values[j])
    return total


def test_linear_time_equals_all_pairs():
    row, column, value, starts = held()
    model = machine()
    expected = [naive(model, column[row == k], value[row == k]) for k in range(len(TEXTS))]
    assert np.allclose(model.margins(starts, column, value), expected, atol=1e-4)


def test_every_text_has_each_statistic_once():
    row, column, _, _ = held()
    for k in range(len(TEXTS)):
        places = column[(row == k) & (column >= M.WORDS)] - M.WORDS
        assert sorted(places // M.BINS) == list(range(M.STATISTICS))


def test_features_do_not_depend_on_the_batch():
    row, column, value, _ = held()
    for k, text in enumerate(TEXTS):
        _, c, v, _ = held([text])
        assert np.array_equal(c, column[row == k]) and np.allclose(v, value[row == k])


def test_gradient_by_finite_differences(monkeypatch):
    """One step on one batch moves every parameter against its slope."""
    monkeypatch.setattr(M, "EPOCHS", 1)
    monkeypatch.setattr(M, "SHRINK", (0.0, 0.0))
    row, column, value, starts = held()
    labels = np.array([0, 1] * (len(TEXTS) // 2))
    trained = M.train(labels, starts, column, value, 0.5)
    start = M.Machine(0.0, np.zeros_like(trained.table))
    start.table[:, 1:] = np.random.default_rng(17).normal(0, 0.05, (M.FEATURES, M.RANK))

    def loss(table):
        p = M.sigmoid(M.Machine(0.0, table).margins(starts, column, value.astype(np.float64)))
        return -np.mean(np.log(np.where(labels == 1, p, 1 - p)))

    base = start.table.astype(np.float64)
    rng = np.random.default_rng(4)
    for c in rng.choice(np.unique(column), 12, replace=False):
        for k in (0, 1, 5):
            up, down = base.copy(), base.copy()
            up[c, k] += 1e-4
            down[c, k] -= 1e-4
            slope = (loss(up) - loss(down)) / 2e-4
            moved = trained.table[c, k] - start.table[c, k]
            # AdaGrad's first step is rate * slope / sqrt(slope^2 + 1e-6)
            assert abs(moved + M.RATE * slope / np.sqrt(slope**2 + 1e-6)) < 2e-3


def test_held_out_labels(spark):
    sf = SF_DIR if "0.001" not in SF_DIR else SF_DIR.replace("0.001", "0.01")
    found = QUERIES["op13_quality_classifier"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in found)
    assert len(found) > 50 and right >= 0.95 * len(found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_held_out_labels_and_other_columns_are_not_used(spark):
    documents, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    before = by_row(M.classify(documents, labels), "doc_id", "score")
    flipped = labels.withColumn("quality", F.when(M.fold() == M.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = documents.withColumns({"lang": F.lit("zz"), "source": F.col("doc_id").cast("string")})
    assert by_row(M.classify(other, flipped), "doc_id", "score") == before


def test_awkward_rows(spark):
    df = awkward(spark)
    ids = [r[0] for r in df.select("doc_id").collect() if r[0] is not None]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids] + [(ids[0], None, None), (ids[1], 0, 0), (None, 1, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    got = M.classify(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    nothing = labels.limit(0)
    assert {r["score"] for r in M.classify(df, nothing).collect()} == {0.5}
    assert {r["score"] > 0.5 for r in M.classify(df, labels.where("quality = 1")).collect()} == {True}
    assert M.classify(empty(spark), labels).collect() == []
