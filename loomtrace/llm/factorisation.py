"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature i has a weight and a vector of ``RANK`` numbers, and every pair of features of a document
interacts by the product of their vectors. With x the features of a document, all pairs together are
half of the sum, over the vectors' places, of (sum of v x)^2 - sum of (v x)^2, so a score takes time linear
in the features and never lists pairs.

Features of a whole text: the words in lower case, hashed to ``WORDS`` places and scaled to length 1, and
one of ``BINS`` places for each statistic of its bytes, words and lines (``statistics``) and for n_chars,
the only metadata that is used. Source, language and id are no inputs.

The machine is fitted in numpy on the driver with at most ``SAMPLE`` labelled documents of each label, drawn
by a hash of their ids; labels count by their share among all labels, so that scores are probabilities.
Scoring is map-only, with bounded batches.

Defined results of the edge cases: null and empty texts are scored by their statistics; null n_chars is a
place of its own; repeated rows are scored each, and of those with one id the least text is learned from;
several labels of one document count as good only if all are, null ones are ignored; a null doc_id is scored
and never learned from; if all labels are alike every document gets (good labels + 1) / (labels + 2), which
is 0.5 without labels; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import kernels as K

FOLDS, HELD_OUT = 4, 2
#: A score from which a document is predicted to be good.
LEAST = 0.7
#: Labelled documents of each label to learn from.
SAMPLE = 4000
WORDS, BINS, RANK = 1 << 15, 32, 8
EPOCHS, BATCH, RATE = 12, 128, 0.08
#: Shrinkage of weights and of vectors.
SHRINK = (1e-5, 1e-4)

SPARSE = pa.schema([("good", pa.int32()), ("columns", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

#: Borders of the bins of shares; of sizes, bins are powers of two.
_SHARES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.999999])
_LENGTHS = np.array([1.0, 2, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 8, 9, 10, 12, 15, 20, 40])


def _bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    return ~K.class_of(list(ranges))


_UPPER = _bytes_in((65, 90))
_LETTER = _bytes_in((65, 90), (97, 122), (128, 255))
_DIGIT = _bytes_in((48, 57))
#: ASCII signs other than those of ordinary sentences (fixed values).
_SIGN = _bytes_in((33, 33), (35, 38), (42, 43), (47, 47), (60, 62), (64, 64), (91, 96), (123, 126))
_STOP = _bytes_in((44, 44), (46, 46), (59, 59), (58, 58), (63, 63))
_LINE = _bytes_in((10, 10))
_HEAD = _bytes_in((0, 127), (192, 255))


def _shares(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bins of shares; the first is for exactly none, the last but one for all, the last for nothing to share."""
    out = np.searchsorted(_SHARES, part / np.maximum(whole, 1), "left")
    return np.where(whole > 0, out, BINS - 1)


def _sizes(values: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(values, 0) + 1.0)), BINS - 2).astype(np.int64)


class Texts:
    """Words and byte counts of some texts."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = K.text_buffer(column)
        self.rows = len(column)
        self.starts, self.ends, self.row = K.words(self.data, self.offsets, K.SPACE_SEPARATED)
        self.first, self.words = K.run_starts(self.row, self.rows)
        self.hashes = K.word_hashes(self.data, self.starts, self.ends, lower=True)

    def count(self, inside: np.ndarray) -> np.ndarray:
        """Bytes of a class in each text."""
        running = np.concatenate([np.zeros(1, np.int64), np.cumsum(inside[self.data], dtype=np.int64)])
        return running[self.offsets[1:]] - running[self.offsets[:-1]]

    def distinct(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: number of distinct hashes, and how often the most frequent one occurs."""
        order = np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(fresh)
        most = np.zeros(self.rows, np.int64)
        np.maximum.at(most, r[at], np.diff(np.append(at, len(h))))
        return np.bincount(r[at], minlength=self.rows), most


def statistics(texts: Texts, n_chars: np.ndarray) -> np.ndarray:
    """Bins (text, statistic) of structure statistics and metadata; ``n_chars`` is -1 where it is null."""
    letters, chars, words = texts.count(_LETTER & _HEAD), texts.count(_HEAD), texts.words
    distinct, most = texts.distinct(texts.hashes, texts.row)
    pairs = K.ngrams(texts.hashes, 2)
    same = texts.row[1:] == texts.row[:-1] if len(texts.row) else np.zeros(0, bool)
    pairs, pair_row = pairs[same], texts.row[:-1][same]
    distinct_pairs, _ = texts.distinct(pairs, pair_row)
    shouted = _UPPER[texts.data]
    running = np.concatenate([np.zeros(1, np.int64), np.cumsum(shouted, dtype=np.int64)])
    loud = np.bincount(texts.row, running[texts.ends] - running[texts.starts] >= 2, texts.rows) if len(texts.row) else np.zeros(texts.rows)
    lines = texts.count(_LINE) + 1
    return np.stack(
        [
            _shares(texts.count(_UPPER), letters),
            _shares(texts.count(_DIGIT), chars),
            _shares(texts.count(_SIGN), chars),
            _shares(texts.count(_STOP), chars),
            _shares(letters, chars),
            _shares(distinct, words),
            _shares(most, words),
            _shares(distinct_pairs, np.bincount(pair_row, minlength=texts.rows)),
            _shares(loud, words),
            np.where(words > 0, np.searchsorted(_LENGTHS, letters / np.maximum(words, 1)), BINS - 1),
            _sizes(words),
            _sizes(lines),
            _sizes(words / lines),
            np.where(n_chars < 0, BINS - 1, _sizes(n_chars)),
        ],
        axis=1,
    )


STATISTICS = 14
FEATURES = WORDS + STATISTICS * BINS


def features(column: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all texts, by row: words scaled to length 1, and one place of each statistic."""
    texts = Texts(column)
    known = n_chars.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    bins = statistics(texts, known)
    place = (texts.hashes % np.uint64(WORDS)).astype(np.int64)
    held, n = np.unique(texts.row * WORDS + place, return_counts=True)
    row, value = held // WORDS, np.log1p(n)
    norm = np.sqrt(np.bincount(row, value * value, texts.rows))
    rows = np.concatenate([row, np.repeat(np.arange(texts.rows), STATISTICS)])
    columns = np.concatenate([held % WORDS, (bins + WORDS + np.arange(STATISTICS) * BINS).ravel()])
    values = np.concatenate([value / norm[row], np.ones(texts.rows * STATISTICS)])
    order = np.argsort(rows, kind="stable")
    return rows[order], columns[order], values[order].astype(np.float32)


@dataclass
class Machine:
    """Bias, and (weight, vector) of every feature as one table."""

    bias: float
    table: np.ndarray

    def margins(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Log odds of documents whose features begin at ``starts``; each has at least one."""
        scaled = self.table[columns] * values[:, None]
        sums = np.add.reduceat(scaled, starts, axis=0)
        squares = np.add.reduceat((scaled[:, 1:] ** 2).sum(axis=1), starts)
        return self.bias + sums[:, 0] + ((sums[:, 1:] ** 2).sum(axis=1) - squares) / 2


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(labels: np.ndarray, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, prior: float) -> Machine:
    """Adaptive gradient descent on the cross entropy, with both labels weighted to their prior."""
    rng = np.random.default_rng(17)
    machine = Machine(float(np.log(prior / (1 - prior))), np.zeros((FEATURES, RANK + 1), np.float32))
    machine.table[:, 1:] = rng.normal(0, 0.05, (FEATURES, RANK))
    seen = np.full(machine.table.shape, 1e-6, np.float32)
    shrink = np.array([SHRINK[0]] + [SHRINK[1]] * RANK, np.float32)
    mean = labels.mean()
    weights = np.where(labels == 1, prior / mean, (1 - prior) / (1 - mean))
    lengths = np.diff(np.append(starts, len(columns)))
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 3)
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            pick = order[begin : begin + BATCH]
            size = lengths[pick]
            own = np.cumsum(size) - size
            at = np.repeat(starts[pick] - own, size) + np.arange(size.sum())
            column, value = columns[at], values[at][:, None]
            slope = (sigmoid(machine.margins(own, column, values[at])) - labels[pick]) * weights[pick] / len(pick)
            machine.bias -= rate * float(slope.sum())
            held, inverse = np.unique(column, return_inverse=True)
            scaled = machine.table[column] * value
            sums = np.repeat(np.add.reduceat(scaled, own, axis=0), size, axis=0)
            push = np.repeat(slope, size)[:, None] * value
            gradient = np.empty_like(scaled)
            gradient[:, :1] = push
            gradient[:, 1:] = push * (sums[:, 1:] - scaled[:, 1:])
            total = np.zeros((len(held), RANK + 1), np.float32)
            np.add.at(total, inverse, gradient)
            total += shrink * machine.table[held]
            seen[held] += total * total
            machine.table[held] -= rate * total / np.sqrt(seen[held])
    return machine


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text modulo 4; 2 is held out of training."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % FOLDS


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the labels to learn from."""
    known = labels.where("quality is not null and doc_id is not null").where(fold() != HELD_OUT)
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))


def _source(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))


def fit(documents: DataFrame, labels: DataFrame) -> Machine | float:
    """The machine learned from labelled documents, or one score for all documents if their labels are alike."""
    known = labelled(labels)
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    good, bad = counts.get(1, 0), sum(n for k, n in counts.items() if k != 1)
    drawn = [known.where(F.col("good") == 1 if k else F.col("good") != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])
    # at most 2 * SAMPLE rows: copies of one id are one document to learn from
    least = _source(documents).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct("text", "n_chars")).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            row, column, value = features(batch.column(1), batch.column(2))
            cut = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            columns = pa.ListArray.from_arrays(cut, pa.array(column.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), columns, pa.ListArray.from_arrays(cut, pa.array(value))], schema=SPARSE)

    found = K.map_arrow(least.orderBy("doc_id").select((F.col("good") == 1).cast("int").alias("good"), "d.text", "d.n_chars"), run, SPARSE).toArrow().combine_chunks()
    labels_ = found.column("good").to_numpy()
    if len(labels_) == 0 or labels_.min() == labels_.max():
        return (good + 1) / (good + bad + 2)
    columns, values = (found.column(c).combine_chunks() for c in ("columns", "values"))
    starts = columns.offsets.to_numpy()[:-1] - columns.offsets[0].as_py()
    return train(labels_, starts, columns.flatten().to_numpy(), values.flatten().to_numpy(), good / (good + bad))


def score(documents: DataFrame, machine: Machine | float) -> DataFrame:
    """doc_id and score of every document."""
    source = _source(documents)
    if not isinstance(machine, Machine):
        return source.select("doc_id", F.lit(machine).cast("double").alias("score"))
    sent = source.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text", 1 << 20):
            row, column, value = features(batch.column(1), batch.column(2))
            starts = np.searchsorted(row, np.arange(batch.num_rows))
            odds = sent.value.margins(starts, column, value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(odds.astype(np.float64)))], schema=SCORED)

    return K.map_arrow(source, run, SCORED)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and predicted label of every document."""
    held_out = F.coalesce(fold() == HELD_OUT, F.lit(False))
    scored = score(documents, fit(documents, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
