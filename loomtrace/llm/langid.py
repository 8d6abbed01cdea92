"""Language identification with a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows, the strongest response of every
filter in a window feeds a softmax layer, and a document's probabilities are the mean over all its
windows, which cover the whole text. The network is trained in numpy on the driver, on windows of at
most ``DOCUMENTS_PER_LANGUAGE`` labelled documents of every language (a documented bound: the driver
never holds more than that many times ``WINDOWS_PER_DOCUMENT`` windows per language). Prediction is
map-only.

Defined results of the edge cases: null texts and texts without a letter are ``und`` with score 0; with
no labelled text at all every document is ``und``; texts are windowed whole however long; repeated rows
are predicted each; null doc_ids are predicted but never trained on; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import kernels as K

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
DOCUMENTS_PER_LANGUAGE = 1200
WINDOWS_PER_DOCUMENT = 6
STEPS, BATCH = 450, 256
UNKNOWN = "und"

PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, row of each window): bytes of windows that overlap by the widest filter less one.

    Every filter position of a text lies in a window; texts shorter than a window are padded with 0.
    """
    step = WINDOW - max(WIDTHS) + 1
    lengths = np.diff(offsets)
    count = np.maximum(1, -(-(lengths - max(WIDTHS) + 1) // step))
    count[lengths == 0] = 0
    rows = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    at = (offsets[rows] + nth * step)[:, None] + np.arange(WINDOW)
    inside = at < offsets[rows + 1][:, None]
    return np.where(inside, K.LOWER[data[np.minimum(at, max(len(data) - 1, 0))]], 0).astype(np.uint8), rows


class Network:
    """One filter bank per width over raw bytes, max pooling over the window, and a softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.banks = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def responses(self, windows: np.ndarray) -> list[np.ndarray]:
        """Per width the responses (window, position, filter)."""
        out = []
        for bank in self.banks:
            w = len(bank)
            n = windows.shape[1] - w + 1
            total = bank[0][windows[:, :n]]
            for j in range(1, w):
                total += bank[j][windows[:, j : j + n]]
            out.append(total)
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the cross entropy; the gradient of max pooling goes to the strongest position."""
        rng = np.random.default_rng(11)
        params = [*self.banks, self.dense, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = np.zeros(0, np.int64)
        for step in range(STEPS):
            if len(order) < min(BATCH, len(windows)):
                order = rng.permutation(len(windows))
            pick, order = order[:BATCH], order[BATCH:]
            batch, target = windows[pick], labels[pick]
            responses = self.responses(batch)
            best = [r.argmax(axis=1) for r in responses]
            pooled = np.concatenate([np.take_along_axis(r, b[:, None, :], 1)[:, 0] for r, b in zip(responses, best, strict=True)], axis=1)
            active = np.maximum(pooled, 0)
            slope = softmax(active @ self.dense + self.bias)
            slope[np.arange(len(pick)), target] -= 1
            slope /= len(pick)
            back = (slope @ self.dense.T) * (pooled > 0)
            grads = []
            for k, (bank, b) in enumerate(zip(self.banks, best, strict=True)):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                grad = np.zeros_like(bank)
                columns = np.broadcast_to(np.arange(FILTERS), b.shape)
                for j in range(len(bank)):
                    np.add.at(grad[j], (np.take_along_axis(batch, b + j, 1), columns), part)
                grads.append(grad)
            grads += [active.T @ slope, slope.sum(axis=0)]
            rate = 0.02 * 0.5 ** (4 * step // STEPS) * np.sqrt(1 - 0.999 ** (step + 1)) / (1 - 0.9 ** (step + 1))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * m / (np.sqrt(v) + 1e-8)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses of byte pairs: leading pairs of all widths, the last byte of 3 and the last pair of 4."""
        two, three, four = self.banks
        pairs = [(b[0][:, None] + b[1][None]).reshape(65536, FILTERS) for b in (two, three, four)]
        return np.concatenate(pairs, axis=1), three[2], (four[2][:, None] + four[3][None]).reshape(65536, FILTERS)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def probabilities(network: Network, tables: tuple[np.ndarray, ...], windows: np.ndarray, block: int = 512) -> np.ndarray:
    """Softmax output of each window, in blocks that bound the memory."""
    lead, third, last = tables
    out = np.zeros((len(windows), len(network.languages)))
    f = FILTERS
    for begin in range(0, len(windows), block):
        part = windows[begin : begin + block]
        pairs = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
        r = np.take(lead, pairs, axis=0)
        r[:, : WINDOW - 2, f : 2 * f] += np.take(third, part[:, 2:], axis=0)
        r[:, : WINDOW - 3, 2 * f :] += np.take(last, pairs[:, 2:], axis=0)
        pooled = np.concatenate([r[:, :, :f].max(axis=1), r[:, : WINDOW - 2, f : 2 * f].max(axis=1), r[:, : WINDOW - 3, 2 * f :].max(axis=1)], axis=1)
        out[begin : begin + block] = softmax(np.maximum(pooled, 0) @ network.dense + network.bias)
    return out


def training_windows(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of a bounded sample of (doc_id, text, lang), drawn by a hash."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    languages = sorted(counts)
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, DOCUMENTS_PER_LANGUAGE / counts[k])) for k in languages], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("train")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = labelled.join(F.broadcast(shares), "lang").where(draw).select("doc_id", "text", "lang")
    schema = pa.schema([("lang", pa.string()), ("windows", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            data, offsets = K.text_buffer(batch.column(1))
            found, rows = windows_of(data, offsets)
            first, count = K.run_starts(rows, batch.num_rows)
            picked = []
            for doc, at, n in zip(batch.column(0).to_pylist(), first, count, strict=True):
                rng = np.random.default_rng((doc or 0) & 0xFFFFFFFF)
                chosen = np.arange(n) if n <= WINDOWS_PER_DOCUMENT else np.sort(rng.choice(n, WINDOWS_PER_DOCUMENT, replace=False))
                picked.append(found[at + chosen].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(picked, pa.binary())], schema=schema)

    inputs, labels = [], []
    for row in K.map_arrow(sample, cut, schema).collect():
        got = np.frombuffer(bytes(row["windows"]), np.uint8).reshape(-1, WINDOW)
        inputs.append(got)
        labels.append(np.full(len(got), languages.index(row["lang"])))
    return np.concatenate(inputs), np.concatenate(labels), languages


def fit(labelled: DataFrame) -> Network | None:
    """Network trained on rows (doc_id, text, lang), or None if there are none with text and lang."""
    usable = labelled.where("lang is not null and text is not null and text <> '' and doc_id is not null")
    windows, labels, languages = training_windows(usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    if not languages or not len(windows):
        return None
    order = np.lexsort((windows[:, :16].copy().view(np.uint64)[:, 1], windows[:, :16].copy().view(np.uint64)[:, 0], labels))
    network = Network(languages)
    network.train(windows[order], labels[order])
    return network


def predict(documents: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score (probability of lang_pred) of every document, from its text alone."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if network is None:
        return source.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = source.sparkSession.sparkContext.broadcast(network)
    made: list[tuple[np.ndarray, ...]] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        if not made:
            made.append(net.tables())
        for batch in K.chunks(batches, "text", 1 << 20):
            data, offsets = K.text_buffer(batch.column(1))
            windows, rows = windows_of(data, offsets)
            sums = np.zeros((batch.num_rows, len(net.languages)))
            np.add.at(sums, rows, probabilities(net, made[0], windows))
            mean = sums / np.maximum(np.bincount(rows, minlength=batch.num_rows), 1)[:, None]
            best = mean.argmax(axis=1)
            letters = has_letter(data, offsets, batch.column(1))
            lang = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            score = np.where(letters, mean[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], schema=PREDICTED)

    return K.map_arrow(source, run, PREDICTED)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letter(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; decodes only texts without an ASCII letter."""
    running = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = running[offsets[1:]] > running[offsets[:-1]]
    for row in np.flatnonzero(~out):
        out[row] = any(c.isalpha() for c in column[int(row)].as_py() or "")
    return out


def lettered(text: Column) -> Column:
    """Whether a text has a letter of any script; false for null."""
    return F.coalesce(text.cast("string").rlike("\\p{L}"), F.lit(False))


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text modulo 3; 1 is held out of training."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def identify(documents: DataFrame) -> DataFrame:
    """Trains on the labelled documents that are not held out and predicts all documents."""
    network = fit(documents.where(fold() != 1))
    held_out = F.coalesce(fold() == 1, F.lit(False))
    return predict(documents, network).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
