"""Language-model scoring by deleted interpolation.

The model mixes the maximum-likelihood bigram and unigram estimates and a uniform distribution. Mixture
weights depend on how often the context was seen; they are learned by expectation-maximisation on a
fold of the training texts whose own counts are taken out ("deleted") while it is predicted.

Counts come from ``exchange``: blocks of documents send their distinct n-gram hashes and get the corpus
counts back. Nothing that grows with the corpus goes through the driver: EM works on a histogram of
bounded size.

Defined results of the edge cases: null and empty texts are one end token; repeated rows count and are
scored each; a null doc_id is training text; with no text in the EM fold fixed weights are used; with
no training text all counts are 0; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import exchange as X
from loomtrace.llm import kernels as K
from loomtrace.llm.storage import input_bytes, materialise

FOLDS, HELD_OUT, DELETED = 7, 2, 3
BLOCK_MB = 2
#: Context-frequency buckets are powers of two; log2 probabilities are binned this finely for EM.
BUCKETS = 24
BINS = 8
EM_ROUNDS = 60
#: Weights (bigram, unigram, uniform) before EM, and the least weight of the uniform distribution.
START = (0.4, 0.5, 0.1)
FLOOR = 1e-4
END_TOKEN, BEGIN_TOKEN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

HISTOGRAM = pa.schema([("bucket", pa.int32()), ("two", pa.int32()), ("one", pa.int32()), ("n", pa.int64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Tokens:
    """Token sequences of a block's documents: unigram and bigram hashes, and the row of each token."""

    def __init__(self, texts: pa.Array):
        data, offsets = K.text_buffer(texts)
        words, rows = [], []
        # hashing in slices bounds the temporaries, whatever the size of the block
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (2 << 20), "right")) - 1)
            part, own = data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
            starts, ends, row = K.words(part, own, K.SPACE_SEPARATED)
            words.append(K.word_hashes(part, starts, ends, lower=True))
            rows.append(row + at)
            at = stop
        word, row = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((words, np.uint64), (rows, np.int64)))
        n = len(texts)
        self.first, count = K.run_starts(row, n)
        self.first = self.first + np.arange(n)
        self.count = count + 1
        self.row = np.repeat(np.arange(n), self.count)
        self.one = np.full(len(word) + n, END_TOKEN)
        self.one[np.arange(len(word)) + row] = word
        before = np.empty_like(self.one)
        before[1:] = self.one[:-1]
        before[self.first] = BEGIN_TOKEN
        # even hashes are unigrams, odd ones bigrams
        self.two = K.mix(before * np.uint64(K.BASE) + K.mix(self.one + np.uint64(1))) | np.uint64(1)
        self.one &= ~np.uint64(1)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, ascending, and of which each unigram and then each bigram is one."""
        return np.unique(np.concatenate([self.one, self.two]), return_inverse=True)

    def context(self, of_token: np.ndarray) -> np.ndarray:
        """A per-token column of the token before; documents begin after an end."""
        out = np.empty_like(of_token)
        out[1:] = of_token[:-1]
        last = self.first + self.count - 1
        out[self.first] = of_token[last]
        return out


def blocked(documents: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text, fold, block; the deleted fold has blocks of its own, numbered from ``blocks``."""
    number, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    fold = F.coalesce(F.crc32(number.cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT + 2)).cast("int")
    mixed = F.xxhash64("doc_id", "text")
    block = F.when(F.col("fold") == DELETED, blocks + F.pmod(mixed, F.lit(blocks // FOLDS + 1))).otherwise(F.pmod(mixed, F.lit(blocks)))
    return documents.withColumn("fold", fold).select(number.alias("doc_id"), text.alias("text"), "fold", block.cast("long").alias("block"))


def requests(docs: DataFrame, shards: int) -> DataFrame:
    """The distinct n-grams of every block; blocks of the deleted fold also ask for the counts of that fold."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        tokens = Tokens(block.column("text").combine_chunks())
        fold = block.column("fold").to_numpy()
        keys, inverse = tokens.keys()
        trained = np.bincount(inverse[np.tile((fold != HELD_OUT)[tokens.row], 2)], minlength=len(keys))
        return X.messages(block.column("block")[0].as_py(), keys, trained, trained if fold[0] == DELETED else None, shards, 64)

    return docs.groupBy("block").applyInArrow(run, from_arrow_schema(X.MESSAGE))


def estimates(tokens: Tokens, answer: pa.Table, n_tokens: int, minus: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per token: count, context bucket, bigram and unigram maximum-likelihood estimates."""
    _, inverse = tokens.keys()
    counts = X.told(answer, "counts").astype(np.int64)
    if minus:
        counts = counts - X.told(answer, "also")
    one, two = counts[inverse[: len(tokens.one)]], counts[inverse[len(tokens.one) :]]
    context = tokens.context(one)
    bucket = np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)
    return one, bucket, two / np.maximum(context, 1), one / max(n_tokens, 1)


def learn(histogram: list[tuple[int, int, int, int]], types: int) -> np.ndarray:
    """Mixture weights (bucket, component) by EM on the binned estimates of the deleted fold."""
    weights = np.tile(np.array(START), (BUCKETS, 1))
    if histogram:
        bucket, two, one, n = np.array(histogram, np.int64).T
        p = np.stack([np.where(two < 0, 0.0, 2.0 ** (-two / BINS)), np.where(one < 0, 0.0, 2.0 ** (-one / BINS)), np.full(len(n), 1 / (types + 1))], axis=1)
        for _ in range(EM_ROUNDS):
            share = weights[bucket] * p
            share *= (n / share.sum(axis=1))[:, None]
            sums = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], axis=1)
            # buckets with little evidence stay near the starting weights
            weights = (sums + np.array(START)) / (sums.sum(axis=1, keepdims=True) + 1)
    weights[0, 1] += weights[0, 0]
    weights[0, 0] = 0  # a context that was never seen has no bigram estimate
    weights = np.maximum(weights, [0, 0, FLOOR])
    return weights / weights.sum(axis=1, keepdims=True)


def score_documents(documents: DataFrame) -> DataFrame:
    """Base and model scores of every document, learned from those that are not held out."""
    from pyspark.sql.pandas.types import from_arrow_schema

    spark = documents.sparkSession
    size = input_bytes(documents) >> 20
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, size // BLOCK_MB + 1)
    every = blocks + blocks // FOLDS + 1
    docs = blocked(documents, blocks)
    held = materialise(X.totals(requests(docs, X.shards_of(every)), every, X.shards_of(every)), "counts")
    answered = held.where("block >= 0").select("block", "shard", "counts", "also")
    totals = held.where("block < 0").agg(F.sum("total"), F.sum("total_also"), F.sum("types")).first()
    n_tokens, gone, types = (int(x or 0) for x in totals)

    def bins(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * BINS), -1).astype(np.int64)

    def count(block: pa.Table, answer: pa.Table) -> pa.Table:
        if not block.num_rows:
            return HISTOGRAM.empty_table()
        tokens = Tokens(block.combine_chunks().column("text").combine_chunks())
        _, bucket, two, one = estimates(tokens, answer, n_tokens - gone, minus=True)
        cells, n = np.unique(np.stack([bucket, bins(two), bins(one)], axis=1), axis=0, return_counts=True)
        return pa.Table.from_arrays([pa.array(cells[:, 0].astype(np.int32)), pa.array(cells[:, 1].astype(np.int32)), pa.array(cells[:, 2].astype(np.int32)), pa.array(n)], schema=HISTOGRAM)

    deleted = docs.where(F.col("fold") == DELETED).groupBy("block").cogroup(answered.where(F.col("block") >= blocks).groupBy("block"))
    paired = docs.groupBy("block").cogroup(answered.groupBy("block"))
    cells = deleted.applyInArrow(count, from_arrow_schema(HISTOGRAM)).groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    weights = learn([tuple(r) for r in cells.collect()], types)

    def score(block: pa.Table, answer: pa.Table) -> pa.Table:
        if not block.num_rows:
            return SCORES.empty_table()
        block = block.combine_chunks()
        tokens = Tokens(block.column("text").combine_chunks())
        one, bucket, two, single = estimates(tokens, answer, n_tokens, minus=False)
        w = weights[bucket]
        model = np.log10(w[:, 0] * two + w[:, 1] * single + w[:, 2] / (types + 1))
        base = np.log10((one + 1) / (n_tokens + types + 1))
        rows = block.num_rows
        return pa.Table.from_arrays(
            [
                block.column("doc_id"),
                pa.array(block.column("fold").to_numpy() == HELD_OUT),
                pa.array(tokens.count),
                pa.array(np.bincount(tokens.row, one > 0, rows).astype(np.int64)),
                pa.array(np.bincount(tokens.row, base, rows)),
                pa.array(np.bincount(tokens.row, model, rows)),
            ],
            schema=SCORES,
        )

    return paired.applyInArrow(score, from_arrow_schema(SCORES)).withColumn("train_tokens", F.lit(n_tokens).cast("long"))
