"""A corpus pipeline over the ``documents`` table: each stage applies one operator to all that is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``. An empty table
passes through all stages. Stages link and filter rows by a key of their own, so documents without a doc_id
are judged like others; what a stage does with nulls, ties and repeated rows is stated by its operator.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import decontaminate, jaccard, langid, packing, storage, suffixes
from loomtrace.llm.queries import table
from loomtrace.llm.storage import BROADCAST_IDS, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates share this percentage of their shingles of so many words.
SHINGLE, PERCENT = 5, 80
#: A document whose likeliest language has less of the mean probability of its windows is in none.
LEAST_SCORE = 0.5


#: The C library keeps freed blocks, up to a size that it raises as it goes. With a fixed one, Python workers give
#: the arrays of one stage back before the next one runs beside them. Arrow's own pool keeps blocks too, so batches
#: come from the C library, and threads share two arenas. Each stage sets this, since stages also run one by one.
MALLOC = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Bytes of an Arrow batch. Batches of ten thousand texts are some 30 MB, of which executor and worker hold several copies,
#: and buffers of that size stay with the executor's C library; kernels work on 1 or 2 MB at a time.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def lean(stage):
    """``stage`` with small batches and workers that give freed memory back."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in MALLOC.items():
            spark.sparkContext.environment.setdefault(name, value)
        for name, value in BATCH.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a key of the row; the table a stage is given is a file scan, so nothing is written for it."""
    return storage.numbered(docs.select(*COLUMNS), "key")


def as_ids(rows: DataFrame) -> DataFrame:
    """The rows under their keys in place of doc_id, as operators take them."""
    return rows.select(F.col("key").alias("doc_id"), *COLUMNS[1:])


def without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents whose key is not among the ids that an operator rejected."""
    ids = materialise(rejected.select(F.col("doc_id").alias("key")), "rejected")
    return rows.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, "key", "left_anti").select(*COLUMNS)


@lean
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without a letter, and those for which the network gives no language half of the probability.

    Without labelled documents to train on there is no network, and letters alone decide.
    """
    rows = numbered(docs)
    network = langid.fit(docs.where(langid.fold() != 1))
    if network is None:
        return rows.where(langid.lettered(F.col("text"))).select(*COLUMNS)
    found = langid.predict(as_ids(rows), network)
    return without(rows, found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_SCORE)))


@lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near-duplicates (a null one only if it has no other); repeated rows are one."""
    return jaccard.deduplicate(docs.select(*COLUMNS), SHINGLE, PERCENT)


@lean
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that occur twice; documents of nothing else are dropped."""
    rows = numbered(docs)
    stripped = suffixes.remove_repeats(as_ids(rows)).where("n_removed < n_bytes or n_bytes = 0").select(F.col("doc_id").alias("key"), "text")
    return rows.drop("text", "n_chars").join(stripped, "key").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@lean
def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a passage with the benchmark."""
    rows = numbered(docs)
    return without(rows, decontaminate.contaminated_spans(as_ids(rows), table(spark, sf_dir, "benchmark")).where(F.size("spans") > 0))


@lean
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_free", benchmark_free),
    ("packing", packed),
]

#: Training, components and packing can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
