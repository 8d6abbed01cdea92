"""Benchmark decontamination by winnowing.

Both sides are cut into words; of every window of consecutive k-gram hashes the smallest is kept, so
any shared span of ``WINDOW`` words has at least one common fingerprint.

1. The benchmark's fingerprints and its windows (with the items that have them) are written as tables.
   Items shorter than ``WINDOW`` words are one window, whose hash is its fingerprint.
2. Documents meet the distinct fingerprints: up to ``SENT_PRINTS`` of them (8 bytes each) are broadcast as
   one sorted array, more are joined with the documents' own fingerprints by a shuffle.
3. Every hit is extended to the windows around it, and these windows, distinct, are joined with the
   benchmark's windows word by word. A passage that a third of all documents share is one row of that join.

Defined results of the edge cases: null or empty texts have no words and no hits; items without words
never occur; repeated documents are judged each, repeated item rows count once per item_id; windows
that several items share are charged to all of them; items without an item_id count for words and
verdict but are not listed; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import kernels as K
from loomtrace.llm.storage import filter_ids, materialise, small

#: Words of a shared span that is always found, and of the k-grams that are hashed.
WINDOW = 10
GRAM = 5
#: Benchmark fingerprints that are sent to every executor, 8 bytes each.
SENT_PRINTS = 4_000_000
#: Matched windows and item sets that are sent to every executor to be joined, some hundred bytes each.
SENT_ROWS = 200_000

WINDOWS = pa.schema([("length", pa.int32()), ("words", pa.string()), ("item", pa.int64())])
PRINTS = pa.schema([("length", pa.int32()), ("print", pa.int64())])
OWN_PRINTS = pa.schema([("row", pa.int64()), ("length", pa.int32()), ("print", pa.int64())])
_WINDOW = pa.struct([("begin", pa.int64()), ("length", pa.int32()), ("words", pa.string())])
CANDIDATES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("windows", pa.list_(_WINDOW))])


def winnow(grams: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Positions of the leftmost minimum of every ``width`` consecutive gram hashes of one row."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(len(grams) - width + 1)
    return np.unique(low[rows[: len(low)] == rows[width - 1 :]])


def found(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mask of the values that occur in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


class Words:
    """The words of a column of texts: their hashes, rows, and the first word and number of words of each row."""

    def __init__(self, texts: pa.Array):
        data, offsets = K.text_buffer(texts)
        self.data = K.LOWER[data]
        self.starts, self.ends, self.rows = K.words(self.data, offsets, K.ALPHANUMERIC)
        self.hashes = K.word_hashes(self.data, self.starts, self.ends, lower=False)
        self.first, self.count = K.run_starts(self.rows, len(texts))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, and which of them lie in one row."""
        grams = K.ngrams(self.hashes, n)
        return grams, self.rows[: len(grams)] == self.rows[n - 1 :] if len(grams) else np.zeros(0, bool)

    def prints(self, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the winnowed fingerprints (of the rows chosen), and the fingerprints."""
        grams, inside = self.grams(GRAM)
        grams[~inside] = np.uint64(0xFFFFFFFFFFFFFFFF)
        kept = winnow(grams, self.rows[: len(grams)], WINDOW - GRAM + 1)
        kept = kept[inside[kept]]
        if chosen is not None:
            kept = kept[chosen[self.rows[kept]]]
        return kept, grams[kept]

    def around(self, hits: np.ndarray) -> np.ndarray:
        """Begins of the whole windows that the fingerprints at ``hits`` lie in."""
        begins = np.unique((hits[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
        begins = begins[(begins >= 0) & (begins + WINDOW <= len(self.hashes))]
        return begins[self.rows[begins] == self.rows[begins + WINDOW - 1]]

    def text(self, begin: int, n: int) -> str:
        return " ".join(self.data[self.starts[j] : self.ends[j]].tobytes().decode() for j in range(begin, begin + n))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(length, words, item) of every window of every item (``WINDOWS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text", 1 << 18):
            words, rows = Words(batch.column(1)), []
            for row, item in enumerate(batch.column(0).to_pylist()):
                first, count = int(words.first[row]), int(words.count[row])
                n = min(count, WINDOW)
                rows += [(n, words.text(at, n), item) for at in range(first, first + count - n + 1 if n else first)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(WINDOWS)], schema=WINDOWS)

    return K.map_arrow(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")), run, WINDOWS)


def item_prints(benchmark: DataFrame) -> DataFrame:
    """(length, print): winnowed fingerprints of the items, and the hashes of those that are one short window (``PRINTS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            words = Words(batch.column(0))
            lengths, prints = [], []
            for n in range(1, WINDOW):
                grams, inside = words.grams(n)
                own = grams[inside & (words.count[words.rows[: len(grams)]] == n)]
                lengths.append(np.full(len(own), n))
                prints.append(own)
            _, own = words.prints(words.count >= WINDOW)
            lengths.append(np.full(len(own), WINDOW))
            prints.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lengths), pa.int32()), pa.array(np.concatenate(prints).view(np.int64))], schema=PRINTS)

    return K.map_arrow(benchmark.select(F.col("text").cast("string").alias("text")), run, PRINTS)


def own_prints(source: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, length, print): the distinct fingerprints of each document, and its short windows of the lengths that items have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            words, ids = Words(batch.column(2)), batch.column(0).to_numpy()
            for n in lengths:
                if n < WINDOW:
                    grams, inside = words.grams(n)
                    places = np.flatnonzero(inside)
                    prints = grams[places]
                else:
                    places, prints = words.prints()
                rows = ids[words.rows[places]]
                once = np.unique(np.stack([rows, prints.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(np.full(once.shape[1], n), pa.int32()), pa.array(once[1])], schema=OWN_PRINTS)

    return K.map_arrow(source, run, OWN_PRINTS)


def candidates(source: DataFrame, sent, lengths: list[int]) -> DataFrame:
    """Per document its number of words and the windows around its fingerprint hits (``CANDIDATES``).

    ``sent`` broadcasts the sorted fingerprints by length; without it each row brings its own hits as
    (length, print) in a fourth column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            words = Words(batch.column(2))
            if sent is not None:
                prints = sent.value
            else:
                listed = [p for row in batch.column(3).to_pylist() for p in row or ()]
                prints = {n: np.unique(np.array([p["print"] for p in listed if p["length"] == n], np.int64).view(np.uint64)) for n in lengths}
            windows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for n in lengths:
                if n < WINDOW:
                    grams, inside = words.grams(n)
                    begins = np.flatnonzero(found(grams, prints[n]) & inside)
                else:
                    places, own = words.prints()
                    begins = words.around(places[found(own, prints[n])])
                for at in begins.tolist():
                    row = int(words.rows[at])
                    windows[row].append({"begin": at - int(words.first[row]), "length": n, "words": words.text(at, n)})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.count), pa.array(windows, CANDIDATES.field(3).type)], schema=CANDIDATES)

    return K.map_arrow(source, run, CANDIDATES)


def contaminated_spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, maximal word spans (begin, end) that occur in the benchmark, and the items hit."""
    spark = documents.sparkSession
    prints = materialise(item_prints(benchmark).distinct(), "prints")
    lengths = sorted(r[0] for r in prints.select("length").distinct().collect())
    source = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if prints.limit(SENT_PRINTS + 1).count() <= SENT_PRINTS:
        rows = prints.toArrow()
        of, value = rows.column("length").to_numpy(), rows.column("print").to_numpy().view(np.uint64)
        sent = spark.sparkContext.broadcast({n: np.sort(value[of == n]) for n in lengths})
        told = candidates(source, sent, lengths)
    else:
        source = materialise(source, "rows")
        hits = own_prints(source, lengths).join(prints, ["length", "print"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("length", "print")).alias("prints"))
        told = candidates(source.join(hits, "row", "left").select("row", "doc_id", "text", "prints"), None, lengths)
    told = materialise(told, "candidates")

    around = told.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.*")
    wanted = around.select("length", "words").distinct()
    # items that share windows share one row of item ids
    of_window = item_windows(benchmark).join(small(wanted, SENT_ROWS), ["length", "words"], "left_semi").groupBy("length", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    matched = materialise(of_window.withColumn("set", F.struct(F.xxhash64("items").alias("a"), F.xxhash64(F.lit(1), "items").alias("b"))), "matched")
    sets = matched.groupBy("set").agg(F.first("items").alias("items"))
    hit = around.join(small(matched.drop("items"), SENT_ROWS), ["length", "words"]).select("row", F.struct("begin", (F.col("begin") + F.col("length")).alias("end")).alias("span"), "set")
    hit = materialise(hit.groupBy("row").agg(F.collect_list("span").alias("spans"), F.collect_set("set").alias("sets")), "hits")
    items = hit.select("row", F.explode("sets").alias("set")).join(small(sets, SENT_ROWS), "set").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = hit.select("row", merge_spans(F.col("spans")).alias("spans")).join(items, "row")
    nothing = F.array().cast("array<struct<begin:long,end:long>>")
    joined = told.select("row", "doc_id", "n_words").join(small(merged, SENT_ROWS), "row", "left")
    return joined.select("doc_id", "n_words", F.coalesce("spans", nothing).alias("spans"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def merge_spans(spans):
    """Union of [begin, end) spans as maximal disjoint spans."""
    kind = "array<struct<begin:long,end:long>>"
    return F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda out, x: F.when(
            (F.size(out) > 0) & (x["begin"] <= F.element_at(out, -1)["end"]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)["begin"].alias("begin"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))),
            ),
        )
        .otherwise(F.concat(out, F.array(x)))
        .cast(kind),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that share no window with the benchmark, with all their columns."""
    hit = contaminated_spans(documents, benchmark).where(F.size("spans") > 0).select("doc_id").distinct()
    return filter_ids(documents, materialise(hit, "contaminated"), "left_anti")


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest of ``contaminated_spans``: counts, the hash of the sorted item ids, and the verdict."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return contaminated_spans(documents, benchmark).select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
