"""Divergence audit: how differently the sources of a language use its terms.

Single-pass in-memory indexing. A task reads documents once and adds postings (term, source, count) and
document frequencies to a block in memory; a full block is spilled as runs sorted by term, one for each hash
shard of terms. A shard merges its runs with a heap, which makes the corpus frequencies of each of its terms
at once; terms below ``LEAST_DOCUMENTS`` are dropped there. A block and a shard are bounded, however often a
term or a source occurs: a block sends each of its terms once.

The distance of two sources sums a penalty over all kept terms. Most terms are missing in most sources, so
each pair starts from what it would be if the two had no term in common, which follows from how often each
count occurs in a source; the terms that both have are then streamed as corrections (``corrections``).

All numbers are integers. Shares are fractions of a billion, divided digit group by digit group, so that no
product exceeds 64 bits.

Defined results of the edge cases: null text, lang and source are empty strings, which are values like
others; repeated rows count as documents each; a source without kept terms is compared like others; a
language without kept terms has distances 0; a language of one source has no pairs; an empty table gives no
row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm import kernels as K
from loomtrace.llm.exchange import narrow, widen
from loomtrace.llm.storage import input_bytes, materialise, small

#: Documents of a language that must have a term, and ranks of a source's own terms.
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
#: Entries of a block in memory, bytes of input behind a shard, and most shards.
ENTRIES = 400_000
SHARD_BYTES = 16 << 20
SHARDS = 1 << 16
#: Bytes of a text that are cut into terms at a time, and pairs that a task adds up before it sends them.
PIECE = 1 << 20
PAIRS = 1 << 20

#: Byte table that lower-cases A-Z and blanks all that separates terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: A run: terms are joined by blanks, numbers are as narrow as their largest (``exchange.narrow``). ``seen`` has all
#: sources of a block, in one row of each language; ``held`` is the number of postings of each term.
RUN = pa.schema(
    [("shard", pa.int64()), ("lang", pa.string()), ("seen", pa.list_(pa.string())), ("names", pa.list_(pa.string())), ("terms", pa.binary()), ("documents", pa.binary()), ("held", pa.binary()), ("sources", pa.binary()), ("counts", pa.binary())]
)
KEPT = "lang string, term string, sources array<string>, counts array<long>"
CORRECTION = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about ``PIECE`` bytes that never cut a term."""
    blanked = text.translate(_TERMS)
    at = 0
    while at < len(blanked):
        stop = len(blanked) if len(blanked) - at <= PIECE else blanked.find(b" ", at + PIECE)
        stop = len(blanked) if stop < 0 else stop
        yield blanked[at:stop].split()
        at = stop


class Block:
    """Postings of some documents by language: counts by source, and documents by term."""

    def __init__(self):
        self.counts: dict[str, dict[str, Counter]] = {}
        self.documents: dict[str, Counter] = {}
        self.entries = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        count = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        having = self.documents.setdefault(lang, Counter())
        before, seen = len(count) + len(having), set()
        for piece in terms_of(text):
            count.update(piece)
            seen.update(piece)
        having.update(seen)
        self.entries += len(count) + len(having) - before

    def runs(self, shards: int) -> Iterator[tuple]:
        """Rows of ``RUN``: for each language and shard the terms in order, with their postings."""
        for lang, by_source in self.counts.items():
            names, having = list(by_source), self.documents[lang]
            # all terms by shard and then by their bytes; a posting is known by the place of its term in that
            terms = sorted(having)
            shard = np.fromiter((zlib.crc32(t) for t in terms), np.int64, len(terms)) % shards
            order = np.argsort(shard, kind="stable")
            terms, shard = [terms[k] for k in order.tolist()], shard[order]
            documents = np.fromiter((having[t] for t in terms), np.int64, len(terms))
            place_of = dict(zip(terms, range(len(terms)), strict=True))
            sizes = [len(c) for c in by_source.values()]
            place = np.fromiter((place_of[t] for c in by_source.values() for t in c), np.int64, sum(sizes))
            counts = np.fromiter((n for c in by_source.values() for n in c.values()), np.int64, sum(sizes))
            by_place = np.argsort(place, kind="stable")
            sources, counts = np.repeat(np.arange(len(names)), sizes)[by_place], counts[by_place]
            held = np.bincount(place, minlength=len(terms))
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(held)])
            cuts = np.concatenate([np.flatnonzero(np.diff(shard, prepend=-1)), [len(terms)]])
            yield 0, lang, names, names, b"", *(narrow(np.zeros(0, np.int64)),) * 4
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = slice(ends[low], ends[high])
                numbers = (documents[low:high], held[low:high], sources[own], counts[own])
                yield int(shard[low]), lang, None, names, b" ".join(terms[low:high]), *(narrow(x) for x in numbers)


def index(documents: DataFrame, shards: int) -> DataFrame:
    """The spilled runs of all blocks (``RUN``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()

        def spilled() -> pa.RecordBatch:
            rows = list(block.runs(shards))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(RUN)], schema=RUN)

        for batch in K.chunks(batches, "text"):
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                block.add(lang, source, text)
                if block.entries >= ENTRIES:
                    yield spilled()
                    block = Block()
        if block.counts:
            yield spilled()

    columns = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    return K.map_arrow(documents.select(*columns), run, RUN)


def merged(runs: list[dict]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Terms of the runs of one language in order, one after another: (terms, number of each over all runs, where terms are new)."""
    terms = [r["terms"].split() for r in runs]
    base = np.cumsum([0, *map(len, terms)]).tolist()
    found = list(heapq.merge(*(zip(t, range(b, b + len(t)), strict=True) for t, b in zip(terms, base, strict=False))))
    order = np.fromiter(map(itemgetter(1), found), np.int64, len(found))
    fresh = np.fromiter((a[0] != b[0] for a, b in zip(found, found[1:], strict=False)), bool, max(len(found) - 1, 0))
    return [f[0] for f in found], order, np.concatenate([np.zeros(min(len(found), 1), np.int64), np.flatnonzero(fresh) + 1])


def merge(runs: pa.Table) -> pa.Table:
    """Terms of a shard in enough documents, with their counts by source (``KEPT``): a heap merge of its runs.

    Postings are looked at only for terms that are kept.
    """
    by_lang: dict[str, list[dict]] = {}
    for run in runs.to_pylist():
        by_lang.setdefault(run["lang"], []).append(run)
    out = []
    for lang, own in by_lang.items():
        terms, order, starts = merged(own)
        if not len(starts):
            continue
        documents = np.concatenate([widen(r["documents"]) for r in own]).astype(np.int64)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        enough = np.add.reduceat(documents[order], starts) >= LEAST_DOCUMENTS
        if not enough.any():
            continue
        names: dict[str, int] = {}
        told = [np.array([names.setdefault(n, len(names)) for n in r["names"]])[widen(r["sources"])] for r in own]
        source, counts = np.concatenate(told), np.concatenate([widen(r["counts"]) for r in own]).astype(np.int64)
        held = np.concatenate([widen(r["held"]) for r in own]).astype(np.int64)
        first = np.cumsum(held) - held
        entry, at = order[enough[group]], group[enough[group]]
        size = held[entry]
        posting = np.repeat(first[entry] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        keys, inverse = np.unique(np.repeat(at, size) * len(names) + source[posting], return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, inverse, counts[posting])
        ends = np.searchsorted(keys // len(names), np.flatnonzero(enough), "right").astype(np.int32)
        cut = pa.array(np.concatenate([np.zeros(1, np.int32), ends]))
        kept = [terms[k].decode() for k in starts[enough].tolist()]
        sources = pa.ListArray.from_arrays(cut, pa.array(list(names)).take(pa.array(keys % len(names))))
        out.append(pa.table({"lang": pa.array([lang] * len(kept)), "term": pa.array(kept), "sources": sources, "counts": pa.ListArray.from_arrays(cut, pa.array(sums))}))
    types = {"lang": pa.string(), "term": pa.string(), "sources": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}
    return pa.concat_tables(out).combine_chunks() if out else pa.schema(list(types.items())).empty_table()


def share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (count + 2) / (size + 2 * terms)), by digit groups of a thousand; null without terms."""
    whole, rest, value = size + 2 * terms, count + 2, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        value = value * 1000 + F.call_function("div", rest, whole)
        rest = rest % whole
    return F.when(terms > 0, value + 1)


def penalty(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _penalties(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


class Sums:
    """Sums of pairs of sources, flushed as rows of ``CORRECTION`` when there are many."""

    def __init__(self):
        self.places: dict[tuple[str, str], int] = {}
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    def add(self, lang: str, names: list[str], p: np.ndarray, missing: np.ndarray) -> None:
        """One term's corrections for all pairs of the sources that have it; ``missing`` is the share of a term they lack."""
        at = np.array([self.places.setdefault((lang, n), len(self.places)) for n in names])
        step = max(1, PAIRS // len(names))
        for first in range(0, len(names), step):
            part = slice(first, first + step)
            one, gone = p[part, None], missing[part, None]
            value = _penalties(one, p) - _penalties(one, missing) - _penalties(gone, p) + _penalties(gone, missing)
            pairs = at[part, None] < at
            self.keys.append(((at[part, None] << 32) + at)[pairs])
            self.values.append(value[pairs])
            self.held += len(self.keys[-1])
            if self.held > 2 * PAIRS:
                self.fold()

    def fold(self) -> None:
        keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, inverse, np.concatenate(self.values))
        self.keys, self.values, self.held = [keys], [sums], len(keys)

    def rows(self) -> pa.RecordBatch:
        if self.keys:
            self.fold()
        names = list(self.places)
        keys = self.keys[0] if self.keys else np.zeros(0, np.int64)
        a, b = [names[k] for k in (keys >> 32).tolist()], [names[k] for k in (keys & 0xFFFFFFFF).tolist()]
        columns = [[x[0] for x in a], [x[1] for x in a], [x[1] for x in b], self.values[0] if self.values else []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CORRECTION, strict=True)], schema=CORRECTION)


def corrections(terms: DataFrame) -> DataFrame:
    """Sums over common terms by pair of sources, from rows (lang, sources, shares, missing) of one term each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            for lang, names, p, missing in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                sums.add(lang, names, np.array(p, np.int64), np.array(missing, np.int64))
                if sums.held > PAIRS and len(sums.keys) == 1:
                    yield sums.rows()
                    sums = Sums()
        yield sums.rows()

    return K.map_arrow(terms, run, CORRECTION)


def _paired(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language."""
    shares = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    having = shares.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("shares"), F.sum("n").alias("own"))
    full = materialise(groups.join(having, ["lang", "source"], "left").withColumns({"shares": F.coalesce("shares", F.array().cast("array<struct<p:long,n:long>>")), "own": F.coalesce("own", F.lit(0))}), "sources")
    other = full.select("lang", *(F.col(c).alias(f"{c}_b") for c in ("source", "missing", "shares", "own")))
    met = full.join(small(other, 100_000), "lang").where("source <> source_b")

    def against(shares: str, missing: str) -> Column:
        return F.aggregate(shares, F.lit(0).cast("long"), lambda total, x: total + x["n"] * penalty(x["p"], F.col(missing)))

    alone = against("shares", "missing_b") + against("shares_b", "missing") + (F.col("terms") - F.col("own") - F.col("own_b")) * penalty(F.col("missing"), F.col("missing_b"))
    start = met.select("lang", "source", F.col("source_b").alias("item"), F.when(F.col("terms") > 0, alone).otherwise(0).alias("value"))
    together = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "missing")).alias("at"))
    once = corrections(together.where(F.size("at") > 1).select("lang", F.col("at.source").alias("sources"), F.col("at.p").alias("shares"), F.col("at.missing").alias("missing")))
    both = once.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("pair"))
    return start.unionByName(both.select("lang", "pair.source", "pair.item", "value")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def audit(documents: DataFrame) -> DataFrame:
    """All distances between the sources of each language, and the terms that each source has more of."""
    spark = documents.sparkSession
    shards = min(SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(documents) // SHARD_BYTES + 1))
    runs = materialise(index(documents, shards), "runs")
    kept = materialise(runs.groupBy("shard").applyInArrow(merge, KEPT), "terms")

    named = runs.select("lang", F.explode("seen").alias("source")).distinct()
    count = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    at = F.explode(F.arrays_zip("sources", "counts")).alias("at")
    each = kept.select("lang", "term", count.alias("lang_n"), at).select("lang", "term", "lang_n", F.col("at.sources").alias("source"), F.col("at.counts").alias("n"))
    sizes = each.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(count).alias("lang_size"))
    joined = named.join(sizes, ["lang", "source"], "left").join(small(materialise(langs, "langs")), "lang", "left")
    filled = joined.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "terms", "lang_size")))
    groups = materialise(filled.withColumn("missing", share(F.lit(0).cast("long"), F.col("size"), F.col("terms"))), "groups")

    shared = each.join(small(groups), ["lang", "source"]).select(
        "lang", "source", "term", "missing", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_size"), F.col("terms")).alias("q")
    )
    pairs = _ranked(_paired(shared, groups)).withColumn("part", F.lit("pair"))
    own = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), penalty(F.col("p"), F.col("q")).alias("value"))
    terms = _ranked(own).where(F.col("rank") <= TOP_TERMS).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.select(*columns))
