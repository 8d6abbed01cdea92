"""Exact substring de-duplication by a hash-compared suffix sort.

Bytes covered by a string of ``LENGTH`` bytes that starts at two or more places are removed.

1. Every window of ``LENGTH`` bytes has an anchor, the place of its smallest k-gram hash; equal windows
   have equal anchors. Anchor hashes are counted, and only anchors that occur again are followed.
2. An anchor's context, the bytes of all windows that have it, is sent to the place of its hash. There
   the suffixes that start at the anchors, and the reversed prefixes that end there, are sorted by
   mergesort; two suffixes are compared by a binary search for their common extension over prefix
   polynomial hashes. Common extensions of neighbours are verified byte by byte (on a collision the
   block is sorted by its bytes).
3. A window o bytes left of its anchor is repeated if another context agrees for o bytes to the left and
   ``LENGTH - o`` to the right: both are runs of the two sorted orders.

Anchors that occur more than ``HOT`` times are taken out before anything is joined by anchor (up to
``HOT_ANCHORS`` of them, each a row of a broadcast): their contexts are made distinct by an aggregation, and
windows of contexts that occur once are aggregated by 128-bit hashes. Texts of more than ``SEGMENT`` bytes
are searched in segments that overlap by a window, which changes no window and no anchor.

Defined results of the edge cases: null and empty texts have no bytes; matches never cross texts;
repeated rows are copies of each other; texts shorter than ``LENGTH`` bytes are kept whole; a null
doc_id is a document like any other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import kernels as K
from loomtrace.llm.storage import input_bytes, materialise

LENGTH = 200
GRAM = 32
SPREAD = LENGTH - GRAM + 1
HOT = 20_000
#: Hot anchors that are sent to all executors (8 bytes each).
HOT_ANCHORS = 100_000
#: Bytes of contexts that are sorted together; whole anchor groups only.
BLOCK_BYTES = 3 << 20
#: Text bytes whose anchors are looked for at once; the temporaries are some hundred times as much.
CHUNK = 1 << 20
#: Bytes that are searched at once, below the places that the low bits of a hash can hold.
SEGMENT = 8 << 20
_PLACE = np.uint64((1 << 28) - 1)
#: What a row is known by: a hash alone would meet another document's sooner or later.
ROW = ["doc_id", "key"]

ANCHORS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64())])
CONTEXTS = pa.schema([("anchor", pa.int64()), ("context", pa.binary()), ("at", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("begin", pa.int64())])
SPANS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, place, first window, last window, hash) of the anchors of all windows inside rows."""
    if len(data) > SEGMENT:
        parts = []
        for at in range(0, len(data) - LENGTH + 1, SEGMENT - LENGTH + 1):
            row, *places, hashes = anchors(data[at : at + SEGMENT], np.clip(offsets - at, 0, min(SEGMENT, len(data) - at)))
            parts.append((row, *(p + at for p in places), hashes))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    n = len(data) - GRAM + 1
    nothing = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return nothing, nothing, nothing, nothing, nothing
    gram = gram_hashes(data)
    low = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
    pad = -n % SPREAD
    blocks = np.concatenate([low, np.full(pad, ~np.uint64(0))]).reshape(-1, SPREAD)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - LENGTH + 1
    place = (np.minimum(back[:windows], ahead[SPREAD - 1 : SPREAD - 1 + windows]) & _PLACE).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(windows), "right") - 1
    valid = np.flatnonzero(np.arange(windows) + LENGTH <= offsets[row + 1])
    if not len(valid):
        return nothing, nothing, nothing, nothing, nothing
    change = np.flatnonzero((np.diff(place[valid]) != 0) | (np.diff(valid) != 1)) + 1
    first = valid[np.concatenate([[0], change])]
    last = valid[np.concatenate([change - 1, [len(valid) - 1]])]
    return row[first], place[first], first, last, gram[place[first]].view(np.int64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    prefix = K.prefix_hash(data)
    n = len(data) - GRAM + 1
    return K.mix((prefix[GRAM:] - prefix[:n]) * K.powers(len(prefix), inverse=True)[:n])


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and a key of the row, the same for repeated rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def repeated_anchors(source: DataFrame) -> DataFrame:
    """(doc_id, key, anchors, hot): by row the anchor hashes that occur again, and of those the hot ones.

    The anchors of all texts are written once: counting them and joining the counts both read them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text", CHUNK):
            data, offsets = K.text_buffer(batch.column(1))
            row, _, _, _, hashes = anchors(data, offsets)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), batch.column(0).take(taken), batch.column(2).take(taken)], schema=ANCHORS)

    found = materialise(K.map_arrow(source, run, ANCHORS), "found")
    counts = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = materialise(counts.select("anchor", (F.col("n") > HOT).alias("is_hot")), "again")
    hottest = again.where("is_hot")
    if hottest.limit(HOT_ANCHORS + 1).count() <= HOT_ANCHORS:
        listed = F.broadcast(hottest.select("anchor"))
        warm = found.join(listed, "anchor", "left_anti").join(again.where("not is_hot"), "anchor")
        marked = warm.unionByName(found.join(listed, "anchor", "left_semi").withColumn("is_hot", F.lit(True)))
    else:  # so many hot ones that each is a small part of all rows
        marked = found.join(again, "anchor")
    lists = marked.groupBy(*ROW).agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("is_hot"), F.col("anchor"))).alias("hot"))
    return materialise(lists, "anchors")


def contexts(source: DataFrame, lists: DataFrame, hot: bool) -> DataFrame:
    """Contexts of the repeated anchors that are (not) hot, with where they come from (``CONTEXTS``).

    Hot anchors are few: up to ``HOT_ANCHORS`` of them are sent to the texts, more are joined.
    """
    few = None
    if hot:
        distinct = lists.select(F.explode("hot").alias("anchor")).distinct().limit(HOT_ANCHORS + 1).collect()
        few = np.array([r[0] for r in distinct], np.int64) if len(distinct) <= HOT_ANCHORS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text", CHUNK):
            data, offsets = K.text_buffer(batch.column(1))
            row, place, first, last, hashes = anchors(data, offsets)
            if not len(row):
                continue
            if few is not None:
                wanted = np.isin(hashes, few)
            else:
                wanted = np.zeros(len(row), bool)
                begin, count = K.run_starts(row, batch.num_rows)
                for r, (listed, hottest) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                    if count[r]:
                        part = slice(begin[r], begin[r] + count[r])
                        warm = np.isin(hashes[part], np.array(hottest.as_py() or [], np.int64))
                        wanted[part] = warm if hot else ~warm & np.isin(hashes[part], np.array(listed.as_py(), np.int64))
            row, place, first, last, hashes = (x[wanted] for x in (row, place, first, last, hashes))
            text = data.tobytes()
            pieces = [text[b:e] for b, e in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)]
            ids, keys = batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(pieces, pa.binary()), pa.array((place - first).astype(np.int32)), ids, keys, pa.array(first - offsets[row])], schema=CONTEXTS)

    if few is not None:
        return K.map_arrow(source.select("doc_id", "text", "key"), run, CONTEXTS)
    wanted = lists.where(F.size("hot") > 0 if hot else F.size("anchors") > F.size("hot"))
    joined = source.join(wanted, ROW).select("doc_id", "text", "key", "anchors", "hot")
    return K.map_arrow(joined, run, CONTEXTS)


class Suffixes:
    """Suffixes of one byte buffer, compared by prefix polynomial hashes; ``limit`` bytes count of each."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.data, self.start, self.length = np.concatenate([data, np.zeros(LENGTH + 1, np.uint8)]), start, np.minimum(length, LENGTH)
        self.prefix = K.prefix_hash(self.data)
        self.inverse = K.powers(len(self.prefix), inverse=True)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffix pairs, by binary search over hash equality."""
        most = np.minimum(self.length[x], self.length[y])
        a, b = self.start[x].copy(), self.start[y].copy()
        got = np.zeros(len(x), np.int64)
        step = 1 << (LENGTH.bit_length() - 1)
        while step:
            fits = got + step <= most
            e, f = np.where(fits, a + step, a), np.where(fits, b + step, b)
            same = fits & ((self.prefix[e] - self.prefix[a]) * self.inverse[a] == (self.prefix[f] - self.prefix[b]) * self.inverse[b])
            got += step * same
            a += step * same
            b += step * same
            step >>= 1
        return got

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether x sorts before y (or is equal, where asked)."""
        n = self.extension(x, y)
        lx, ly = self.length[x], self.length[y]
        end = (n == lx) | (n == ly)
        return np.where(end, (lx < ly) | ((lx == ly) & or_equal), self.data[self.start[x] + n] < self.data[self.start[y] + n])

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Indices sorted by (group, suffix): mergesort of all groups at once, runs doubling."""
        order = np.argsort(group, kind="stable")
        sorted_group = group[order]
        first = np.searchsorted(sorted_group, sorted_group)
        size = np.searchsorted(sorted_group, sorted_group, "right") - first
        width, widest = 1, int(size.max(initial=0))
        while width < widest:
            at = np.arange(len(order)) - first
            run = at // width
            other = (run ^ 1) * width
            live = np.flatnonzero((other < size) & (size > width))
            low, high = np.zeros(len(live), np.int64), np.minimum(width, size[live] - other[live])
            item, left = order[live], (run[live] & 1) == 1
            open_ = np.arange(len(live))
            while len(open_):
                mid = (low[open_] + high[open_]) >> 1
                there = order[first[live[open_]] + other[live[open_]] + mid]
                # items of the right run stand behind equal items of the left run
                ahead = self.before(there, item[open_], left[open_])
                low[open_] = np.where(ahead, mid + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], mid)
                open_ = open_[low[open_] < high[open_]]
            target = first[live] + np.minimum(run[live] * width, other[live]) + (at[live] - run[live] * width) + low
            moved = order.copy()
            moved[target] = item
            order, width = moved, width * 2
        return order

    def verified(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, common extension with the suffix before, -1 at a group's first), checked on bytes."""
        order = self.sort(group)
        shared = self._neighbours(order)
        x, y = order[:-1], order[1:]
        if len(x) and (self.extension(x, y) != shared[1:])[group[x] == group[y]].any():
            text = self.data.tobytes()
            order = np.array(sorted(range(len(group)), key=lambda i: (group[i], text[self.start[i] : self.start[i] + self.length[i]])))
            shared = self._neighbours(order)
        shared[np.concatenate([[True], group[order[1:]] != group[order[:-1]]])] = -1
        return order, shared

    def _neighbours(self, order: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.full(len(order), -1)
        span = np.arange(LENGTH)
        for b in range(1, len(order), block):
            x, y = order[b - 1 : b - 1 + block][: len(order) - b], order[b : b + block]
            most = np.minimum(self.length[x], self.length[y])
            differ = (self.data[self.start[x][:, None] + span] != self.data[self.start[y][:, None] + span]) | (span >= most[:, None])
            out[b : b + block] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        return out


def repeated_windows(group: np.ndarray, pieces: list[bytes], at: np.ndarray) -> list[np.ndarray]:
    """For every context the window starts (in the context) whose window occurs in another one, or again."""
    # equal contexts of a group stand for one another
    seen: dict[tuple[int, int, bytes], int] = {}
    owner = np.array([seen.setdefault((g, a, p), i) for i, (g, a, p) in enumerate(zip(group.tolist(), at.tolist(), pieces, strict=True))])
    copies = np.bincount(owner, minlength=len(pieces))
    length = np.array([len(p) for p in pieces])
    flags = [np.ones(n - LENGTH + 1, bool) if copies[o] > 1 else None for n, o in zip(length, owner, strict=True)]
    alone = copies == 1
    mixed = np.isin(group, group[alone])
    use = np.flatnonzero((copies > 0) & mixed)
    _, several = np.unique(group[use], return_counts=True)
    use = use[np.isin(group[use], np.unique(group[use])[several > 1])]
    for i in np.flatnonzero(alone):
        flags[i] = np.zeros(length[i] - LENGTH + 1, bool)
    if len(use):
        data = np.frombuffer(b"".join(pieces[i] for i in use), np.uint8)
        n, a, g = length[use], at[use].astype(np.int64), group[use]
        start = np.cumsum(n) - n
        orders = []
        for suffixes in (lambda: Suffixes(data, start + a, n - a), lambda: Suffixes(data[::-1].copy(), len(data) - start - a, a)):
            orders.append(suffixes().verified(g))  # one after the other: each has hashes of eight times the data
        (right, right_shared), (left, left_shared) = orders
        right_class, left_class = np.empty(len(use), np.int64), np.empty(len(use), np.int64)
        for o in range(int((a - n + LENGTH).min()), int(a.max()) + 1):
            live = np.flatnonzero((o <= a) & (o >= a - n + LENGTH))
            if len(live) < 2:
                continue
            right_class[right] = np.cumsum(right_shared < LENGTH - o)
            left_class[left] = np.cumsum(left_shared < o)
            both = left_class[live] * (len(use) + 1) + right_class[live]
            order = np.argsort(both, kind="stable")
            same = both[order[1:]] == both[order[:-1]]
            twice = np.zeros(len(live), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            for j in live[twice].tolist():
                i = use[j]
                if alone[i]:
                    flags[i][a[j] - o] = True
    return [np.flatnonzero(flags[i]) if flags[i] is not None else np.zeros(0, np.int64) for i in range(len(pieces))]


def runs(windows: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans [begin, end) that sorted window starts cover, where starts follow each other directly."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > 1) + 1
    first, last = windows[np.concatenate([[0], cut])], windows[np.concatenate([cut - 1, [len(windows) - 1]])]
    return list(zip(first.tolist(), (last + LENGTH).tolist(), strict=True))


def sorted_spans(found: DataFrame, parts: int) -> DataFrame:
    """Repeated byte spans of the contexts: all contexts of an anchor are sorted in one task (``SPANS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            _, group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
            windows = repeated_windows(group, [r[1] for r in rows], np.array([r[2] for r in rows], np.int64))
            out = [(r[3], r[4], r[5] + b, r[5] + e) for r, w in zip(rows, windows, strict=True) for b, e in runs(w)]
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], schema=SPANS)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        if held:
            yield solve(held)

    return K.map_arrow(found.repartition(parts, "anchor").sortWithinPartitions("anchor"), run, SPANS)


def hot_spans(found: DataFrame) -> DataFrame:
    """The same for hot anchors, by aggregation of distinct contexts and then of their windows."""
    named = found.withColumns({"a": F.xxhash64("anchor", "at", "context"), "b": F.xxhash64("context", "at", "anchor")})
    distinct = named.groupBy("anchor", "at", "context").agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    each = distinct.select("a", "b", "n", "context", F.explode(F.sequence(F.lit(0), F.octet_length("context") - LENGTH)).alias("i"))
    window = F.substring("context", F.col("i") + 1, F.lit(LENGTH))
    hashed = each.select("a", "b", "n", "i", F.xxhash64(window).alias("w"), F.xxhash64(F.lit(1), window).alias("x"))
    twice = hashed.groupBy("w", "x").agg(F.sum("n").alias("n")).where("n > 1").select("w", "x")
    hits = hashed.join(twice, ["w", "x"], "left_semi").groupBy("a", "b").agg(F.collect_list("i").alias("hits"))
    back = named.select("a", "b", "doc_id", "key", "begin").join(hits, ["a", "b"]).select("doc_id", "key", "begin", F.explode("hits").alias("i"))
    return back.select("doc_id", "key", (F.col("begin") + F.col("i")).alias("begin"), (F.col("begin") + F.col("i") + LENGTH).alias("end"))


def strip(source: DataFrame, spans: DataFrame) -> DataFrame:
    """Removes the spans from the texts (``RESULT``)."""
    # joined by the same columns as the contexts are: Spark shuffles the texts once for both
    lists = spans.groupBy(*ROW).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = source.join(lists, ROW, "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            rows = []
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                kept, at, count = [], 0, 0
                for begin, end in sorted((s["begin"], s["end"]) for s in found or ()):
                    if not count or begin > at:
                        kept.append(data[at:begin])
                        count += 1
                        at = end
                    else:
                        at = max(at, end)
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append((None if doc == -(1 << 63) else doc, len(data), len(data) - len(rest), count, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(RESULT)], schema=RESULT)

    return K.map_arrow(joined, run, RESULT)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Every document without its repeated bytes, with counts and the hash of the bytes that are kept.

    ``text`` are the kept bytes; where a span begins or ends inside a character, the rest of that
    character goes too.
    """
    source = keyed(documents)
    lists = repeated_anchors(source)
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(source) // (8 << 20) + 1)
    spans = sorted_spans(contexts(source, lists, hot=False), parts)
    if not lists.where(F.size("hot") > 0).isEmpty():
        spans = spans.unionByName(hot_spans(materialise(contexts(source, lists, hot=True), "contexts")))
    return strip(source, spans)
