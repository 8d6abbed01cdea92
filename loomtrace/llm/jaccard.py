"""N-gram Jaccard join: documents whose word-shingle sets overlap enough, as linked components.

1. In how many sets each shingle occurs (up to ``MOST``) comes from ``exchange``: blocks of documents send
   their distinct shingle hashes, cut short to a few bits more than the corpus needs; a collision only
   raises a count.
2. Shingles are ordered by that count and their hash, one order for all. Linked sets have one of their
   first ``prefix_length`` shingles in common, so sets without a prefix shingle that occurs again have
   no link: passages that many documents share stand last and don't count.
3. Equal sets are one set from here. Common prefix shingles join the remaining sets into candidate
   groups that contain all links.
4. A group's sets are stored in a trie, rarest shingles first. Each set in turn traverses the paths of
   the trie that its own rarest shingles meet; overlaps are counted once per shared path, and subtrees
   whose remaining lengths can't reach the threshold are left. Sets that link join the component and
   are not compared again, so a group of thousands of near copies is not expanded into pairs.

Groups of more than ``BLOCK`` shingles are linked block by block; if representatives of the blocks
don't show the group to be one component, its sets are dealt out once more by each prefix shingle that
they share, and linked there (block by block, all pairs of blocks, where one shingle's sets are more than
``BLOCK`` shingles).

A set is known by its size and two 64-bit digests, never by its doc_id, so rows with equal, clashing or
no ids link like any others.

Defined results of the edge cases: texts without words and null texts have the empty set and link with
nothing; repeated rows are one node and each returned; null doc_ids link like others but are named by
null only if no linked row has an id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import exchange as X
from loomtrace.llm import kernels as K
from loomtrace.llm.components import connected_components
from loomtrace.llm.storage import filter_ids, input_bytes, materialise, numbered, small

#: Words of a shingle, and sets link when PERCENT * union <= 100 * intersection, unless others are asked for.
SHINGLE = 4
PERCENT = 85
#: Shingles of a group that are linked together, and megabytes of input in a block of documents.
BLOCK = 1 << 21
BLOCK_MB = 2
#: Counts of sets are not told apart above this.
MOST = 255

#: Candidate sets are broadcast to the texts up to this many (some 60 bytes each); more are joined by a shuffle.
BROADCAST_SETS = 500_000
#: The doc_id under which rows without one are handled.
NO_ID = -(1 << 63)

SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest_a", pa.int64()), ("digest_b", pa.int64()), ("prefix", pa.list_(pa.int64()))])
MEMBERS = pa.schema([("n_shingles", pa.int64()), ("digest_a", pa.int64()), ("digest_b", pa.int64()), ("shingles", pa.binary())])
LINKS = pa.schema([("key", pa.int64()), ("root", pa.int64())])
#: Name of the row number while duplicates are looked for.
ROW = "loomtrace_row"
SET = ["digest_a", "digest_b", "n_shingles"]


def needed(n, percent: int = PERCENT):
    """Fewest common shingles that a set of n (or of each of an array) needs with any partner."""
    return -(-percent * n // 100)


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """First shingles of a set of n, one of which any partner has among its own first ones."""
    return n - needed(n, percent) + 1


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    data, offsets = K.text_buffer(texts)
    starts, ends, rows = K.words(data, offsets, K.SPACE_SEPARATED)
    hashes = K.word_hashes(data, starts, ends, lower=True)
    grams = K.ngrams(hashes, shingle)
    first, count = K.run_starts(rows, len(texts))
    out = []
    for at, n in zip(first.tolist(), count.tolist(), strict=True):
        out.append(np.unique(grams[at : at + n - shingle + 1]) if n >= shingle else K.ngrams(hashes[at : at + n], n) if n else np.zeros(0, np.uint64))
    return out


def block_sets(block: pa.Table, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Shingle sets of all rows, in slices that bound the temporaries."""
    return [s for batch in K.chunks(iter(block.to_batches()), "text") for s in shingle_sets(batch.column(batch.schema.get_field_index("text")), shingle)]


def digests(flat: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set, whose shingles follow each other in ``flat``."""
    ends = np.concatenate([[0], np.cumsum(size)])
    out = []
    for values in (flat, K.mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        out.append((running[ends[1:]] - running[ends[:-1]]).view(np.int64))
    return out


def describe(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Size and digests of every document's shingle set, and its prefix shingles that occur again (``SETS``)."""
    from pyspark.sql.pandas.types import from_arrow_schema

    size = input_bytes(documents)
    count = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size >> 20) // BLOCK_MB + 1)
    # twice the shards: half the keys that a task merges at once
    shards, bits = 2 * X.shards_of(count), min(64, max(32, size.bit_length() + 8))
    blocks = _source(documents).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)))

    def ask(block: pa.Table) -> pa.Table:
        unique, sets = np.unique(np.concatenate(block_sets(block, shingle)) >> np.uint64(64 - bits), return_counts=True)
        return X.messages(block.column("block")[0].as_py(), unique, np.minimum(sets, MOST), None, shards, bits)

    def run(block: pa.Table, answer: pa.Table) -> pa.Table:
        if not block.num_rows:
            return SETS.empty_table()
        sets = block_sets(block, shingle)
        flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, inverse = np.unique(flat >> np.uint64(64 - bits), return_inverse=True)
        n_sets = X.told(answer, "counts")[inverse] if len(flat) else np.zeros(0, np.uint8)
        order = np.lexsort((flat, n_sets, row))
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        chosen = order[(nth < prefix_length(size, percent)[row]) & (n_sets[order] > 1)]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(row[chosen], minlength=len(sets)))])
        prefix = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat[chosen].view(np.int64)))
        return pa.Table.from_arrays([block.column("doc_id"), pa.array(size, pa.int64()), *map(pa.array, digests(flat, size)), prefix], schema=SETS)

    asked = blocks.groupBy("block").applyInArrow(ask, from_arrow_schema(X.MESSAGE))
    told = X.totals(asked, count, shards, bits, MOST).where("block >= 0")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, from_arrow_schema(SETS))


def _source(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def full_sets(source: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The whole shingle set of every (doc_id, text), as bytes, with what it is known by (``MEMBERS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches, "text"):
            sets = shingle_sets(batch.column(1), shingle)
            size = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), *map(pa.array, digests(np.concatenate(sets), size)), pa.array([s.tobytes() for s in sets], pa.binary())], schema=MEMBERS)

    return K.map_arrow(source, run, MEMBERS)


class Trie:
    """Sequences of ascending shingle ranks (rarest first), stored once per shared path.

    Sorted sequences are cut at the path they share with the one before; ``parent`` is the sequence
    whose stored part the shared path ends in. ``near`` lists, for each rank, the sequences that have it
    in the prefix that must meet a partner's prefix.
    """

    def __init__(self, sequences: list[np.ndarray], ranks: int, percent: int = PERCENT):
        self.percent = percent
        self.order = np.array(sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes()))
        ordered = [sequences[i] for i in self.order]
        n = len(ordered)
        self.length = np.array([len(s) for s in ordered])
        self.common, self.parent, self.level = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        stack: list[int] = []
        for i in range(n):
            if i:
                m = min(len(ordered[i]), len(ordered[i - 1]))
                differ = np.flatnonzero(ordered[i][:m] != ordered[i - 1][:m])
                self.common[i] = differ[0] if len(differ) else m
            while stack and self.common[stack[-1]] >= self.common[i]:
                stack.pop()
            if stack and self.common[i]:
                self.parent[i] = stack[-1]
                self.level[i] = self.level[stack[-1]] + 1
            stack.append(i)
        self.begin = np.concatenate([[0], np.cumsum(self.length - self.common)])
        self.stored = np.concatenate([s[c:] for s, c in zip(ordered, self.common, strict=True)])
        prefixes = [s[: len(s) - needed(len(s), percent) + 1] for s in ordered]
        tokens = np.concatenate(prefixes)
        by_token = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(n), [len(p) for p in prefixes])[by_token]
        self.near = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=ranks))])

    def partners(self, query: np.ndarray, ranks: int, waiting: np.ndarray) -> np.ndarray:
        """Indices (of the constructor's list) of the waiting sequences that link with the query."""
        percent = self.percent
        head = query[: len(query) - needed(len(query), percent) + 1]
        lists = [self.owner[self.near[r] : self.near[r + 1]] for r in head]
        ends = np.unique(np.concatenate(lists))
        ends = ends[waiting[self.order[ends]]]
        # sizes that are too different can't link
        ends = ends[(100 * self.length[ends] >= percent * len(query)) & (100 * len(query) >= percent * self.length[ends])]
        if not len(ends):
            return ends
        paths, up = [ends], self.parent[ends]
        while (up >= 0).any():
            up = np.unique(up[up >= 0])
            paths.append(up)
            up = self.parent[up]
        nodes = np.unique(np.concatenate(paths))
        inside = np.zeros(ranks, bool)
        inside[query] = True
        sizes = self.begin[nodes + 1] - self.begin[nodes]
        first = np.cumsum(sizes) - sizes
        hits = np.concatenate([[0], np.cumsum(inside[self.stored[np.repeat(self.begin[nodes] - first, sizes) + np.arange(sizes.sum())]])])
        base = np.zeros(len(nodes), np.int64)
        dead = np.zeros(len(nodes), bool)
        need = -(-percent * (len(query) + np.maximum(needed(len(query), percent), 1)) // (100 + percent))
        for level in range(1, int(self.level[nodes].max()) + 1):
            at = np.flatnonzero(self.level[nodes] == level)
            above = np.searchsorted(nodes, self.parent[nodes[at]])
            shared_path = self.common[nodes[at]]
            base[at] = base[above] + hits[first[above] + shared_path - self.common[nodes[above]]] - hits[first[above]]
            # what is left of the query behind the shared path bounds the overlap of the whole subtree
            last = self.stored[self.begin[nodes[above]] + shared_path - self.common[nodes[above]] - 1]
            dead[at] = dead[above] | (base[at] + len(query) - np.searchsorted(query, last, "right") < need)
        overlap = base + hits[first + sizes] - hits[first]
        linked = ~dead & (100 * overlap >= percent * (len(query) + self.length[nodes] - overlap))
        linked &= np.isin(nodes, ends)
        return self.order[nodes[linked]]


def link(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """A component number for each set: traverses from every set to those not yet placed."""
    label = np.full(len(sets), -1)
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(values))
    bounds = np.cumsum([len(s) for s in sets])[:-1]
    sequences = [np.sort(s) for s in np.split(rank[inverse], bounds)]
    trie, held, left = None, np.arange(len(sets)), len(sets)
    for seed in range(len(sets)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        left -= 1
        queue = [seed]
        while queue and left:
            if trie is None or left * 2 < len(held):
                held = np.flatnonzero(label < 0)
                trie = Trie([sequences[i] for i in held], len(values), percent)
            partners = held[trie.partners(sequences[queue.pop()], len(values), label[held] < 0)]
            label[partners] = seed
            left -= len(partners)
            queue.extend(partners.tolist())
    return label


def link_groups(members: DataFrame, by: list[str], percent: int = PERCENT) -> DataFrame:
    """(key, root) for each row of (by..., key, shingles); root is the smallest linked key of the group."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(group: pa.Table) -> pa.Table:
        keys = np.array(group.column("key").to_pylist(), np.int64)
        order = np.argsort(keys, kind="stable")
        sets = [np.frombuffer(group.column("shingles")[int(i)].as_py(), np.uint64) for i in order]
        keys = keys[order]
        label = link(sets, percent) if len(sets) > 1 else np.zeros(len(sets), np.int64)
        return pa.Table.from_arrays([pa.array(keys), pa.array(keys[label])], schema=LINKS)

    return members.groupBy(*by).applyInArrow(run, from_arrow_schema(LINKS))


def candidates(sets: DataFrame) -> DataFrame:
    """(key, shingle, low): prefix shingles that several sets have, with the smallest of those sets."""
    prefix = sets.select("key", F.explode("prefix").alias("shingle"))
    common = prefix.groupBy("shingle").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("shingle", "low")
    return materialise(prefix.join(common, "shingle"), "candidates")


def in_blocks(members: DataFrame, by: str, percent: int) -> DataFrame:
    """Links (key, root) of the sets of each ``by``: in one task up to ``BLOCK`` shingles, else by pairs of blocks."""
    blocks = members.groupBy(by).agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("parts"))
    dealt = members.join(blocks, by).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    # a block meets itself in its pairs with others
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.col("part").alias("i"), F.col("part").alias("j")))).otherwise(F.filter(others, lambda p: p["i"] != p["j"]))
    return link_groups(dealt.select(by, "key", "shingles", F.explode(pairs).alias("p")).select(by, "p.i", "p.j", "key", "shingles"), [by, "i", "j"], percent)


def link_candidates(documents: DataFrame, sets: DataFrame, shared: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, component) of the candidate sets that link with another one."""
    groups = connected_components(shared.select(F.col("key").alias("u"), F.col("low").alias("v"))).select(F.col("node").alias("key"), F.col("component").alias("group"))
    found = groups.join(sets.select("key", "doc_id", *SET), "key")
    blocks = found.groupBy("group").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks"))
    placed = found.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    placed = materialise(placed, "placed")
    # the texts of a set's smallest doc_id include one with the set; others of that id go by their digests
    members = full_sets(filter_ids(_source(documents), placed.select("doc_id").distinct()), shingle).join(small(placed.drop("doc_id"), BROADCAST_SETS), SET).dropDuplicates(["key"])
    if placed.where("blocks > 1").isEmpty():
        return link_groups(members, ["group"], percent).select("key", F.col("root").alias("component"))
    members = materialise(members, "sets")
    within = materialise(link_groups(members, ["group", "block"], percent), "links")
    large = members.where("blocks > 1")
    roots = large.join(within.where("key = root").select("key"), "key", "left_semi")
    few = roots.groupBy("group").agg(F.sum(F.octet_length("shingles") / 8).alias("size")).where(F.col("size") <= BLOCK).select("group")
    across = materialise(link_groups(roots.join(few, "group", "left_semi"), ["group"], percent), "links")
    joined = across.groupBy("key").agg(F.min("root").alias("root")).join(large.select("key", "group"), "key")
    split = large.join(joined.groupBy("group").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a = b").select("group"), "group", "left_anti")
    rest = in_blocks(split.select("key", "n_shingles", "shingles").join(shared.select("key", "shingle"), "key"), "shingle", percent)
    edges = within.unionByName(across).unionByName(rest)
    return connected_components(edges.select(F.col("key").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("key"), "component")


def join_components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest linked doc_id) of every document."""
    rows = materialise(describe(documents, shingle, percent), "shingles")
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    # equal sets are one from here; the key is written, so that it stays the same when tasks run again
    distinct = rows.where("n_shingles > 0").groupBy(*SET).agg(F.min(real).alias("name"), F.min("doc_id").alias("doc_id"), F.min("prefix").alias("prefix"))
    sets = materialise(distinct.withColumn("key", F.monotonically_increasing_id()), "distinct")
    linked = link_candidates(documents, sets, candidates(sets), shingle, percent)
    named = materialise(sets.join(linked, "key", "left").select(*SET, "name", "component", F.coalesce("component", "key").alias("of")), "named")
    names = named.where("component is not null").groupBy(F.col("component").alias("of")).agg(F.min("name").alias("least"), F.lit(True).alias("known"))
    of_set = named.join(small(names), "of", "left").select(*SET, F.when(F.col("known"), F.col("least")).otherwise(F.col("name")).alias("component_id"))
    doc_id = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    return rows.select("doc_id", *SET).join(of_set, SET, "left").select(doc_id, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(real).alias("component_id"))


def deduplicate(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (one without only if no row has one).

    Rows without words are alone, but those with the same doc_id and the same text are one.
    """
    kept = documents.columns
    rows = numbered(documents, ROW)
    named = join_components(rows.select(F.col(ROW).alias("doc_id"), "text"), shingle, percent).withColumnRenamed("doc_id", ROW)
    # two hashes of a text tell those without words apart; the texts themselves are not joined
    text = F.coalesce("text", F.lit(""))
    told = rows.select(ROW, "doc_id", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    empty = F.when((F.col("n_shingles") == 0) & F.col("doc_id").isNotNull(), F.struct("doc_id", "a", "b"))
    linked = told.join(named, ROW).select(ROW, "doc_id", empty.alias("same"), F.when(empty.isNull(), F.col("component_id")).alias("component"))
    best = linked.groupBy("component", "same").agg(F.min_by(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias(ROW))
    return rows.join(small(materialise(best.select(ROW), "kept")), ROW, "left_semi").select(*kept)
