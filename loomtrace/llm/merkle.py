"""Merkle manifest of a table: a digest for every row, a root for every language, one root for all, and proofs.

Time-forward processing. Nodes carry labels in which every parent comes after its children; a node's digest
is sent to the label of its parent through a priority queue ordered by label, so one pass over ascending
labels makes all digests. The queue has two parts. Spark's shuffle and external sort deliver between blocks
of ``FAN ** SWEEP`` neighbouring nodes of a tree; inside a block a heap delivers between ``SWEEP`` levels. A
task group thus holds one block, whatever the size of a language, and a round leaves one node of a block.
The reversed sweep goes through the labels downwards and hands every node the proof suffix of its parent.

Leaves are placed in their tree by one range sort of the digests, never of the texts.

Defined results of the edge cases: a null field is ``-``; rows with one doc_id (or none, they come first)
follow by leaf digest, and repeated rows are leaves each; a language of one row has its leaf as subroot; a
table of one language has its subroot as root; a null doc_id is never tampered with; an empty table gives no
row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm.storage import materialise, small

#: Children of a node, and levels of one sweep: a block is ``FAN ** SWEEP`` nodes.
FAN = 8
SWEEP = 3
BLOCK = FAN**SWEEP
#: One document in so many is tampered with, by crc32 of its id.
TAMPERED = 3

NODE = "tree long, size long, at long, digest string"
SUFFIX = "tree long, at long, lefts array<string>, rights array<string>, top string, root string"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined(digests: list[str]) -> str:
    """Lower-case hex SHA-256 of digests that are concatenated as text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(size: int) -> int:
    """Levels above ``size`` nodes until one is left."""
    levels = 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def sweep_up(digests: list[str], levels: int) -> list[list[str]]:
    """All digests of a block by level; nodes are made in the order of their labels (level, place)."""
    nodes = [digests, *([] for _ in range(levels))]
    queue = [(1, i // FAN, i, d) for i, d in enumerate(digests)] if levels else []
    while queue:
        level, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        digest = joined(children)
        nodes[level].append(digest)
        if level < levels:
            heapq.heappush(queue, (level + 1, place // FAN, place, digest))
    return nodes


def sweep_down(nodes: list[list[str]], lefts: list[str], rights: list[str]) -> list[tuple[list[str], list[str]]]:
    """For each lowest node of a block, its siblings on the left and on the right by level, up to the root.

    ``lefts`` and ``rights`` are those of the block's top; each level hands its own on, with them as suffix.
    """
    above = [(lefts, rights)]
    for level in reversed(nodes[:-1]):
        below = []
        for place in range(len(level)):
            first = place // FAN * FAN
            up = above[place // FAN]
            below.append((["".join(level[first:place]), *up[0]], ["".join(level[place + 1 : first + FAN]), *up[1]]))
        above = below
    return above


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a digest leads to with these siblings."""
    for left, right in zip(lefts, rights, strict=True):
        digest = joined([left, digest, right])
    return digest


def _block() -> Column:
    return F.floor(F.col("at") / BLOCK).alias("block")


def _levels(block: pa.Table) -> int:
    return min(SWEEP, height(block.column("size")[0].as_py()))


def _up(block: pa.Table) -> pa.Table:
    block = block.sort_by("at")
    nodes = sweep_up(block.column("digest").to_pylist(), _levels(block))
    size, at = block.column("size")[0].as_py(), block.column("at")[0].as_py()
    # a tree of one node is done and passes through
    row = (block.column("tree")[0].as_py(), -(-size // BLOCK), at // BLOCK, nodes[-1][0])
    return pa.table({name: [value] for name, value in zip(("tree", "size", "at", "digest"), row, strict=True)})


def grown(nodes: DataFrame) -> list[DataFrame]:
    """The forest by rounds, from the given nodes to the roots (``NODE``); trees hold at least one node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("size")).first()[0] or 1) > 1:
        raised = rounds[-1].select("tree", "size", "at", "digest", _block()).groupBy("tree", "block").applyInArrow(_up, NODE)
        rounds.append(materialise(raised, "nodes"))
    return rounds


def _paths(block: pa.Table, suffix: pa.Table) -> tuple[pa.Table, list[tuple[list[str], list[str]]]]:
    block = block.sort_by("at")
    nodes = sweep_up(block.column("digest").to_pylist(), _levels(block))
    return block, sweep_down(nodes, suffix.column("lefts")[0].as_py(), suffix.column("rights")[0].as_py())


def _down(block: pa.Table, suffix: pa.Table) -> pa.Table:
    block, paths = _paths(block, suffix)
    text = pa.list_(pa.string())
    return pa.table(
        {
            "tree": block.column("tree"),
            "at": block.column("at"),
            "lefts": pa.array([p[0] for p in paths], text),
            "rights": pa.array([p[1] for p in paths], text),
            "top": [suffix.column("top")[0].as_py()] * len(paths),
            "root": [suffix.column("root")[0].as_py()] * len(paths),
        }
    )


def _prove(block: pa.Table, suffix: pa.Table) -> pa.Table:
    block, paths = _paths(block, suffix)
    leaves = block.column("digest").to_pylist()
    shown = [t or d for t, d in zip(block.column("tampered").to_pylist(), leaves, strict=True)]
    return pa.table(
        {
            "doc_id": block.column("doc_id"),
            "leaf": block.column("digest"),
            "subroot": [suffix.column("top")[0].as_py()] * len(paths),
            "root": [suffix.column("root")[0].as_py()] * len(paths),
            "proof_sha256": [joined([side for level in zip(*p, strict=True) for side in level]) for p in paths],
            "folded_root": [fold(d, *p) for d, p in zip(shown, paths, strict=True)],
        }
    )


def _with_suffixes(nodes: DataFrame, suffixes: DataFrame, function, schema: str) -> DataFrame:
    blocks = nodes.withColumn("block", _block()).groupBy("tree", "block")
    return blocks.cogroup(suffixes.withColumn("block", F.col("at")).groupBy("tree", "block")).applyInArrow(function, schema)


def handed_down(rounds: list[DataFrame], suffixes: DataFrame) -> DataFrame:
    """The suffixes of the first round's blocks, from those of the roots."""
    for nodes in reversed(rounds[1:]):
        suffixes = materialise(_with_suffixes(nodes, suffixes, _down, SUFFIX), "suffixes")
    return suffixes


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their number from 0 in the given order (``place``): one range sort, then the sizes of its partitions."""
    number = F.monotonically_increasing_id()
    # equal rows are dealt over partitions by their number
    apart = rows.withColumn("number", number).repartitionByRange(*order, "number").sortWithinPartitions(*order)
    written = materialise(apart.drop("number").select("*", F.shiftright(number, 33).alias("part"), number.bitwiseAND((1 << 33) - 1).alias("nth")), "placed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return written.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("nth")).drop("part", "nth", "start")


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its UTF-8 byte count, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(documents: DataFrame) -> DataFrame:
    """doc_id, lang, digest of every document, and that of its tampered form where it has one."""
    number, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    head = F.concat(field(number), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars").cast("long")))
    chosen = F.crc32(number.cast("string").cast("binary")) % TAMPERED == 0
    return documents.select(
        number.alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.sha2(F.concat(head, field(text)), 256).alias("digest"),
        F.when(chosen, F.sha2(F.concat(head, field(F.translate(text, _UPPER, _LOWER))), 256)).alias("tampered"),
    )


def manifest(documents: DataFrame) -> DataFrame:
    """Leaf, subroot, root, proof and outcome of the check of every document."""
    hashed = placed(materialise(leaves(documents), "leaves"), F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.col("digest"))
    trees = materialise(hashed.groupBy("lang").agg(F.min("place").alias("tree"), F.count("*").alias("size")), "trees")
    named = small(trees.withColumnRenamed("lang", "of"))
    nodes = hashed.join(named, F.col("lang").eqNullSafe(F.col("of"))).select("tree", "size", (F.col("place") - F.col("tree")).alias("at"), "digest", "doc_id", "tampered")
    rounds = grown(materialise(nodes, "leaf-nodes"))

    # the subroots are the leaves of one more tree, in the order of their languages
    subroots = materialise(placed(rounds[-1].select(F.col("tree").alias("of"), "digest"), F.col("of")), "subroots")
    upper = grown(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(subroots.count()).cast("long").alias("size"), F.col("place").alias("at"), "digest"))
    none = F.array().cast("array<string>")
    last = handed_down(upper, upper[-1].select("tree", "at", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("top"), F.col("digest").alias("root")))
    # blocks of the upper tree's leaves give each subroot its suffix
    shown = _with_suffixes(upper[0], last, _down, SUFFIX).withColumnRenamed("at", "place").drop("tree", "top")
    roots = subroots.join(shown, "place").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("at"), "lefts", "rights", F.col("digest").alias("top"), "root")
    proved = _with_suffixes(rounds[0], handed_down(rounds, materialise(roots, "roots")), _prove, PROVED)
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))
