"""Corpus totals of hashed keys, returned to the blocks of documents that hold them.

A block sends every distinct key once, with its counts, cut at the borders of equal ranges of the hash
(shards). A shard adds up what its blocks sent and answers each of them with the totals of exactly the
keys it sent. However often a block has a key it sends it once, so no key is hot.

Messages are blocks times shards. Beyond ``FAN`` blocks, ``FAN`` of them at a time are merged: in each
shard the group speaks as one block, whose keys are cut into finer shards, and so on upwards; the sums
come back the same way. Messages then grow with the keys (times the levels, one for each factor of
``FAN``), and a task holds one shard of one group at any size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import kernels as K
from loomtrace.llm.storage import materialise

#: Blocks that exchange directly, and blocks whose keys make up a shard.
FAN = 1024
SHARE = 4

MESSAGE = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("width", pa.int32()), ("counts", pa.binary()), ("also", pa.binary())])
#: Rows of block -1 carry the totals of a shard's even keys: their counts, their second counts, and how many have a count.
ANSWER = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("counts", pa.binary()), ("also", pa.binary()), ("total", pa.int64()), ("total_also", pa.int64()), ("types", pa.int64())])


def narrow(values: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest, behind one byte that names the width."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def widen(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


def shards_of(blocks: int) -> int:
    """Shards that so many blocks cut their keys into."""
    return max(4, min(blocks, FAN) // SHARE)


def messages(block: int, keys: np.ndarray, counts: np.ndarray, also: np.ndarray | None, shards: int, bits: int) -> pa.Table:
    """What a block sends: its ascending distinct keys by shard (``MESSAGE``)."""
    shard = K.shard_of(keys, bits, shards)
    cut = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(np.diff(shard)) + 1, [len(keys)]])
    rows = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b > a:
            rows.append((block, int(shard[a]), *K.squeeze(keys[a:b]), narrow(counts[a:b]), None if also is None else narrow(also[a:b])))
    return table(rows, MESSAGE)


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


class Merged:
    """The messages of one shard: distinct keys with their summed counts, and where each message's keys are."""

    def __init__(self, sent: pa.Table):
        self.blocks = sent.column("block").to_pylist()
        self.shards = sent.column("shard").to_pylist()
        parts = [K.unsqueeze(k, w) for k, w in zip(sent.column("keys").to_pylist(), sent.column("width").to_pylist(), strict=True)]
        sizes = [len(p) for p in parts]
        self.ends = np.cumsum(sizes)
        joined = np.concatenate(parts)
        del parts  # as much again as the joined keys
        self.keys, self.where = np.unique(joined, return_inverse=True)
        del joined
        self.counts = self._added([widen(c) for c in sent.column("counts").to_pylist()])
        second = sent.column("also").to_pylist()
        self.asks = [a is not None for a in second]
        self.also = self._added([np.zeros(n, np.uint8) if a is None else widen(a) for a, n in zip(second, sizes, strict=True)]) if any(self.asks) else None

    def _added(self, parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(self.keys), np.int64)
        for end, part in zip(self.ends.tolist(), parts, strict=True):
            out[self.where[end - len(part) : end]] += part  # a block has a key once
        return out

    def answers(self, counts: np.ndarray, also: np.ndarray | None) -> list[tuple]:
        """Every block's own part of the sums (rows of ``ANSWER``)."""
        rows, at = [], 0
        for block, shard, end, asks in zip(self.blocks, self.shards, self.ends.tolist(), self.asks, strict=True):
            own = self.where[at:end]
            rows.append((block, shard, narrow(counts[own]), narrow(also[own]) if asks else None, None, None, None))
            at = end
        return rows


def totals(asked: DataFrame, blocks: int, shards: int, bits: int = 64, most: int | None = None) -> DataFrame:
    """Answers to all messages of blocks 0..``blocks``-1, not told apart above ``most`` (``ANSWER``)."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def capped(counts: np.ndarray) -> np.ndarray:
        return counts if most is None else np.minimum(counts, most)

    def answer(sent: pa.Table) -> pa.Table:
        all_of = Merged(sent)
        even = (all_of.keys & np.uint64(1)) == 0
        gone = 0 if all_of.also is None else int(all_of.also[even].sum())
        rows = all_of.answers(capped(all_of.counts), all_of.also)
        rows.append((-1, all_of.shards[0], None, None, int(all_of.counts[even].sum()), gone, int((all_of.counts[even] > 0).sum())))
        return table(rows, ANSWER)

    if blocks <= FAN:
        return asked.groupBy("shard").applyInArrow(answer, from_arrow_schema(ANSWER))

    groups = -(-blocks // FAN)
    factor = min(groups, FAN)

    def speak(key: tuple, sent: pa.Table) -> pa.Table:
        all_of = Merged(sent)
        return messages(key[0].as_py(), all_of.keys, capped(all_of.counts), all_of.also, shards * factor, bits)

    def pass_on(sent: pa.Table, above: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return ANSWER.empty_table()
        above = above.sort_by("shard")
        second = above.column("also").to_pylist()
        counts = np.concatenate([widen(c) for c in above.column("counts").to_pylist()])
        also = np.concatenate([widen(a) for a in second]) if second[0] is not None else None
        return table(Merged(sent).answers(counts, also), ANSWER)

    named = materialise(asked, "asked").withColumn("group", F.floor(F.col("block") / FAN))
    merged = named.groupBy("group", "shard").applyInArrow(speak, from_arrow_schema(MESSAGE))
    above = materialise(totals(merged, groups, shards * factor, bits, most), "totals")
    down = above.where("block >= 0").withColumns({"group": F.col("block"), "coarse": F.floor(F.col("shard") / factor)})
    back = named.groupBy("group", "shard").cogroup(down.groupBy("group", "coarse")).applyInArrow(pass_on, from_arrow_schema(ANSWER))
    return back.unionByName(above.where("block < 0"))


def told(answer: pa.Table, column: str) -> np.ndarray:
    """A block's answers in the order of its keys."""
    return np.concatenate([widen(c) for c in answer.sort_by("shard").column(column).to_pylist()])
