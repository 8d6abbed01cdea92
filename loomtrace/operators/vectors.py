"""Nearest vectors by cosine: a query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of either side.
BLOCK = 2048
_ROWS = "query_id long, vec_id long, label int, cosine double"


def _blocks(vectors: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    """Rows of about ``BLOCK`` vectors each, as parallel arrays."""
    n = max(1, -(-vectors.count() // BLOCK))
    dealt = vectors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return dealt.select(*(F.col(f"rows.{c}").alias(f"{prefix}_{c}") for c in columns))


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, label, cosine, rank): the ``k`` vectors nearest to each query, itself left out; ties by vec_id.

    ``vectors`` has (vec_id, label, embedding), ``queries`` is a part of it. Every pair of blocks is one
    matrix product that leaves ``k`` rows a query, so what is shuffled grows with queries times blocks.
    Vectors of length 0 are near nothing.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_id, q, v_id, label, v = (batch.column(i)[row] for i in range(5))
                q_id, v_id, label = np.array(q_id.as_py(), np.int64), np.array(v_id.as_py(), np.int64), label.as_py()
                q, v = (np.array(x.as_py(), np.float64) for x in (q, v))
                with np.errstate(invalid="ignore", divide="ignore"):
                    q, v = q / np.linalg.norm(q, axis=1, keepdims=True), v / np.linalg.norm(v, axis=1, keepdims=True)
                cosine = np.round(q @ v.T, 5)
                cosine[np.isnan(cosine) | (q_id[:, None] == v_id[None, :])] = -2
                out = []
                for i in range(len(q_id)):
                    best = np.lexsort((v_id, -cosine[i]))[:k]
                    out += [(int(q_id[i]), int(v_id[j]), label[j], float(cosine[i, j])) for j in best if cosine[i, j] > -2]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "label": pa.array([o[2] for o in out], pa.int32()), "cosine": pa.array([o[3] for o in out], pa.float64())})

    left = _blocks(queries, "q", ["vec_id", "embedding"])
    right = _blocks(vectors.withColumn("label", F.col("label").cast("int")), "v", ["vec_id", "label", "embedding"])
    found = right.crossJoin(left).select("q_vec_id", "q_embedding", "v_vec_id", "v_label", "v_embedding").mapInArrow(products, _ROWS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
