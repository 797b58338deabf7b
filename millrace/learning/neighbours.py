"""Exact nearest neighbours of a query set among all rows.

Queries go to the tasks in blocks of 8 MB, their best rows counted in; every task of the searched side keeps the k best of its rows for each
query, so at most k rows per query and task are shuffled. More queries mean more blocks, one scan each.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

QUERY_BYTES = 8 << 20


def _array(features, alias: str):
    made = F.array(*[F.col(c).cast("double") for c in features]) if isinstance(features, list) else F.transform(features, lambda x: x.cast("double"))
    return made.alias(alias)


def _scan(queries: np.ndarray, ids: np.ndarray, k: int, step: int = 1024):
    def run(batches):
        best_d = np.full((len(ids), k), np.inf)
        best_i = np.zeros((len(ids), k), np.int64)
        best_c = np.zeros((len(ids), k))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                key, carried = part.column("key").to_numpy(), part.column("carried").to_numpy(zero_copy_only=False)
                for q in range(0, len(ids), 256):
                    rows = slice(q, q + 256)
                    d = ((queries[rows, None, :] - x[None, :, :]) ** 2).sum(axis=2)
                    all_d = np.hstack([best_d[rows], d])
                    all_i = np.hstack([best_i[rows], np.broadcast_to(key, d.shape)])
                    all_c = np.hstack([best_c[rows], np.broadcast_to(carried, d.shape)])
                    pick = np.lexsort((all_i, all_d), axis=1)[:, :k]
                    best_d[rows], best_i[rows], best_c[rows] = (np.take_along_axis(m, pick, 1) for m in (all_d, all_i, all_c))
        full = np.isfinite(best_d)
        at, _ = np.nonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best_i[full]), pa.array(best_d[full]), pa.array(best_c[full])], names=["query", "neighbour", "d2", "carried"])

    return run


def nearest(queries: DataFrame, rows: DataFrame, features, key: str, k: int, carry: str | None = None, exclude_self: bool = False) -> DataFrame:
    """query, rank (from 1), neighbour, d2 (squared distance), carried; ties go to the smaller key."""
    spare = k + exclude_self
    side = rows.select(F.col(key).cast("long").alias("key"), _array(features, "x"), (F.col(carry).cast("double") if carry else F.lit(0.0)).alias("carried"))
    asked = queries.select(F.col(key).cast("long").alias("key"), _array(features, "x"))
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    blocks = -(-n * 8 * ((width or 0) + 2 + 2 * spare) // QUERY_BYTES)
    parts = []
    for b in range(max(1, blocks)):
        block = asked if blocks <= 1 else asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b)
        got = block.toPandas()
        if len(got):
            parts.append(side.mapInArrow(_scan(np.stack(got["x"].to_numpy()), got["key"].to_numpy(), spare), "query long, neighbour long, d2 double, carried double"))
    if not parts:
        return side.select(F.col("key").alias("query"), F.lit(1).alias("rank"), F.col("key").alias("neighbour"), F.lit(0.0).alias("d2"), "carried").limit(0)
    found = reduce(DataFrame.union, parts)
    if exclude_self:
        found = found.where("query <> neighbour")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d2", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "neighbour", "d2", "carried")
