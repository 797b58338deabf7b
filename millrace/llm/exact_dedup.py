"""Exact duplicates by a tree-merge of sorted digest runs.

Every scan partition turns its texts into sorted runs of (digest, best row, count), already reduced to distinct
digests. Runs then meet in binomial rounds: in round r the runs whose numbers agree after dropping the lowest
``fan_in ** r`` digits are merged, multiway, until one run is left. Digest ranges ("lanes") keep each merge small:
a lane holds a bounded share of the digests, whatever the input size, and a group of copies of any size is one
entry per run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .storage import Table, shuffle_width

#: The characters that do not count: space, tab, newline, vertical tab, form feed, carriage return.
WHITESPACE = " \t\n\x0b\f\r"
LARGEST = np.iinfo(np.int64).max
RUN_ROWS = 100_000


def _reduce(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs that lie back to back; of equal digests give the place of the best row and the sum of counts."""
    digest = np.array([d.ljust(32) for d in table["digest"].to_pylist()], dtype="V32").view("S32")
    # A stable sort of concatenated sorted runs is a multiway merge: timsort finds the runs and gallops through them.
    missing = table["best_id"].is_null().to_numpy()
    ids = np.where(missing, LARGEST, table["best_id"].fill_null(0).to_numpy())
    length, row = table["best_length"].to_numpy(), table["best_row"].to_numpy()
    order = np.argsort(digest, kind="stable")
    same = digest[order][1:] == digest[order][:-1]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    for name in ("check_length", "check_hash"):
        value = table[name].to_numpy()[order]
        if (value[1:][same] != value[:-1][same]).any():
            raise ValueError("two different texts share a SHA-256 digest")
    ranked = np.lexsort((row[order], ids[order], missing[order], -length[order], group))
    head = np.searchsorted(group[ranked], np.arange(group[-1] + 1 if len(group) else 0))
    best = order[ranked[head]]
    copies = np.bincount(group, weights=None if table.num_rows == 0 else table["copies"].to_numpy()[order]).astype(np.int64)
    return best, copies


def _merged(table: pa.Table, run: int) -> pa.Table:
    best, copies = _reduce(table)
    out = table.take(pa.array(best)).combine_chunks()
    out = out.set_column(out.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int64()))
    return out.set_column(out.schema.get_field_index("run"), "run", pa.array(np.full(len(out), run), pa.int64()))


def digest_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, WHITESPACE, "")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_points"), bare.alias("bare")).select(
        "doc_id",
        "n_points",
        F.unhex(F.sha2("bare", 256)).alias("digest"),
        F.octet_length("bare").cast("long").alias("check_length"),
        F.xxhash64("bare").alias("check_hash"),
        F.monotonically_increasing_id().alias("row"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8, lane_rows: int = 200_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree without whitespace; null counts as empty, and empty texts form a group of their own.
    The longest original (code points), then the smallest id stays; a null id ranks after all others, and of wholly
    repeated rows exactly one is kept. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    base = Table(spark, digest_table(df, id_col, text_col), "digests")
    lanes = max(shuffle_width(spark), math.ceil(base.df.count() / lane_rows))
    lane = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(lanes)).cast("int")
    rows = base.df.select(lane.alias("lane"), F.lit(0).cast("long").alias("run"), "digest", "check_length", "check_hash", F.col("n_points").alias("best_length"), F.col("doc_id").alias("best_id"), F.col("row").alias("best_row"), F.lit(1).cast("long").alias("copies"))
    schema = rows.schema

    def first_run(batches):
        # A partition of many rows gives several sorted runs of its number, each of bounded size.
        number, part, rows = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            part, rows = [*part, batch] if batch.num_rows else part, rows + batch.num_rows
            if rows >= RUN_ROWS:
                yield from _merged(pa.Table.from_batches(part), number).to_batches(max_chunksize=10_000)
                part, rows = [], 0
        if part:
            yield from _merged(pa.Table.from_batches(part), number).to_batches(max_chunksize=10_000)

    def merge(key, table):
        return _merged(table, key[1].as_py())

    # The first round also meets the runs of one partition, so there is one at least.
    runs, left = rows.mapInArrow(first_run, schema), max(2, rows.rdd.getNumPartitions())
    while left > 1:
        runs = runs.groupBy("lane", F.floor(F.col("run") / fan_in).alias("next")).applyInArrow(merge, schema)
        left = math.ceil(left / fan_in)
    groups = runs.select("digest", F.col("best_id").alias("keep_id"), "best_row", F.col("copies").alias("group_size"))
    # The digest side may hold one hot digest; the group side has one row per digest, so adaptive execution can split the join.
    return base.df.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("best_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
