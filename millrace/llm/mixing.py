"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks. With weight w, block k (from 0) of a source may run from slot floor(k / w)
and must run before slot ceil((k + 1) / w); earliest-deadline-first over these windows keeps every source less than one
block away from its share after every slot. Weights are whole multiples of 2 ** -52, as exact as the numbers given, so
the schedule does not repeat: the driver simulates all slots (one for each block of rows) and the plan holds sixteen
bytes for each. Blocks have 32 rows, and more where a table would have more than 4 million blocks, so driver and plan
are bounded. When a source runs out, the rest goes on with its weights scaled up; every row is placed.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from .ranks import spread_rank
from .storage import Table

DENOMINATOR = 1 << 52
CHUNK = 1024
BLOCK_ROWS = 32
MAX_BLOCKS = 1 << 22
PLAN = T.StructType([T.StructField("p_source", T.StringType()), T.StructField("p_chunk", T.LongType()), *[T.StructField(n, T.ArrayType(T.LongType())) for n in ("p_slots", "p_starts")]])


def whole_shares(weights: dict, period: int) -> dict:
    """Weights as whole numbers, at least 1, that sum to ``period`` (largest remainder)."""
    total = math.fsum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    share = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (share[s] - exact[s], str(s)))
    while (gap := period - sum(share.values())) != 0:
        if gap > 0:
            for s in order[:gap]:
                share[s] += 1
        else:
            for s in sorted((s for s in share if share[s] > 1), key=lambda s: (exact[s] - share[s], str(s)))[:-gap]:
                share[s] -= 1
    return share


def schedule(share: dict) -> Iterator:
    """The source of each slot, without end, by earliest deadline among released blocks."""
    period = sum(share.values())
    names = sorted(share, key=str)
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list = []  # deadline, source, block
    for t in itertools.count():
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // share[names[i]]), i, k))
        deadline, i, k = heapq.heappop(ready)
        if deadline <= t:
            raise ArithmeticError("a block missed its deadline")
        yield names[i]
        heapq.heappush(waiting, ((k + 1) * period // share[names[i]], i, k + 1))


def one_period(share: dict) -> dict:
    """Slots of each source's blocks in one period."""
    slots: dict = {s: [] for s in share}
    for t, s in enumerate(itertools.islice(schedule(share), sum(share.values()))):
        slots[s].append(t)
    return slots


def plan(rows: dict, weights: dict, block_rows: int, chunk: int) -> list[tuple]:
    """Source, chunk number, slots and first positions of its blocks, up to ``chunk`` blocks in one tuple.

    A phase ends with the last block of one source; the others go on with their weights scaled up.
    """
    left = {s: -(-n // block_rows) for s, n in rows.items() if n}
    slots = {s: array("q") for s in left}
    starts = {s: array("q") for s in left}
    slot = missing = 0
    while left:
        for s in schedule(whole_shares({s: weights[s] for s in left}, DENOMINATOR)):
            slots[s].append(slot)
            starts[s].append(slot * block_rows - missing)
            slot += 1
            left[s] -= 1
            if not left[s]:
                missing += -rows[s] % block_rows
                del left[s]
                break
    return [(s, k // chunk, slots[s][k : k + chunk], starts[s][k : k + chunk]) for s in slots for k in range(0, len(slots[s]), chunk)]


def mix_sources(
    df: DataFrame,
    weights: dict | None = None,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    temperature: float = 0.5,
    block_rows: int | None = None,
    carry: tuple[str, ...] = (),
    bucket_rows: int = 4096,
) -> DataFrame:
    """Every row with its place in the mixture: doc_id, source, block, slot, place, position (gapless from 0).

    ``weights`` maps sources to positive numbers; left out, a source weighs rows ** temperature. A null source is a
    source of its own and null ids rank like other values; equal rows get places of their own, in any order. Rows of one
    id and source, if they are more than a range holds, are written with a number and spread by it. An empty table gives
    an empty result. ``carry`` columns come along unchanged. ``block_rows``, left out, is 32, or more if the table would have over 4 million blocks.
    """
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.groupBy(F.col(source_col).cast("string").alias("s")).count().collect()}
    if weights is None:
        weights = {s: n**temperature for s, n in counts.items()}
    if missing := [s for s in counts if not weights.get(s, 0) > 0]:
        raise ValueError(f"sources without a positive weight: {missing[:5]}")
    block_rows = block_rows or max(BLOCK_ROWS, math.ceil(sum(counts.values()) / MAX_BLOCKS))
    places = spark.createDataFrame([(s, c, list(x), list(y)) for s, c, x, y in plan(counts, weights, block_rows, CHUNK)], PLAN)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.lit(6), F.col(id_col)).alias("__hash"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    hot = rows.groupBy(F.col("source").alias("__s"), F.col("doc_id").alias("__i")).agg(F.count(F.lit(1)).alias("__many")).where(F.col("__many") > bucket_rows)
    if hot.head(1):
        # Row numbers hold for a written table only; the other side has one row per hot id, so the join can be split.
        rows = Table(spark, rows.withColumn("__row", F.monotonically_increasing_id()), "mixture").df
        rows = rows.join(hot, F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__i")), "left")
        rows = rows.withColumn("__hash", F.when(F.col("__many").isNull(), F.col("__hash")).otherwise(F.xxhash64(F.lit(6), "doc_id", "__row"))).drop("__s", "__i", "__many")
    ranked = spread_rank(rows, ["source"], "__hash", ["doc_id"], max(1, math.ceil(max(counts.values(), default=0) / bucket_rows)), "__rank")
    ranked = ranked.withColumn("block", F.floor(F.col("__rank") / block_rows)).withColumn("place", F.col("__rank") % block_rows)
    # At most MAX_BLOCKS blocks of sixteen bytes, and a row for each source.
    placed = ranked.join(F.broadcast(places), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("p_chunk") == F.floor(F.col("block") / CHUNK)))
    at = (F.col("block") % CHUNK).cast("int")
    columns = [F.col("p_slots")[at].alias("slot"), "place", (F.col("p_starts")[at] + F.col("place")).alias("position")]
    return placed.select("doc_id", "source", "block", *columns, *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)])
