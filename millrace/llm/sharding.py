"""Sharding by balanced label propagation, in DataFrame operations only (after Ugander and Backstrom, 2013).

Documents start on shards by a hash. In every round each group of linked documents counts its members by shard (one row
for each group, however large), and its members ask to move to the shard where most of them are. How many may move
between two shards is settled on a matrix of shards by shards: opposite wishes are swapped, the rest is granted as far as
the capacity reaches. A last pass evens the counts out exactly, taking unlinked documents first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import spread_rank
from .storage import Table

BUCKET_ROWS = 4096


def grants(wishes: list[list[int]], sizes: list[int], capacity: float) -> list[list[int]]:
    """How many of the wished moves from shard a to shard b are granted so that no shard exceeds ``capacity``."""
    n = len(sizes)
    granted = [[min(wishes[a][b], wishes[b][a]) if a != b else 0 for b in range(n)] for a in range(n)]
    size = list(sizes)
    moved = True
    while moved:
        moved = False
        # Shards with the most room take first, from the fullest shards.
        for b in sorted(range(n), key=lambda s: (size[s], s)):
            for a in sorted((s for s in range(n) if s != b), key=lambda s: (-size[s], s)):
                more = min(wishes[a][b] - granted[a][b], math.floor(capacity) - size[b])
                if more > 0:
                    granted[a][b] += more
                    size[a] -= more
                    size[b] += more
                    moved = True
    return granted


def _chance(*columns) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _table(values: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), key + 1)


def propagate(rows: DataFrame, shards: int, rounds: int = 8, start: Column | None = None) -> Table:
    """Table of ``rows`` (with columns row and hub; a null hub has no links) plus shard and linked (size of the group).

    Rows begin on shard ``start``, left out a hash of the row. Linked rows alone are counted against the capacity here:
    unlinked ones make room when counts are evened out.
    """
    spark = rows.sparkSession
    groups = Table(spark, rows.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("linked")).where("linked > 1"), "groups")
    start = (F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(shards)) if start is None else start).cast("int")
    # Null hubs meet no group; the group side has one row per hub, so a hot hub can be split over tasks.
    state = Table(spark, rows.join(groups.df, "hub", "left").select(*rows.columns, start.alias("shard"), F.coalesce("linked", F.lit(1)).alias("linked")), "shards")
    groups.drop()
    capacity = max(1, state.df.count() // shards)
    big = F.col("linked") > max(2, capacity // 64)
    for turn in range(rounds):
        linked = state.df.where("linked > 1")
        counts = [F.sum((F.col("shard") == s).cast("long")).alias(f"c{s}") for s in range(shards)]
        votes = linked.groupBy("hub").agg(*counts)
        sizes = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}
        sizes = [sizes.get(s, 0) for s in range(shards)]
        full = [n >= capacity for n in sizes]
        # Ties go to the shard that a hash of the group prefers, so that all members want the same.
        order = [F.struct(F.col(f"c{s}").alias("n"), F.xxhash64(F.lit(s), "hub").alias("h"), F.lit(s).alias("s")) for s in range(shards)]
        room = [x for x, f in zip(order, full, strict=True) if not f]
        second = F.greatest(*room)["s"] if len(room) > 1 else room[0]["s"] if room else F.lit(None).cast("int")
        wanted = Table(spark, votes.select("hub", F.greatest(*order)["s"].alias("first"), second.alias("second")), "wanted")
        wish = F.when(F.col("shard") == F.col("first"), F.col("shard")).when(_table(full, F.col("first")), F.coalesce("second", "shard")).otherwise(F.col("first"))
        # Small groups move as one; members of large ones are drawn singly, as quotas may split those.
        draw = F.when(big, _chance(F.lit(turn), F.col("row"))).otherwise(_chance(F.lit(turn), F.col("hub")))
        asked = state.df.join(wanted.df, "hub", "left").withColumn("wish", F.coalesce(wish, F.col("shard"))).withColumn("big", big).withColumn("draw", draw).drop("first", "second")
        wishing = Table(spark, asked, "wishes")
        wanted.drop()
        cells = {(r["big"], r["shard"], r["wish"]): r["count"] for r in wishing.df.where("wish <> shard").groupBy("big", "shard", "wish").count().collect()}
        share, any_move = [], False
        for kind in (False, True):
            wishes = [[cells.get((kind, a, b), 0) for b in range(shards)] for a in range(shards)]
            granted = grants(wishes, sizes, capacity)
            share += [granted[a][b] / wishes[a][b] if wishes[a][b] else 0.0 for a in range(shards) for b in range(shards)]
            any_move = any_move or any(map(any, granted))
            sizes = [sizes[s] - sum(granted[s]) + sum(g[s] for g in granted) for s in range(shards)]
        if not any_move:
            wishing.drop()
            break
        goes = F.col("draw") < _table(share, F.col("big").cast("int") * shards * shards + F.col("shard") * shards + F.col("wish"))
        after = Table(spark, wishing.df.withColumn("shard", F.when(goes, F.col("wish")).otherwise(F.col("shard"))).drop("wish", "draw", "big"), "shards")
        wishing.drop()
        state.drop()
        state = after
    return state


def even_out(state: DataFrame, shards: int) -> DataFrame:
    """Move as few rows as possible so that shard counts differ by one at most."""
    found = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
    sizes = [found.get(s, 0) for s in range(shards)]
    total = sum(sizes)
    fullest = sorted(range(shards), key=lambda s: (-sizes[s], s))
    goal = [total // shards + (fullest.index(s) < total % shards) for s in range(shards)]
    excess = [max(0, sizes[s] - goal[s]) for s in range(shards)]
    lacking = [max(0, goal[s] - sizes[s]) for s in range(shards)]
    if not any(excess):
        return state
    # Unlinked rows rank first, then small groups one after the other, then rows of large groups.
    tier = F.when(F.col("linked") == 1, 0).when(F.col("linked") <= BUCKET_ROWS // 4, 1).otherwise(2).cast("long")
    spread = F.when(F.col("linked") <= BUCKET_ROWS // 4, F.xxhash64("hub")).otherwise(F.xxhash64("row"))
    spread = F.when(F.col("linked") == 1, F.xxhash64("row")).otherwise(spread)
    keyed = state.withColumn("order", F.shiftleft(tier, 61).bitwiseOR(F.shiftrightunsigned(spread, 3)))
    ranked = spread_rank(keyed, ["shard"], "order", ["row"], 4 * max(1, math.ceil(max(sizes) / BUCKET_ROWS)), "rank")
    before = [sum(excess[:s]) for s in range(shards)]
    place = F.col("rank") + _table(before, F.col("shard"))
    # The rows that move, numbered through, fill the lacking places shard by shard.
    target = F.lit(None).cast("int")
    for s in reversed(range(shards)):
        if lacking[s]:
            target = F.when(place < sum(lacking[: s + 1]), F.lit(s)).otherwise(target)
    goes = F.col("rank") < _table(excess, F.col("shard"))
    return ranked.withColumn("shard", F.when(goes, target).otherwise(F.col("shard"))).drop("rank", "order")


def shard_documents(df: DataFrame, shards: int = 8, rounds: int = 8, *, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ("rows"), shard, slot, grown_shard, linked, and ``carry``.

    Shard counts differ by one at most; slots number the rows of a shard from 0. Documents of equal text are linked and
    stay together as far as that allows. A null text has size 1, the checksum of an empty text and no links; empty texts
    are linked like others; null and repeated ids are rows of their own. An empty table gives an empty result. Other
    columns are only read if ``carry`` names them.

    With ``order_col`` (distinct longs, gapless from 0) rows are dealt to the shards in turn by that number and slots
    follow it, so each shard read by slot is a sample of the whole order at even distances, but for rows that links or
    the evening out move.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select((F.col(order_col).cast("long") if order_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("hub"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    base = Table(spark, source, "shard-rows")
    state = propagate(base.df.select("row", "doc_id", "size", "text_crc32", "hub"), shards, rounds, F.pmod("row", F.lit(shards)) if order_col else None)
    even = Table(spark, even_out(state.df, shards), "shards")
    state.drop()
    total = even.df.count()
    buckets = max(1, math.ceil(total / shards / BUCKET_ROWS))
    if order_col:
        # Row numbers stretched over the positive longs keep their order; those are half of the ranges.
        order, buckets = F.col("row") * F.lit(((1 << 63) - 1) // max(1, total)), 2 * buckets
    else:
        # The hash of a row number is one to one, so slots have no ties.
        order = F.xxhash64(F.lit(7), "row")
    slots = spread_rank(even.df.withColumn("order", order), ["shard"], "order", ["row"], buckets, "slot")
    if carry:
        slots = slots.join(base.df.select("row", *[f"__c{i}" for i in range(len(carry))]), "row")
    law = [F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked"]
    return slots.select("doc_id", "size", "text_crc32", *law, *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)])
