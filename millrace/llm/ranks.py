"""Exact row numbers over large groups without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def spread_rank(df: DataFrame, group: list[str], hash_col: str, ties: list[str], buckets: int, out: str) -> DataFrame:
    """Add ``out``: the 0-based rank of each row in its group, ordered by ``hash_col`` (a well-spread long), then ``ties``.

    A group is cut into ``buckets`` ranges of the hash; ranks are taken inside a range and shifted by the sizes of
    the ranges before it. So a group of any size costs as many tasks as it has ranges.
    """
    # 2**62 values: a positive long holds the width even of a single range.
    width = (1 << 62) // buckets + 1
    cut = df.withColumn("__bucket", F.floor(F.shiftrightunsigned(F.col(hash_col), 2) / F.lit(width)).cast("int"))
    cell = [*group, "__bucket"]
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(c).alias(f"__r_{c}") for c in cell], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*cell).orderBy(hash_col, *ties)) - 1
    ranked = cut.withColumn("__place", place.cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cell]
    joined = ranked.join(starts, same)
    return joined.withColumn(out, F.col("__start") + F.col("__place")).drop("__bucket", "__place", "__start", *[f"__r_{c}" for c in cell])
