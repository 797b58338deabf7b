"""Labelled tables: positions, selection, cleaning, grouping, profiles and correlation."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations_with_replacement
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from millrace.operators.quantiles import quantiles
from millrace.storage import Table, shuffle_width

RANGE_ROWS = 1_000_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _ordered(keys: list[str]) -> list[Column]:
    return [F.col(k).asc_nulls_last() for k in keys]


def with_position(df: DataFrame, order_by: list[str], name: str = "_pos", buckets: int | None = None) -> DataFrame:
    """0-based position in the order of ``order_by`` (nulls last), without sorting in one task.

    The rows are sorted in ranges of the whole key, about one for a million rows, and written once with their number in
    the range; a position is that number plus the sizes of the ranges before. ``order_by`` should be a total key.
    """
    spark = df.sparkSession
    n = buckets or max(shuffle_width(spark), math.ceil(df.count() / RANGE_ROWS))
    ranged = df.repartitionByRange(n, *_ordered(order_by)).sortWithinPartitions(*_ordered(order_by))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = Table(spark, ranged.select("*", F.spark_partition_id().alias("__part"), inside.alias("__inside")), "positions").df
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    starts = rows.groupBy(F.col("__part").alias("__r")).agg(F.count(F.lit(1)).alias("__n")).select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = rows.join(F.broadcast(starts), F.col("__part") == F.col("__r"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__start") + F.col("__inside")).alias(name))


def columns(df: DataFrame) -> DataFrame:
    """The column names with their places."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "place long, name string")


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def shape_frame(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def head(df: DataFrame, k: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*_ordered(order_by)).limit(k)


def tail(df: DataFrame, k: int, order_by: list[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).desc_nulls_first() for c in order_by]).limit(k)


def column(df: DataFrame, name: str) -> DataFrame:
    return df.select(name)


def loc(df: DataFrame, label, index: str = "_index") -> DataFrame:
    return df.where(F.col(index) == F.lit(label))


def loc_between(df: DataFrame, low, high, columns: list[str] | None = None, index: str = "_index") -> DataFrame:
    """Both ends included."""
    rows = df.where(F.col(index).between(low, high))
    return rows.select(*columns) if columns else rows


def where(df: DataFrame, predicate: str) -> DataFrame:
    return df.where(F.expr(predicate))


def iloc(df: DataFrame, start: int, stop: int | None = None, columns: list[int] | None = None, pos: str = "_pos") -> DataFrame:
    """Row ``start``, or rows start..stop-1."""
    rows = df.where(F.col(pos) == start) if stop is None else df.where((F.col(pos) >= start) & (F.col(pos) < stop))
    return rows.select(*[df.columns[i] for i in columns]) if columns else rows


def cell(df: DataFrame, name: str, position: int, pos: str = "_pos") -> DataFrame:
    return df.where(F.col(pos) == position).select(name)


def drop(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep_first_by: str | None = None) -> DataFrame:
    """Distinct rows; with ``keep_first_by`` the row of a group that is least by that column."""
    if keep_first_by is None:
        return df.dropDuplicates(subset) if subset else df.dropDuplicates()
    keys = subset or [c for c in df.columns if c != keep_first_by]
    rest = [c for c in df.columns if c not in keys and c != keep_first_by]
    first = F.min(F.struct(keep_first_by, *rest)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*keys, "__first.*").select(*df.columns)


def dropna(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def fillna(df: DataFrame, value) -> DataFrame:
    """Null and NaN become ``value`` in the columns of its type."""
    return df.na.fill(value)


def sort_values(df: DataFrame, by: str | list[str], ties: list[str] | None = None) -> DataFrame:
    keys = [by] if isinstance(by, str) else by
    return df.orderBy(*_ordered([*keys, *(ties or [])]))


STATISTICS = {
    "count": F.count,
    "sum": F.sum,
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
}


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two results with one row per group side by side; null groups are equal."""
    named = right.withColumnsRenamed({c: f"__by{i}" for i, c in enumerate(by)})
    if not by:
        return left.withColumn("__one", F.lit(1)).join(F.broadcast(named.withColumn("__two", F.lit(1))), F.col("__one") == F.col("__two")).drop("__one", "__two")
    same = reduce(and_, [left[c].eqNullSafe(named[f"__by{i}"]) for i, c in enumerate(by)])
    return left.join(named, same).drop(*[f"__by{i}" for i in range(len(by))])


def groupby(df: DataFrame, by: str | list[str], values: list[str], statistics: tuple[str, ...] = ("count", "sum", "mean", "min", "max", "std")) -> DataFrame:
    """Statistics of columns by group; the median is exact."""
    keys = [by] if isinstance(by, str) else list(by)
    out = df.groupBy(*keys).agg(*[STATISTICS[s](F.col(v)).alias(f"{v}_{s}") for v in values for s in statistics if s != "median"], F.count(F.lit(1)).alias("__rows"))
    if "median" in statistics:
        out = _beside(out, quantiles(df, {f"__m_{v}": F.col(v) for v in values}, [0.5], keys), keys)
        out = out.withColumns({f"{v}_median": F.col(f"__m_{v}")[0] for v in values})
    return out.select(*keys, *[f"{v}_{s}" for v in values for s in statistics])


def _moments(name: str) -> list[Column]:
    c = F.col(name).cast("double")
    return [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]


def _profile(moments: Column, quartiles: Column) -> list[Column]:
    return [*[moments[n].alias(n) for n in ("count", "mean", "std", "min")], *[quartiles[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))], moments["max"].alias("max")]


def describe(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """One row per column (and group): count, mean, std, min, exact quartiles, max."""
    names, keys = columns or numeric_columns(df), list(by or [])
    wide = df.groupBy(*keys).agg(*[F.struct(*_moments(c)).alias(f"__s{i}") for i, c in enumerate(names)])
    wide = _beside(wide, quantiles(df, {f"__q{i}": F.col(c) for i, c in enumerate(names)}, [0.25, 0.5, 0.75], keys), keys)
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *_profile(F.col(f"__s{i}"), F.col(f"__q{i}"))) for i, c in enumerate(names)]))
    return wide.select(*keys, entries.alias("e")).select(*keys, "e.*")


def approximate_describe(df: DataFrame, columns: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """As ``describe`` with quartiles in bounded memory (rank error at most 1 / accuracy)."""
    names = columns or numeric_columns(df)
    rows = []
    for c in names:
        x = F.col(c).cast("double")
        q = F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy)
        rows.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(x).alias("max")))
    return df.agg(*[r.alias(f"s{i}") for i, r in enumerate(rows)]).select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(rows))])).alias("s")).select("s.*")


def series_stats(df: DataFrame, name: str) -> DataFrame:
    c = F.col(name)
    wide = df.agg(F.struct(*_moments(name)).alias("__s"), F.sum(c).alias("sum"), F.var_samp(c).alias("var"), F.count_distinct(c).alias("n_unique"))
    return _beside(wide, quantiles(df, {"__q": c}, [0.25, 0.5, 0.75]), []).select(*_profile(F.col("__s"), F.col("__q")), "sum", "var", "n_unique")


def corr(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlations of all pairs in one pass, in long form: c1, c2, r."""
    names = columns or numeric_columns(df)
    pairs = list(combinations_with_replacement(names, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    both = [(a, b, i) for i, (a, b) in enumerate(pairs)] + [(b, a, i) for i, (a, b) in enumerate(pairs) if a != b]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"r{i}").alias("r")) for a, b, i in both])).alias("e")).select("e.*")


def render(df: DataFrame, rows: int = 20) -> str:
    return df._show_string(rows, 20, False)
