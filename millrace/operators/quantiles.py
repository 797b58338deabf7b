"""Exact quantiles of any number of rows in bounded memory: bracket by a sketch, then count inside the bracket."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000


def quantiles(df: DataFrame, columns: dict[str, Column], points: list[float], by: list[str] | None = None) -> DataFrame:
    """One row per group: the group's columns and for every name an array of its quantiles, interpolated linearly.

    A sketch per group brackets each quantile by values a few ten-thousandths of the rows below and above it; a second
    pass counts what is below and the distinct values inside, so a group's task holds those alone. Nulls don't count; a
    column without values gives nulls.
    """
    groups, names = [f"__g{i}" for i in range(len(by or []))], list(columns)
    keys = [F.col(f"`{c}`").alias(g) for c, g in zip(by or [], groups, strict=True)]
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), columns[n].cast("double").alias("v")) for i, n in enumerate(names)]))
    rows = df.select(*keys, values.alias("x")).select(*groups, "x.i", "x.v")
    ends = [F.lit(min(1.0, max(0.0, p + side * 3 / ACCURACY))) for p in points for side in (-1, 1)]
    cell = [*groups, "i"]
    named = {c: f"__s{c}" for c in cell}
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(named[c])) for c in cell])
    sketch = rows.groupBy(*cell).agg(F.percentile_approx("v", F.array(*ends), ACCURACY).alias("b")).withColumnsRenamed(named)
    # One row per group and column on the right; without groups one row per column.
    met = rows.join(sketch if by else F.broadcast(sketch), same)
    low, high = (lambda k: F.col("b")[2 * k]), (lambda k: F.col("b")[2 * k + 1])
    under = [x for k in range(len(points)) for x in (F.count(F.when(F.col("v") < low(k), 1)).alias(f"below{k}"), F.max(F.when(F.col("v") < low(k), F.col("v"))).alias(f"before{k}"), F.min(F.when(F.col("v") > high(k), F.col("v"))).alias(f"behind{k}"))]
    sides = met.groupBy(*cell).agg(F.count("v").alias("n"), *under)
    inside = F.filter(F.array(*[F.when(F.col("v").between(low(k), high(k)), F.lit(k)) for k in range(len(points))]), lambda k: k.isNotNull())
    counted = met.select(*cell, "v", F.explode(inside).alias("k")).groupBy(*cell, "k", "v").agg(F.count(F.lit(1)).alias("m"))
    lists = counted.groupBy(*cell).agg(*[F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("v", "m")))).alias(f"l{k}") for k in range(len(points))])
    both = sides.join(lists.withColumnsRenamed(named), same, "left")

    def value(k: int, rank: Column) -> Column:
        inner = F.coalesce(F.col(f"l{k}"), F.array().cast("array<struct<v:double,m:bigint>>"))
        start = F.struct(F.col(f"below{k}").alias("seen"), F.lit(None).cast("double").alias("v"))
        # The first value whose copies reach beyond the rank.
        found = F.aggregate(inner, start, lambda a, x: F.struct((a["seen"] + x["m"]).alias("seen"), F.when((a["seen"] <= rank) & (a["seen"] + x["m"] > rank), x["v"]).otherwise(a["v"]).alias("v")))["v"]
        return F.when(rank < F.col(f"below{k}"), F.col(f"before{k}")).otherwise(F.coalesce(found, F.col(f"behind{k}")))

    def quantile(k: int) -> Column:
        place = F.lit(points[k]) * (F.col("n") - 1)
        first = F.floor(place)
        a, b = value(k, first), value(k, first + 1)
        return F.when(place > first, a + (b - a) * (place - first)).otherwise(a)

    done = both.select(*cell, F.array(*[quantile(k) for k in range(len(points))]).alias("q"))
    wide = done.groupBy(*groups).agg(*[F.first(F.when(F.col("i") == i, F.col("q")), ignorenulls=True).alias(n) for i, n in enumerate(names)])
    return wide.select(*[F.col(g).alias(c) for c, g in zip(by or [], groups, strict=True)], *names)
