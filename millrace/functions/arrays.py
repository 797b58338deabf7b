"""Dense arrays as coordinate-form DataFrames (i, j, v): factories, shape, and reductions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def array(spark: SparkSession, values: list) -> DataFrame:
    """A literal vector (a column) or matrix."""
    rows = [[v] for v in values] if values and not isinstance(values[0], list | tuple) else values
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i long, j long, v double")


def full(spark: SparkSession, m: int, n: int, value: float) -> DataFrame:
    return spark.range(m * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"), F.lit(float(value)).alias("v"))


def zeros(spark: SparkSession, m: int, n: int = 1) -> DataFrame:
    return full(spark, m, n, 0.0)


def ones(spark: SparkSession, m: int, n: int = 1) -> DataFrame:
    return full(spark, m, n, 1.0)


def eye(spark: SparkSession, n: int) -> DataFrame:
    """The identity, its zeros left out."""
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def arange(spark: SparkSession, start: float, stop: float, step: float = 1.0) -> DataFrame:
    n = max(0, math.ceil((stop - start) / step))
    return spark.range(n).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), (F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias("v"))


def linspace(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("j"), (F.lit(float(start)) + F.col("id") * F.lit(step)).alias("v"))


def shape(a: DataFrame) -> DataFrame:
    return a.agg((F.max("i") + 1).alias("m"), (F.max("j") + 1).alias("n"))


def reshape(a: DataFrame, columns: int, new_columns: int) -> DataFrame:
    flat = F.col("i") * columns + F.col("j")
    return a.select(F.floor(flat / new_columns).alias("i"), (flat % new_columns).alias("j"), "v")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def from_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Coordinate form of numeric columns, the row number given by ``key``."""
    cells = F.explode(F.array(*[F.struct(F.lit(j).cast("long").alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(columns)]))
    return df.select(F.col(key).cast("long").alias("i"), cells.alias("c")).select("i", "c.*")


def reduced(value: Column, position: Column) -> dict[str, Column]:
    """All reductions of a column; argmin and argmax take the least position among ties."""
    return {
        "sum": F.sum(value),
        "mean": F.avg(value),
        "std": F.stddev_samp(value),
        "var": F.var_samp(value),
        "min": F.min(value),
        "max": F.max(value),
        "prod": F.product(value),
        "argmin": F.min(F.struct(value.alias("v"), position.alias("p")))["p"],
        "argmax": F.min(F.struct((-value).alias("v"), position.alias("p")))["p"],
    }


def reduce_all(df: DataFrame, value: str, position: str, names: list[str] | None = None) -> DataFrame:
    every = reduced(F.col(value), F.col(position))
    return df.where(F.col(value).isNotNull()).agg(*[every[n].alias(n) for n in names or every])
