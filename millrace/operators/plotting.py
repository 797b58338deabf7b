"""Data for plots, small enough to draw: series, scatter points, binned grids and class grids. Drawing is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from millrace.learning.metrics import confusion_matrix


def line_points(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """The series in bins of equal width over x: bin, n, x (mean), y (mean)."""
    low, high = df.agg(F.min(x).cast("double"), F.max(x).cast("double")).first()
    width = ((high - low) / bins) or 1.0
    place = F.least(F.floor((F.col(x).cast("double") - low) / width), F.lit(bins - 1).cast("long"))
    return df.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def heat_grid(df: DataFrame, x: str, y: str, x_step: float, y_step: float, value: str | None = None) -> DataFrame:
    """Counts, or means of ``value``, in cells of a grid: a density scatter or an image."""
    cell = df.groupBy(F.floor(F.col(x).cast("double") / x_step).alias("gx"), F.floor(F.col(y).cast("double") / y_step).alias("gy"))
    return cell.agg(F.count(F.lit(1)).alias("n"), *([F.avg(value).alias("v")] if value else []))


def scatter_points(df: DataFrame, x: str, y: str, key: str, most: int = 5000) -> DataFrame:
    """At most ``most`` points, chosen by a hash of the key: enough to draw."""
    return df.select(key, x, y).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(most)


def confusion_heat(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Cells of a confusion heat map: gx (predicted), gy (true), n, and share of the true class."""
    cells = confusion_matrix(df, truth, predicted)
    total = F.sum("n").over(Window.partitionBy("y_true"))
    return cells.select(F.col("y_pred").alias("gx"), F.col("y_true").alias("gy"), "n", F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)).alias("share"))


def image_matrix(a: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Cells (i, j, v) of a matrix as an image: row, column and a shade from 0 (``low``, left out the least value) to 255."""
    first, last = a.agg(F.min("v"), F.max("v")).first()
    low, high = first if low is None else low, last if high is None else high
    shade = (F.col("v") - F.lit(low)) / F.lit((high - low) or 1.0) if low is not None else F.lit(None).cast("double")
    return a.select(F.col("i").alias("row"), F.col("j").alias("column"), F.greatest(F.lit(0), F.least(F.lit(255), F.round(255 * shade).cast("int"))).alias("shade"))
