"""Scores of predictions, each a single aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def regression_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """mse, mae and r2 in one pass; r2 of a constant truth is null."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    error = y - p
    return df.agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), (1 - F.try_divide(F.sum(error * error), F.regr_syy(y, y))).alias("r2"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Long form over the whole grid of classes: y_true, y_pred, n."""
    pairs = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    classes = pairs.select(F.explode(F.array("y_true", "y_pred")).alias("c")).distinct().agg(F.sort_array(F.collect_set("c")).alias("all"))
    grid = classes.select(F.explode("all").alias("y_true"), "all").select("y_true", F.explode("all").alias("y_pred"))
    return grid.join(pairs, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, precision, recall, f1, support; ratios without cases are 0."""
    cells = df.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("e")).select("e.*")
    sums = cells.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("called"), F.sum("hit").alias("hits"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    precision, recall = ratio(F.col("hits"), F.col("called")), ratio(F.col("hits"), F.col("support"))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("hits"), F.col("called") + F.col("support")).alias("f1"), "support")


def print_confusion_matrix(df: DataFrame, truth: str, predicted: str) -> str:
    wide = confusion_matrix(df, truth, predicted).groupBy("y_true").pivot("y_pred").sum("n").orderBy("y_true")
    return wide._show_string(1000, 20, False)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)
