"""Splits, folds, pipelines and grid search. Splits are exact in size and depend on keys and seed alone."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from millrace.operators.frame import with_position


class Estimator(Protocol):
    def fit(self, df: DataFrame) -> Estimator: ...

    def score(self, df: DataFrame) -> float: ...


def shuffled(df: DataFrame, key: str, seed: int, name: str = "_rank") -> DataFrame:
    """A 0-based rank in an order given by md5 of key and seed."""
    drawn = df.withColumn("__draw", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")))
    return with_position(drawn, ["__draw", key], name).drop("__draw")


def train_test_split(df: DataFrame, key: str, test_ratio: float = 0.3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    ranked, n = shuffled(df, key, seed), df.count()
    k = math.ceil(n * test_ratio)
    return ranked.where(F.col("_rank") >= k).drop("_rank"), ranked.where(F.col("_rank") < k).drop("_rank")


def with_folds(df: DataFrame, key: str, cv: int = 5, seed: int = 42) -> DataFrame:
    ranked = shuffled(df, key, seed)
    return ranked.withColumn("fold", (F.col("_rank") % cv).cast("int")).drop("_rank")


def cross_val_score(make, df: DataFrame, key: str, cv: int = 5, seed: int = 42, n_jobs: int = 1) -> list[float]:
    """One score for each fold; ``make()`` gives a fresh estimator."""
    folds = with_folds(df, key, cv, seed).persist()

    def one(f: int) -> float:
        return make().fit(folds.where(F.col("fold") != f).drop("fold")).score(folds.where(F.col("fold") == f).drop("fold"))

    try:
        with ThreadPoolExecutor(max(1, n_jobs)) as pool:
            return list(pool.map(one, range(cv)))
    finally:
        folds.unpersist()


class Pipeline:
    """Transforms, then an estimator."""

    def __init__(self, steps: list):
        self.steps = steps

    def fit(self, df):
        for step in self.steps[:-1]:
            df = step.fit_transform(df)
        self.steps[-1].fit(df)
        return self

    def _prepared(self, df):
        for step in self.steps[:-1]:
            df = step.transform(df)
        return df

    def predict(self, df):
        return self.steps[-1].predict(self._prepared(df))

    def score(self, df):
        return self.steps[-1].score(self._prepared(df))


class GridSearchCV:
    """Every combination of ``grid`` by its mean score over the folds; the best is fitted again on all rows."""

    def __init__(self, make, grid: dict[str, list], cv: int = 3, seed: int = 42, n_jobs: int = 1):
        self.make, self.grid, self.cv, self.seed, self.n_jobs = make, grid, cv, seed, n_jobs

    def fit(self, df, key: str):
        self.results = []
        for values in product(*self.grid.values()):
            params = dict(zip(self.grid, values, strict=True))
            scores = cross_val_score(lambda p=params: self.make(**p), df, key, self.cv, self.seed, self.n_jobs)
            self.results.append((sum(scores) / len(scores), params))
        self.best_score, self.best_params = max(self.results, key=lambda r: r[0])
        self.best_estimator = self.make(**self.best_params).fit(df)
        return self

    def predict(self, df):
        return self.best_estimator.predict(df)
