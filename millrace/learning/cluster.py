"""Clustering and principal components."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.ml.clustering import KMeans as MLKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from millrace.operators.frame import with_position
from millrace.operators.linalg import gram
from millrace.storage import Table


def _distance(features: list[str], centre) -> F.Column:
    return sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(features, centre, strict=True)), F.lit(0.0))


def assign(df: DataFrame, features: list[str], centres: list, out: str = "cluster") -> DataFrame:
    """The nearest centre, the lower number among ties: a column expression."""
    options = [F.struct(_distance(features, c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]
    return df.withColumn(out, F.array_min(F.array(*options))["k"])


def lloyd(df: DataFrame, features: list[str], centres: list, steps: int) -> list:
    """Steps of Lloyd's algorithm from given centres; an empty cluster keeps its centre."""
    for _ in range(steps):
        found = {r["cluster"]: [r[f"m{i}"] for i in range(len(features))] for r in assign(df, features, centres).groupBy("cluster").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)]).collect()}
        centres = [found.get(k, c) for k, c in enumerate(centres)]
    return centres


class KMeans:
    """Centres are drawn (k-means||), or start from ``centres`` and take ``max_iter`` steps."""

    def __init__(self, features: list[str], k: int, seed: int = 42, max_iter: int = 20, centres: list | None = None):
        self.features, self.k, self.seed, self.max_iter, self.start = features, k, seed, max_iter, centres

    def fit(self, df):
        if self.start is not None:
            self.centres = lloyd(df, self.features, self.start, self.max_iter)
            return self
        ready = VectorAssembler(inputCols=self.features, outputCol="__features").transform(df)
        self.centres = [list(map(float, c)) for c in MLKMeans(k=self.k, seed=self.seed, maxIter=self.max_iter, featuresCol="__features").fit(ready).clusterCenters()]
        return self

    def predict(self, df):
        return assign(df, self.features, self.centres, "prediction")


class DBSCAN:
    """Density clusters: grid cells of side eps meet their neighbours, cores join by least-label propagation.

    ``fit`` returns key, label (-1 noise; clusters numbered by their least core key), core. Points count themselves.
    Pairs, cores and the labels of every fourth round are written tables, which cut the lineage.
    """

    def __init__(self, features: list[str], eps: float, min_points: int, key: str = "id", max_rounds: int = 1000):
        self.features, self.eps, self.min_points, self.key, self.max_rounds = features, eps, min_points, key, max_rounds

    def fit(self, df: DataFrame) -> DataFrame:
        d, spark = len(self.features), df.sparkSession
        points = df.select(F.col(self.key).cast("long").alias("p"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)]).withColumns({f"g{i}": F.floor(F.col(f"x{i}") / self.eps) for i in range(d)})
        steps = F.explode(F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(step)]) for step in product((-1, 0, 1), repeat=d)]))
        moved = points.withColumn("s", steps).select(F.col("p").alias("q"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(d)], *[(F.col(f"g{i}") + F.col(f"s.s{i}")).alias(f"g{i}") for i in range(d)])
        apart = sum(((F.col(f"x{i}") - F.col(f"y{i}")) * (F.col(f"x{i}") - F.col(f"y{i}")) for i in range(d)), F.lit(0.0))
        near = Table(spark, points.join(moved, [f"g{i}" for i in range(d)]).where(apart <= self.eps * self.eps).select("p", "q"), "near")
        cores = Table(spark, near.df.groupBy("p").count().where(F.col("count") >= self.min_points).select("p"), "cores")
        edges = Table(spark, near.df.join(cores.df, "p").join(cores.df.withColumnRenamed("p", "q"), "q").where("p <> q").select("p", "q"), "edges")
        labels, kept = cores.df.select("p", F.col("p").alias("label")), None
        for turn in range(self.max_rounds):
            reached = edges.df.join(labels.select(F.col("p").alias("q"), "label"), "q").select("p", "label").union(labels.select("p", "label"))
            spread = reached.groupBy("p").agg(F.min("label").alias("label"))
            # Then follow the label's own label: paths halve in every round.
            jumped = spread.join(labels.select(F.col("p").alias("label"), F.col("label").alias("far")), "label").select("p", F.least("label", "far").alias("label"))
            before, kept = kept, Table(spark, jumped, "labels") if turn % 4 == 3 else kept
            after = kept.df if turn % 4 == 3 else jumped.persist()
            changed = after.join(labels.withColumnRenamed("label", "old"), "p").where("label <> old").limit(1).count()
            labels.unpersist()
            labels = after
            if before and before is not kept:
                before.drop()
            if not changed:
                break
        else:
            raise RuntimeError("clusters did not settle")
        final = Table(spark, labels, "labels")
        labels.unpersist()
        border = near.df.join(final.df.select(F.col("p").alias("q"), "label"), "q").groupBy("p").agg(F.min("label").alias("first"))
        out = points.select("p").join(final.df, "p", "left").join(border, "p", "left")
        label = F.coalesce("label", "first")
        found = out.select(F.col("p").alias(self.key), label.alias("root"), F.col("label").isNotNull().alias("core"))
        names = with_position(final.df.select(F.col("label").alias("root")).distinct(), ["root"], "label")
        self.n_clusters = names.count()
        return found.join(names, "root", "left").select(self.key, F.coalesce("label", F.lit(-1).cast("long")).alias("label"), "core")


class PCA:
    """Principal components of centred data from the aggregated covariance; the largest loading of each is positive."""

    def __init__(self, features: list[str], k: int):
        self.features, self.k = features, k

    def fit(self, df):
        g, self.mean, n = gram(df, self.features, center=True)
        w, v = np.linalg.eigh(g / max(1, n - 1))
        order = np.argsort(w)[::-1][: self.k]
        v = v[:, order]
        self.components = (v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])).T
        self.explained_variance, self.explained_variance_ratio = w[order], w[order] / w.sum()
        return self

    def transform(self, df):
        return df.withColumns({f"pc{k}": sum(((F.col(c) - float(m)) * float(v) for c, m, v in zip(self.features, self.mean, row, strict=True)), F.lit(0.0)) for k, row in enumerate(self.components)})


