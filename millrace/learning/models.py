"""Classifiers and regressors: ``fit(df)``, ``predict(df)`` adds ``prediction``, ``score(df)`` is accuracy or R squared.

Labels are whole numbers from 0. Trees, forests, boosting and logistic regression are MLlib's; linear models solve the
aggregated normal equations; neighbours, kernels and networks run on Arrow batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import classification as mc, regression as mr
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from millrace.learning import gradient, metrics
from millrace.operators.linalg import gram
from millrace.storage import Table

from .neighbours import nearest


class _Model:
    kind = "classifier"

    def __init__(self, features: list[str], label: str = "target"):
        self.features, self.label = list(features), label

    def score(self, df: DataFrame) -> float:
        out = self.predict(df)
        if self.kind == "classifier":
            return metrics.accuracy(out, self.label, "prediction").first()[0]
        return metrics.regression_scores(out, self.label, "prediction").first()["r2"]


class _Wrapped(_Model):
    """An MLlib estimator behind the common interface; parameters that ``defaults`` doesn't name are refused."""

    defaults: dict = {}

    def __init__(self, features, label="target", **params):
        super().__init__(features, label)
        if unknown := sorted(set(params) - set(self.defaults)):
            raise TypeError(f"{type(self).__name__} has no parameter {', '.join(unknown)}")
        self.params = self.defaults | params

    def estimator(self):
        raise NotImplementedError

    def _vectors(self, df):
        return VectorAssembler(inputCols=self.features, outputCol="__features", handleInvalid="keep").transform(df)

    def fit(self, df):
        ready = self._vectors(df.withColumn("__label", F.col(self.label).cast("double")))
        self.model = self.estimator().setFeaturesCol("__features").setLabelCol("__label").setPredictionCol("__prediction").fit(ready)
        return self

    def predict(self, df):
        out = self.model.transform(self._vectors(df))
        value = F.col("__prediction").cast("int") if self.kind == "classifier" else F.col("__prediction")
        return out.withColumn("prediction", value).select(*df.columns, "prediction")


class _Tree(_Wrapped):
    """``min_samples_split`` rows are needed in a node that is split: MLlib asks that of the two children, half each.

    ``max_bins`` bounds the thresholds that are tried for a feature. ``n_jobs`` is accepted for its name: Spark runs the
    trees of a forest side by side on the cores it has.
    """

    defaults = {"max_depth": 5, "min_samples_split": 2, "max_bins": 32, "seed": 42, "n_jobs": 1}

    def _shape(self) -> dict:
        p = self.params
        return {"maxDepth": p["max_depth"], "minInstancesPerNode": max(1, -(-p["min_samples_split"] // 2)), "maxBins": p["max_bins"], "seed": p["seed"]}


class DecisionTreeClassifier(_Tree):
    def estimator(self):
        return mc.DecisionTreeClassifier(**self._shape())


class RandomForestClassifier(_Tree):
    defaults = _Tree.defaults | {"n_estimators": 20, "bootstrap": True}

    def estimator(self):
        return mc.RandomForestClassifier(numTrees=self.params["n_estimators"], bootstrap=self.params["bootstrap"], **self._shape())


class LogisticRegression(_Wrapped):
    defaults = {"max_iter": 100, "penalty": 0.0}

    def estimator(self):
        return mc.LogisticRegression(family="multinomial", maxIter=self.params["max_iter"], regParam=self.params["penalty"], tol=1e-9)


class GradientBoostingClassifier(_Tree):
    """Boosted trees, one against the rest."""

    defaults = _Tree.defaults | {"n_estimators": 20, "learning_rate": 0.1, "max_depth": 3}

    def estimator(self):
        return mc.OneVsRest(classifier=mc.GBTClassifier(maxIter=self.params["n_estimators"], stepSize=self.params["learning_rate"], **self._shape()))


class DecisionTreeRegressor(_Tree):
    kind = "regressor"

    def estimator(self):
        return mr.DecisionTreeRegressor(**self._shape())


class RandomForestRegressor(_Tree):
    kind = "regressor"
    defaults = _Tree.defaults | {"n_estimators": 20, "bootstrap": True}

    def estimator(self):
        return mr.RandomForestRegressor(numTrees=self.params["n_estimators"], bootstrap=self.params["bootstrap"], **self._shape())


class GradientBoostingRegressor(_Tree):
    kind = "regressor"
    defaults = _Tree.defaults | {"n_estimators": 20, "learning_rate": 0.1, "max_depth": 3}

    def estimator(self):
        return mr.GBTRegressor(maxIter=self.params["n_estimators"], stepSize=self.params["learning_rate"], **self._shape())


class Lasso(_Wrapped):
    """Least squares / (2 n) plus alpha times the absolute weights."""

    kind = "regressor"
    defaults = {"alpha": 1.0, "max_iter": 1000}

    def estimator(self):
        return mr.LinearRegression(regParam=self.params["alpha"], elasticNetParam=1.0, standardization=False, maxIter=self.params["max_iter"], tol=1e-9)


class _Linear(_Model):
    kind = "regressor"
    alpha = 0.0

    def fit(self, df):
        g, means, _ = gram(df, self.features, self.label, center=True)
        a = g[:-1, :-1] + self.alpha * np.eye(len(self.features))
        self.weights = np.linalg.lstsq(a, g[:-1, -1], rcond=None)[0]
        self.intercept = float(means[-1] - self.weights @ means[:-1])
        return self

    def predict(self, df):
        return df.withColumn("prediction", sum((F.col(c) * float(w) for c, w in zip(self.features, self.weights, strict=True)), F.lit(self.intercept)))


class LinearRegression(_Linear):
    pass


class Ridge(_Linear):
    """Squared error plus alpha times the squared weights, the intercept free."""

    def __init__(self, features, label="target", alpha: float = 1.0):
        super().__init__(features, label)
        self.alpha = alpha


class GaussianNB(_Model):
    """Class-wise means and population variances in one aggregate; prediction is a column expression."""

    def fit(self, df):
        moments = [s.alias(f"{k}{i}") for i, c in enumerate(self.features) for k, s in (("m", F.avg(c)), ("v", F.var_pop(c)))]
        rows = df.groupBy(F.col(self.label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"), *moments).orderBy("y").collect()
        total = sum(r["n"] for r in rows)
        largest = max((r[f"v{i}"] for r in rows for i in range(len(self.features))), default=0.0)
        self.classes = [(r["y"], r["n"] / total, [r[f"m{i}"] for i in range(len(self.features))], [r[f"v{i}"] + 1e-9 * largest for i in range(len(self.features))]) for r in rows]
        return self

    def predict(self, df):
        options = []
        for y, prior, means, variances in self.classes:
            value = F.lit(float(np.log(prior)))
            for c, m, v in zip(self.features, means, variances, strict=True):
                value = value - 0.5 * F.lit(float(np.log(2 * np.pi * v))) - (F.col(c) - m) * (F.col(c) - m) / (2 * v)
            options.append(F.struct(value.alias("l"), F.lit(-y).alias("y")))
        return df.withColumn("prediction", -F.array_max(F.array(*options))["y"])


class _Neighbours(_Model):
    def __init__(self, features, label="target", k: int = 5, key: str = "id", weights: str = "uniform"):
        super().__init__(features, label)
        self.k, self.key, self.weights = k, key, weights

    def fit(self, df):
        self.train = df
        return self

    def _votes(self, df):
        found = nearest(df, self.train, self.features, self.key, self.k, carry=self.label)
        return found.withColumn("w", F.lit(1.0) if self.weights == "uniform" else 1 / F.greatest(F.sqrt("d2"), F.lit(1e-12)))


class KNeighborsClassifier(_Neighbours):
    def predict(self, df):
        tally = self._votes(df).groupBy("query", "carried").agg(F.sum("w").alias("w"))
        best = tally.groupBy("query").agg(F.max(F.struct("w", (-F.col("carried")).alias("y"))).alias("b")).select(F.col("query").alias(self.key), (-F.col("b.y")).cast("int").alias("prediction"))
        return df.join(best, self.key)


class KNeighborsRegressor(_Neighbours):
    kind = "regressor"

    def predict(self, df):
        best = self._votes(df).groupBy("query").agg((F.sum(F.col("w") * F.col("carried")) / F.sum("w")).alias("prediction")).withColumnRenamed("query", self.key)
        return df.join(best, self.key)


class AdaBoostClassifier(_Model):
    """Stumps by the SAMME rule. The weights of a round are kept until those of the next are."""

    def __init__(self, features, label="target", n_estimators: int = 20, max_depth: int = 1):
        super().__init__(features, label)
        self.n, self.max_depth = n_estimators, max_depth

    def fit(self, df):
        self.stumps, self.alphas = [], []
        assembler = VectorAssembler(inputCols=self.features, outputCol="__features")
        data = assembler.transform(df.withColumn("__label", F.col(self.label).cast("double"))).select("__features", "__label", F.lit(1.0).alias("__w")).persist()
        k = data.agg(F.max("__label")).first()[0] + 1
        for t in range(self.n):
            stump = mc.DecisionTreeClassifier(maxDepth=self.max_depth, featuresCol="__features", labelCol="__label", weightCol="__w", predictionCol="__p", probabilityCol="__q", rawPredictionCol="__r").fit(data)
            judged = stump.transform(data).withColumn("__wrong", (F.col("__p") != F.col("__label")).cast("double"))
            e = judged.agg(F.sum(F.col("__w") * F.col("__wrong")) / F.sum("__w")).first()[0]
            if e >= 1 - 1 / k:
                break
            alpha = float(np.log((1 - e) / max(e, 1e-10)) + np.log(k - 1))
            self.stumps.append(stump)
            self.alphas.append(alpha)
            if e <= 1e-10:
                break
            weighed = judged.select("__features", "__label", (F.col("__w") * F.exp(alpha * F.col("__wrong"))).alias("__w"))
            if t % 10 == 9:
                # The plan of a round holds those of all before: a written table cuts it.
                after = Table(df.sparkSession, weighed, "boosting").df.persist()
            else:
                after = weighed.persist()
            after.count()
            data.unpersist()
            data = after
        self.n_classes = int(k)
        data.unpersist()
        return self

    def predict(self, df):
        out = VectorAssembler(inputCols=self.features, outputCol="__features").transform(df)
        votes = [F.lit(0.0)] * self.n_classes
        for i, (stump, alpha) in enumerate(zip(self.stumps, self.alphas, strict=True)):
            m = stump.copy().setPredictionCol(f"__p{i}").setProbabilityCol("").setRawPredictionCol("")
            out = m.transform(out)
            votes = [v + F.when(F.col(f"__p{i}") == y, alpha).otherwise(0.0) for y, v in enumerate(votes)]
        best = F.array_max(F.array(*[F.struct(v.alias("v"), F.lit(-y).alias("y")) for y, v in enumerate(votes)]))["y"]
        return out.withColumn("prediction", -best).select(*df.columns, "prediction")


class _Trained(_Model):
    """Features are standardised inside, so step sizes fit any scale."""

    def _scaled(self, df):
        row = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(self.features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.mean = np.array([row[f"m{i}"] for i in range(len(self.features))], float)
        self.scale = np.array([row[f"s{i}"] or 1.0 for i in range(len(self.features))], float)
        return df.withColumns({f"__x{i}": (F.col(c) - float(self.mean[i])) / float(self.scale[i]) for i, c in enumerate(self.features)}), [f"__x{i}" for i in range(len(self.features))]

    def _predicted(self, df, f, kind):
        mean, scale = self.mean, self.scale
        return gradient.predict_column(df, self.features, lambda x: f((x - mean) / scale), "prediction", kind)


class SVC(_Trained):
    """Squared-hinge machines, one against the rest: linear, polynomial (exact), or RBF by random features."""

    def __init__(self, features, label="target", kernel: str = "rbf", gamma: float | None = None, degree: int = 3, components: int = 100, penalty: float = 1e-3, steps: int = 60, seed: int = 42):
        super().__init__(features, label)
        self.kernel, self.gamma, self.degree, self.components, self.penalty, self.steps, self.seed = kernel, gamma, degree, components, penalty, steps, seed

    def fit(self, df):
        ready, names = self._scaled(df)
        k = int(df.agg(F.max(self.label)).first()[0]) + 1
        lift, width = gradient.kernel(self.kernel, len(names), self.gamma, self.degree, self.components, self.seed)
        inner = gradient.hinge_loss(k)
        data = gradient.matrix(ready, names, [self.label])
        theta = gradient.minimise(data, lambda x, y, t: inner(lift(x), y, t), np.zeros((width + 1) * k), self.steps, 0.1, self.penalty)
        data.unpersist()
        self.w, self.lift = theta.reshape(width + 1, k), lift
        return self

    def predict(self, df):
        w, lift = self.w, self.lift
        return self._predicted(df, lambda x: (lift(x) @ w[:-1] + w[-1]).argmax(axis=1), "int")


class SVR(_Trained):
    """Epsilon-insensitive regression: linear, polynomial (exact), or RBF by random features."""

    kind = "regressor"

    def __init__(self, features, label="target", kernel: str = "linear", epsilon: float = 0.1, gamma: float | None = None, degree: int = 3, components: int = 100, penalty: float = 1e-4, steps: int = 80, seed: int = 42):
        super().__init__(features, label)
        self.kernel, self.epsilon, self.gamma, self.degree, self.components, self.penalty, self.steps, self.seed = kernel, epsilon, gamma, degree, components, penalty, steps, seed

    def fit(self, df):
        ready, names = self._scaled(df)
        y = df.agg(F.avg(self.label), F.stddev_pop(self.label)).first()
        self.shift, self.unit = float(y[0]), float(y[1] or 1.0)
        lift, width = gradient.kernel(self.kernel, len(names), self.gamma, self.degree, self.components, self.seed)
        inner = gradient.svr_loss(self.epsilon / self.unit)
        data = gradient.matrix(ready.withColumn("__y", (F.col(self.label) - self.shift) / self.unit), names, ["__y"])
        self.theta = gradient.minimise(data, lambda x, y, t: inner(lift(x), y, t), np.zeros(width + 1), self.steps, 0.05, self.penalty)
        data.unpersist()
        self.lift = lift
        return self

    def predict(self, df):
        t, lift, shift, unit = self.theta, self.lift, self.shift, self.unit
        return self._predicted(df, lambda x: (lift(x) @ t[:-1] + t[-1]) * unit + shift, "double")


class _Network(_Trained):
    def __init__(self, features, label="target", hidden: tuple[int, ...] = (10,), activation: str = "relu", max_iter: int = 150, learning_rate: float = 0.05, seed: int = 42):
        super().__init__(features, label)
        self.hidden, self.activation, self.max_iter, self.learning_rate, self.seed = tuple(hidden), activation, max_iter, learning_rate, seed

    def _train(self, df, names, targets, outputs, kind):
        self.net = gradient.Network([len(names), *self.hidden, outputs], self.activation, kind)
        data = gradient.matrix(df, names, targets)
        self.theta = gradient.minimise(data, self.net.loss, self.net.start(self.seed), self.max_iter, self.learning_rate)
        data.unpersist()
        return self


class MLPClassifier(_Network):
    def fit(self, df):
        ready, names = self._scaled(df)
        return self._train(ready, names, [self.label], int(df.agg(F.max(self.label)).first()[0]) + 1, "softmax")

    def predict(self, df):
        net, theta = self.net, self.theta
        return self._predicted(df, lambda x: net.forward(x, theta)[-1].argmax(axis=1), "int")


class MLPRegressor(_Network):
    kind = "regressor"

    def fit(self, df):
        ready, names = self._scaled(df)
        y = df.agg(F.avg(self.label), F.stddev_pop(self.label)).first()
        self.shift, self.unit = float(y[0]), float(y[1] or 1.0)
        return self._train(ready.withColumn("__y", (F.col(self.label) - self.shift) / self.unit), names, ["__y"], 1, "linear")

    def predict(self, df):
        net, theta, shift, unit = self.net, self.theta, self.shift, self.unit
        return self._predicted(df, lambda x: net.forward(x, theta)[-1][:, 0] * unit + shift, "double")


class Autoencoder(_Network):
    """A network that reproduces its features; ``predict`` gives each row's mean squared reconstruction error."""

    kind = "regressor"

    def fit(self, df):
        ready, names = self._scaled(df)
        return self._train(ready, names, names, len(names), "linear")

    def predict(self, df):
        net, theta = self.net, self.theta
        return self._predicted(df, lambda x: ((net.forward(x, theta)[-1] - x) ** 2).mean(axis=1), "double")


FACTORY = {
    ("tree", "classifier"): DecisionTreeClassifier,
    ("tree", "regressor"): DecisionTreeRegressor,
    ("forest", "classifier"): RandomForestClassifier,
    ("forest", "regressor"): RandomForestRegressor,
    ("neighbours", "classifier"): KNeighborsClassifier,
    ("neighbours", "regressor"): KNeighborsRegressor,
}


def make(kind: str, task: str, features: list[str], label: str = "target", **params):
    """A model by name and task."""
    return FACTORY[kind, task](features, label, **params)
