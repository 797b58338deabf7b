"""Full-batch training of small models: partitions add up their gradients on Arrow batches, groups of partitions add up theirs,
the driver takes Adam steps."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def matrix(df: DataFrame, features: list[str], targets: list[str], parts: int | None = None) -> DataFrame:
    """Features and targets as two array columns, persisted: training reads them in every step."""
    made = df.select(F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.array(*[F.col(c).cast("double") for c in targets]).alias("y"))
    return (made.coalesce(parts) if parts else made).persist()


def _numpy(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


SUMS = "value double, n long, grad binary"
#: Beyond so many partitions their sums are added in the cluster first.
FAN_IN = 32


def _added(batches):
    for batch in batches:
        if batch.num_rows:
            grad = sum(np.frombuffer(g.as_buffer()) for g in batch.column("grad"))
            yield pa.RecordBatch.from_arrays([pa.array([sum(batch.column("value").to_pylist())]), pa.array([sum(batch.column("n").to_pylist())], pa.int64()), pa.array([grad.tobytes()], pa.binary())], names=["value", "n", "grad"])


def gradient_sum(data: DataFrame, loss, theta: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Sums of loss and gradient over all rows; ``loss(x, y, theta)`` works on a batch."""

    def run(batches):
        value, grad, n = 0.0, np.zeros_like(theta), 0
        for batch in batches:
            if batch.num_rows:
                v, g = loss(_numpy(batch.column("x")), _numpy(batch.column("y")), theta)
                value, grad, n = value + v, grad + g, n + batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([n], pa.int64()), pa.array([grad.tobytes()], pa.binary())], names=["value", "n", "grad"])

    partial = data.mapInArrow(run, SUMS)
    if (parts := data.rdd.getNumPartitions()) > FAN_IN:
        partial = partial.repartition(-(-parts // FAN_IN)).mapInArrow(_added, SUMS)
    rows = partial.collect()
    return sum(r.value for r in rows), sum((np.frombuffer(r.grad) for r in rows), np.zeros_like(theta)), sum(r.n for r in rows)


def minimise(data: DataFrame, loss, theta: np.ndarray, steps: int, rate: float, penalty: float = 0.0, tolerance: float = 1e-7) -> np.ndarray:
    m, v, last = np.zeros_like(theta), np.zeros_like(theta), np.inf
    for t in range(1, steps + 1):
        value, grad, n = gradient_sum(data, loss, theta)
        value, grad = value / max(n, 1), grad / max(n, 1) + penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if abs(last - value) < tolerance:
            break
        last = value
    return theta


ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50))), lambda a: a * (1 - a)),
}


class Network:
    """Layers of a multilayer perceptron, packed into one vector."""

    def __init__(self, sizes: list[int], activation: str, output: str):
        self.sizes, self.activation, self.output = sizes, activation, output

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            parts += [rng.normal(0, np.sqrt(2 / (a + b)), a * b), np.zeros(b)]
        return np.concatenate(parts)

    def layers(self, theta):
        at, out = 0, []
        for a, b in zip(self.sizes, self.sizes[1:], strict=False):
            out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x, theta):
        f, _ = ACTIVATIONS[self.activation]
        values = [x]
        layers = self.layers(theta)
        for k, (w, b) in enumerate(layers):
            z = values[-1] @ w + b
            if k + 1 < len(layers):
                z = f(z)
            elif self.output == "softmax":
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
            values.append(z)
        return values

    def loss(self, x, y, theta):
        values, layers = self.forward(x, theta), self.layers(theta)
        if self.output == "softmax":
            want = np.eye(self.sizes[-1])[y[:, 0].astype(int)]
            value = -np.log(np.maximum((values[-1] * want).sum(axis=1), 1e-300)).sum()
        else:
            want = y
            value = 0.5 * ((values[-1] - y) ** 2).sum()
        slope, grads = values[-1] - want, []
        for k in reversed(range(len(layers))):
            grads[:0] = [(values[k].T @ slope).reshape(-1), slope.sum(axis=0)]
            if k:
                slope = (slope @ layers[k][0].T) * ACTIVATIONS[self.activation][1](values[k])
        return float(value), np.concatenate(grads)


def svr_loss(epsilon: float):
    def loss(x, y, theta):
        error = x @ theta[:-1] + theta[-1] - y[:, 0]
        over = np.abs(error) > epsilon
        pull = np.sign(error) * over
        return float((np.abs(error) - epsilon)[over].sum()), np.append(x.T @ pull, pull.sum())

    return loss


def hinge_loss(k: int):
    """One squared-hinge machine per class, side by side."""

    def loss(x, y, theta):
        w = theta.reshape(-1, k)
        sign = 2.0 * np.eye(k)[y[:, 0].astype(int)] - 1
        margin = np.maximum(0, 1 - sign * (x @ w[:-1] + w[-1]))
        pull = -2 * sign * margin
        return float((margin**2).sum()), np.vstack([x.T @ pull, pull.sum(axis=0)]).reshape(-1)

    return loss


def fourier(d: int, n: int, gamma: float, seed: int):
    """Random features whose inner products approximate the RBF kernel exp(-gamma |x - z|^2)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (d, n)), rng.uniform(0, 2 * np.pi, n)
    return lambda x: np.sqrt(2 / n) * np.cos(x @ w + b)


def monomials(d: int, degree: int, gamma: float):
    """Features whose inner products are the polynomial kernel (gamma x.z + 1) ** degree."""
    terms = [t for n in range(1, degree + 1) for t in combinations_with_replacement(range(d), n)]
    scale = []
    for t in terms:
        ways = math.factorial(degree) / math.factorial(degree - len(t))
        for i in set(t):
            ways /= math.factorial(t.count(i))
        scale.append(math.sqrt(ways * gamma ** len(t)))
    return lambda x: np.column_stack([np.prod(x[:, list(t)], axis=1) * s for t, s in zip(terms, scale, strict=True)]), len(terms)


def kernel(name: str, d: int, gamma: float | None, degree: int, components: int, seed: int):
    """A map to features that stand for a kernel (the constant left to the intercept), and their number."""
    if name == "linear":
        return (lambda x: x), d
    if name == "poly":
        return monomials(d, degree, gamma or 1 / d)
    if name == "rbf":
        return fourier(d, components, gamma or 1 / d, seed), components
    raise ValueError(f"no kernel {name}")


def predict_column(df: DataFrame, features: list[str], f, out: str, kind: str) -> DataFrame:
    """``df`` with one more column, computed batch by batch from its features; rows with a missing feature get null."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType() if kind == "int" else T.DoubleType())])
    places = [df.columns.index(c) for c in features]

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(p).cast(pa.float64()).to_numpy(zero_copy_only=False) for p in places]) if batch.num_rows else np.zeros((0, len(places)))
            whole = ~np.isnan(x).any(axis=1)
            y = np.zeros(len(x))
            if whole.any():
                y[whole] = f(x[whole])
            made = pa.array(y.astype(np.int32) if kind == "int" else y, mask=~whole)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
