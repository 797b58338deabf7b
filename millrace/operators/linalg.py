"""Linear algebra: coordinate-form products and norms as joins and aggregates; decompositions of tall matrices through their
feature-sized Gram matrix, which executors add up and the driver solves."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_DENSE = 4096
FEW_COLUMNS = 12


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.sum("v").alias("trace"))


def norms(a: DataFrame) -> DataFrame:
    """Frobenius norm, largest absolute column sum and largest absolute row sum."""
    size = F.sum(F.abs("v"))
    fro = a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    one = a.groupBy("j").agg(size.alias("s")).agg(F.max("s").alias("norm1"))
    inf = a.groupBy("i").agg(size.alias("s")).agg(F.max("s").alias("norm_inf"))
    return fro.join(one).join(inf)


def gram(df: DataFrame, columns: list[str], target: str | None = None, center: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X (of columns and target), their means and the number of rows, in one pass; rows with a null are left out.

    Few columns are summed pair by pair in one aggregate. With more, every task multiplies its Arrow batches and adds
    them up; beyond 32 tasks their sums are added in the cluster.
    """
    names = [*columns, *([target] if target else [])]
    d = len(names)
    total = _pair_sums(df, names) if d <= FEW_COLUMNS else _batch_sums(df, names)
    g, n = total[: d * d].reshape(d, d), int(total[-1])
    means = total[d * d : -1] / max(n, 1)
    return (g - n * np.outer(means, means) if center else g), means, n


def _pair_sums(df: DataFrame, names: list[str]) -> np.ndarray:
    x, d = [F.col(c).cast("double") for c in names], len(names)
    cells = [F.sum(x[min(a, b)] * x[max(a, b)]).alias(f"g{a}_{b}") for a in range(d) for b in range(d)]
    whole = sum((F.col(c).isNull().cast("int") for c in names), F.lit(0)) == 0
    return np.array([float(v or 0) for v in df.where(whole).agg(*cells, *[F.sum(c) for c in x], F.count(F.lit(1))).first()])


def _batch_sums(df: DataFrame, names: list[str]) -> np.ndarray:
    d = len(names)
    rows = df.select(F.array(*[F.col(c).cast("double") for c in names]).alias("x"))

    def run(batches):
        g, m, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if batch.num_rows else np.zeros((0, d))
            gaps = batch.column("x").flatten().is_null().to_numpy(zero_copy_only=False).reshape(-1, d).any(axis=1)
            x = x[~gaps]
            g, m, n = g + x.T @ x, m + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g.reshape(-1), m, [n]]).tobytes()], pa.binary())], names=["sums"])

    def added(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([sum(np.frombuffer(v.as_buffer()) for v in batch.column("sums")).tobytes()], pa.binary())], names=["sums"])

    partial = rows.mapInArrow(run, "sums binary")
    if (parts := rows.rdd.getNumPartitions()) > 32:
        partial = partial.repartition(-(-parts // 32)).mapInArrow(added, "sums binary")
    return sum((np.frombuffer(r.sums) for r in partial.collect()), np.zeros(d * d + d + 1))


def dense(a: DataFrame) -> np.ndarray:
    """A small coordinate matrix on the driver; at most 4096 x 4096."""
    m, n = a.agg(F.max("i") + 1, F.max("j") + 1).first()
    if max(m, n) > MAX_DENSE:
        raise ValueError("too large for the driver; use the row-form functions")
    out = np.zeros((m, n))
    for i, j, v in a.collect():
        out[i, j] = v
    return out


def coordinates(spark, a: np.ndarray) -> DataFrame:
    a = np.atleast_2d(a)
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "i long, j long, v double")


def _square(a: DataFrame) -> np.ndarray:
    x = dense(a)
    if x.shape[0] != x.shape[1]:
        raise ValueError("a square matrix is needed")
    return x


def det(a: DataFrame) -> float:
    return float(np.linalg.det(_square(a)))


def inv(a: DataFrame) -> DataFrame:
    return coordinates(a.sparkSession, np.linalg.inv(_square(a)))


def matrix_rank(a: DataFrame) -> int:
    return int(np.linalg.matrix_rank(dense(a)))


def solve(a: DataFrame, b: DataFrame) -> DataFrame:
    return coordinates(a.sparkSession, np.linalg.solve(_square(a), dense(b)))


def cholesky(a: DataFrame) -> DataFrame:
    """Lower factor; the matrix must be symmetric and positive definite."""
    x = _square(a)
    if not np.allclose(x, x.T):
        raise ValueError("not symmetric")
    return coordinates(a.sparkSession, np.linalg.cholesky(x))


@dataclass
class Eigen:
    values: DataFrame  # k, re, im
    vectors: DataFrame  # i, j (the value's k), re, im


def eig(a: DataFrame) -> Eigen:
    w, v = np.linalg.eig(_square(a))
    order = np.lexsort((w.imag, -w.real))
    spark = a.sparkSession
    values = spark.createDataFrame([(k, float(w[o].real), float(w[o].imag)) for k, o in enumerate(order)], "k long, re double, im double")
    v = v[:, order]
    cells = [(i, j, float(v[i, j].real), float(v[i, j].imag)) for i in range(len(v)) for j in range(len(v))]
    return Eigen(values, spark.createDataFrame(cells, "i long, j long, re double, im double"))


def pinv(a: DataFrame) -> DataFrame:
    return coordinates(a.sparkSession, np.linalg.pinv(dense(a)))


@dataclass
class Factors:
    """Left factor in row form, small factors on the driver."""

    left: DataFrame
    small: tuple[np.ndarray, ...]


def _rows_times(df: DataFrame, key: str, columns: list[str], w: np.ndarray, name: str) -> DataFrame:
    made = [sum((F.col(c).cast("double") * float(w[i, k]) for i, c in enumerate(columns)), F.lit(0.0)).alias(f"{name}{k}") for k in range(w.shape[1])]
    return df.select(key, *made)


def svd(df: DataFrame, key: str, columns: list[str]) -> Factors:
    """A = U diag(s) V' of a tall matrix: V and s from the Gram matrix, U = A V / s row by row. Null directions are left out."""
    g, _, _ = gram(df, columns)
    w, v = np.linalg.eigh(g)
    keep = np.argsort(w)[::-1]
    keep = keep[w[keep] > w.max() * 1e-14]
    s, v = np.sqrt(w[keep]), v[:, keep]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return Factors(_rows_times(df, key, columns, v / s, "u"), (s, v))


def qr(df: DataFrame, key: str, columns: list[str]) -> Factors:
    """A = Q R with a positive diagonal in R, by Cholesky of the Gram matrix, done twice for accuracy."""
    g, _, _ = gram(df, columns)
    r1 = np.linalg.cholesky(g).T
    q1 = _rows_times(df, key, columns, np.linalg.inv(r1), "q")
    names = [f"q{k}" for k in range(len(columns))]
    g2, _, _ = gram(q1, names)
    r2 = np.linalg.cholesky(g2).T
    return Factors(_rows_times(q1, key, names, np.linalg.inv(r2), "q"), (r2 @ r1,))


def lstsq(df: DataFrame, columns: list[str], target: str) -> np.ndarray:
    """Least squares without intercept."""
    g, _, _ = gram(df, columns, target)
    return np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
