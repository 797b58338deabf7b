"""Element-wise functions on columns; division and logarithms outside their domain give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def add(a, b) -> Column:
    return _c(a) + _c(b)


def subtract(a, b) -> Column:
    return _c(a) - _c(b)


def multiply(a, b) -> Column:
    return _c(a) * _c(b)


def divide(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def power(a, n) -> Column:
    return F.pow(_c(a), _c(n))


def sqrt(a) -> Column:
    return F.sqrt(_c(a))


def exp(a) -> Column:
    return F.exp(_c(a))


def log(a) -> Column:
    return F.ln(_c(a))


def sin(a) -> Column:
    return F.sin(_c(a))


def cos(a) -> Column:
    return F.cos(_c(a))


def tan(a) -> Column:
    return F.tan(_c(a))


def absolute(a) -> Column:
    return F.abs(_c(a))


def negate(a) -> Column:
    return -_c(a)


BINARY = {"add": add, "subtract": subtract, "multiply": multiply, "divide": divide}


def rowwise(op: str, a: str, b) -> Column:
    """A binary function on row-form arrays, or an array and a scalar."""
    f = BINARY[op]
    if isinstance(b, str):
        return F.zip_with(a, b, f)
    return F.transform(a, lambda x: f(x, b))


def cellwise(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """A binary function on coordinate-form matrices (i, j, v); absent cells are missing, not zero."""
    other = b.select("i", "j", F.col("v").alias("w"))
    return a.join(other, ["i", "j"]).select("i", "j", BINARY[op]("v", "w").alias("v"))
