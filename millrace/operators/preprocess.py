"""Preprocessing: fitted transforms as column expressions, statistics in one aggregate. Constant columns scale to 0."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.frame import with_position
from millrace.operators.quantiles import quantiles


class Transform:
    """``fit`` learns from a DataFrame, ``transform`` adds or replaces columns."""

    def fit(self, df: DataFrame) -> Transform:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class _Scaler(Transform):
    def __init__(self, columns: list[str], suffix: str = ""):
        self.columns, self.suffix = columns, suffix

    def statistics(self, x: Column) -> tuple[Column, Column]:
        raise NotImplementedError

    def fit(self, df):
        wanted = [s.alias(f"{k}{i}") for i, c in enumerate(self.columns) for k, s in zip("ab", self.statistics(F.col(c).cast("double")), strict=True)]
        row = df.agg(*wanted).first()
        self.moments = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(self.columns)}
        return self

    def transform(self, df):
        return df.withColumns({c + self.suffix: F.when(F.col(c).isNotNull(), (F.col(c) - F.lit(a)) / F.lit(b) if b else F.lit(0.0)) for c, (a, b) in self.moments.items()})


class StandardScaler(_Scaler):
    """(x - mean) / population standard deviation."""

    def statistics(self, x):
        return F.avg(x), F.stddev_pop(x)


class MinMaxScaler(_Scaler):
    def statistics(self, x):
        return F.min(x), F.max(x) - F.min(x)


class RobustScaler(_Scaler):
    """(x - median) / interquartile range, exact."""

    def fit(self, df):
        row = quantiles(df, {f"q{i}": F.col(c) for i, c in enumerate(self.columns)}, [0.25, 0.5, 0.75]).first()
        found = [row[f"q{i}"] or [None] * 3 for i in range(len(self.columns))]
        self.moments = {c: (m, None if low is None else high - low) for c, (low, m, high) in zip(self.columns, found, strict=True)}
        return self


class LabelEncoder(Transform):
    """Classes in ascending order to 0..k-1; ``inverse_transform`` undoes it.

    Up to ``few`` classes are part of the plan; more stay a table, which is joined.
    """

    def __init__(self, column: str, out: str = "label", few: int = 10_000):
        self.column, self.out, self.few = column, out, few

    def fit(self, df):
        every = df.select(F.col(self.column).alias("__class")).where(F.col("__class").isNotNull()).distinct()
        found = every.limit(self.few + 1).collect()
        self.classes = sorted(r[0] for r in found) if len(found) <= self.few else None
        self.table = None if self.classes is not None else with_position(every, ["__class"], "__place")
        return self

    def transform(self, df):
        if self.table is not None:
            joined = df.join(self.table, F.col(self.column) == F.col("__class"), "left")
            return joined.withColumn(self.out, F.col("__place").cast("int")).drop("__class", "__place")
        place = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(self.column)) - 1
        return df.withColumn(self.out, F.when(place >= 0, place.cast("int")))

    def inverse_transform(self, df, out: str = "class"):
        if self.table is not None:
            return df.join(self.table, F.col(self.out) == F.col("__place"), "left").withColumn(out, F.col("__class")).drop("__class", "__place")
        return df.withColumn(out, F.get(F.array(*[F.lit(c) for c in self.classes]), F.col(self.out)))


class OneHotEncoder(Transform):
    """One 0/1 column for each class."""

    def __init__(self, column: str):
        self.column = column

    def fit(self, df):
        self.classes = LabelEncoder(self.column).fit(df).classes
        if self.classes is None:
            raise ValueError("a column for each class: more than 10,000 classes are too many")
        return self

    def transform(self, df):
        return df.withColumns({f"{self.column}_{c}": (F.col(self.column) == F.lit(c)).cast("int") for c in self.classes})


class PolynomialFeatures(Transform):
    """All products of the columns up to ``degree``, from the constant 1 on."""

    def __init__(self, columns: list[str], degree: int = 2):
        self.columns, self.degree = columns, degree

    def terms(self) -> list[tuple[str, ...]]:
        return [t for d in range(self.degree + 1) for t in combinations_with_replacement(self.columns, d)]

    def transform(self, df):
        made = {}
        for term in self.terms():
            value = F.lit(1.0)
            for c in term:
                value = value * F.col(c)
            made["poly_" + ("_".join(term) or "1")] = value
        return df.withColumns(made)


class SimpleImputer(Transform):
    """Null and NaN become the mean, the exact median, the most frequent value or a constant."""

    def __init__(self, columns: list[str], strategy: str = "mean", fill_value: float = 0.0):
        self.columns, self.strategy, self.fill_value = columns, strategy, fill_value

    def fit(self, df):
        known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in self.columns}
        if self.strategy == "constant":
            self.values = dict.fromkeys(self.columns, self.fill_value)
        elif self.strategy == "median":
            row = quantiles(df, known, [0.5]).first()
            self.values = {c: row[c][0] if row[c] else None for c in self.columns}
        elif self.strategy == "most_frequent":
            # Counts by value, so that no task holds all values; the least of the most frequent.
            best = F.max(F.struct("count", (-F.col("x")).alias("y")))["y"]
            self.values = {c: None if (y := df.select(x.alias("x")).where("x is not null").groupBy("x").count().agg(best).first()[0]) is None else -y for c, x in known.items()}
        else:
            self.values = df.agg(*[F.avg(x).alias(c) for c, x in known.items()]).first().asDict()
        return self

    def transform(self, df):
        return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(v)) for c, v in self.values.items()})
