"""Reading and writing tables, literal tables and generated data sets."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SEARCH_PATH = [".", "data", "datasets"]
# Names of the data sets that may be loaded by name.
DATASETS = ["breast_cancer", "california_housing", "diabetes", "diamonds", "digits", "flights", "iris", "penguins", "tips", "titanic", "wine"]
#: Paths of data sets that lie elsewhere than in the folder given.
REGISTRY: dict[str, str] = {}


def resolve(path: str) -> str:
    """URIs and existing paths as they are; otherwise the first of the local search path that has the file."""
    if "://" in path or os.path.isabs(path):
        return path
    for folder in SEARCH_PATH:
        if os.path.exists(candidate := os.path.join(folder, path)):
            return candidate
    return path


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", skiprows: int = 0, header: int | None = 0, names: list[str] | None = None, index_col: int | None = None, schema=None) -> DataFrame:
    """CSV with values trimmed and NaN read as null.

    ``skiprows`` drops physical lines first; ``header`` is the line of the header among the rest, None for no header
    line. ``names`` replaces column names, ``index_col`` renames that column to ``_index``. Lines are skipped in every
    file, at the start of its first split; quoted values then may not hold line breaks.
    """
    path = resolve(path)
    reader = spark.read.option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("nanValue", "NaN").option("header", header is not None)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    skip = skiprows + (header or 0)
    if skip:
        numbered = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        df = _csv_of_lines(reader, numbered.mapInArrow(_behind(skip), "value string"))
    else:
        df = reader.csv(path)
    if names:
        df = df.toDF(*names)
    if index_col is not None:
        df = df.withColumnRenamed(df.columns[index_col], "_index")
    return nan_to_null(df)


def _behind(skip: int):
    """The lines of each file but the first ``skip``: lines of a split come in order."""

    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            keep = []
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                seen[file] = seen.get(file, 0) + (start == 0)
                keep.append(start > 0 or seen[file] > skip)
            yield pa.RecordBatch.from_arrays([batch.column("value")], names=["value"]).filter(pa.array(keep, pa.bool_()))

    return run


def _csv_of_lines(reader, lines: DataFrame) -> DataFrame:
    """CSV out of a table of lines, without Python."""
    encoder = lines.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    return DataFrame(reader._jreader.csv(getattr(lines._jdf, "as")(encoder)), lines.sparkSession)


def read_json(spark: SparkSession, path: str, *, multiline: bool = False, schema=None) -> DataFrame:
    """JSON lines, or with ``multiline`` a JSON array per file."""
    reader = spark.read.option("multiLine", multiline)
    return nan_to_null((reader.schema(schema) if schema is not None else reader).json(resolve(path)))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def to_csv(df: DataFrame, path: str, *, header: bool = True, single_file: bool = False) -> None:
    """A folder of part files; ``single_file`` writes one file at ``path`` through one task, for small results."""
    if not single_file:
        df.write.mode("overwrite").option("header", header).csv(path)
        return
    spark = df.sparkSession
    df.coalesce(1).write.mode("overwrite").option("header", header).csv(path + ".parts")
    jvm = spark.sparkContext._jvm
    source = jvm.org.apache.hadoop.fs.Path(path + ".parts")
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, True)
    part = next(s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    fs.rename(part, target)
    fs.delete(source, True)


def from_rows(spark: SparkSession, rows: list, columns: list[str], index: list[str] | None = None) -> DataFrame:
    """A literal table with an explicit position and, if given, index labels."""
    fields = [T.StructField("_pos", T.LongType())] + ([T.StructField("_index", T.StringType())] if index else [])
    fields += [T.StructField(c, T.StringType() if any(isinstance(r[i], str) for r in rows) else T.DoubleType()) for i, c in enumerate(columns)]
    made = [(i, *([index[i]] if index else []), *[float(v) if isinstance(v, int) else v for v in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(made, T.StructType(fields))


def load_dataset(spark: SparkSession, name: str, folder: str | None = None) -> DataFrame:
    """A named data set: its path in ``REGISTRY``, else ``<name>.csv`` in ``folder`` or on the local search path.

    The files themselves are not part of this library.
    """
    if name not in REGISTRY and name not in DATASETS:
        raise KeyError(f"no data set {name}; there are {', '.join([*DATASETS, *REGISTRY])}")
    path = REGISTRY.get(name) or (f"{folder.rstrip('/')}/{name}.csv" if folder else f"{name}.csv")
    return spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path)


def hashed_uniform(*parts) -> F.Column:
    """A number in (0, 1) that depends on the parts alone and is the same in other SQL engines (md5)."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, int | str) and not isinstance(p, F.Column) else p for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def hashed_normal(*parts) -> F.Column:
    return F.sqrt(-2 * F.ln(hashed_uniform("u", *parts))) * F.cos(2 * 3.141592653589793 * hashed_uniform("v", *parts))


def make_blobs(spark: SparkSession, n: int, d: int, centers: int, seed: int, spread: float = 1.0) -> DataFrame:
    """Gaussian blobs around centres in [-10, 10]^d: id, x0.., target."""
    base = spark.range(n).withColumn("target", (F.col("id") % centers).cast("int"))
    middle = [20 * hashed_uniform(str(seed), "c", F.col("target").cast("string"), str(j)) - 10 for j in range(d)]
    return base.select("id", *[(middle[j] + spread * hashed_normal(str(seed), F.col("id").cast("string"), str(j))).alias(f"x{j}") for j in range(d)], "target")


def make_regression(spark: SparkSession, n: int, d: int, noise: float, seed: int) -> DataFrame:
    """Linear data with coefficients 1..d and Gaussian noise: id, x0.., target."""
    x = [hashed_normal(str(seed), F.col("id").cast("string"), str(j)) for j in range(d)]
    base = spark.range(n).select("id", *[c.alias(f"x{j}") for j, c in enumerate(x)], (noise * hashed_normal(str(seed), F.col("id").cast("string"), "e")).alias("e"))
    return base.withColumn("target", sum((F.col(f"x{j}") * (j + 1) for j in range(d)), F.col("e"))).drop("e")


def flower_like(spark: SparkSession, n: int = 150, seed: int = 42) -> DataFrame:
    """Three classes of n/3 rows with four measures each, drawn around fixed means: a stand-in for a small labelled set."""
    means = [[5.0, 3.4, 1.5, 0.2], [5.9, 2.8, 4.3, 1.3], [6.6, 3.0, 5.5, 2.0]]
    spread = [0.35, 0.3, 0.3, 0.2]
    base = spark.range(n).withColumn("target", (F.col("id") % 3).cast("int"))
    names = ["sepal_length", "sepal_width", "petal_length", "petal_width"]
    cols = [(F.element_at(F.array(*[F.lit(m[j]) for m in means]), F.col("target") + 1) + spread[j] * hashed_normal(str(seed), F.col("id").cast("string"), str(j))).alias(names[j]) for j in range(4)]
    return base.select("id", *cols, "target")


def data_of(bunch: DataFrame, target: str = "target") -> DataFrame:
    return bunch.drop(target)


def target_of(bunch: DataFrame, target: str = "target") -> DataFrame:
    return bunch.select(target)


def to_rows(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The numeric columns as one array per row, with the row's key: a row-form matrix."""
    return df.select(F.col(key).cast("long").alias("row_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("features"))


def grayscale(red, green, blue) -> F.Column:
    """Luma of a pixel."""
    return 0.299 * F.col(red) + 0.587 * F.col(green) + 0.114 * F.col(blue)
