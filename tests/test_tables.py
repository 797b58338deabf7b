import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import frame, preprocess as pp, quantiles
from millrace.sources import tabular


@pytest.fixture(scope="module")
def edge(spark):
    """Null, NaN, a constant, ties, a group of one."""
    return spark.createDataFrame([(1, 1.0, 5.0, "a"), (2, None, 5.0, "a"), (3, float("nan"), 5.0, "b"), (4, 2.0, 5.0, "c"), (5, 2.0, 5.0, "c")], "id long, x double, same double, g string")


def test_csv_round_trip_single_file(spark, tmp_path, edge):
    path = str(tmp_path / "out.csv")
    tabular.to_csv(edge, path, single_file=True)
    assert (tmp_path / "out.csv").is_file()
    back = tabular.read_csv(spark, path)
    assert frame.shape(back) == (5, 4) and back.where("x is null").count() == 2


def test_messy_csv(spark, tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text("junk\nmore\nId;Age;Salary\nUSR1; 25; 1000.5\nUSR2; 30; 2000.0\nUSR3; 22; 1500.2\n")
    df = tabular.read_csv(spark, str(path), sep=";", skiprows=2, index_col=0, names=["id", "age", "pay"])
    assert frame.loc(df, "USR3").first().asDict() == {"_index": "USR3", "age": 22, "pay": 1500.2}


def test_lines_are_skipped_in_every_file(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"part{n}.csv").write_text(f"junk {n}\nid,v\n{n},{n}.5\n{n + 10},1.5\n")
    df = tabular.read_csv(spark, str(tmp_path), skiprows=1)
    assert sorted(map(tuple, df.collect())) == [(n + k, v) for k, f in ((0, None), (10, 1.5)) for n in range(3) for v in [n + 0.5 if f is None else f]]
    assert dict(df.dtypes) == {"id": "int", "v": "double"}


def test_datasets_by_name(spark, tmp_path):
    (tmp_path / "tips.csv").write_text("a,b\n1,x\n")
    assert tabular.load_dataset(spark, "tips", str(tmp_path)).collect()[0] == (1, "x")
    with pytest.raises(KeyError):
        tabular.load_dataset(spark, "unknown")


def test_paths_of_the_local_search_path(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "x.csv").write_text("a\n1\n")
    assert tabular.resolve("x.csv") == "data/x.csv" and tabular.resolve("y.csv") == "y.csv" and tabular.resolve("s3://b/x.csv") == "s3://b/x.csv"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 100, 30_000])
def test_quantiles_are_exact(spark, n, monkeypatch):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.3, rng.integers(0, 4, n), rng.normal(0, 50, n))
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 3, n), "v": values, "t": rng.integers(0, 3, n).astype(float)})).repartition(5)
    got = {r.g: r for r in quantiles.quantiles(df, {"v": F.col("v"), "t": F.col("t"), "none": F.lit(None)}, [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).collect()}
    local = df.toPandas()
    assert set(got) == set(local.g)
    for g, part in local.groupby("g"):
        for c in ("v", "t"):
            assert np.allclose(got[g][c], np.quantile(part[c], [0.0, 0.25, 0.5, 0.9, 1.0]))
        assert got[g]["none"] == [None] * 5
    monkeypatch.setattr(quantiles, "ACCURACY", 20)  # wide brackets
    assert np.allclose(quantiles.quantiles(df, {"v": F.col("v")}, [0.25, 0.5, 0.75]).first().v, np.quantile(local.v, [0.25, 0.5, 0.75]))


def test_statistics_of_an_empty_table(spark, edge):
    none = edge.limit(0)
    assert quantiles.quantiles(none, {"x": F.col("x")}, [0.5]).first().x is None
    assert frame.describe(none, ["x"]).first().p50 is None and frame.describe(none, ["x"], ["g"]).count() == 0
    assert pp.RobustScaler(["x"]).fit_transform(none).count() == pp.SimpleImputer(["x"], "median").fit_transform(none).count() == 0
    assert frame.with_position(none, ["id"]).count() == 0


def test_more_classes_than_the_plan_holds(spark):
    df = spark.range(500).select("id", F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("c")).union(spark.createDataFrame([(1, None)], "id long, c string"))
    e = pp.LabelEncoder("c", few=20)
    coded = e.fit_transform(df)
    assert sorted((r.id, r.label) for r in coded.collect() if r.c) == [(i, i) for i in range(500)]
    assert [r.label for r in coded.collect() if r.c is None] == [None]
    assert sorted((r.id, r["class"]) for r in e.inverse_transform(coded).where("c is not null").collect()) == [(i, f"c{i:03d}") for i in range(500)]


def test_json_array(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert tabular.read_json(spark, str(path), multiline=True).count() == 2


def test_missing_values(edge):
    assert [r.id for r in frame.dropna(edge).orderBy("id").collect()] == [1, 4, 5]
    assert [r.x for r in frame.fillna(edge, 0.0).orderBy("id").collect()] == [1.0, 0.0, 0.0, 2.0, 2.0]
    assert frame.fillna(edge, 0).where("g = '0'").count() == 0


def test_positions(spark, edge):
    got = frame.with_position(edge.withColumn("x", F.nanvl("x", F.lit(None))), ["x", "id"]).orderBy("_pos").collect()
    assert [r.id for r in got] == [1, 4, 5, 2, 3] and [r._pos for r in got] == list(range(5))
    many = spark.range(5000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(97)))
    assert [r._pos for r in frame.with_position(many, ["k", "id"], buckets=7).orderBy("k", "id").collect()] == list(range(5000))


def test_describe_of_constant_and_single(edge):
    got = {r["column"]: r for r in frame.describe(edge.where("id = 1"), ["x", "same"]).collect()}
    assert got["x"]["std"] is None and got["same"]["p50"] == 5.0
    assert [r["count"] for r in frame.approximate_describe(edge, ["same"]).collect()] == [5]


@pytest.mark.parametrize("scaler", [pp.StandardScaler, pp.MinMaxScaler, pp.RobustScaler])
def test_constant_columns_scale_to_zero(edge, scaler):
    assert {r.same for r in scaler(["same"]).fit_transform(edge).collect()} == {0.0}


def test_imputer_strategies(edge):
    for strategy, want in (("mean", 5 / 3), ("median", 2.0), ("most_frequent", 2.0), ("constant", 7.0)):
        out = pp.SimpleImputer(["x"], strategy, 7.0).fit_transform(edge)
        assert abs(out.where("id = 3").first().x - want) < 1e-12


def test_polynomial_and_codes(spark, edge):
    p = pp.PolynomialFeatures(["a", "b"]).transform(spark.createDataFrame([(2.0, 3.0)], "a double, b double")).first()
    assert [p[c] for c in ("poly_1", "poly_a", "poly_b", "poly_a_a", "poly_a_b", "poly_b_b")] == [1, 2, 3, 4, 6, 9]
    e = pp.LabelEncoder("g")
    assert [r["class"] for r in e.inverse_transform(e.fit_transform(edge)).orderBy("id").collect()] == ["a", "a", "b", "c", "c"]


def test_drop_duplicates_keeps_first(edge):
    assert sorted(r.id for r in frame.drop_duplicates(edge, ["g"], "id").collect()) == [1, 3, 4]


def test_stream(spark, tmp_path):
    from millrace.streaming.grouped import windowed_stats

    src = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(src).schema
    spark.read.parquet(src).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = windowed_stats(stream, "ts", "value", ["event_type"]).writeStream.format("memory").queryName("stats").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert spark.sql("select sum(count) from stats").first()[0] == spark.read.parquet(src).count()
    finally:
        q.stop()
