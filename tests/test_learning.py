import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import arrays
from millrace.learning import cluster, gradient, metrics, models, selection
from millrace.operators import linalg, preprocess as pp
from millrace.plans import learning
from millrace.sources import tabular

FOUR = ["sepal_length", "sepal_width", "petal_length", "petal_width"]


@pytest.fixture(scope="module")
def flowers(spark):
    df = tabular.flower_like(spark).coalesce(2).persist()
    return selection.train_test_split(df, "id", 0.3, 42)


FLOORS = [
    (models.DecisionTreeClassifier, {}, 0.5),
    (models.RandomForestClassifier, {}, 0.5),
    (models.KNeighborsClassifier, {"k": 5}, 0.9),
    (models.GaussianNB, {}, 0.5),
    (models.LogisticRegression, {}, 0.3),
    (models.SVC, {}, 0.9),
    (models.GradientBoostingClassifier, {"n_estimators": 5}, 0.5),
    (models.AdaBoostClassifier, {"n_estimators": 8, "max_depth": 2}, 0.5),
    (models.MLPClassifier, {"max_iter": 120}, 0.95),
]


@pytest.mark.parametrize("model,params,floor", FLOORS, ids=lambda x: getattr(x, "__name__", None))
def test_classifier_floors(flowers, model, params, floor):
    train, test = flowers
    assert (train.count(), test.count()) == (105, 45)
    assert model(FOUR, **params).fit(train).score(test) >= floor


@pytest.mark.parametrize(
    "model,params,floor",
    [
        (models.LinearRegression, {}, 0.6),
        (models.Ridge, {"alpha": 0.1}, 0.6),
        (models.Lasso, {"alpha": 0.01}, 0.6),
        (models.SVR, {}, 0.5),
        (models.GradientBoostingRegressor, {}, 0.0),
        (models.DecisionTreeRegressor, {}, 0.3),
        (models.RandomForestRegressor, {}, 0.3),
        (models.KNeighborsRegressor, {"k": 5, "weights": "distance"}, 0.3),
        (models.MLPRegressor, {"max_iter": 120}, 0.5),
    ],
    ids=lambda x: getattr(x, "__name__", None),
)
def test_regressor_floors(flowers, model, params, floor):
    train, test = flowers
    assert model(FOUR[:2], "petal_length", **params).fit(train).score(test) > floor


def test_linear_algebra_closed_forms(spark):
    a, b = arrays.array(spark, [[1, 2], [3, 4]]), arrays.array(spark, [5, 6])
    assert abs(linalg.det(a) + 2) < 1e-9 and linalg.trace(a).first()[0] == 5
    assert [round(x, 9) for x in linalg.norms(a).first()] == [round(30**0.5, 9), 6, 7]
    assert np.allclose(linalg.dense(linalg.solve(a, b)).ravel(), [-4, 4.5])
    assert np.allclose(linalg.dense(linalg.matmul(a, a)), [[7, 10], [15, 22]])
    assert np.allclose(linalg.dense(linalg.matmul(a, linalg.inv(a))), np.eye(2)) and linalg.matrix_rank(a) == 2
    with pytest.raises(ValueError):
        linalg.cholesky(a)
    with pytest.raises(np.linalg.LinAlgError):
        linalg.inv(arrays.array(spark, [[1, 2], [2, 4]]))
    v = arrays.reduce_all(arrays.array(spark, [10, 20, 30, 40, 50]), "v", "i").first()
    assert v["mean"] == 30 and round(v["std"], 4) == 15.8114 and (v["argmin"], v["argmax"]) == (0, 4) and v["prod"] == 12e6


def test_tall_decompositions(spark):
    x = np.random.default_rng(0).normal(size=(60, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    f = linalg.qr(df, "id", ["a", "b", "c"])
    q = np.array([r[1:] for r in f.left.orderBy("id").collect()])
    assert np.allclose(q @ f.small[0], x) and np.allclose(q.T @ q, np.eye(3)) and (np.diag(f.small[0]) > 0).all()
    g = linalg.svd(df, "id", ["a", "b", "c"])
    u = np.array([r[1:] for r in g.left.orderBy("id").collect()])
    assert np.allclose(u * g.small[0] @ g.small[1].T, x) and np.allclose(g.small[0], np.linalg.svd(x)[1])
    p = cluster.PCA(["a", "b", "c"], 2).fit(df)
    assert np.allclose(p.explained_variance, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2])


def test_confusion_of_known_vectors(spark):
    truth = [0] * 10 + [1] * 10 + [2] * 10
    said = [0] * 9 + [1] + [1] * 9 + [2] + [1] + [2] * 9
    df = spark.createDataFrame(list(zip(truth, said, strict=True)), "y int, p int")
    assert [r.n for r in metrics.confusion_matrix(df, "y", "p").orderBy("y_true", "y_pred").collect()] == [9, 1, 0, 0, 9, 1, 0, 1, 9]
    assert metrics.accuracy(df, "y", "p").first()[0] == 0.9
    assert list(metrics.regression_scores(df, "y", "y").first()) == [0, 0, 1]
    assert "|" in metrics.print_confusion_matrix(df, "y", "p")


def test_selection(flowers):
    train, _ = flowers
    assert len(selection.cross_val_score(lambda: models.GaussianNB(FOUR), train, "id", 3)) == 3
    grid = selection.GridSearchCV(lambda **p: models.DecisionTreeClassifier(FOUR, **p), {"max_depth": [1, 4]}, cv=2, n_jobs=2).fit(train, "id")
    assert grid.best_score > 0.5 and grid.best_params["max_depth"] == 4
    holes = train.withColumn("petal_width", F.when(F.col("id") % 7 > 0, F.col("petal_width")))
    pipe = selection.Pipeline([pp.SimpleImputer(FOUR), pp.StandardScaler(FOUR), models.LogisticRegression(FOUR)])
    assert pipe.fit(holes).score(train) > 0.8 and pipe.predict(train).count() == 105


def test_clusters(flowers):
    train, _ = flowers
    assert cluster.KMeans(FOUR, 3).fit(train).predict(train).select("prediction").distinct().count() == 3
    d = cluster.DBSCAN(FOUR[:2], 0.6, 4)
    assert d.fit(train).count() == 105 and d.n_clusters >= 1


def test_autoencoder_and_factory(flowers):
    train, _ = flowers
    error = models.Autoencoder(FOUR, hidden=(2,), activation="tanh", max_iter=80).fit(train).predict(train).agg(F.avg("prediction")).first()[0]
    assert error < 0.7
    assert isinstance(models.make("tree", "classifier", FOUR, max_depth=3), models.DecisionTreeClassifier)


def test_queries_have_the_sizes_of_the_reference(monkeypatch):
    fitted, searched = [], []

    class Search:
        results = []

        def __init__(self, make, grid, **options):
            searched.append((grid, options["cv"]))

        def fit(self, *_):
            return self

    class Session:
        def createDataFrame(self, *_):
            return None

    monkeypatch.setattr(learning, "_fitted", lambda model, _: fitted.append(model))
    monkeypatch.setattr(learning, "_quality", lambda *_: None)
    monkeypatch.setattr(learning, "planted", lambda *_: None)
    monkeypatch.setattr(selection, "GridSearchCV", Search)
    for f in (learning.random_forest_regressor, learning.gradient_boosting_regressor, learning.random_forest_classifier, learning.gradient_boosting_classifier, learning.ada_boost_classifier):
        f(None, "")
    assert [m.n if hasattr(m, "n") else m.params["n_estimators"] for m in fitted] == [20] * 5
    learning.grid_search(Session(), "")
    assert searched == [({"n_estimators": [5, 10], "max_depth": [3, 5]}, 3)]


def test_parameters_are_honoured_or_refused(spark, flowers):
    train, _ = flowers
    whole = models.DecisionTreeClassifier(FOUR, min_samples_split=400).fit(train).model
    assert whole.depth == 0 and models.DecisionTreeClassifier(FOUR, min_samples_split=2).fit(train).model.depth > 0
    assert models.RandomForestClassifier(FOUR, n_estimators=3, n_jobs=-1).params["n_estimators"] == 3
    with pytest.raises(TypeError, match="max_dept"):
        models.RandomForestClassifier(FOUR, max_dept=3)


def test_polynomial_kernel(spark, flowers):
    lift, n = gradient.kernel("poly", 3, 0.5, 3, 0, 0)
    x, z = np.random.default_rng(0).normal(size=(2, 5, 3))
    assert np.allclose(lift(x) @ lift(z).T + 1, (0.5 * x @ z.T + 1) ** 3) and lift(x).shape[1] == n
    ring = [(i, float(np.cos(i) * r), float(np.sin(i) * r), int(r > 1)) for i in range(60) for r in (0.5, 2.0)]
    df = spark.createDataFrame(ring, "id long, a double, b double, target int")
    assert models.SVC(["a", "b"], kernel="poly", degree=2).fit(df).score(df) > 0.95 > models.SVC(["a", "b"], kernel="linear").fit(df).score(df)
    with pytest.raises(ValueError):
        models.SVC(["a", "b"], kernel="cubic").fit(df)


def test_complex_eigenvectors(spark):
    a = np.array([[0.0, -2.0], [1.0, 0.5]])
    e = linalg.eig(arrays.array(spark, a.tolist()))
    w = np.array([complex(r.re, r.im) for r in e.values.orderBy("k").collect()])
    v = np.zeros((2, 2), complex)
    for r in e.vectors.collect():
        v[r.i, r.j] = complex(r.re, r.im)
    assert np.allclose(a @ v, v * w) and abs(w[0].imag) > 1


def test_sums_of_many_partitions_and_columns(spark):
    x = np.random.default_rng(3).normal(size=(500, 20))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{j} double" for j in range(20))).repartition(70)
    g, m, n = linalg.gram(df, df.columns)
    assert np.allclose(g, x.T @ x) and np.allclose(m, x.mean(axis=0)) and n == 500
    few, _, _ = linalg.gram(df, df.columns[:3])
    assert np.allclose(few, (x.T @ x)[:3, :3])
    value, grad, rows = gradient.gradient_sum(gradient.matrix(df, df.columns[:2], ["c2"]), lambda x, y, t: (float(y.sum()), x.sum(axis=0)), np.zeros(2))
    assert np.allclose([value, *grad], [x[:, 2].sum(), *x[:, :2].sum(axis=0)]) and rows == 500


def test_settings():
    s = session.Settings(share=0.5, threads=None)
    assert s.resolve(3) == 3 and s.resolve(-1) >= 1 and s.resolve() >= 1
    s.threads = 7
    assert s.as_dict()["resolved"] == 7
    s.reset()
    assert s.threads is None and s.share == 0.6
