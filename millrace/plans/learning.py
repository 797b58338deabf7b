"""Catalogue entries of models, selection, metrics, clustering and sources."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.learning import cluster, metrics, models, neighbours, selection
from millrace.operators import preprocess as pp
from millrace.plans.catalogue import _CENTRED, PLANTED, planted, query, rounded, table
from millrace.sources import tabular
from millrace.storage import scratch

# --- sources ----------------------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    """A new folder for a round trip, shared by driver and executors; it goes with the driver."""
    return f"{scratch(spark, 'trip')}/files"


_NATION = "select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation"


def _longs(df):
    return df.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query(_NATION)
def read_csv_round_trip(spark, d):
    path = _folder(spark)
    tabular.to_csv(table(spark, d, "nation"), path)
    return _longs(tabular.read_csv(spark, path))


@query(_NATION.replace("n_name,", "n_name as _index,"))
def read_csv_options(spark, d):
    path = _folder(spark)
    lines = table(spark, d, "nation").coalesce(1).orderBy("n_nationkey").select(F.concat_ws("; ", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("value"))
    junk = spark.createDataFrame([("junk",), ("more junk",), ("a;b;c",)], "value string").coalesce(1)
    junk.union(lines).coalesce(1).write.text(path)
    return tabular.read_csv(spark, path, sep=";", skiprows=2, names=["n_nationkey", "n_name", "n_regionkey"], index_col=1).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "_index", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query(_NATION)
def read_json_round_trip(spark, d):
    path = _folder(spark)
    table(spark, d, "nation").write.json(path)
    return _longs(tabular.read_json(spark, path))


@query("select * from (values (0::bigint, 'row1', 1.1e0, 2.2e0, 3.3e0), (1, 'row2', 4.4e0, 5.5e0, 6.6e0)) t(_pos, _index, \"A\", \"B\", \"C\")")
def literal_table(spark, d):
    return tabular.from_rows(spark, [[1.1, 2.2, 3.3], [4.4, 5.5, 6.6]], ["A", "B", "C"], ["row1", "row2"])


def _uniform(parts: str) -> str:
    return f"((('0x' || substr(md5({parts}), 1, 8))::bigint::double + 0.5) / 4294967296.0)"


def _normal(parts: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(f'concat_ws(chr(124), chr(117), {parts})')})) * cos(2 * 3.141592653589793 * {_uniform(f'concat_ws(chr(124), chr(118), {parts})')}))"


@query(
    "select id, "
    + ", ".join(f"round(20 * {_uniform(f'''concat_ws('|', '42', 'c', (id % 3)::varchar, '{j}')''')} - 10 + {_normal(f'''42, id::varchar, '{j}' ''')}, 6) as x{j}" for j in range(2))
    + ", (id % 3)::bigint as target from range(100) t(id)"
)
def make_blobs(spark, d):
    return rounded(tabular.make_blobs(spark, 100, 2, 3, 42), 6).withColumn("target", F.col("target").cast("long"))


@query(
    "with x as (select id, " + ", ".join(f"{_normal(f'''42, id::varchar, '{j}' ''')} as x{j}" for j in range(5)) + f", 0.1 * {_normal(''' 42, id::varchar, 'e' ''')} as e from range(100) t(id)) select id, " + ", ".join(f"round(x{j}, 6) as x{j}" for j in range(5)) + ", round(e + x0 + 2 * x1 + 3 * x2 + 4 * x3 + 5 * x4, 6) as target from x"
)
def make_regression(spark, d):
    return rounded(tabular.make_regression(spark, 100, 5, 0.1, 42), 6)


# Means of the measures by class, and their spread.
_MEANS, _SPREAD = [[5.0, 5.9, 6.6], [3.4, 2.8, 3.0], [1.5, 4.3, 5.5], [0.2, 1.3, 2.0]], [0.35, 0.3, 0.3, 0.2]
_MEASURED = ["sepal_length", "sepal_width", "petal_length", "petal_width"]
_FLOWERS = (
    "select id, " + ", ".join(f"round({_MEANS[j]}[(id % 3) + 1]::double + {_SPREAD[j]}::double * {_normal(f"""42, id::varchar, '{j}' """)}, 6) as {n}" for j, n in enumerate(_MEASURED)) + ", (id % 3)::bigint as target from range(150) t(id)"
)


def _flowers(spark):
    return rounded(tabular.flower_like(spark), 6).withColumn("target", F.col("target").cast("long"))


@query(_FLOWERS)
def flower_like(spark, d):
    return _flowers(spark)


@query(f"select * exclude (target) from ({_FLOWERS})")
def bunch_data(spark, d):
    return tabular.data_of(_flowers(spark))


@query(f"select target from ({_FLOWERS})")
def bunch_target(spark, d):
    return tabular.target_of(_flowers(spark))


@query(_NATION)
def load_dataset(spark, d):
    folder = _folder(spark)
    tabular.to_csv(table(spark, d, "nation"), f"{folder}/tips.csv")
    return _longs(tabular.load_dataset(spark, "tips", folder))


# --- splits and metrics -----------------------------------------------------------------------------------------------

_DRAWN = "(select o_orderkey, o_totalprice, row_number() over (order by md5(o_orderkey::varchar || ':42'), o_orderkey) - 1 as r, count(*) over () as n from orders)"


@query(f"select o_orderkey, case when r < ceil(n * 0.3) then 'test' else 'train' end as part from {_DRAWN}")
def train_test_split(spark, d):
    train, test = selection.train_test_split(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.3, 42)
    return train.select("o_orderkey", F.lit("train").alias("part")).union(test.select("o_orderkey", F.lit("test").alias("part")))


@query(f"select o_orderkey, (r % 5)::bigint as fold from {_DRAWN}")
def k_folds(spark, d):
    return selection.with_folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, 42).select("o_orderkey", F.col("fold").cast("long").alias("fold"))


def _judged(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("p"))


_JUDGED = "(select quality as y, (n_chars > 1000)::int as p from labels join documents using (doc_id))"


@query(f"select round(avg((y = p)::int::double), 6) as accuracy from {_JUDGED}")
def accuracy(spark, d):
    return rounded(metrics.accuracy(_judged(spark, d), "y", "p"), 6)


@query(f"with j as {_JUDGED}, c as (select unnest([0, 1]) as k) select a.k as y_true, b.k as y_pred, (select count(*) from j where y = a.k and p = b.k) as n from c a, c b")
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_judged(spark, d), "y", "p")


@query(
    f"with j as {_JUDGED}, c as (select unnest([0, 1]) as class), s as (select class, (select count(*) from j where y = class) as support, (select count(*) from j where p = class) as called, (select count(*) from j where y = class and p = class) as hits from c) "
    "select class, round(coalesce(hits / nullif(called, 0), 0), 6) as precision, round(coalesce(hits / nullif(support, 0), 0), 6) as recall, round(2 * hits / (called + support), 6) as f1, support from s"
)
def classification_report(spark, d):
    return rounded(metrics.classification_report(_judged(spark, d), "y", "p"), 6)


@query("select round(avg(pow(l_extendedprice - l_quantity * 1000, 2)) / 1e6, 4) as mse, round(avg(abs(l_extendedprice - l_quantity * 1000)), 3) as mae, round(1 - sum(pow(l_extendedprice - l_quantity * 1000, 2)) / regr_syy(l_extendedprice, l_extendedprice), 6) as r2 from lineitem")
def regression_scores(spark, d):
    out = metrics.regression_scores(table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("p")), "l_extendedprice", "p")
    return out.select(F.round(F.col("mse") / 1e6, 4).alias("mse"), F.round("mae", 3).alias("mae"), F.round("r2", 6).alias("r2"))


# --- regressors -------------------------------------------------------------------------------------------------------

_X = ["l_quantity", "l_discount"]


def _weights(spark, model):
    return rounded(spark.createDataFrame([(float(model.weights[0]), float(model.weights[1]), model.intercept)], "w0 double, w1 double, intercept double"), 5)


@query(_CENTRED.format("0"))
def linear_regression(spark, d):
    return _weights(spark, models.LinearRegression(_X).fit(planted(spark, d)))


@query(_CENTRED.format("0.1"))
def ridge(spark, d):
    return _weights(spark, models.Ridge(_X, alpha=0.1).fit(planted(spark, d)))


def _fitted(model, data):
    """Scores on the rows a model was fitted on: one row."""
    name = type(model).__name__
    return data.sparkSession.createDataFrame([(name, float(model.fit(data).score(data)))], "model string, score double")


# Both weights differ from 0, so the least point solves two linear equations with the signs put in.
@query(
    f"with t as (select l_quantity as x, l_discount as z, {PLANTED} as y from lineitem), c as (select var_pop(x) as a, covar_pop(x, z) as b, var_pop(z) as c, covar_pop(x, y) - 0.01 as p, covar_pop(z, y) + 0.01 as q, var_pop(y) as v from t), "
    "w as (select *, (p * c - q * b) / (a * c - b * b) as w0, (q * a - p * b) / (a * c - b * b) as w1 from c) "
    "select 'Lasso' as model, round(1 - (v - 2 * (w0 * (p + 0.01) + w1 * (q - 0.01)) + w0 * w0 * a + 2 * w0 * w1 * b + w1 * w1 * c) / v, 6) as score from w where w0 > 0 and w1 < 0"
)
def lasso(spark, d):
    return rounded(_fitted(models.Lasso(_X, alpha=0.01), planted(spark, d)), 6)


def _stump_sql(feature: str, i: int) -> str:
    return f"select {i} as f, v, sum(sy) over w as sl, sum(n) over w as nl from (select {feature} as v, sum(y) as sy, count(*) as n from t group by 1) window w as (order by v)"


@query(
    f"with t as (select l_quantity as x, l_discount as z, {PLANTED} as y from lineitem), s as (select sum(y) as sy, count(*) as n from t), c as ({_stump_sql('x', 0)} union all {_stump_sql('z', 1)}), "
    "best as (select f, v from c, s where nl < n order by sl * sl / nl + (sy - sl) * (sy - sl) / (n - nl) desc limit 1) "
    "select round(avg(y), 4) as prediction, count(*) as n from t, best group by case when f = 0 then x <= v else z <= v end"
)
def decision_tree_stump(spark, d):
    data = planted(spark, d)
    out = models.DecisionTreeRegressor(_X, max_depth=1, max_bins=64).fit(data).predict(data)
    return out.groupBy(F.round("prediction", 4).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query()
def decision_tree_regressor(spark, d):
    return _fitted(models.DecisionTreeRegressor(_X), planted(spark, d))


def _boosted_sql(rounds: int, rate: float) -> str:
    """Boosted stumps: each is fitted on twice the error left, and all but the first are scaled by the rate."""
    parts = [f"t0 as (select l_quantity as x, l_discount as z, {PLANTED} as y, 0e0 as p from lineitem)"]
    for k in range(rounds):
        error, scale = ("y" if k == 0 else "2 * (y - p)"), (1 if k == 0 else rate)
        parts.append(f"e{k} as (select *, {error} as e from t{k}), a{k} as (select sum(e) as sy, count(*) as n from e{k})")
        sides = " union all ".join(f"select {i} as f, v, sum(sy) over w as sl, sum(n) over w as nl from (select {c} as v, sum(e) as sy, count(*) as n from e{k} group by 1) window w as (order by v)" for i, c in enumerate("xz"))
        parts.append(f"c{k} as ({sides}), b{k} as (select f, v from c{k}, a{k} where nl < n order by sl * sl / nl + (sy - sl) * (sy - sl) / (n - nl) desc limit 1)")
        parts.append(f"t{k + 1} as (select x, z, y, p + {scale} * avg(e) over (partition by case when f = 0 then x <= v else z <= v end) as p from e{k}, b{k})")
    return f"with {', '.join(parts)} select round(p, 4) as prediction, count(*) as n from t{rounds} group by 1"


@query(_boosted_sql(1, 0.1))
def random_forest_regressor_stump(spark, d):
    data = planted(spark, d)
    out = models.RandomForestRegressor(_X, n_estimators=1, max_depth=1, max_bins=64, bootstrap=False).fit(data).predict(data)
    return out.groupBy(F.round("prediction", 4).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query(_boosted_sql(3, 0.1))
def gradient_boosting_stumps(spark, d):
    data = planted(spark, d)
    out = models.GradientBoostingRegressor(_X, n_estimators=3, max_depth=1, max_bins=64).fit(data).predict(data)
    return out.groupBy(F.round("prediction", 4).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query()
def random_forest_regressor(spark, d):
    return _fitted(models.RandomForestRegressor(_X, n_estimators=20), planted(spark, d))


@query()
def gradient_boosting_regressor(spark, d):
    return _fitted(models.GradientBoostingRegressor(_X, n_estimators=20), planted(spark, d))


@query()
def svr(spark, d):
    return _fitted(models.SVR(_X, steps=60), planted(spark, d))


@query()
def mlp_regressor(spark, d):
    return _fitted(models.MLPRegressor(_X, max_iter=60), planted(spark, d))


@query()
def autoencoder(spark, d):
    data = planted(spark, d).select("l_quantity", "l_discount", "target")
    return models.Autoencoder(["l_quantity", "l_discount", "target"], hidden=(2,), activation="tanh", max_iter=60).fit(data).predict(data).agg(F.avg("prediction").alias("error"))


# --- classifiers ------------------------------------------------------------------------------------------------------


def _quality(spark, d):
    letters = F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) / F.greatest(F.length("text"), F.lit(1))
    spaces = (F.length("text") - F.length(F.translate("text", " ", ""))) / F.greatest(F.length("text"), F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", letters.alias("letters"), spaces.alias("spaces"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("target")).join(docs, "doc_id")


_Q = ["letters", "spaces"]
_QUALITY = "(select doc_id, quality as target, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) / greatest(length(text), 1) as letters, (length(text) - length(replace(text, ' ', ''))) / greatest(length(text), 1) as spaces from labels join documents using (doc_id))"


@query(
    f"with q as {_QUALITY}, v as (select greatest(max(a), max(b)) * 1e-9 as e from (select var_pop(letters) as a, var_pop(spaces) as b from q group by target)), m as (select target as y, count(*) / (select count(*) from q) as prior, avg(letters) as m0, var_pop(letters) + (select e from v) as v0, avg(spaces) as m1, var_pop(spaces) + (select e from v) as v1 from q group by 1) "
    "select doc_id, arg_max(y, (ln(prior) - 0.5 * ln(2 * pi() * v0) - (letters - m0) * (letters - m0) / (2 * v0) - 0.5 * ln(2 * pi() * v1) - (spaces - m1) * (spaces - m1) / (2 * v1), -y))::bigint as prediction from q, m group by doc_id"
)
def gaussian_nb(spark, d):
    data = _quality(spark, d)
    return models.GaussianNB(_Q).fit(data).predict(data).select("doc_id", F.col("prediction").cast("long").alias("prediction"))


@query()
def decision_tree_classifier(spark, d):
    return _fitted(models.DecisionTreeClassifier(_Q), _quality(spark, d))


def _parts(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_size") / 2).cast("double").alias("a"), F.floor(F.col("p_retailprice") / 100).cast("double").alias("b"))
    return p.withColumn("target", (F.col("a") + F.col("b") + F.col("p_partkey") % 7 > 27).cast("int"))


def _samme_sql(rounds: int) -> str:
    """Weighted stumps by Gini impurity; the weight of what a stump gets wrong grows by the odds that it is right."""
    parts = ["t0 as (select p_partkey as id, floor(p_size / 2) as a, floor(p_retailprice / 100) as b, (floor(p_size / 2) + floor(p_retailprice / 100) + p_partkey % 7 > 27)::int as y, 1e0 as w, 0e0 as votes from part)"]
    for k in range(rounds):
        sides = " union all ".join(f"select {i} as f, v, sum(w0) over o as l0, sum(w1) over o as l1 from (select {c} as v, sum(w * (1 - y)) as w0, sum(w * y) as w1 from t{k} group by 1) window o as (order by v)" for i, c in enumerate("ab"))
        parts.append(f"s{k} as (select sum(w * (1 - y)) as w0, sum(w * y) as w1 from t{k}), c{k} as ({sides})")
        parts.append(f"b{k} as (select f, v from c{k}, s{k} where l0 + l1 < w0 + w1 - 1e-9 order by (l0 * l0 + l1 * l1) / (l0 + l1) + ((w0 - l0) ** 2 + (w1 - l1) ** 2) / (w0 + w1 - l0 - l1) desc limit 1)")
        parts.append(f"j{k} as (select t{k}.*, (sum(w * y) over g > sum(w * (1 - y)) over g)::int as p from t{k}, b{k} window g as (partition by case when f = 0 then a <= v else b <= v end))")
        parts.append(f"e{k} as (select sum(w * (p <> y)::int) / sum(w) as e from j{k})")
        parts.append(f"t{k + 1} as (select id, a, b, y, w * case when p <> y then (1 - e) / e else 1 end as w, votes + ln((1 - e) / e) * (2 * p - 1) as votes from j{k}, e{k})")
    return f"with {', '.join(parts)} select id as p_partkey, (votes > 0)::bigint as prediction from t{rounds}"


@query(_samme_sql(3))
def ada_boost_stumps(spark, d):
    data = _parts(spark, d)
    return models.AdaBoostClassifier(["a", "b"], n_estimators=3).fit(data).predict(data).select("p_partkey", F.col("prediction").cast("long").alias("prediction"))


@query(_samme_sql(1))
def decision_tree_classifier_stump(spark, d):
    data = _parts(spark, d)
    return models.DecisionTreeClassifier(["a", "b"], max_depth=1).fit(data).predict(data).select("p_partkey", F.col("prediction").cast("long").alias("prediction"))


# A forest of one tree on all rows is that tree, and so is the first stump of boosting on two classes.
@query(_samme_sql(1))
def random_forest_classifier_stump(spark, d):
    data = _parts(spark, d)
    return models.RandomForestClassifier(["a", "b"], n_estimators=1, max_depth=1, bootstrap=False).fit(data).predict(data).select("p_partkey", F.col("prediction").cast("long").alias("prediction"))


@query(_samme_sql(1))
def gradient_boosting_classifier_stump(spark, d):
    data = _parts(spark, d)
    return models.GradientBoostingClassifier(["a", "b"], n_estimators=1, max_depth=1).fit(data).predict(data).select("p_partkey", F.col("prediction").cast("long").alias("prediction"))


@query()
def random_forest_classifier(spark, d):
    return _fitted(models.RandomForestClassifier(_Q, n_estimators=20), _quality(spark, d))


def _newton_sql(steps: int, source: str = _QUALITY) -> str:
    """Newton's method for two features and a constant, the 3 x 3 systems solved by Cramer's rule."""
    parts = [f"q as (select target as y, letters as u, spaces as v from {source})", "w0 as (select 0e0 as a, 0e0 as b, 0e0 as c)"]
    for k in range(steps):
        parts.append(f"p{k} as (select y, u, v, 1 / (1 + exp(-(a + b * u + c * v))) as p from q, w{k})")
        parts.append(
            f"s{k} as (select sum(y - p) as g0, sum((y - p) * u) as g1, sum((y - p) * v) as g2, sum(p * (1 - p)) as h00, sum(p * (1 - p) * u) as h01, sum(p * (1 - p) * v) as h02, sum(p * (1 - p) * u * u) as h11, sum(p * (1 - p) * u * v) as h12, sum(p * (1 - p) * v * v) as h22 from p{k})"
        )
        parts.append(f"d{k} as (select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as d from s{k})")
        parts.append(
            f"w{k + 1} as (select a + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / d as a, "
            "b + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / d as b, "
            f"c + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / d as c from w{k}, d{k})"
        )
    return f"with {', '.join(parts)} select 'LogisticRegression' as model, round(avg(((a + b * u + c * v > 0)::int = y)::int::double), 6) as score from q, w{steps}"


@query(_newton_sql(12))
def logistic_regression(spark, d):
    return rounded(_fitted(models.LogisticRegression(_Q, max_iter=500), _quality(spark, d)), 6)


@query()
def gradient_boosting_classifier(spark, d):
    return _fitted(models.GradientBoostingClassifier(_Q, n_estimators=20), _quality(spark, d))


@query()
def ada_boost_classifier(spark, d):
    return _fitted(models.AdaBoostClassifier(_Q, n_estimators=20), _quality(spark, d))


@query()
def svc(spark, d):
    return _fitted(models.SVC(_Q, steps=40), _quality(spark, d))


@query()
def mlp_classifier(spark, d):
    return _fitted(models.MLPClassifier(_Q, max_iter=60), _quality(spark, d))


_NEAREST = "(select q.vec_id as query, e.vec_id as neighbour, e.label, d2, row_number() over (partition by q.vec_id order by d2, e.vec_id) as rank from embeddings q, embeddings e, lateral (select list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::double - e.embedding[i]::double) ** 2)) as d2) where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id)"


@query(f"select query, rank, neighbour, round(d2, 6) as d2 from {_NEAREST} where rank <= 5")
def nearest_neighbours(spark, d):
    e = table(spark, d, "embeddings")
    found = neighbours.nearest(e.where("vec_id % 20 = 0"), e, "embedding", "vec_id", 5, exclude_self=True)
    return found.select("query", F.col("rank").cast("long").alias("rank"), "neighbour", F.round("d2", 6).alias("d2"))


def _embedding_columns(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").alias("target"), *[F.col("embedding")[j].cast("double").alias(f"x{j}") for j in range(64)])


_KNN = _NEAREST.replace(" and q.vec_id <> e.vec_id", "")


@query(f"select vec_id, prediction from (select query as vec_id, label::bigint as prediction, row_number() over (partition by query order by count(*) desc, label) as r from {_KNN} where rank <= 5 group by query, label) where r = 1")
def k_neighbors_classifier(spark, d):
    e = _embedding_columns(spark, d)
    model = models.KNeighborsClassifier([f"x{j}" for j in range(64)], k=5, key="vec_id").fit(e)
    return model.predict(e.where("vec_id % 20 = 0")).select("vec_id", F.col("prediction").cast("long").alias("prediction"))


@query(f"select query as vec_id, round(avg(label), 6) as prediction from {_KNN} where rank <= 5 group by query")
def k_neighbors_regressor(spark, d):
    e = _embedding_columns(spark, d)
    model = models.KNeighborsRegressor([f"x{j}" for j in range(64)], k=5, key="vec_id").fit(e)
    return model.predict(e.where("vec_id % 20 = 0")).select("vec_id", F.round("prediction", 6).alias("prediction"))


# --- clusters and components ------------------------------------------------------------------------------------------


def _suppliers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_nationkey") / 5.0).cast("double").alias("y"))


_S = "select s_suppkey, s_acctbal / 1000 as x, s_nationkey / 5e0 as y from supplier"


def _lloyd_sql(steps: int) -> str:
    parts, centres = [f"s as ({_S})", "c0 as (select * from (values (0, 0e0, 1e0), (1, 5e0, 2e0), (2, 9e0, 4e0)) t(k, cx, cy))"], "c0"
    for i in range(steps + 1):
        parts.append(f"a{i} as (select s_suppkey, any_value(x) as x, any_value(y) as y, arg_min(k, ((x - cx) * (x - cx) + (y - cy) * (y - cy), k)) as k from s, {centres} group by s_suppkey)")
        if i < steps:
            parts.append(f"c{i + 1} as (select k, avg(x) as cx, avg(y) as cy from a{i} group by k)")
            centres = f"c{i + 1}"
    return f"with {', '.join(parts)} select s_suppkey, k::bigint as cluster from a{steps}"


@query(_lloyd_sql(3))
def kmeans_lloyd(spark, d):
    s = _suppliers(spark, d)
    centres = cluster.lloyd(s, ["x", "y"], [[0.0, 1.0], [5.0, 2.0], [9.0, 4.0]], 3)
    return cluster.assign(s, ["x", "y"], centres).select("s_suppkey", F.col("cluster").cast("long").alias("cluster"))


@query(f"select cluster as prediction, count(*) as n from ({_lloyd_sql(4)}) group by 1")
def kmeans_given_centres(spark, d):
    s = _suppliers(spark, d)
    model = cluster.KMeans(["x", "y"], 3, max_iter=4, centres=[[0.0, 1.0], [5.0, 2.0], [9.0, 4.0]]).fit(s)
    return model.predict(s).groupBy(F.col("prediction").cast("long").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


@query()
def kmeans(spark, d):
    s = _suppliers(spark, d)
    return cluster.KMeans(["x", "y"], 3).fit(s).predict(s).groupBy("prediction").count()


@query(
    f"with recursive s as ({_S}), near as (select a.s_suppkey as p, b.s_suppkey as q from s a, s b where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.64), "
    "core as (select p from near group by p having count(*) >= 4), edges as (select p, q from near where p in (select p from core) and q in (select p from core)), "
    "reach as (select p, p as root from core union select e.p, r.root from edges e join reach r on e.q = r.p), "
    "lab as (select p, min(root) as root from reach group by p), ids as (select root, dense_rank() over (order by root) - 1 as label from (select distinct root from lab)), "
    "bord as (select n.p, min(l.root) as root from near n join lab l on n.q = l.p group by n.p) "
    "select s_suppkey, coalesce(i.label, -1)::bigint as label, (lab.p is not null) as core from s left join lab on s_suppkey = lab.p left join bord on s_suppkey = bord.p left join ids i on i.root = coalesce(lab.root, bord.root)"
)
def dbscan(spark, d):
    return cluster.DBSCAN(["x", "y"], 0.8, 4, "s_suppkey").fit(_suppliers(spark, d))


@query(
    f"with s as ({_S}), c as (select var_samp(x) as a, covar_samp(x, y) as b, var_samp(y) as d, avg(x) as mx, avg(y) as my from s), e as (select *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) as l from c), v as (select *, b / sqrt(b * b + (l - a) * (l - a)) as v0, (l - a) / sqrt(b * b + (l - a) * (l - a)) as v1 from e), w as (select *, case when abs(v0) >= abs(v1) then sign(v0) else sign(v1) end as sg from v) "
    "select s_suppkey, round(sg * ((x - mx) * v0 + (y - my) * v1), 5) as pc0 from s, w"
)
def pca(spark, d):
    s = _suppliers(spark, d)
    return cluster.PCA(["x", "y"], 1).fit(s).transform(s).select("s_suppkey", F.round("pc0", 5).alias("pc0"))


# --- tuning -----------------------------------------------------------------------------------------------------------


def _folded_sql(alpha: str) -> str:
    """R squared of ridge regression on every fold, fitted on the others."""
    return (
        f"with t as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as key, l_quantity as x, l_discount as z, {PLANTED} as y from lineitem), f as (select x, z, y, (row_number() over (order by md5(key || ':42'), key) - 1) % 3 as fold from t), "
        f"g as (select v.fold, regr_sxx(x, x) + {alpha} as xx, count(*) * covar_pop(x, z) as xz, regr_sxx(z, z) + {alpha} as zz, count(*) * covar_pop(x, y) as xy, count(*) * covar_pop(z, y) as zy, avg(x) as mx, avg(z) as mz, avg(y) as my from (select distinct fold from f) v join f on f.fold <> v.fold group by 1), "
        "w as (select fold, mx, mz, my, (xy * zz - zy * xz) / (xx * zz - xz * xz) as w0, (zy * xx - xy * xz) / (xx * zz - xz * xz) as w1 from g) "
        "select fold::bigint as fold, 1 - sum((y - my - w0 * (x - mx) - w1 * (z - mz)) ** 2) / regr_syy(y, y) as score from f join w using (fold) group by 1"
    )


def _keyed(spark, d):
    return planted(spark, d).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


@query(f"select fold, round(score, 6) as score from ({_folded_sql('0')})")
def cross_val_score(spark, d):
    scores = selection.cross_val_score(lambda: models.LinearRegression(_X), _keyed(spark, d), "key", 3)
    return rounded(spark.createDataFrame(list(enumerate(scores)), "fold long, score double"), 6)


@query(" union all ".join(f"select {a}::double as alpha, round(avg(score), 6) as score from ({_folded_sql(a)})" for a in ("0.5", "20", "500")))
def grid_search_ridge(spark, d):
    found = selection.GridSearchCV(lambda **p: models.Ridge(_X, **p), {"alpha": [0.5, 20.0, 500.0]}, cv=3).fit(_keyed(spark, d), "key")
    return rounded(spark.createDataFrame([(p["alpha"], s) for s, p in found.results], "alpha double, score double"), 6)


@query()
def grid_search(spark, d):
    data = _quality(spark, d)
    found = selection.GridSearchCV(lambda **p: models.RandomForestClassifier(_Q, **p), {"n_estimators": [5, 10], "max_depth": [3, 5]}, cv=3, n_jobs=2).fit(data, "doc_id")
    return spark.createDataFrame([(json.dumps(p), s) for s, p in found.results], "params string, score double")


_HOLED = f"(select target, spaces, coalesce(l, median(l) over ()) as letters from (select *, case when doc_id % 9 > 0 then letters end as l from {_QUALITY}))"


# Scaling does not change what logistic regression predicts.
@query(_newton_sql(12, _HOLED).replace("'LogisticRegression'", "'Pipeline'"))
def pipeline_fit(spark, d):
    data = _quality(spark, d).withColumn("letters", F.when(F.col("doc_id") % 9 > 0, F.col("letters")))
    steps = [pp.SimpleImputer(_Q, "median"), pp.StandardScaler(_Q), models.LogisticRegression(_Q, max_iter=500)]
    return rounded(_fitted(selection.Pipeline(steps), data), 6)
