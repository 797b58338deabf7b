"""The query catalogue: every operator applied to whole tables, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions import arrays, elementwise as ew
from millrace.operators import frame, linalg, plotting, preprocess as pp
from millrace.sources import tabular

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n, t in df.dtypes if t in ("double", "float")})


def rounds(sql: str, names: str, places: int = 4) -> str:
    """``sql`` with the named columns rounded."""
    return f"select * replace ({', '.join(f'round({n}, {places}) as {n}' for n in names.split())}) from ({sql})"


PROFILE = "count({c}) as count, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, quantile_cont({c}, 0.25) as p25, quantile_cont({c}, 0.5) as p50, quantile_cont({c}, 0.75) as p75, max({c}) as max"
MOMENTS = "mean std min p25 p50 p75 max"


def profile_sql(name: str, source: str, by: str = "") -> str:
    return f"select {by + ', ' if by else ''}'{name}' as \"column\", {PROFILE.format(c=f'{name}::double')} from {source} {'group by ' + by if by else ''}"


# --- profiles and groups -------------------------------------------------------------------------------------------

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query(rounds(" union all ".join(profile_sql(c, "lineitem", "l_returnflag") for c in _MEASURES), MOMENTS))
def describe_lineitem(spark, d):
    return rounded(frame.describe(table(spark, d, "lineitem").select("l_returnflag", *_MEASURES), _MEASURES, ["l_returnflag"]))


@query(rounds(" union all ".join(profile_sql(c, "part") for c in ("p_size", "p_retailprice")), MOMENTS))
def describe_part(spark, d):
    return rounded(frame.describe(table(spark, d, "part").select("p_size", "p_retailprice")))


@query(rounds(f"select {PROFILE.format(c='value')}, sum(value) as sum, var_samp(value) as var, count(distinct value) as n_unique from events", MOMENTS + " sum var", 3))
def series_stats(spark, d):
    return rounded(frame.series_stats(table(spark, d, "events"), "value"), 3)


def _corr_sql(columns: list[str], source: str) -> str:
    return " union all ".join(f"select '{a}' as c1, '{b}' as c2, round(corr({a}::double, {b}::double), 6) as r from {source}" for a in columns for b in columns)


@query(_corr_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem"))
def corr_lineitem(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(frame.corr(table(spark, d, "lineitem").select(*names), names), 6)


@query(
    rounds(
        "select l_returnflag, l_linestatus, count(l_quantity) as l_quantity_count, sum(l_quantity) as l_quantity_sum, avg(l_quantity) as l_quantity_mean, min(l_quantity) as l_quantity_min, max(l_quantity) as l_quantity_max, stddev_samp(l_quantity) as l_quantity_std from lineitem group by all",
        "l_quantity_sum l_quantity_mean l_quantity_std",
    )
)
def groupby_stats(spark, d):
    return rounded(frame.groupby(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"]))


@query("select c_nationkey, count(c_acctbal) as c_acctbal_count, round(median(c_acctbal), 4) as c_acctbal_median, round(var_samp(c_acctbal), 3) as c_acctbal_var from customer group by 1")
def groupby_median(spark, d):
    out = frame.groupby(table(spark, d, "customer"), "c_nationkey", ["c_acctbal"], ("count", "median", "var"))
    return out.withColumns({"c_acctbal_median": F.round("c_acctbal_median", 4), "c_acctbal_var": F.round("c_acctbal_var", 3)})


# --- selection -----------------------------------------------------------------------------------------------------


@query("select count(*) as n_rows, 3::bigint as n_cols from orders")
def shape(spark, d):
    return frame.shape_frame(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 10")
def head(spark, d):
    return frame.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, ["o_orderkey"])


@query("select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 10")
def tail(spark, d):
    return frame.tail(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 10, ["o_orderkey"])


_POSITIONS = "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice nulls last, o_orderkey) - 1 as _pos from orders"


@query(_POSITIONS)
def sort_values(spark, d):
    return frame.with_position(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@query(f"select * from ({_POSITIONS}) where _pos = 7")
def iloc(spark, d):
    return frame.iloc(sort_values(spark, d), 7)


@query(f"select o_orderkey, _pos from ({_POSITIONS}) where _pos >= 100 and _pos < 200")
def iloc_slice(spark, d):
    return frame.iloc(sort_values(spark, d), 100, 200, [0, 2])


@query(f"select o_totalprice from ({_POSITIONS}) where _pos = 3")
def cell(spark, d):
    return frame.cell(sort_values(spark, d), "o_totalprice", 3)


@query("select * from customer where c_name = (select c_name from customer where c_custkey = 7)")
def loc_label(spark, d):
    customers = table(spark, d, "customer")
    label = customers.where("c_custkey = 7").first()["c_name"]
    return frame.loc(customers, label, "c_name")


@query("select c_custkey, c_acctbal from customer where c_custkey between 100 and 250")
def loc_slice(spark, d):
    return frame.loc_between(table(spark, d, "customer"), 100, 250, ["c_custkey", "c_acctbal"], "c_custkey")


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount from lineitem where l_quantity > 45 and l_discount = 0.1")
def filter_predicate(spark, d):
    return frame.where(table(spark, d, "lineitem"), "l_quantity > 45 and l_discount = 0.1").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")


@query("select p_brand from part")
def column(spark, d):
    return frame.column(table(spark, d, "part"), "p_brand")


@query("select s_suppkey, s_nationkey from supplier")
def drop_columns(spark, d):
    return frame.drop(table(spark, d, "supplier"), "s_name", "s_acctbal")


@query("select distinct l_returnflag, l_linestatus from lineitem")
def drop_duplicates(spark, d):
    return frame.drop_duplicates(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"))


@query("select text, min(doc_id) as doc_id from documents group by text")
def drop_duplicates_first(spark, d):
    return frame.drop_duplicates(table(spark, d, "documents").select("text", "doc_id"), ["text"], "doc_id")


def _holes(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.nullif("l_tax", F.lit(0.0)).alias("tax"))


_HOLES = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, nullif(l_tax, 0.0) as tax from lineitem"


@query(f"select * from ({_HOLES}) where tax is not null")
def dropna(spark, d):
    return frame.dropna(_holes(spark, d))


@query(f"select * replace (coalesce(tax, -1e0) as tax) from ({_HOLES})")
def fillna(spark, d):
    return frame.fillna(_holes(spark, d), -1.0)


# --- element-wise functions and reductions --------------------------------------------------------------------------


@query("select event_id, round(value + 1.5e0, 6) as added, round(value - event_id, 6) as subtracted, round(value * value, 6) as multiplied, round(value / nullif(event_id % 7, 0), 6) as divided, round(-value, 6) as negated, round(abs(value - 50e0), 6) as magnitude from events")
def arithmetic(spark, d):
    e = table(spark, d, "events")
    made = {"added": ew.add("value", 1.5), "subtracted": ew.subtract("value", "event_id"), "multiplied": ew.multiply("value", "value"), "divided": ew.divide("value", F.col("event_id") % 7), "negated": ew.negate("value"), "magnitude": ew.absolute(F.col("value") - 50)}
    return e.select("event_id", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(pow(l_quantity, 2), 6) as pow, round(sqrt(l_quantity), 6) as sqrt, round(exp(l_discount), 6) as exp, round(case when l_tax > 0 then ln(l_tax) end, 6) as log, round(sin(l_quantity), 6) as sin, round(cos(l_quantity), 6) as cos, round(tan(l_discount), 6) as tan from lineitem")
def transcendental(spark, d):
    x = table(spark, d, "lineitem")
    made = {"pow": ew.power("l_quantity", 2), "sqrt": ew.sqrt("l_quantity"), "exp": ew.exp("l_discount"), "log": ew.log("l_tax"), "sin": ew.sin("l_quantity"), "cos": ew.cos("l_quantity"), "tan": ew.tan("l_discount")}
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query("select vec_id, i::bigint as i, round((embedding[i]::double + embedding[i]::double) * 2, 6) as v from embeddings, range(1, 65) t(i)")
def rowwise_arrays(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    twice = e.withColumn("s", ew.rowwise("add", "x", "x")).withColumn("v", ew.rowwise("multiply", "s", 2.0))
    return twice.select("vec_id", F.posexplode("v").alias("p", "v")).select("vec_id", (F.col("p") + 1).cast("long").alias("i"), F.round("v", 6).alias("v"))


@query(
    rounds(
        "select sum(value) as sum, avg(value) as mean, stddev_samp(value) as std, var_samp(value) as var, min(value) as min, max(value) as max, arg_min(event_id, (value, event_id)) as argmin, arg_min(event_id, (-value, event_id)) as argmax from events",
        "sum mean std var min max",
        3,
    )
)
def reductions(spark, d):
    return rounded(arrays.reduce_all(table(spark, d, "events"), "value", "event_id", ["sum", "mean", "std", "var", "min", "max", "argmin", "argmax"]), 3)


@query("select round(product(1 + (s_nationkey - 12) / 1e4), 6) as prod from supplier")
def reduction_prod(spark, d):
    # Factors close to 1 on either side keep the product of any number of suppliers in range.
    s = table(spark, d, "supplier").select((1 + (F.col("s_nationkey") - 12) / F.lit(1e4)).alias("v"), F.col("s_suppkey").alias("p"))
    return rounded(arrays.reduce_all(s, "v", "p", ["prod"]), 6)


# --- array factories and shape ---------------------------------------------------------------------------------------


def _grid(m: int, n: int, v: str) -> str:
    return f"select i, j, {v} as v from range({m}) a(i), range({n}) b(j)"


@query(_grid(30, 20, "0e0"))
def array_zeros(spark, d):
    return arrays.zeros(spark, 30, 20)


@query(_grid(30, 20, "1e0"))
def array_ones(spark, d):
    return arrays.ones(spark, 30, 20)


@query(_grid(8, 5, "2.5e0"))
def array_full(spark, d):
    return arrays.full(spark, 8, 5, 2.5)


@query("select i, i as j, 1e0 as v from range(50) t(i)")
def array_eye(spark, d):
    return arrays.eye(spark, 50)


@query("select i, 0::bigint as j, round(1e0 + i * 0.25e0, 9) as v from range(16) t(i)")
def array_arange(spark, d):
    return rounded(arrays.arange(spark, 1.0, 5.0, 0.25), 9)


@query("select i, 0::bigint as j, round(i * 10e0 / 99, 9) as v from range(100) t(i)")
def array_linspace(spark, d):
    return rounded(arrays.linspace(spark, 0.0, 10.0, 100), 9)


@query("select * from (values (0::bigint, 0::bigint, 1e0), (0, 1, 2e0), (1, 0, 3e0), (1, 1, 4e0)) t(i, j, v)")
def array_literal(spark, d):
    return arrays.array(spark, [[1, 2], [3, 4]])


def _part_matrix(spark, d):
    return arrays.from_columns(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])


_PART = "(select p_partkey as i, 0::bigint as j, p_size::double as v from part union all select p_partkey, 1, p_retailprice from part)"


@query(f"select max(i) + 1 as m, max(j) + 1 as n from {_PART}")
def array_shape(spark, d):
    return arrays.shape(_part_matrix(spark, d))


@query(f"select (i * 2 + j) // 4 as i, (i * 2 + j) % 4 as j, v from {_PART}")
def array_reshape(spark, d):
    return arrays.reshape(_part_matrix(spark, d), 2, 4)


@query(f"select j as i, i as j, v from {_PART}")
def array_transpose(spark, d):
    return arrays.transpose(_part_matrix(spark, d))


@query(f"select a.i, a.j, round(a.v + b.v, 6) as v from {_PART} a join {_PART} b on a.i = b.i and a.j = b.j")
def cellwise_add(spark, d):
    a = _part_matrix(spark, d)
    return rounded(ew.cellwise("add", a, a), 6)


# --- linear algebra --------------------------------------------------------------------------------------------------


def _embedding_matrix(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v"))
    return e.select(F.col("vec_id").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


_EMBEDDING = "(select vec_id as i, j - 1 as j, embedding[j]::double as v from embeddings, range(1, 65) t(j))"


@query(f"select a.j as i, b.j, round(sum(a.v * b.v), 4) as v from {_EMBEDDING} a join {_EMBEDDING} b on a.i = b.i group by a.j, b.j")
def matmul_gram(spark, d):
    a = _embedding_matrix(spark, d)
    return rounded(linalg.matmul(arrays.transpose(a), a))


@query(f"select round(sum(v), 4) as trace from {_EMBEDDING} where i = j")
def trace(spark, d):
    return rounded(linalg.trace(_embedding_matrix(spark, d)))


@query(f"select round((select sqrt(sum(v * v)) from {_EMBEDDING}), 4) as norm, round((select max(s) from (select sum(abs(v)) as s from {_EMBEDDING} group by j)), 4) as norm1, round((select max(s) from (select sum(abs(v)) as s from {_EMBEDDING} group by i)), 4) as norm_inf")
def norms(spark, d):
    return rounded(linalg.norms(_embedding_matrix(spark, d)))


_G = "with g as (select sum(p_size::double * p_size) as a, sum(p_size * p_retailprice) as b, sum(p_retailprice * p_retailprice) as c from part)"


def _two(spark, d):
    g, _, _ = linalg.gram(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return g, linalg.coordinates(spark, g)


@query(f"{_G} select round(ln(a * c - b * b), 6) as log_det from g")
def det(spark, d):
    return rounded(spark.createDataFrame([(linalg.det(_two(spark, d)[1]),)], "v double").select(F.ln("v").alias("log_det")), 6)


_CELLS = "select 0::bigint as i, 0::bigint as j, {0} as v from g union all select 0, 1, {1} from g union all select 1, 0, {2} from g union all select 1, 1, {3} from g"


@query(f"select i, j, round(v * 1e6, 4) as v from ({_G} {_CELLS.format('c / (a * c - b * b)', '-b / (a * c - b * b)', '-b / (a * c - b * b)', 'a / (a * c - b * b)')})")
def inv(spark, d):
    return rounded(linalg.inv(_two(spark, d)[1]).withColumn("v", F.col("v") * 1e6))


@query(f"select i, j, round(v * 1e6, 4) as v from ({_G} {_CELLS.format('c / (a * c - b * b)', '-b / (a * c - b * b)', '-b / (a * c - b * b)', 'a / (a * c - b * b)')})")
def pinv(spark, d):
    return rounded(linalg.pinv(_two(spark, d)[1]).withColumn("v", F.col("v") * 1e6))


@query(f"select i, j, round(v, 3) as v from ({_G} {_CELLS.format('sqrt(a)', '0e0', 'b / sqrt(a)', 'sqrt(c - b * b / a)')})")
def cholesky(spark, d):
    return rounded(linalg.cholesky(_two(spark, d)[1]), 3)


@query(f"{_G} select 0::bigint as k, round(ln((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 6) as log_value from g union all select 1, round(ln((a * c - b * b) / ((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b))), 6) from g")
def eig(spark, d):
    return linalg.eig(_two(spark, d)[1]).values.select("k", F.round(F.ln("re"), 6).alias("log_value"))


@query(f"{_G} select 0::bigint as k, round(sqrt((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)), 3) as s from g union all select 1, round(sqrt((a * c - b * b) / ((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b))), 3) from g")
def svd_values(spark, d):
    s, _ = linalg.svd(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"]).small
    return spark.createDataFrame([(k, round(float(v), 3)) for k, v in enumerate(s)], "k long, s double")


@query(f"{_G} select p_partkey, round(p_size / sqrt(a) * 1000, 5) as q0, round((p_retailprice - p_size * b / a) / sqrt(c - b * b / a) * 1000, 5) as q1 from part, g")
def qr_left(spark, d):
    q = linalg.qr(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"]).left
    return q.select("p_partkey", F.round(F.col("q0") * 1000, 5).alias("q0"), F.round(F.col("q1") * 1000, 5).alias("q1"))


@query("select 64::bigint as rank")
def matrix_rank(spark, d):
    g, _, _ = linalg.gram(table(spark, d, "embeddings").select(*[F.col("embedding")[j].cast("double").alias(f"x{j}") for j in range(64)]), [f"x{j}" for j in range(64)])
    return spark.createDataFrame([(linalg.matrix_rank(linalg.coordinates(spark, g)),)], "rank long")


@query("select * from (values (0::bigint, 0::bigint, -4e0), (1, 0, 4.5e0)) t(i, j, v)")
def solve(spark, d):
    return rounded(linalg.solve(arrays.array(spark, [[1, 2], [3, 4]]), arrays.array(spark, [5, 6])), 9)


PLANTED = "3e0 * l_quantity - 200e0 * l_discount + (((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 1000) / 1000e0 - 0.5e0) * 20e0"


def planted(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", F.expr(PLANTED).alias("target"))


_M = f"with t as (select l_quantity as x, l_discount as z, {PLANTED} as y from lineitem), g as (select sum(x*x) as xx, sum(x*z) as xz, sum(z*z) as zz, sum(x*y) as xy, sum(z*y) as zy from t)"
_CENTRED = f"with t as (select l_quantity as x, l_discount as z, {PLANTED} as y from lineitem), g as (select regr_sxx(x, x) + {{0}} as xx, count(*) * covar_pop(x, z) as xz, regr_sxx(z, z) + {{0}} as zz, count(*) * covar_pop(x, y) as xy, count(*) * covar_pop(z, y) as zy, avg(x) as mx, avg(z) as mz, avg(y) as my from t), w as (select *, (xy * zz - zy * xz) / (xx * zz - xz * xz) as w0, (zy * xx - xy * xz) / (xx * zz - xz * xz) as w1 from g) select round(w0, 5) as w0, round(w1, 5) as w1, round(my - w0 * mx - w1 * mz, 5) as intercept from w"


@query(_M + " select round((xy * zz - zy * xz) / (xx * zz - xz * xz), 5) as w0, round((zy * xx - xy * xz) / (xx * zz - xz * xz), 5) as w1 from g")
def lstsq(spark, d):
    w = linalg.lstsq(planted(spark, d), ["l_quantity", "l_discount"], "target")
    return rounded(spark.createDataFrame([tuple(map(float, w))], "w0 double, w1 double"), 5)


# --- preprocessing ---------------------------------------------------------------------------------------------------

_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_IDS = ", ".join(_ID)


def _scaled(spark, d, scaler):
    x = table(spark, d, "lineitem").select(*_ID, "l_quantity", "l_tax", F.lit(5.0).alias("same"))
    return scaler(["l_quantity", "l_tax", "same"]).fit_transform(x).select(*_ID, *[F.round(c, 5).alias(c) for c in ("l_quantity", "l_tax", "same")])


def _scaled_sql(a: str, b: str) -> str:
    made = ", ".join(f"round((l.{c} - {a.format(c)}) / {b.format(c)}, 5) as {c}" for c in ("l_quantity", "l_tax"))
    stats = ", ".join(f"avg({c}) as {c}_avg, stddev_pop({c}) as {c}_pop, min({c}) as {c}_min, max({c}) as {c}_max, quantile_cont({c}, 0.25) as {c}_q1, median({c}) as {c}_med, quantile_cont({c}, 0.75) as {c}_q3" for c in ("l_quantity", "l_tax"))
    return f"with s as (select {stats} from lineitem) select {_IDS}, {made}, 0e0 as same from lineitem l, s"


@query(_scaled_sql("{0}_avg", "{0}_pop"))
def standard_scaler(spark, d):
    return _scaled(spark, d, pp.StandardScaler)


@query(_scaled_sql("{0}_min", "({0}_max - {0}_min)"))
def min_max_scaler(spark, d):
    return _scaled(spark, d, pp.MinMaxScaler)


@query(_scaled_sql("{0}_med", "({0}_q3 - {0}_q1)"))
def robust_scaler(spark, d):
    return _scaled(spark, d, pp.RobustScaler)


@query("select o_orderkey, (dense_rank() over (order by o_orderpriority) - 1)::bigint as label from orders")
def label_encoder(spark, d):
    return pp.LabelEncoder("o_orderpriority").fit_transform(table(spark, d, "orders")).select("o_orderkey", F.col("label").cast("long").alias("label"))


@query("select o_orderkey, o_orderpriority as class from orders")
def label_decoder(spark, d):
    e = pp.LabelEncoder("o_orderpriority")
    return e.inverse_transform(e.fit_transform(table(spark, d, "orders"))).select("o_orderkey", "class")


@query("select o_orderkey, (o_orderstatus = 'F')::bigint as is_f, (o_orderstatus = 'O')::bigint as is_o, (o_orderstatus = 'P')::bigint as is_p from orders")
def one_hot_encoder(spark, d):
    out = pp.OneHotEncoder("o_orderstatus").fit_transform(table(spark, d, "orders"))
    return out.select("o_orderkey", *[(F.col(f"o_orderstatus_{c}") if f"o_orderstatus_{c}" in out.columns else F.lit(0)).cast("long").alias(f"is_{c.lower()}") for c in "FOP"])


@query("select p_partkey, 1e0 as poly_1, p_size::double as poly_a, round(p_retailprice, 4) as poly_b, (p_size * p_size)::double as poly_a_a, round(p_size * p_retailprice, 4) as poly_a_b, round(p_retailprice * p_retailprice, 4) as poly_b_b from part")
def polynomial_features(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return rounded(pp.PolynomialFeatures(["a", "b"]).fit_transform(part).drop("a", "b"))


def _imputed(spark, d, strategy):
    return pp.SimpleImputer(["tax"], strategy, 9.0).fit_transform(_holes(spark, d)).withColumn("tax", F.round("tax", 6))


@query(f"with h as ({_HOLES}) select * replace (round(coalesce(tax, (select avg(tax) from h)), 6) as tax) from h")
def imputer_mean(spark, d):
    return _imputed(spark, d, "mean")


@query(f"with h as ({_HOLES}) select * replace (round(coalesce(tax, (select median(tax) from h)), 6) as tax) from h")
def imputer_median(spark, d):
    return _imputed(spark, d, "median")


@query(f"with h as ({_HOLES}) select * replace (round(coalesce(tax, 9e0), 6) as tax) from h")
def imputer_constant(spark, d):
    return _imputed(spark, d, "constant")


# --- plot data --------------------------------------------------------------------------------------------------------


@query("with b as (select min(event_id)::double as lo, (max(event_id)::double - min(event_id)) / 20 as w from events) select least(floor((event_id - lo) / w)::bigint, 19) as bin, count(*) as n, round(avg(event_id), 4) as x, round(avg(value), 4) as y from events, b group by 1")
def plot_line(spark, d):
    return rounded(plotting.line_points(table(spark, d, "events"), "event_id", "value", 20))


@query("select floor(p_size::double / 10e0)::bigint as gx, floor(p_retailprice / 200e0)::bigint as gy, count(*) as n, round(avg(p_retailprice), 4) as v from part group by 1, 2")
def plot_heat_grid(spark, d):
    return rounded(plotting.heat_grid(table(spark, d, "part"), "p_size", "p_retailprice", 10.0, 200.0, "p_retailprice"))


@query("select p_partkey, p_size, p_retailprice from part order by md5(p_partkey::varchar), p_partkey limit 500")
def plot_scatter(spark, d):
    return plotting.scatter_points(table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", 500)


@query("select i as row, j as column, greatest(0, least(255, round(255 * (v - lo) / (hi - lo))))::bigint as shade from (select *, min(v) over () as lo, max(v) over () as hi from " + _PART + ")")
def plot_image(spark, d):
    return plotting.image_matrix(_part_matrix(spark, d)).withColumn("shade", F.col("shade").cast("long"))


_STATUS = "(select o_orderstatus as y, case when o_totalprice > 200000 then 'F' else 'O' end as p from orders)"


@query(
    f"with j as {_STATUS}, c as (select y as k from j union select p from j), n as (select a.k as gy, b.k as gx, (select count(*) from j where y = a.k and p = b.k) as n from c a, c b) "
    "select gx, gy, n, round(coalesce(n / nullif(sum(n) over (partition by gy), 0), 0), 6) as share from n"
)
def plot_confusion(spark, d):
    said = table(spark, d, "orders").select(F.col("o_orderstatus").alias("y"), F.when(F.col("o_totalprice") > 200000, "F").otherwise("O").alias("p"))
    return rounded(plotting.confusion_heat(said, "y", "p"), 6)


# --- names, rows and cells of tables ----------------------------------------------------------------------------------


@query("select (row_number() over () - 1)::bigint as place, column_name as name from (describe orders)")
def column_names(spark, d):
    return frame.columns(table(spark, d, "orders"))


@query("select p_partkey as row_id, 0::bigint as j, p_size::double as v from part union all select p_partkey, 1, p_retailprice from part")
def to_rows(spark, d):
    rows = tabular.to_rows(table(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey")
    return rows.select("row_id", F.posexplode("features").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


@query("select p_partkey, round(0.299e0 * (p_size % 256) + 0.587e0 * (p_partkey % 256) + 0.114e0 * (p_partkey % 7), 6) as luma from part")
def grayscale(spark, d):
    pixels = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 256).alias("r"), (F.col("p_partkey") % 256).alias("g"), (F.col("p_partkey") % 7).alias("b"))
    return pixels.select("p_partkey", F.round(tabular.grayscale("r", "g", "b"), 6).alias("luma"))


@query("select (i - 1)::bigint as place, line from (select unnest(range(1, 6)) as i, unnest(['+-----------+------+', '|r_regionkey|r_name|', '+-----------+------+', '+-----------+------+', '']) as line)")
def print_table(spark, d):
    shown = frame.render(table(spark, d, "region").where("r_regionkey < 0"))
    return spark.createDataFrame(list(enumerate(shown.split("\n"))), "place long, line string")
