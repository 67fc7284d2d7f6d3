"""Queries of long runs and wide panels, whose work spreads over time and over pairs of series, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model_sql as M
from .functions import tables
from .kernels.scan import Linear
from .operators import lagged, long_runs, regression, tiles
from .queries import _dense_by_region, _month, _r, _rounded, _t, query

# --- runs of any length: hourly values of events, two factors ---

_LINEAR = Linear.of([[1.0, 0.5]], [[0.9, 0.1], [0.0, 0.7]], [[0.5, 0.1], [0.1, 0.3]], [1.0])
FAN = 96  #: steps of a block here, so that a month of hours has several

_HOURS = """h AS (SELECT event_type AS run_id, (epoch(date_trunc('hour', ts))::BIGINT // 3600) AS hr, avg(value) / 50 AS y FROM events GROUP BY 1, 2),
s AS (SELECT run_id, min(hr) AS low, max(hr) AS high FROM h GROUP BY 1),
g AS (SELECT run_id, low, unnest(range(low, high + 1)) AS hr FROM s),
y AS (SELECT g.run_id, g.hr - g.low AS t, h.y FROM g LEFT JOIN h ON g.run_id = h.run_id AND g.hr = h.hr)"""
#: One step: prediction m, a; innovation variance and gains; a null y leaves the prediction.
_FILTER = f"""{_HOURS},
k(run_id, t, x1, x2, p11, p12, p22, loglik) AS (
  SELECT run_id, -1::BIGINT, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE, 0::DOUBLE FROM s
  UNION ALL
  SELECT run_id, t, m1 + g1 * e, m2 + g2 * e, a11 - g1 * (a11 + 0.5 * a12), a12 - g1 * (a12 + 0.5 * a22), a22 - g2 * (a12 + 0.5 * a22),
    CASE WHEN seen THEN -0.5 * (ln(2 * pi()) + ln(v) + e * e / v) ELSE 0 END
  FROM (SELECT run_id, t, m1, m2, a11, a12, a22, v, y IS NOT NULL AS seen, coalesce(y - m1 - 0.5 * m2, 0) AS e,
      CASE WHEN y IS NULL THEN 0 ELSE (a11 + 0.5 * a12) / v END AS g1, CASE WHEN y IS NULL THEN 0 ELSE (a12 + 0.5 * a22) / v END AS g2
    FROM (SELECT *, a11 + a12 + 0.25 * a22 + 1 AS v FROM (SELECT y.run_id, y.t, y.y, 0.9 * x1 + 0.1 * x2 AS m1, 0.7 * x2 AS m2,
        0.81 * p11 + 0.18 * p12 + 0.01 * p22 + 0.5 AS a11, 0.63 * p12 + 0.07 * p22 + 0.1 AS a12, 0.49 * p22 + 0.3 AS a22
      FROM k JOIN y ON y.run_id = k.run_id AND y.t = k.t + 1) z1) z2) z3)"""


def _hours(spark: SparkSession, sf: str) -> DataFrame:
    """(run_id, t, y): mean value of each event type's hours, an hour without an event null."""
    hour = F.expr("unix_timestamp(date_trunc('hour', ts)) div 3600")
    h = _t(spark, sf, "events").groupBy(F.col("event_type").alias("run_id"), hour.alias("at")).agg((F.avg("value") / 50).alias("y"))
    ends = h.groupBy("run_id").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    grid = ends.select("run_id", "low", F.explode(F.sequence("low", "high")).alias("at"))
    return grid.join(h, ["run_id", "at"], "left").select("run_id", (F.col("at") - F.col("low")).alias("t"), F.array("y").alias("y"))


def _two(df: DataFrame) -> DataFrame:
    cells = {"x1": "state[0]", "x2": "state[1]", "p11": "cov[0]", "p12": "cov[1]", "p22": "cov[3]"}
    return df.select("run_id", "t", *[F.expr(v).alias(k) for k, v in cells.items()], *[c for c in df.columns if c == "loglik"])


@query(f"""WITH RECURSIVE {_FILTER} SELECT run_id, t, round(x1, 6) AS x1, round(x2, 6) AS x2, round(p11, 6) AS p11, round(p12, 6) AS p12, round(p22, 6) AS p22,
round(loglik, 6) AS loglik FROM k WHERE t >= 0""")
def long_filter(spark, sf):
    return _rounded(_two(long_runs.filter_long_df(_hours(spark, sf), _LINEAR, FAN)))


@query(f"""WITH RECURSIVE {_FILTER},
f AS (SELECT *, 0.9 * x1 + 0.1 * x2 AS m1, 0.7 * x2 AS m2, 0.81 * p11 + 0.18 * p12 + 0.01 * p22 + 0.5 AS a11, 0.63 * p12 + 0.07 * p22 + 0.1 AS a12,
  0.49 * p22 + 0.3 AS a22, 0.9 * p11 + 0.1 * p12 AS c11, 0.7 * p12 AS c12, 0.9 * p12 + 0.1 * p22 AS c21, 0.7 * p22 AS c22 FROM k WHERE t >= 0),
w AS (SELECT *, (c11 * a22 - c12 * a12) / (a11 * a22 - a12 * a12) AS e11, (c12 * a11 - c11 * a12) / (a11 * a22 - a12 * a12) AS e12,
  (c21 * a22 - c22 * a12) / (a11 * a22 - a12 * a12) AS e21, (c22 * a11 - c21 * a12) / (a11 * a22 - a12 * a12) AS e22 FROM f),
b(run_id, t, x1, x2, p11, p12, p22) AS (
  SELECT f.run_id, f.t, f.x1, f.x2, f.p11, f.p12, f.p22 FROM f JOIN s ON f.run_id = s.run_id AND f.t = s.high - s.low
  UNION ALL
  SELECT w.run_id, w.t, w.x1 + e11 * (b.x1 - m1) + e12 * (b.x2 - m2), w.x2 + e21 * (b.x1 - m1) + e22 * (b.x2 - m2),
    w.p11 + e11 * e11 * (b.p11 - a11) + 2 * e11 * e12 * (b.p12 - a12) + e12 * e12 * (b.p22 - a22),
    w.p12 + e11 * e21 * (b.p11 - a11) + (e11 * e22 + e12 * e21) * (b.p12 - a12) + e12 * e22 * (b.p22 - a22),
    w.p22 + e21 * e21 * (b.p11 - a11) + 2 * e21 * e22 * (b.p12 - a12) + e22 * e22 * (b.p22 - a22)
  FROM b JOIN w ON w.run_id = b.run_id AND w.t = b.t - 1)
SELECT run_id, t, round(x1, 6) AS x1, round(x2, 6) AS x2, round(p11, 6) AS p11, round(p12, 6) AS p12, round(p22, 6) AS p22 FROM b""")
def long_smoother(spark, sf):
    return _rounded(_two(long_runs.smooth_long_df(long_runs.filter_long_df(_hours(spark, sf), _LINEAR, FAN), _LINEAR, FAN)))


# --- portmanteau tests from lagged cross-covariances ---

_LAGS = 4
_PORTMANTEAU = f"""WITH {M.DENSE},
c AS (SELECT run_id, t, unnest([1, 2, 3]) AS i, unnest([y1, y2, y3]) AS v FROM d),
m AS (SELECT run_id, i, avg(v) AS m, count(*) AS n FROM c GROUP BY 1, 2),
z AS (SELECT c.run_id, t, c.i, v - m AS v, n FROM c JOIN m ON c.run_id = m.run_id AND c.i = m.i),
x AS (SELECT a.run_id, a.t - b.t AS h, a.i, b.i AS j, max(a.n) AS n, sum(a.v * b.v) / max(a.n) AS v FROM z a JOIN z b ON a.run_id = b.run_id AND a.t - b.t BETWEEN 0 AND {_LAGS} GROUP BY 1, 2, 3, 4),
o AS (SELECT run_id, {', '.join(f'max(v) FILTER (i = {i} AND j = {j}) AS c{i}{j}' for i in (1, 2, 3) for j in (1, 2, 3))} FROM x WHERE h = 0 GROUP BY 1),
q AS (SELECT *, c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c23 * c13) + c13 * (c12 * c23 - c22 * c13) AS det FROM o),
g AS (SELECT run_id, unnest([1, 1, 1, 2, 2, 2, 3, 3, 3]) AS i, unnest([1, 2, 3, 1, 2, 3, 1, 2, 3]) AS j, unnest([
  (c22 * c33 - c23 * c23) / det, (c13 * c23 - c12 * c33) / det, (c12 * c23 - c13 * c22) / det, (c13 * c23 - c12 * c33) / det, (c11 * c33 - c13 * c13) / det,
  (c12 * c13 - c11 * c23) / det, (c12 * c23 - c13 * c22) / det, (c12 * c13 - c11 * c23) / det, (c11 * c22 - c12 * c12) / det]) AS v FROM q),
l AS (SELECT x.run_id, x.h, x.i, g.j, max(x.n) AS n, sum(x.v * g.v) AS v FROM x JOIN g ON x.run_id = g.run_id AND x.j = g.i WHERE x.h > 0 GROUP BY 1, 2, 3, 4),
r AS (SELECT x.run_id, x.h, x.j AS i, g.j, sum(x.v * g.v) AS v FROM x JOIN g ON x.run_id = g.run_id AND x.i = g.i WHERE x.h > 0 GROUP BY 1, 2, 3, 4),
e AS (SELECT l.run_id, l.h, max(l.n) AS n, sum(r.v * l.v) AS v FROM r JOIN l ON r.run_id = l.run_id AND r.h = l.h AND r.j = l.i AND r.i = l.j GROUP BY 1, 2)"""


@query(_PORTMANTEAU + f""", u AS (SELECT run_id, 'hosking' AS test, sum(v * n * n / (n - h)) AS q FROM e GROUP BY 1
UNION ALL SELECT run_id, 'limcleod', max(n) * sum(v) + {9 * _LAGS * (_LAGS + 1)} / (2.0 * max(n)) FROM e GROUP BY 1)
SELECT run_id, test, {_LAGS}::INT AS lags, round(q, 6) AS statistic, {9 * _LAGS}::INT AS dof FROM u""")
def portmanteau_tests(spark, sf):
    return _rounded(lagged.portmanteau_df(_dense_by_region(spark, sf), _LAGS, block=16).drop("p_value"))


_CROSS = f"SELECT run_id, h::INT AS h, (i - 1)::INT AS i, (j - 1)::INT AS j, round(v, 9) AS value FROM x"


@query(_PORTMANTEAU.split(",\no AS")[0] + _CROSS.replace("SELECT", "\nSELECT", 1))
def lagged_cross_covariances(spark, sf):
    return lagged.cross_covariances(_dense_by_region(spark, sf), _LAGS, block=3).select("run_id", "h", "i", "j", _r("value", 9).alias("value"))


# --- tests by regression sums ---


def _eliminated(source: str, names: list[str]) -> str:
    """CTEs m0, m1, ... over covariances of names by series: each takes one more of them out of the others."""
    n = len(names)
    cells = [(i, j) for i in range(n) for j in range(i + 1)]
    first = ", ".join(f"covar_pop({names[i]}, {names[j]}) AS c{i}_{j}" for i, j in cells)
    whole = " AND ".join(f"{x} IS NOT NULL" for x in names)
    out = [f"m0 AS (SELECT series, count(*) AS n, {first} FROM {source} WHERE {whole} GROUP BY 1)"]
    for k in range(n - 1):
        rest = ", ".join(f"c{i}_{j} - c{i}_{k} * c{j}_{k} / c{k}_{k} AS c{i}_{j}" for i, j in cells if j > k)
        out.append(f"m{k + 1} AS (SELECT series, n, {rest} FROM m{k})")
    return ",\n".join(out)


_EVENT_HOURS = "v AS (SELECT event_type AS series, date_trunc('hour', ts) AS hr, avg(value) AS value FROM events GROUP BY 1, 2)"


def _event_hours(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("at")).agg(F.avg("value").alias("value"))


_ARCH, _ADF = 5, 4


@query(f"""WITH {_EVENT_HOURS}, l AS (SELECT series, value * value AS s0, {', '.join(f'lag(value * value, {k}) OVER w AS s{k}' for k in range(1, _ARCH + 1))} FROM v
WINDOW w AS (PARTITION BY series ORDER BY hr)), {_eliminated('l', [f's{k}' for k in range(1, _ARCH + 1)] + ['s0'])}
SELECT m0.series, m0.n, round(m0.n * (1 - e.c{_ARCH}_{_ARCH} / m0.c{_ARCH}_{_ARCH}), 6) AS statistic FROM m0 JOIN m{_ARCH} e ON m0.series = e.series""")
def arch_lm_sums(spark, sf):
    return _rounded(regression.arch_lm(_event_hours(spark, sf), "at", ["series"], lags=_ARCH))


_ADF_NAMES = [f"d{k}" for k in range(1, _ADF + 1)] + ["x", "d0"]


@query(f"""WITH {_EVENT_HOURS}, o AS (SELECT series, hr, lag(value) OVER w AS x, value - lag(value) OVER w AS d0 FROM v WINDOW w AS (PARTITION BY series ORDER BY hr)),
l AS (SELECT series, x, d0, {', '.join(f'lag(d0, {k}) OVER w AS d{k}' for k in range(1, _ADF + 1))} FROM o WINDOW w AS (PARTITION BY series ORDER BY hr)),
{_eliminated('l', _ADF_NAMES)}
SELECT b.series, b.n, {_ADF}::INT AS lags, round(b.c{_ADF + 1}_{_ADF} / sqrt(b.c{_ADF}_{_ADF}) / sqrt(e.c{_ADF + 1}_{_ADF + 1} / (b.n - {_ADF + 2})), 6) AS statistic,
round(b.n * ln(e.c{_ADF + 1}_{_ADF + 1}) + {2 * (_ADF + 2)}, 6) AS aic FROM m{_ADF} b JOIN m{_ADF + 1} e ON b.series = e.series""")
def dickey_fuller_sums(spark, sf):
    return _rounded(regression.dickey_fuller(_event_hours(spark, sf), "at", ["series"], lags=_ADF))


# --- wide panels ---

_BRANDS = """v AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, p_brand AS series_id, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem JOIN orders
ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _by_part(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Monthly revenue by a column of part: (at, series_id, value)."""
    items = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    orders = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _month("o_orderdate").alias("at"))
    parts = _t(spark, sf, "part").select("p_partkey", F.col(name).alias("series_id"))
    return items.join(orders, "l_orderkey").join(parts, "p_partkey").groupBy("at", "series_id").agg(F.sum("v").alias("value"))


@query(f"""WITH {_BRANDS} SELECT x.series_id AS a, y.series_id AS b, round(corr(x.value, y.value), 6) AS corr, count(*) AS n FROM v x JOIN v y ON x.month = y.month
WHERE x.series_id <= y.series_id GROUP BY 1, 2""")
def wide_correlations(spark, sf):
    return _rounded(tiles.correlations(_by_part(spark, sf, "p_brand"), "at", span=32, side=8))


def _power(name: str, matrix: str, rounds: int) -> str:
    """CTEs: the leading eigenvalue and vector of a symmetric matrix, long m(i, j, v), by power iteration on lists."""
    return f"""{name}r AS (SELECT i, list(v ORDER BY j) AS row FROM {matrix} GROUP BY 1), {name}a AS (SELECT list(row ORDER BY i) AS a FROM {name}r),
{name}p(k, x) AS (SELECT 0, list_transform(a, lambda r: 1 + r[1] + r[2] / 3) FROM {name}a UNION ALL
  SELECT k + 1, list_transform(y, lambda z: z / sqrt(list_sum(list_transform(y, lambda u: u * u)))) FROM
    (SELECT k, list_transform(a, lambda r: list_sum(list_transform(range(1, len(r) + 1), lambda q: r[q] * x[q]))) AS y FROM {name}p, {name}a WHERE k < {rounds})),
{name}v AS (SELECT i, x[i] AS x FROM {name}p, {name}r WHERE k = {rounds}),
{name}e AS (SELECT sum(l.x * m.v * r.x) AS e FROM {matrix} m JOIN {name}v l ON l.i = m.i JOIN {name}v r ON r.i = m.j)"""


@query(f"""WITH RECURSIVE {_BRANDS},
c AS (SELECT x.series_id AS a, y.series_id AS b, corr(x.value, y.value) AS v FROM v x JOIN v y ON x.month = y.month GROUP BY 1, 2),
n AS (SELECT a, row_number() OVER (ORDER BY a) AS i FROM (SELECT DISTINCT a FROM c)),
g AS (SELECT p.i, q.i AS j, c.v FROM c JOIN n p ON c.a = p.a JOIN n q ON c.b = q.a),
{_power('f', 'g', 400)},
g2 AS (SELECT g.i, g.j, g.v - e * l.x * r.x AS v FROM g JOIN fv l ON l.i = g.i JOIN fv r ON r.i = g.j, fe),
{_power('s', 'g2', 400)},
z AS (SELECT 1 AS component, i, x, e FROM fv, fe UNION ALL SELECT 2, i, x, e FROM sv, se),
d AS (SELECT component, CASE WHEN max(x) > -min(x) THEN 1 ELSE -1 END AS sign FROM z GROUP BY 1)
SELECT z.component::INT AS component, n.a AS series, round(z.x * sign, 4) AS loading, round(z.e, 4) AS eigenvalue, round(z.e / (SELECT count(*) FROM n), 4) AS ratio
FROM z JOIN n ON n.i = z.i JOIN d ON d.component = z.component""")
def wide_components(spark, sf):
    return _rounded(tiles.components(_by_part(spark, sf, "p_brand"), "at", 2, span=32, side=8), 4)


# --- a table function, called from SQL ---


@query(f"""WITH RECURSIVE {_EVENT_HOURS}, r AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY hr) AS i, value / 50 AS value FROM v),
p(series, i, h) AS (SELECT series, 1::BIGINT, 1::DOUBLE FROM r WHERE i = 1 UNION ALL SELECT p.series, p.i + 1, 0.1 + 0.15 * r.value ** 2 + 0.7 * p.h FROM p
JOIN r ON r.series = p.series AND r.i = p.i JOIN r n ON n.series = p.series AND n.i = p.i + 1) SELECT series, i::INT AS i, round(h, 6) AS variance FROM p""")
def garch_table_function(spark, sf):
    tables.register(spark)
    hours = _event_hours(spark, sf).select("series", "at", (F.col("value") / 50).alias("value"))
    hours.createOrReplaceTempView("event_hours")
    return _rounded(spark.sql("SELECT * FROM garch_path(TABLE(event_hours) PARTITION BY series ORDER BY (at), 0.1, 0.15, 0.7, 1.0)"))
