"""Queries of studies and of models at stated parameters, and the same in DuckDB's SQL. Parameters, records and states are
made of columns of the driver's tables, so that SQL can follow every one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as P
from . import model_sql as M
from .kernels.params import Params
from .operators import aggregate, models, panel
from .operators.reshape import heatmap
from .plans import study
from .queries import _dense_by_region, _flag_params, _r, _rounded, _shared_params, _t, query


def _array(*columns) -> Column:
    return F.array(*[(c if isinstance(c, Column) else F.lit(c)).cast("double") for c in columns])


# --- recursions at stated parameters ---


@query("WITH RECURSIVE p(k, v) AS (SELECT 0, 0.05::DOUBLE UNION ALL SELECT k + 1, 0.95 * v * 0.95 + 0.05 FROM p WHERE k < 30) SELECT k::INT AS k, round(v, 9) AS p FROM p")
def lyapunov_fixed_point_k1(spark, sf):
    one = {"k1": Params.from_dict({"lambda_r": [[1.0], [0.5]], "Phi_f": 0.2, "Phi_h": 0.95, "mu": -1.0, "sigma2": 0.1, "Q_h": 0.05})}
    return models.lyapunov_df(models.params_df(spark, one), 30).select(F.col("rounds").alias("k"), _r("value", 9).alias("p"))


_GARCH, _DCC = {"omega": 0.001, "alpha": 0.1, "beta": 0.8}, {"a": 0.05, "b": 0.9}
_PAIRS = ("11", "12", "13", "22", "23", "33")


def _dcc_sql() -> str:
    """CTEs up to w(run_id, t, r.., s.., i.., det): correlations, covariances, cofactors and determinant."""
    w, a, b = _GARCH, _DCC["a"], _DCC["b"]
    grown = ", ".join(f"{w['omega']} + {w['alpha']} * y{i} * y{i} + {w['beta']} * h{i}" for i in "123")
    mean = ", ".join(f"avg(e{p[0]} * e{p[1]}) AS m{p}" for p in _PAIRS)
    moved = ", ".join(f"{1 - a - b!r} * m{p} + {a} * e{p[0]} * e{p[1]} + {b} * q{p}" for p in _PAIRS)
    corr = ", ".join(f"q{p} / sqrt(q{p[0]}{p[0]} * q{p[1]}{p[1]}) AS r{p}" for p in _PAIRS)
    cov = ", ".join(f"r{p} * sqrt(h{p[0]} * h{p[1]}) AS s{p}" for p in _PAIRS)
    return f"""WITH RECURSIVE {M.DENSE},
m0 AS (SELECT run_id, {', '.join(f'avg(y{i} * y{i}) AS h{i}' for i in '123')} FROM d GROUP BY 1),
v(run_id, t, h1, h2, h3) AS (SELECT run_id, 0, h1, h2, h3 FROM m0 UNION ALL SELECT run_id, t + 1, {grown} FROM v JOIN d USING (run_id, t)),
e AS (SELECT run_id, t, {', '.join(f'y{i} / sqrt(h{i}) AS e{i}' for i in '123')} FROM v JOIN d USING (run_id, t)),
q0 AS (SELECT run_id, {mean} FROM e GROUP BY 1),
c(run_id, t, {', '.join('q' + p for p in _PAIRS)}) AS (SELECT run_id, 0, {', '.join('m' + p for p in _PAIRS)} FROM q0
  UNION ALL SELECT run_id, t + 1, {moved} FROM c JOIN e USING (run_id, t) JOIN q0 USING (run_id)),
r AS (SELECT run_id, t, h1, h2, h3, {corr} FROM c JOIN v USING (run_id, t)),
s AS (SELECT *, {cov} FROM r),
w AS (SELECT *, s22 * s33 - s23 ** 2 AS i11, s13 * s23 - s12 * s33 AS i12, s12 * s23 - s13 * s22 AS i13, s11 * s33 - s13 ** 2 AS i22, s12 * s13 - s11 * s23 AS i23,
  s11 * s22 - s12 ** 2 AS i33, s11 * (s22 * s33 - s23 ** 2) - s12 * (s12 * s33 - s13 * s23) + s13 * (s12 * s23 - s13 * s22) AS det FROM s)"""


_WEIGHT = {"1": "(i11 + i12 + i13)", "2": "(i12 + i22 + i23)", "3": "(i13 + i23 + i33)"}
_ALL = " + ".join(_WEIGHT.values())


@query(f"""{_dcc_sql()} SELECT run_id, t, {', '.join(f'round(r{p}, 6) AS r{p}' for p in ('12', '13', '23'))},
{', '.join(f'round({x} / ({_ALL}), 5) AS w{i}' for i, x in _WEIGHT.items())} FROM w""")
def dcc_forecast_weights(spark, sf):
    """Correlations and minimum-variance weights at stated parameters, and one step ahead."""
    path = models.dcc_path_df(_dense_by_region(spark, sf), **_DCC, **_GARCH)
    corr = [_r(F.get("corr", F.lit(i))).alias(n) for i, n in ((1, "r12"), (2, "r13"), (5, "r23"))]
    return path.select("run_id", "t", *corr, *[_r(F.get("gmv", F.lit(i)), 5).alias(f"w{i + 1}") for i in range(3)])


_QUAD = " + ".join(f"{'2 * ' if p[0] != p[1] else ''}i{p} * y{p[0]} * y{p[1]}" for p in _PAIRS)


@query(f"""{_dcc_sql()}, l AS (SELECT run_id, lgamma(4) - lgamma(2.5) - 1.5 * ln(pi() * 3) - 0.5 * ln(det) - 4 * ln(1 + ({_QUAD}) / det / 3) AS v FROM w JOIN d USING (run_id, t))
SELECT run_id, count(*) AS n_obs, round(sum(v), 3) AS loglik, round(16 - 2 * sum(v), 3) AS aic, round(8 * ln(count(*)) - 2 * sum(v), 3) AS bic FROM l GROUP BY 1""")
def student_likelihood(spark, sf):
    dense = _dense_by_region(spark, sf)
    covs = models.dcc_path_df(dense, **_DCC, **_GARCH)
    return _rounded(models.student_loglik_df(dense, covs, 5.0, 8), 3)


_MC = M.components(12)


@query(f"SELECT run_id, {', '.join(f'min(component) FILTER (cumulative >= {s} - 1e-12) AS needed_{round(100 * s)}' for s in (0.5, 0.8, 0.9, 0.95))} FROM ({_MC}) GROUP BY 1")
def components_needed(spark, sf):
    return models.components_needed(models.pca_df(_dense_by_region(spark, sf)))


_NORMAL = "-0.5 * ln(2 * pi() * {v}) - ({x}) ** 2 / (2 * {v})"


def _terms() -> str:
    seen = " + ".join(_NORMAL.format(v=M.S2, x=f"y{i + 1} - {lam} * y1") for i, lam in enumerate(M.LAM))
    factor = _NORMAL.format(v="exp(h)", x=f"y1 - {M.PHI_F} * lag(y1) OVER w")
    vol = _NORMAL.format(v=M.Q_H, x=f"h - {M.MU} - {M.PHI_H} * (lag(h) OVER w - {M.MU})")
    return f"SELECT run_id, t, {seen} AS a, {factor} AS b, {vol} AS c FROM (SELECT *, {M.MU} + y2 AS h FROM d) WINDOW w AS (PARTITION BY run_id ORDER BY t)"


@query(f"""WITH {M.DENSE} SELECT run_id, round(sum(a), 4) AS observation, round(sum(b), 4) AS factors, round(sum(c), 4) AS volatility, round(sum(a) + sum(b) + sum(c), 4) AS joint
FROM ({_terms()}) GROUP BY 1""")
def complete_likelihoods(spark, sf):
    """The first series as the factor, the second as log volatility."""
    dense = _dense_by_region(spark, sf)
    return _rounded(models.complete_loglik_df(_with_states(dense), _shared_params(spark, dense)), 4)


def _with_states(dense: DataFrame) -> DataFrame:
    return dense.withColumns({"f": F.array(F.get("y", F.lit(0))), "h": F.array(F.get("y", F.lit(1)) + M.MU)})


_ACC = "round(sqrt(avg(({v} - {x}) ** 2)), 6) AS rmse, round(CASE WHEN stddev_pop({v}) > 1e-10 AND stddev_pop({x}) > 1e-10 AND count(*) > 1 THEN corr({v}, {x}) END, 6) AS corr"


@query(f"""WITH {M.DENSE} SELECT run_id, 'f' AS kind, 0 AS k, {_ACC.format(v='y3', x='y1')} FROM d GROUP BY 1
UNION ALL SELECT run_id, 'h', 0, {_ACC.format(v='y1', x=f'({M.MU} + y2)')} FROM d GROUP BY 1""")
def state_accuracy(spark, sf):
    dense = _dense_by_region(spark, sf)
    states = dense.select("run_id", "t", F.array(F.get("y", F.lit(2)), F.get("y", F.lit(0))).alias("state"))
    return _rounded(models.accuracy_df(states, _with_states(dense)))


def _gain_sql() -> str:
    joined = f"SELECT x.run_id, t, x.f, x.h, q.f AS sf, q.h AS sh, y1 AS tf, {M.MU} + y2 AS th FROM x JOIN b q USING (run_id, t) JOIN d USING (run_id, t)"
    part = "SELECT run_id, '{k}' AS kind, 0 AS k, sqrt(avg(({k} - t{k}) ** 2)) AS fr, corr({k}, t{k}) AS fc, sqrt(avg((s{k} - t{k}) ** 2)) AS sr, corr(s{k}, t{k}) AS sc FROM j GROUP BY 1"
    text = M.smoothed(4)
    return f"""{text[:text.rindex('SELECT run_id, t, ' + chr(39) + 'f')].rstrip()}, j AS ({joined}), u AS ({part.format(k='f')} UNION ALL {part.format(k='h')})
SELECT run_id, kind, k, round(fr, 4) AS filtered_rmse, round(fc, 4) AS filtered_corr, round(sr, 4) AS smoothed_rmse, round(sc, 4) AS smoothed_corr, round(100 * (1 - sr / fr), 3) AS gain_pct FROM u"""


@query(_gain_sql())
def smoothing_gain(spark, sf):
    dense = _dense_by_region(spark, sf)
    p = _shared_params(spark, dense)
    gain = models.smoothing_gain_df(models.filter_df(dense, p), models.smooth_df(dense, p), _with_states(dense))
    return _rounded(gain.withColumn("gain_pct", _r("gain_pct", 3)), 4)


@query(f"WITH {M.DENSE} SELECT run_id, 0 AS k, round(min(exp(({M.MU} + y2) / 2)), 6) AS low, round(max(exp(({M.MU} + y2) / 2)), 6) AS high, round(avg(exp(({M.MU} + y2) / 2)), 6) AS mean FROM d GROUP BY 1")
def volatility_ranges(spark, sf):
    return _rounded(models.volatility_range_df(_with_states(_dense_by_region(spark, sf))))


@query(f"""WITH {M.DENSE} SELECT run_id, a, b, round(r, 6) AS corr FROM (SELECT run_id, corr(y1, y2) AS r, 0 AS a, 1 AS b FROM d WHERE t > 0 GROUP BY 1
UNION ALL SELECT run_id, corr(y1, y3), 0, 2 FROM d WHERE t > 0 GROUP BY 1 UNION ALL SELECT run_id, corr(y2, y3), 1, 2 FROM d WHERE t > 0 GROUP BY 1)""")
def return_correlations(spark, sf):
    return _rounded(models.return_correlations_df(_dense_by_region(spark, sf)))


def _summary_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT run_id, t, {i} AS series, y{i + 1} AS v FROM d WHERE t > 0" for i in range(3))
    return f"""WITH {M.DENSE}, c AS ({cells}), l AS (SELECT *, lag(v) OVER (PARTITION BY run_id, series ORDER BY t) AS b FROM c)
SELECT run_id, series, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(corr(v, b), 6) AS autocorr, round(corr(v * v, b * b), 6) AS autocorr_sq FROM l GROUP BY 1, 2"""


@query(_summary_sql())
def panel_summary(spark, sf):
    return _rounded(models.simulation_summary_df(_dense_by_region(spark, sf)))


@query()
def student_jarque_bera(spark, sf):
    dense = _dense_by_region(spark, sf)
    p = _shared_params(spark, dense)
    return models.student_jarque_bera_df(models.residuals_df(dense, models.filter_df(dense, p), p), draws=400)


# --- errors of parameters: sets made of suppliers ---

#: (truth, estimate) of each parameter's numbers, over a = s_acctbal / 10000 and n = s_nationkey / 25.
_SETS = {
    "lambda_r": (("1.0", "a", "n"), ("1.0", "a + 0.1", "n * 1.1")), "Phi_f": (("0.5 + 0.4 * n",), ("0.5 + 0.3 * n",)), "Phi_h": (("0.9",), ("0.8",)),
    "mu": (("a - 4",), ("-4.0",)), "sigma2": (("0.1 + n", "0.2", "0.3"), ("0.1 + n * n", "0.2", "0.35")), "Q_h": (("0.1 + n",), ("0.2 + n * n",)),
}
_SQUARE = ("Phi_f", "Phi_h", "Q_h")


def _param_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    base = _t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("param_id"), (F.col("s_acctbal") / 10000).alias("a"), (F.col("s_nationkey") / 25).alias("n"))

    def column(name: str, which: int) -> Column:
        values = [F.expr(x).cast("double") for x in _SETS[name][which]]
        return F.array(*(values if name in ("mu", "sigma2") else [F.array(v) for v in values])).alias(name)

    fixed = (F.lit(3).alias("N"), F.lit(1).alias("K"))
    true, est = (base.select("param_id", *fixed, *[column(name, i) for name in _SETS]) for i in (0, 1))
    return true, est


_SUPPLIERS = "(SELECT s_suppkey::VARCHAR AS id, s_acctbal / 10000 AS a, s_nationkey / 25 AS n FROM supplier)"
_LISTS = " UNION ALL ".join(
    f"SELECT id, '{name}' AS param, {name in _SQUARE} AS square, [{', '.join(f'({x})::DOUBLE' for x in a)}] AS x, [{', '.join(f'({x})::DOUBLE' for x in b)}] AS y FROM {_SUPPLIERS}"
    for name, (a, b) in _SETS.items()
)


@query(f"""WITH l AS (SELECT id, param, square, unnest(x) AS x, unnest(y) AS y FROM ({_LISTS})), g AS (SELECT id, param, square, avg(y - x) AS bias, avg(abs(y - x)) AS mae,
sqrt(avg((y - x) ** 2)) AS rmse, sqrt(sum((y - x) ** 2)) AS frob, sqrt(sum(x * x)) AS norm, avg(abs(y - x) / (abs(x) + 1e-8)) AS rel, max(x) AS x, max(y) AS y FROM l GROUP BY 1, 2, 3)
SELECT id, param, round(bias, 6) AS bias, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(frob, 6) AS frob_diff, round(CASE WHEN norm > 1e-10 THEN frob / norm END, 6) AS frob_rel_diff,
round(rel, 6) AS rel_error, round(CASE WHEN square THEN abs(y) - abs(x) END, 6) AS eig_bias, round(CASE WHEN square THEN abs(abs(y) - abs(x)) END, 6) AS eig_mae,
round(CASE WHEN square THEN abs(abs(y) - abs(x)) END, 6) AS eig_rmse, round(CASE WHEN square AND x > 0 AND y > 0 THEN ln(y) - ln(x) END, 6) AS logdet_diff,
round(CASE WHEN square THEN y - x END, 6) AS trace_diff FROM g""")
def parameter_errors(spark, sf):
    return _rounded(models.param_errors_df(*_param_sets(spark, sf)))


@query(f"SELECT id, param, i, 0 AS j, round(y - x, 6) AS bias FROM (SELECT id, param, unnest(x) AS x, unnest(y) AS y, (generate_subscripts(x, 1) - 1)::INT AS i FROM ({_LISTS}))")
def element_bias(spark, sf):
    return _rounded(models.element_bias_df(*_param_sets(spark, sf)))


@query(f"""SELECT id, round(abs(0.5 + 0.4 * n), 6) AS phi_f_size, 0.9::DOUBLE AS phi_h_size, round(a - 4, 6) AS mu_mean, round(least(0.1 + n, 0.2, 0.3), 6) AS sigma2_min,
round(greatest(0.1 + n, 0.2, 0.3), 6) AS sigma2_max, round((0.6 + n) / 3, 6) AS sigma2_mean, round(0.1 + n, 6) AS q_h_mean FROM {_SUPPLIERS}""")
def key_parameters(spark, sf):
    return _rounded(models.key_parameters_df(_param_sets(spark, sf)[0]))


@query("""SELECT id::VARCHAR AS id, side FROM (SELECT s_suppkey AS id, 'true' AS side FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT n_nationkey, 'estimated' FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey FROM supplier))""")
def unmatched_parameter_ids(spark, sf):
    a = _t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("param_id"))
    return models.unmatched_ids(a, _t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("param_id")))


@query("""WITH b AS (SELECT l_returnflag AS param, l_linenumber % 2 AS i, l_orderkey % 2 AS j, l_discount - 0.04 + CASE WHEN l_linenumber % 2 = l_orderkey % 2 THEN 0.01 ELSE 0 END AS v FROM lineitem),
m AS (SELECT param, avg(v) FILTER (i = 0 AND j = 0) AS p, (avg(v) FILTER (i = 0 AND j = 1) + avg(v) FILTER (i = 1 AND j = 0)) / 2 AS q, avg(v) FILTER (i = 1 AND j = 1) AS r FROM b GROUP BY 1)
SELECT param, round((p + r) / 2 + sqrt(((p - r) / 2) ** 2 + q * q), 6) AS major, round((p + r) / 2 - sqrt(((p - r) / 2) ** 2 + q * q), 6) AS minor,
round(degrees(atan2(2 * q, p - r)) / 2, 4) AS angle FROM m""")
def bias_ellipses(spark, sf):
    i, j = F.col("l_linenumber") % 2, F.col("l_orderkey") % 2
    bias = F.col("l_discount") - 0.04 + F.when(i == j, 0.01).otherwise(0.0)
    rows = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("param"), i.alias("i"), j.alias("j"), bias.alias("bias"))
    return _rounded(models.bias_ellipses_df(rows).withColumn("angle", _r("angle", 4)))


# --- studies: records made of events ---

_RECORD = """SELECT event_id, 3 + 2 * (user_id % 2) AS N, 1 AS K, 80 AS T, CASE event_type WHEN 'view' THEN 'BIF' WHEN 'click' THEN 'BF' ELSE 'PF-300' END AS filter_config,
(value + value / 2) / 2 AS rmse_f, value / 100 AS corr_f, value * 2 AS rmse_h, (user_id % 7) / 7.0 AS corr_h, value / 10 AS filter_time, -value AS loglik FROM events WHERE value <= 90"""
_LISTED = (*study.METRIC_LISTS, "filter_time", "loglik")


def _stats_sql(columns, by: str, source: str, stats=("mean", "std", "median", "count", "se"), digits: int = 5) -> str:
    of = {
        "mean": "round(avg({c}), {d}) AS {c}_mean", "std": "round(stddev_samp({c}), {d}) AS {c}_std", "median": "round(median({c}), {d}) AS {c}_median",
        "count": "count({c}) AS {c}_count", "se": "round(stddev_samp({c}) / sqrt(count({c})), {d}) AS {c}_se",
    }
    return f"SELECT {by}, {', '.join(of[s].format(c=c, d=digits) for c in columns for s in stats)} FROM ({source}) GROUP BY ALL"


@query(_stats_sql(_LISTED, "N, K, T, filter_config", _RECORD))
def study_statistics(spark, sf):
    v = F.col("value")
    kind = P.case_map("event_type", {"view": "BIF", "click": "BF"}, "PF")
    rows = _t(spark, sf, "events").select(
        (3 + 2 * (F.col("user_id") % 2)).alias("N"), F.lit(1).alias("K"), F.lit(80).alias("T"), kind.alias("filter_type"), F.lit(300).alias("num_particles"),
        _array(v, v / 2).alias("rmse_f"), _array(v / 100).alias("corr_f"), _array(v * 2).alias("rmse_h"), _array(F.col("user_id") % 7 / 7).alias("corr_h"),
        (v / 10).alias("filter_time"), (-v).alias("loglik"), F.when(v > 90, "failed").alias("error"),
    )
    return _rounded(study.summarised(rows), 5)


def _fit_records(spark: SparkSession, sf: str) -> DataFrame:
    v, u = F.col("value"), F.col("user_id")
    kind = P.case_map("event_type", {"view": "BIF", "click": "BF"}, "PF")
    scalars = {c: (v * (i + 1)).cast("double") for i, c in enumerate(study.FIT_SCALARS)}
    errors = F.create_map(F.lit("mu_bias"), v / 100, F.lit("mu_rmse"), (u % 11).cast("double"))
    return _t(spark, sf, "events").select(
        (3 + 2 * (u % 2)).alias("N"), F.lit(1).alias("K"), F.lit(80).alias("T"), kind.alias("filter_type"), F.lit(300).alias("num_particles"),
        F.when(u % 5 != 0, u % 3 == 0).alias("fix_mu"), (v <= 90).alias("success"), errors.alias("errors"), *[x.alias(c) for c, x in scalars.items()],
    )


def _report_sql() -> str:
    base = """SELECT value AS v, 3 + 2 * (user_id % 2) AS N, 1 AS K, 80 AS T, CASE event_type WHEN 'view' THEN 'BIF' WHEN 'click' THEN 'BF' ELSE 'PF-300' END AS filter_config,
    CASE WHEN user_id % 5 != 0 THEN (user_id % 3 = 0)::INT ELSE -1 END AS fix_mu, user_id % 11 AS u FROM events WHERE value <= 90"""
    parts = [f"SELECT 'errors' AS part, 'all' AS label, '{m}' AS metric, avg({x}) AS value FROM p" for m, x in (("mu_bias", "v / 100"), ("mu_rmse", "u"))]
    for i, c in enumerate(study.FIT_SCALARS):
        for stat, f in (("mean", "avg"), ("median", "median")):
            parts.append(f"SELECT 'scalars', concat_ws('-', N, K, T, filter_config, fix_mu), '{c}_{stat}', {f}(v * {i + 1}) FROM p GROUP BY N, K, T, filter_config, fix_mu")
        a, b = (f"avg(v * {i + 1}) FILTER (fix_mu = {k})" for k in (1, 0))
        parts.append(f"SELECT 'fix_mu', filter_config, '{c}', 100 * ({a} - {b}) / abs({b}) FROM p GROUP BY filter_config")
    return f"WITH p AS ({base}) SELECT part, label, metric, round(value, 5) AS value FROM ({' UNION ALL '.join(parts)})"


@query(_report_sql())
def fit_analysis_report(spark, sf):
    return _rounded(study.analysed_fits(_fit_records(spark, sf))["report"], 5)


@query()
def fit_study(spark, sf):
    """Simulate, fit, compare with the truth: a small grid of fits in both filters, with mu known and not."""
    runs = study.grid(spark, [2], [1], [50], ["BIF", "BF"], [], 1)
    arms = runs.withColumn("fix_mu", F.lit(False)).union(runs.withColumns({"run_id": F.concat("run_id", F.lit("-mu")), "fix_mu": F.lit(True)}))
    done = study.run_fits(arms)
    return done.select("run_id", "filter_type", "fix_mu", "optimizer_name", "success", "result_code", "steps", "final_loss", "loss_at_truth", "factor_rmse_mean", "errors", "error")


_TWO = "SELECT user_id % 4 AS N, CASE WHEN event_type = 'view' THEN 'BIF' ELSE 'PF' END AS filter_type, value AS v, event_id FROM events WHERE event_type IN ('view', 'click')"


@query(f"""SELECT N, filter_type, round(CASE filter_type WHEN 'BIF' THEN avg(v) ELSE avg(v * 3) END, 5) AS rmse_0, round(CASE filter_type WHEN 'BIF' THEN avg(v * 2) ELSE avg(v * 4) END, 5) AS rmse_1,
round(CASE filter_type WHEN 'BIF' THEN avg(v) * 1.5 ELSE avg(v) * 3.5 END, 5) AS rmse_mean FROM ({_TWO}) GROUP BY 1, 2""")
def metrics_pipeline(spark, sf):
    e, v = _t(spark, sf, "events"), F.col("value")
    by = [(F.col("user_id") % 4).alias("N")]
    a = e.filter("event_type = 'view'").select(*by, F.lit("BIF").alias("filter_type"), _array(v, v * 2).alias("bif_rmse"))
    b = e.filter("event_type = 'click'").select(*by, F.lit("PF").alias("filter_type"), _array(v * 3, v * 4).alias("pf_rmse"))
    return _rounded(study.finished_metrics([a, b], ["N", "filter_type"], "filter_type", ["BIF", "PF"], ["bif_rmse", "pf_rmse"], 2), 5)


@query("""WITH p AS (SELECT CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_brand END AS brand, p_size, p_retailprice AS price FROM part WHERE p_size % 3 = 0 OR p_brand < 'Brand#3')
SELECT b.brand, s.p_size, round(median(price), 4) AS price_median, count(price) AS price_count FROM (SELECT DISTINCT brand FROM p) b CROSS JOIN (SELECT DISTINCT p_size FROM p) s
LEFT JOIN p ON p.brand IS NOT DISTINCT FROM b.brand AND p.p_size = s.p_size GROUP BY 1, 2""")
def unobserved_combinations(spark, sf):
    rows = _t(spark, sf, "part").filter("p_size % 3 = 0 OR p_brand < 'Brand#3'")
    rows = rows.select(F.when(F.col("p_size") % 7 != 0, F.col("p_brand")).alias("brand"), "p_size", F.col("p_retailprice").alias("price"))
    return _rounded(aggregate.with_unobserved(rows, ["brand", "p_size"], ["price"]), 4)


# --- names, casts, prefixes ---

_NAMED = "SELECT 'ME' || (p_size % 10 + 1) || ' BM' || (p_partkey % 10 + 1) AS name, p_size % 10 + 1 AS s, p_partkey % 10 + 1 AS b, p_retailprice AS price FROM part"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part")
    name = F.format_string("ME%d BM%d", F.col("p_size") % 10 + 1, F.col("p_partkey") % 10 + 1)
    size, value = P.portfolio_deciles("name")
    return p.select(name.alias("name"), F.col("p_retailprice").alias("price")).select("*", size.alias("size_decile"), value.alias("value_decile"))


@query(f"SELECT s::INT AS size_decile, {', '.join(f'round(avg(price) FILTER (b = {i}), 4) AS bm_{i}' for i in range(1, 11))} FROM ({_NAMED}) GROUP BY 1")
def portfolio_grid(spark, sf):
    wide = heatmap(_named(spark, sf), "size_decile", "value_decile", "price", list(range(1, 11)))
    return _rounded(wide.withColumnsRenamed({str(i): f"bm_{i}" for i in range(1, 11)}), 4)


@query(f"SELECT s::INT AS size_decile, round(avg(price), 4) AS mean_price, count(*) AS firms FROM ({_NAMED}) GROUP BY 1")
def decile_means(spark, sf):
    return _rounded(_named(spark, sf).groupBy("size_decile").agg(F.avg("price").alias("mean_price"), F.count("*").alias("firms")), 4)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS whole, trunc(o_totalprice)::BIGINT AS floored FROM orders""")
def cast_chains(spark, sf):
    """Text to a number to a whole one; what is no number is NULL."""
    o = _t(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.format_string("%.1f", F.col("o_custkey").cast("double")))
    whole = text.try_cast("double").cast("long")
    return o.select("o_orderkey", whole.alias("whole"), F.col("o_totalprice").cast("string").try_cast("double").cast("long").alias("floored"))


@query("SELECT event_id, round((value + value * 2) / 2, 6) AS bif_rmse_mean, round(CASE WHEN user_id % 2 = 0 THEN value * 3 END, 6) AS pf_rmse_mean, NULL::DOUBLE AS bf_rmse_mean FROM events")
def means_by_prefix(spark, sf):
    v = F.col("value")
    e = _t(spark, sf, "events").select("event_id", v.alias("bif_rmse_0"), (v * 2).alias("bif_rmse_1"), F.when(F.col("user_id") % 2 == 0, v * 3).alias("pf_rmse_0"))
    return _rounded(aggregate.mean_by_prefix(e, ["bif", "pf", "bf"], "rmse").select("event_id", "bif_rmse_mean", "pf_rmse_mean", "bf_rmse_mean"))


@query("""SELECT name, round(total, 2) AS total, round(sum(total) OVER (ORDER BY total DESC), 2) AS running,
round(sum(total) OVER (ORDER BY total DESC) / sum(total) OVER (), 6) AS running_share FROM (SELECT o_orderpriority AS name, sum(o_totalprice) AS total FROM orders GROUP BY 1)""")
def cumulative_shares(spark, sf):
    """Of one small aggregated table: five rows meet in one task."""
    totals = _t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.sum("o_totalprice").alias("total"))
    out = panel.cumulative_share(totals, "total", "total")
    return out.select("name", _r("total", 2).alias("total"), _r("running", 2).alias("running"), _r("running_share").alias("running_share"))
