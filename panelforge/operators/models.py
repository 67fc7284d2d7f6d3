"""State-space operators over DataFrames: simulation, filters, smoothers, likelihoods, estimation, residuals.

A run is a group: (run_id, t, y). Its rows meet in one task, as a recursion in t is sequential; parallelism is over runs,
parameter sets and replicates. A run's own cost is T (2K)^2 numbers. Parameters are one row for each run, joined before
the group is formed, so that nothing is broadcast that grows with the data.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..kernels import diagnostics, filters, garch, likelihoods, optimize, particle, simulate
from ..kernels.params import FIELDS, Params, as_params, as_row

DESIGN = ("N", "K", *FIELDS)
BATCH = 4_000_000  #: observations and covariances of runs that a kernel takes at once; one run beyond it goes alone


def params_df(spark: SparkSession, params: dict[str, Params]) -> DataFrame:
    rows = [{"param_id": k, **as_row(p)} for k, p in params.items()]
    return spark.createDataFrame([tuple(r[c] for c in ("param_id", *DESIGN)) for r in rows], schemas.PARAMS)


def _of(row) -> Params:
    return as_params({c: row[c] for c in DESIGN if c in row})


def _y(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf.sort_values("t")["y"].tolist(), float)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by key over all shuffle partitions. A group costs far more than its bytes, by which adaptive execution would
    put small partitions together into one task; a stated number of partitions is left alone, and serves the group-by."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def with_params(panel: DataFrame, params: DataFrame) -> DataFrame:
    """panel (run_id, t, y) with its run's parameters on its first row only: the others carry none across the shuffle.
    params: param_id, or run_id, names the run."""
    key = "run_id" if "run_id" in params.columns else "param_id"
    p = params.select(F.col(key).alias("run_id"), F.lit(0).alias("t"), F.struct(*DESIGN).alias("p"))
    return spread(panel.select("run_id", "t", "y").join(p, ["run_id", "t"], "left"), "run_id")


def _design(pdf: pd.DataFrame) -> Params:
    rows = pdf["p"].dropna()
    if rows.empty:
        raise ValueError(f"run {pdf['run_id'].iloc[0]} has no parameters, or no row t = 0")
    return _of(rows.iloc[0].asDict() if hasattr(rows.iloc[0], "asDict") else dict(rows.iloc[0]))


class Run(NamedTuple):
    """A whole run, in the order of t."""

    run_id: str
    t: np.ndarray
    y: np.ndarray
    p: Params


def _whole_runs(batches: Iterator[pd.DataFrame]) -> Iterator[Run]:
    """Runs out of rows that are sorted by run, however batches cut them."""
    held: list[pd.DataFrame] = []

    def run() -> Run:
        pdf = pd.concat(held)
        return Run(pdf["run_id"].iloc[0], np.sort(pdf["t"].to_numpy()), _y(pdf), _design(pdf))

    for pdf in batches:
        for _, part in pdf.groupby("run_id", sort=False, dropna=False):
            if held and held[0]["run_id"].iloc[0] != part["run_id"].iloc[0]:
                yield run()
                held = []
            held.append(part)
    if held:
        yield run()


def by_batches(panel: DataFrame, params: DataFrame, kernel: Callable[[list[Run]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """kernel over the runs of each partition, those of one shape in batches of at most BATCH numbers: a recursion's steps
    cost about the same for one run as for many. A run's result doesn't depend on its batch."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[Run]] = defaultdict(list)
        size = 0
        for r in _whole_runs(batches):
            n = len(r.t) * (r.p.N + 4 * r.p.K**2)
            if size and size + n > BATCH:
                for runs in held.values():
                    yield from kernel(runs)
                held.clear()
                size = 0
            held[len(r.t), r.p.N, r.p.K].append(r)
            size += n
        for runs in held.values():
            yield from kernel(runs)

    return with_params(panel, params).sortWithinPartitions("run_id", "t").mapInPandas(mapped, schema)


def simulate_df(params: DataFrame, T: int, replicates: int = 1, seed: int = 0) -> DataFrame:
    """(run_id, t, y, f, h) for each parameter set and replicate; run_id is param_id/replicate. A replicate's seed depends
    on its own number only, so reruns agree."""
    grid = params.crossJoin(params.sparkSession.range(replicates).withColumnRenamed("id", "rep"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                y, f, h = simulate.simulate(_of(r), T, seed + int(r["rep"]))
                yield pd.DataFrame({"run_id": f"{r['param_id']}/{r['rep']}", "t": range(T), "y": list(y), "f": list(f), "h": list(h)})

    return spread(grid, "param_id", "rep").mapInPandas(run, schemas.SIMULATED)


def run_params(simulated: DataFrame, params: DataFrame) -> DataFrame:
    """Each simulated run's parameters, under its run_id."""
    runs = simulated.select("run_id").distinct().withColumn("param_id", F.regexp_extract("run_id", r"^(.*)/\d+$", 1))
    return runs.join(params, "param_id").drop("param_id")


def filter_df(panel: DataFrame, params: DataFrame, kind: str = "BIF", predict_first: bool = True, init_factor_var: float | None = None, covariances: bool = True) -> DataFrame:
    """Filtered states of each run: the mode filter in information (BIF) or covariance (BF) form."""
    def kernel(runs: list[Run]) -> Iterator[pd.DataFrame]:
        x = filters.run_filter(filters.Batch.of([r.p for r in runs]), np.stack([r.y for r in runs]), kind, predict_first, init_factor_var)
        for i, r in enumerate(runs):
            cov = list(filters.full(x.cov_f[i], x.cov_h[i]).reshape(len(r.t), -1)) if covariances else None
            yield pd.DataFrame({"run_id": r.run_id, "t": r.t, "state": list(x.alpha[i]), "cov": cov, "dim": 2 * r.p.K, "loglik": x.loglik[i], "clamped": bool(x.clamped[i])})

    return by_batches(panel, params, kernel, schemas.FILTERED)


def smooth_df(panel: DataFrame, params: DataFrame, kind: str = "BIF") -> DataFrame:
    """Smoothed states, covariances, and lag-one covariances (from t to t - 1; none at the first t)."""
    def kernel(runs: list[Run]) -> Iterator[pd.DataFrame]:
        b = filters.Batch.of([r.p for r in runs])
        s = filters.smooth(b, filters.run_filter(b, np.stack([r.y for r in runs]), kind))
        for i, r in enumerate(runs):
            cov = filters.full(s.cov_f[i], s.cov_h[i]).reshape(len(r.t), -1)
            lag = filters.full(s.lag_f[i], s.lag_h[i]).reshape(len(r.t) - 1, -1)
            yield pd.DataFrame({"run_id": r.run_id, "t": r.t, "state": list(s.alpha[i]), "cov": list(cov), "lag1_cov": [None, *lag], "dim": 2 * r.p.K})

    return by_batches(panel, params, kernel, schemas.SMOOTHED)


def particle_df(panel: DataFrame, params: DataFrame, particles: int = 1000, resample_below: float = 0.5, seed: int = 42, smoothed: bool = False) -> DataFrame:
    """The bootstrap particle filter of each run, or its Gaussian smoother."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, y = _design(pdf), _y(pdf)
        x = particle.particle_filter(p, y, particles, resample_below, seed)
        means, covs = particle.smooth_particles(p, x) if smoothed else (x.means, x.covs)
        rows = {"run_id": pdf["run_id"].iloc[0], "t": np.sort(pdf["t"].to_numpy()), "state": list(means), "cov": list(covs.reshape(len(y), -1))}
        return pd.DataFrame(rows | {"dim": 2 * p.K, "ess": x.ess, "loglik": x.loglik})

    return with_params(panel, params).groupBy("run_id").applyInPandas(run, schemas.PARTICLE)


def long_states(states: DataFrame) -> DataFrame:
    """(run_id, t, kind, k, value): factors and log volatilities as rows."""
    half = (F.size("state") / 2).cast("int")
    each = states.select("run_id", "t", half.alias("__k"), F.posexplode("state").alias("i", "value"))
    return each.select("run_id", "t", F.when(F.col("i") < F.col("__k"), "f").otherwise("h").alias("kind"), (F.col("i") % F.col("__k")).alias("k"), "value")


def accuracy_df(states: DataFrame, truth: DataFrame) -> DataFrame:
    """(run_id, kind, k, rmse, corr) of states against simulated ones; built-in aggregates."""
    true = long_states(truth.select("run_id", "t", F.concat("f", "h").alias("state"))).withColumnRenamed("value", "true")
    both = long_states(states).join(true, ["run_id", "t", "kind", "k"])
    live = (F.stddev_pop("value") > 1e-10) & (F.stddev_pop("true") > 1e-10)
    corr = F.covar_pop("value", "true") / (F.stddev_pop("value") * F.stddev_pop("true"))
    return both.groupBy("run_id", "kind", "k").agg(F.sqrt(F.avg((F.col("value") - F.col("true")) ** 2)).alias("rmse"), F.when(live & (F.count("*") > 1), corr).alias("corr"))


def loglik_df(panel: DataFrame, candidates: DataFrame, kind: str = "BIF", particles: int = 1000, seed: int = 42) -> DataFrame:
    """(run_id, param_id, filter_type, loglik, loglik_constant) of every candidate on every run. Candidates are dealt into
    as many blocks as there are shuffle partitions; a block meets a run in one task and is evaluated in one batch, so a grid
    over one run runs in parallel, and a panel is copied once a block. loglik_constant is to be added to a mode filter's
    value before filters are compared."""
    packed = panel.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("ys"))
    block = F.pmod(F.xxhash64("param_id"), F.lit(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("block")
    blocks = candidates.groupBy(block).agg(F.collect_list(F.struct("param_id", *DESIGN)).alias("candidates"))
    pairs = spread(packed.crossJoin(blocks), "run_id", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run_id, ys, block in zip(pdf["run_id"], pdf["ys"], pdf["candidates"]):
                y, block = np.array([r["y"] for r in ys], float), [_plain(c) for c in block]
                ll = likelihoods.logliks([_of(c) for c in block], y, kind, particles, seed)
                const = 0.0 if kind == "PF" else filters.constant(y.shape[1], len(y))
                names = [c["param_id"] for c in block]
                yield pd.DataFrame({"run_id": run_id, "param_id": names, "filter_type": kind, "loglik": ll, "loglik_constant": const})

    return pairs.mapInPandas(run, schemas.LOGLIK)


def fit_df(panel: DataFrame, starts: DataFrame, kind: str = "BIF", **options) -> DataFrame:
    """One estimation for each run, all steps inside its task; starts: one parameter row a run. Failures are rows."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        run_id = pdf["run_id"].iloc[0]
        r = optimize.fit(_y(pdf), _design(pdf), kind, **options)
        row = {f.split()[0]: getattr(r, f.split()[0], None) for f in schemas.FIT.split("struct<")[0].split(",") if f.split()}
        row |= {
            "fit_id": run_id, "final_loss": float(r.final_loss) if np.isfinite(r.final_loss) else None, "final_params": as_row(r.final_params),
            "loss_history": r.loss_history, "param_history": [as_row(p) for p in r.param_history]
        }
        names = [
            "fit_id", "filter_type", "optimizer_name", "uses_transformations", "fix_mu", "prior_config_name", "success", "result_code", "final_loss",
            "steps", "time_taken", "error_message", "final_params", "loss_history", "param_history"
        ]
        return pd.DataFrame([[row[n] for n in names]], columns=names)

    return with_params(panel, starts).groupBy("run_id").applyInPandas(run, schemas.FIT)


PANEL_BYTES = 64 << 20  #: of a panel that fit_distributed sends to every task


def fit_distributed(panel: DataFrame, start: Params, kind: str = "BIF", **options) -> optimize.Fit:
    """One estimation whose values and slopes are Spark jobs: every step's candidates are rows, evaluated in parallel. The panel is
    one run; one of more than PANEL_BYTES is refused before any of it is collected."""
    spark = panel.sparkSession
    size = 8 * (panel.agg(F.sum(F.size("y"))).first()[0] or 0)
    if size > PANEL_BYTES:
        raise ValueError(f"the panel has {size} bytes, more than the {PANEL_BYTES} that every task may hold; use fit_df")
    y = _y(panel.select("t", "y").toPandas())
    data = spark.sparkContext.broadcast(y)
    priors, weight = options.get("priors"), options.get("stability_weight", 1000.0)

    def evaluate(candidates: list[Params]) -> np.ndarray:
        parts = min(len(candidates), spark.sparkContext.defaultParallelism)
        table = params_df(spark, {str(i): p for i, p in enumerate(candidates)}).repartition(parts)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                values = likelihoods.objectives([_of(r) for r in pdf.to_dict("records")], data.value, kind, priors, weight)
                yield pd.DataFrame({"i": pdf["param_id"].astype(int), "value": values})

        got = table.mapInPandas(run, "i int, value double").collect()
        return np.array([r["value"] for r in sorted(got, key=lambda r: r["i"])])

    def gradients(build, points: np.ndarray, _y, kind: str, priors, boundary_weight: float, modes=None) -> np.ndarray:
        """Exact slopes, a point a row: a Hessian's points are worked out in parallel."""
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "i int, v array<double>").repartition(len(points))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                at = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
                yield pd.DataFrame({"i": pdf["i"], "g": list(likelihoods.slopes(build, at, data.value, kind, priors, boundary_weight)) if len(pdf) else []})

        return np.array([r["g"] for r in sorted(table.mapInPandas(run, "i int, g array<double>").collect(), key=lambda r: r["i"])])

    try:
        exact = {"gradients": gradients} if kind != "PF" else {}
        return optimize.fit(y, start, kind, evaluate=evaluate, **exact, **options)
    finally:
        data.destroy()


def _pairs(true: DataFrame, estimated: DataFrame, key: str) -> DataFrame:
    a = true.select(F.col(key).alias("id"), F.struct(*DESIGN).alias("a"))
    return a.join(estimated.select(F.col(key).alias("id"), F.struct(*DESIGN).alias("b")), "id")


def param_errors_df(true: DataFrame, estimated: DataFrame, key: str = "param_id") -> DataFrame:
    """Errors of each parameter, for ids that both tables have; unmatched_ids() gives the others."""
    pairs = _pairs(true, estimated, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = zip(pdf["id"], pdf["a"], pdf["b"])
            yield pd.DataFrame([{"id": i} | r for i, a, b in both for r in diagnostics.param_errors(_of(_plain(a)), _of(_plain(b)))])

    return pairs.mapInPandas(run, schemas.PARAM_ERRORS)


def unmatched_ids(true: DataFrame, estimated: DataFrame, key: str = "param_id") -> DataFrame:
    """(id, side): ids that only one of the tables has, true or estimated."""
    a, b = (d.select(F.col(key).alias("id")).distinct() for d in (true, estimated))
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("true")).union(b.join(a, "id", "left_anti").withColumn("side", F.lit("estimated")))


def element_bias_df(true: DataFrame, estimated: DataFrame, key: str = "param_id") -> DataFrame:
    """(id, param, i, j, bias): estimate minus truth of every element, vectors with j = 0; built-in expressions."""
    def cells(side: str, name: str) -> Column:
        x = F.col(f"{side}.{name}")
        return x if name in ("lambda_r", "Phi_f", "Phi_h", "Q_h") else F.transform(x, lambda v: F.array(v))

    def bias(name: str) -> Column:
        rows = F.zip_with(cells("a", name), cells("b", name), lambda r, s: F.zip_with(r, s, lambda v, w: w - v))
        flat = F.flatten(F.transform(rows, lambda r, i: F.transform(r, lambda v, j: F.struct(F.lit(name).alias("param"), i.alias("i"), j.alias("j"), v.alias("bias")))))
        return flat

    return _pairs(true, estimated, key).select("id", F.inline(F.concat(*[bias(f) for f in FIELDS])))


def bias_ellipses_df(bias: DataFrame, by: tuple[str, ...] = ("param",)) -> DataFrame:
    """(by, major, minor, angle): axes and angle, in degrees, of each group's mean 2 x 2 bias matrix; built-in aggregates.
    bias: element_bias_df(), of whose matrices those of 2 x 2 elements count."""
    def at(i: int, j: int) -> Column:
        return F.avg(F.when((F.col("i") == i) & (F.col("j") == j), F.col("bias")))

    square = bias.groupBy(*by).agg(F.max("i").alias("__i"), F.max("j").alias("__j"), at(0, 0).alias("p"), ((at(0, 1) + at(1, 0)) / 2).alias("q"), at(1, 1).alias("r"))
    half, gap = (F.col("p") + F.col("r")) / 2, F.sqrt(((F.col("p") - F.col("r")) / 2) ** 2 + F.col("q") ** 2)
    angle = F.degrees(F.atan2(2 * F.col("q"), F.col("p") - F.col("r"))) / 2
    return square.filter("__i = 1 and __j = 1").select(*by, (half + gap).alias("major"), (half - gap).alias("minor"), angle.alias("angle"))


def key_parameters_df(params: DataFrame, key: str = "param_id") -> DataFrame:
    """(id, phi_f_size, phi_h_size, mu_mean, sigma2_min, sigma2_max, sigma2_mean, q_h_mean): greatest eigenvalue sizes of the
    dynamics, mean mu, range and mean of the variances, mean diagonal of Q_h."""
    schema = "id string, phi_f_size double, phi_h_size double, mu_mean double, sigma2_min double, sigma2_max double, sigma2_mean double, q_h_mean double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                p = _of(r)
                sizes = [float(np.abs(np.linalg.eigvals(x)).max()) for x in (p.Phi_f, p.Phi_h)]
                rows.append((str(r[key]), *sizes, p.mu.mean(), p.sigma2.min(), p.sigma2.max(), p.sigma2.mean(), np.diag(p.Q_h).mean()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return params.select(key, *DESIGN).mapInPandas(run, schema)


def _plain(x):
    return x.asDict() if hasattr(x, "asDict") else dict(x)


def residuals_df(panel: DataFrame, states: DataFrame, params: DataFrame) -> DataFrame:
    """(run_id, t, z, logdet, avg_corr, factor_share): whitened residuals, and statistics of the implied covariance. Rows
    are independent of each other once states are known, so they aren't grouped."""
    key = "run_id" if "run_id" in params.columns else "param_id"
    p = params.select(F.col(key).alias("run_id"), F.struct(*DESIGN).alias("p"))
    rows = panel.select("run_id", "t", "y").join(states.select("run_id", "t", "state", "cov"), ["run_id", "t"]).join(p, "run_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for run_id, g in pdf.groupby("run_id", sort=False):
                q = _of(_plain(g["p"].iloc[0]))
                k = q.K
                cov_f = np.array(g["cov"].tolist()).reshape(-1, 2 * k, 2 * k)[:, :k, :k]
                sigma = diagnostics.implied_covariance(q, cov_f)
                z = diagnostics.standardized(q, np.array(g["y"].tolist(), float), np.array(g["state"].tolist())[:, :k], cov_f)
                of = {"logdet": diagnostics.generalized_variance(sigma)[1], "avg_corr": diagnostics.average_correlation(sigma)}
                yield pd.DataFrame({"run_id": run_id, "t": g["t"].to_numpy(), "z": list(z)} | of | {"factor_share": diagnostics.factor_share(q, cov_f)})

    return rows.mapInPandas(run, "run_id string, t int, z array<double>, logdet double, avg_corr double, factor_share double")


def series_tests_df(df: DataFrame, by: str, at: str, value: str, lb_lags=(5, 10, 15, 20), arch_lags=(5, 10)) -> DataFrame:
    """(series, test, lags, statistic, p_value, passed) of each series: portmanteau of squares, ARCH-LM, Jarque-Bera, unit
    root. A test that can't be done is a row with no value."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(at)[value].dropna().to_numpy(float)
        tests = [("ljung_box_sq", k, lambda k=k: diagnostics.ljung_box(x**2, k)) for k in lb_lags] + [("arch_lm", k, lambda k=k: diagnostics.arch_lm(x, k)) for k in arch_lags]
        tests += [("jarque_bera", 0, lambda: diagnostics.jarque_bera(x)[:2]), ("adf", 0, lambda: diagnostics.adf(x)[:2])]
        rows = []
        for name, k, test in tests:
            try:
                s, p = test() if len(x) > k + 10 and x.std() > 1e-12 else (None, None)
            except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
                s = p = None
            rows.append((str(pdf[by].iloc[0]), name, k, s, p, None if p is None else bool(p <= 0.05 if name == "adf" else p > 0.05)))
        return pd.DataFrame(rows, columns=["series", "test", "lags", "statistic", "p_value", "passed"])

    return spread(df.select(by, at, value), by).groupBy(by).applyInPandas(run, "series string, test string, lags int, statistic double, p_value double, passed boolean")


def multivariate_tests_df(residuals: DataFrame, run: str = "run_id", lags: int = 5) -> DataFrame:
    """(run_id, test, statistic, p_value): Mardia, Hosking and Li-McLeod tests on vectors z, and the Student degrees of
    freedom. Rows with a NaN are left out."""
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.array(pdf.sort_values("t")["z"].tolist(), float)
        z = z[np.isfinite(z).all(1)]
        m = diagnostics.mardia(z)
        rows = [("mardia_skewness", m["skewness"], m["skewness_p"]), ("mardia_kurtosis", m["kurtosis"], m["kurtosis_p"])]
        rows += [(k, *diagnostics.portmanteau(z, lags, k)[:2]) for k in ("hosking", "limcleod")] + [("student_df", diagnostics.student_df(z), None)]
        return pd.DataFrame([(pdf[run].iloc[0], *r) for r in rows], columns=["run_id", "test", "statistic", "p_value"])

    return spread(residuals, run).groupBy(run).applyInPandas(go, "run_id string, test string, statistic double, p_value double")


def student_jarque_bera_df(residuals: DataFrame, run: str = "run_id", draws: int = 2000, blocks: int = 8, seed: int = 0) -> DataFrame:
    """(run_id, dof, n, statistic, draws, p_value): the Jarque-Bera statistic of pooled residuals z under a Student t of unit
    variance, whose degrees of freedom are estimated first; its distribution comes from Monte Carlo draws of the same size.
    Draws are dealt as rows, each block with a seed of its own; the p value counts the observed one among them."""
    def observed(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.array(pdf["z"].tolist(), float)
        z = z[np.isfinite(z).all(1)].ravel()
        return pd.DataFrame([(str(pdf[run].iloc[0]), diagnostics.student_df(z), len(z), diagnostics.jarque_bera(z)[0])], columns=["run_id", "dof", "n", "statistic"])

    seen = spread(residuals.select(run, "z"), run).groupBy(run).applyInPandas(observed, "run_id string, dof double, n long, statistic double")
    each = -(-draws // blocks)
    dealt = spread(seen.crossJoin(residuals.sparkSession.range(blocks).withColumnRenamed("id", "block")), "run_id", "block")

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            above = []
            for r in pdf.itertuples():
                g = np.random.default_rng([seed, int(r.block)])
                scale = np.sqrt((r.dof - 2) / r.dof)
                above.append(sum(diagnostics.jarque_bera(scale * g.standard_t(r.dof, int(r.n)))[0] >= r.statistic for _ in range(each)))
            yield pdf.assign(above=above)

    schema = "run_id string, dof double, n long, statistic double, block long, above long"
    sums = dealt.mapInPandas(drawn, schema).groupBy("run_id", "dof", "n", "statistic").agg(F.sum("above").alias("above"), F.lit(each * blocks).alias("draws"))
    return sums.select("run_id", "dof", "n", "statistic", "draws", ((F.col("above") + 1) / (F.col("draws") + 1)).alias("p_value"))


def garch_df(df: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """One row a series: GARCH(1,1) parameters, fit, Wald test, conditional variances and standardised residuals in the
    order of time. A series that can't be fitted has an error."""
    schema = "series string, omega double, alpha double, beta double, nu double, loglik double, converged boolean, wald_p double, variance array<double>, residuals array<double>, error string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = str(pdf[by].iloc[0])
        try:
            g = garch.fit_garch(pdf.sort_values(at)[value].dropna().to_numpy(float))
            row = [name, g.omega, g.alpha, g.beta, g.nu, g.loglik, g.converged, g.wald_p, g.variance.tolist(), g.residuals.tolist(), None]
        except (ValueError, np.linalg.LinAlgError) as e:
            row = [name, *[None] * 9, str(e)]
        return pd.DataFrame([row], columns=[f.strip().split()[0] for f in schema.split(",")])

    return spread(df.select(by, at, value), by).groupBy(by).applyInPandas(run, schema)


def dcc_df(panel: DataFrame, run: str = "run_id") -> DataFrame:
    """(run_id, t, a, b, corr, cov, dim, gmv): dynamic conditional correlations of dense panels (run_id, t, y), and each
    step's minimum-variance weights. Univariate fits first, then the correlation recursion, in the run's task."""
    schema = "run_id string, t int, a double, b double, corr array<double>, cov array<double>, dim int, gmv array<double>"

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _y(pdf)
        fits = [garch.fit_garch(y[:, i]) for i in range(y.shape[1])]
        eps, sigma = np.column_stack([g.residuals for g in fits]), np.sqrt(np.column_stack([g.variance for g in fits]))
        a, b, _ = garch.fit_dcc(eps)
        r, h = garch.dcc_path(eps, sigma, a, b)
        rows = {"run_id": pdf[run].iloc[0], "t": np.sort(pdf["t"].to_numpy()), "a": a, "b": b, "corr": list(r.reshape(len(y), -1)), "cov": list(h.reshape(len(y), -1))}
        return pd.DataFrame(rows | {"dim": y.shape[1], "gmv": [garch.minimum_variance(c) for c in h]})

    return spread(panel.select(run, "t", "y"), run).groupBy(run).applyInPandas(go, schema)


def lyapunov_df(params: DataFrame, rounds: int = 30) -> DataFrame:
    """(param_id, rounds, i, j, value): the covariance that log volatilities reach after each number of rounds up to rounds."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                p = _of(r)
                for n in range(rounds + 1):
                    x = filters.lyapunov(p.Phi_h, p.Q_h, n)
                    i, j = np.indices(x.shape)
                    yield pd.DataFrame({"param_id": r["param_id"], "rounds": n, "i": i.ravel(), "j": j.ravel(), "value": x.ravel()})

    return params.mapInPandas(run, "param_id string, rounds int, i int, j int, value double")


def garch_path_df(df: DataFrame, by: str, at: str, value: str, omega: float, alpha: float, beta: float, start: float) -> DataFrame:
    """(series, i, variance): conditional variances at given parameters, from i = 1 on, one for each value in the order of
    time."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(at)[value].dropna().to_numpy(float)
        h = garch.variance_path(x * x, omega, alpha, beta, start)[:, 0]
        return pd.DataFrame({"series": str(pdf[by].iloc[0]), "i": np.arange(1, len(h) + 1), "variance": h})

    return spread(df.select(by, at, value), by).groupBy(by).applyInPandas(run, "series string, i int, variance double")


def dcc_path_df(panel: DataFrame, a: float, b: float, omega: float, alpha: float, beta: float, run: str = "run_id") -> DataFrame:
    """(run_id, t, corr, cov, dim, gmv) at given parameters of the variances and of the correlations; each variance begins
    with its series' mean square. The last row of a run, one step after its last observation, is the forecast."""
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _y(pdf)
        ahead = np.vstack([y, np.zeros(y.shape[1])])
        h = np.column_stack([garch.variance_path(ahead[:, i] ** 2, omega, alpha, beta, float((y[:, i] ** 2).mean()))[:, 0] for i in range(y.shape[1])])
        eps, sigma = y / np.sqrt(h[:-1]), np.sqrt(h)
        cov = np.concatenate([garch.dcc_path(eps, sigma[:-1], a, b)[1], garch.dcc_forecast(eps, sigma[-1], a, b)[None]])
        corr = cov / (sigma[:, :, None] * sigma[:, None, :])
        t = np.sort(pdf["t"].to_numpy())
        rows = {"run_id": pdf[run].iloc[0], "t": np.r_[t, t[-1] + 1], "corr": list(corr.reshape(len(cov), -1)), "cov": list(cov.reshape(len(cov), -1))}
        return pd.DataFrame(rows | {"dim": y.shape[1], "gmv": [garch.minimum_variance(c) for c in cov]})

    schema = "run_id string, t int, corr array<double>, cov array<double>, dim int, gmv array<double>"
    return spread(panel.select(run, "t", "y"), run).groupBy(run).applyInPandas(go, schema)


def student_loglik_df(panel: DataFrame, covs: DataFrame, dof: float, n_params: int, run: str = "run_id") -> DataFrame:
    """(run_id, n_obs, loglik, aic, bic) of returns under a multivariate Student t with each step's covariance. panel: (run_id,
    t, y); covs: (run_id, t, cov). Steps are independent once covariances are known, so rows aren't grouped: each gives its
    density, and sums are aggregates. A step whose covariance has no positive determinant, ridged, is left out."""
    rows = panel.select(run, "t", "y").join(covs.select(run, "t", "cov"), [run, "t"])

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = [np.array(v, float) for v in pdf["y"]]
            values = [garch.student_loglik(v[None], np.array(c, float).reshape(1, len(v), len(v)), dof) for v, c in zip(y, pdf["cov"])]
            yield pd.DataFrame({"run_id": pdf[run].astype(str), "value": values})

    sums = rows.mapInPandas(go, "run_id string, value double").groupBy("run_id").agg(F.count("*").alias("n_obs"), F.sum("value").alias("loglik"))
    return sums.withColumns({"aic": 2.0 * n_params - 2 * F.col("loglik"), "bic": n_params * F.log("n_obs") - 2 * F.col("loglik")})


def linear_factors_df(panel: DataFrame, k: int, run: str = "run_id") -> DataFrame:
    """(run_id, t, state, loglik, aic, bic) of a linear Gaussian factor model fitted to each run."""
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _y(pdf)
        m = garch.fit_linear_factors(y, k)
        aic, bic = diagnostics.information_criteria(m.loglik, y.shape[1] * k + 2 * k * k + y.shape[1], len(y))
        return pd.DataFrame({"run_id": pdf[run].iloc[0], "t": np.sort(pdf["t"].to_numpy()), "state": list(m.states), "loglik": m.loglik, "aic": aic, "bic": bic})

    return spread(panel.select(run, "t", "y"), run).groupBy(run).applyInPandas(go, "run_id string, t int, state array<double>, loglik double, aic double, bic double")


def pca_df(panel: DataFrame, run: str = "run_id") -> DataFrame:
    """(run_id, component, eigenvalue, ratio, cumulative) of each dense panel."""
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        got = diagnostics.pca(_y(pdf))
        return pd.DataFrame({"run_id": pdf[run].iloc[0], "component": range(1, len(got["ratio"]) + 1), "eigenvalue": got["eigenvalues"], "ratio": got["ratio"], "cumulative": got["cumulative"]})

    return spread(panel.select(run, "t", "y"), run).groupBy(run).applyInPandas(go, "run_id string, component int, eigenvalue double, ratio double, cumulative double")


def components_needed(components: DataFrame, shares: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95), run: str = "run_id") -> DataFrame:
    """(run_id, needed_50, needed_80, ...): how many components reach each share. components: pca_df()."""
    least = [F.min(F.when(F.col("cumulative") >= s - 1e-12, F.col("component"))).alias(f"needed_{round(100 * s)}") for s in shares]
    return components.groupBy(run).agg(*least)


def complete_loglik_df(simulated: DataFrame, params: DataFrame) -> DataFrame:
    """(run_id, observation, factors, volatility, joint): complete-data log likelihoods of runs whose states are known."""
    key = "run_id" if "run_id" in params.columns else "param_id"
    p = params.select(F.col(key).alias("run_id"), F.lit(0).alias("t"), F.struct(*DESIGN).alias("p"))
    rows = spread(simulated.select("run_id", "t", "y", "f", "h").join(p, ["run_id", "t"], "left"), "run_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, pdf = _design(pdf), pdf.sort_values("t")
        y, f, h = (np.array(pdf[c].tolist(), float) for c in ("y", "f", "h"))
        parts = likelihoods.observation_loglik(q, y, f).sum(), likelihoods.factor_loglik(q, f, h).sum(), likelihoods.volatility_loglik(q, h).sum()
        return pd.DataFrame([[pdf["run_id"].iloc[0], *parts, sum(parts)]], columns=["run_id", "observation", "factors", "volatility", "joint"])

    return rows.groupBy("run_id").applyInPandas(run, "run_id string, observation double, factors double, volatility double, joint double")


def fit_quality_df(panel: DataFrame, states: DataFrame, params: DataFrame) -> DataFrame:
    """(run_id, series, r2, rmse) of the returns that states imply; built-in expressions. A constant series has no r2."""
    key = "run_id" if "run_id" in params.columns else "param_id"
    rows = panel.select("run_id", "t", "y").join(states.select("run_id", "t", "state"), ["run_id", "t"]).join(params.select(F.col(key).alias("run_id"), "lambda_r"), "run_id")
    implied = F.transform("lambda_r", lambda row: F.aggregate(F.zip_with(row, F.slice("state", F.lit(1), F.size(row)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    cells = rows.select("run_id", F.posexplode(F.zip_with("y", implied, lambda a, b: F.struct(a.alias("y"), b.alias("x")))).alias("series", "c"))
    squares = F.sum((F.col("c.y") - F.col("c.x")) ** 2)
    whole = F.var_pop("c.y") * F.count("*")
    return cells.groupBy("run_id", "series").agg(F.when(whole > 1e-20, 1 - squares / whole).alias("r2"), F.sqrt(squares / F.count("*")).alias("rmse"))


def smoothing_gain_df(filtered: DataFrame, smoothed: DataFrame, truth: DataFrame) -> DataFrame:
    """(run_id, kind, k, filtered and smoothed rmse and corr, gain_pct)."""
    a = accuracy_df(filtered, truth).withColumnsRenamed({"rmse": "filtered_rmse", "corr": "filtered_corr"})
    b = accuracy_df(smoothed, truth).withColumnsRenamed({"rmse": "smoothed_rmse", "corr": "smoothed_corr"})
    return a.join(b, ["run_id", "kind", "k"]).withColumn("gain_pct", F.when(F.col("filtered_rmse") > 0, 100 * (1 - F.col("smoothed_rmse") / F.col("filtered_rmse"))))


def volatility_range_df(simulated: DataFrame) -> DataFrame:
    """(run_id, k, low, high, mean): the range of each factor's volatility, exp(h / 2); aggregates."""
    v = F.exp(F.col("h") / 2)
    cells = simulated.select("run_id", F.posexplode("h").alias("k", "h"))
    return cells.groupBy("run_id", "k").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"))


def return_correlations_df(panel: DataFrame) -> DataFrame:
    """(run_id, a, b, corr) of every two series of a run, from one row's pairs: no join; the first step, which a simulator
    leaves at 0, is left out."""
    n = F.size("y")
    pairs = F.flatten(F.transform("y", lambda x, i: F.transform(F.slice("y", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda z, j: F.struct(
        i.alias("a"), (i + j + 1).alias("b"), x.alias("x"), z.alias("z")))))
    cells = panel.filter("t > 0").select("run_id", F.inline(pairs))
    return cells.groupBy("run_id", "a", "b").agg(F.corr("x", "z").alias("corr"))


def simulation_summary_df(simulated: DataFrame) -> DataFrame:
    """(run_id, series, mean, std, autocorr, autocorr_sq): what a simulated panel looks like; windows and aggregates."""
    from pyspark.sql import Window

    from ..functions import guarded_corr

    cells = simulated.filter("t > 0").select("run_id", "t", F.posexplode("y").alias("series", "v"))
    w = Window.partitionBy("run_id", "series").orderBy("t")
    back = cells.withColumn("b", F.lag("v").over(w))
    return back.groupBy("run_id", "series").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), guarded_corr("v", "b").alias("autocorr"),
        guarded_corr(F.col("v") ** 2, F.col("b") ** 2).alias("autocorr_sq")
    )
