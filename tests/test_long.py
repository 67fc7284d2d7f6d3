"""Long runs and wide panels: the same whatever the split, and the same as the plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.kernels import diagnostics, garch, scan
from panelforge.operators import lagged, long_runs, panel, ranged, regression, tiles


@pytest.fixture(scope="module")
def linear():
    rng = np.random.default_rng(0)
    return scan.Linear.of(rng.normal(size=(3, 2)), [[0.8, 0.1], [0.05, 0.6]], [[0.5, 0.1], [0.1, 0.3]], [0.2, 0.3, 0.4])


def plain_smoother(m, y):
    xs, ps, pp, ll = garch.kalman(y, m.lam, m.phi, m.q, m.s2)
    sx, sp = xs.copy(), ps.copy()
    for t in range(len(y) - 2, -1, -1):
        g = np.linalg.solve(pp[t + 1], m.phi @ ps[t]).T
        sx[t], sp[t] = xs[t] + g @ (sx[t + 1] - m.phi @ xs[t]), ps[t] + g @ (sp[t + 1] - pp[t + 1]) @ g.T
    return xs, ps, ll, sx, sp


@pytest.mark.parametrize("n", [1, 2, 3, 8, 57])
def test_scans_equal_the_recursion(linear, n):
    y = np.random.default_rng(n).normal(size=(n, 3))
    xs, ps, ll, sx, sp = plain_smoother(linear, y)
    x, p, own = scan.filtered(linear, y, np.zeros(2), np.eye(2))
    assert np.abs(x - xs).max() < 1e-12 and np.abs(p - ps).max() < 1e-12 and abs(own.sum() - ll) < 1e-9
    e = tuple(v[::-1] for v in scan.smoothing_elements(linear, x, p, True))
    _, g, spread = scan.prefix(e, scan.combine_smoothing)
    assert np.abs(g[::-1] - sx).max() < 1e-10 and np.abs(spread[::-1] - sp).max() < 1e-10
    whole = scan.reduced(scan.filtering_elements(linear, y), scan.combine_filtering)
    end = scan.combine_filtering(scan.of_state(np.zeros(2), np.eye(2)), whole)
    assert np.abs(end[1][0] - xs[-1]).max() < 1e-12


@pytest.mark.parametrize("fan", [4, 7, 64])
def test_long_runs_at_any_split(spark, linear, fan):
    """Blocks of 4 make three levels of elements; runs of several lengths, one of them a single step."""
    rng = np.random.default_rng(5)
    runs = {"a": rng.normal(size=(90, 3)), "b": rng.normal(size=(5, 3)), "c": rng.normal(size=(1, 3))}
    rows = [(k, t, v.tolist()) for k, y in runs.items() for t, v in enumerate(y)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(r[0], int(r[1]), [float(x) for x in r[2]]) for r in rows], "run_id string, t int, y array<double>")
    states = long_runs.filter_long_df(df, linear, fan)
    got, smooth = states.collect(), long_runs.smooth_long_df(states, linear, fan).collect()
    for k, y in runs.items():
        xs, ps, ll, sx, sp = plain_smoother(linear, y)
        own, back = (sorted((r for r in rs if r["run_id"] == k), key=lambda r: r["t"]) for rs in (got, smooth))
        assert [r["t"] for r in own] == [r["t"] for r in back] == list(range(len(y)))
        assert np.abs(np.array([r["state"] for r in own]) - xs).max() < 1e-8 and abs(sum(r["loglik"] for r in own) - ll) < 1e-8
        assert np.abs(np.array([r["state"] for r in back]) - sx).max() < 1e-8
        assert np.abs(np.array([r["cov"] for r in back]).reshape(-1, 2, 2) - sp).max() < 1e-8


def test_steps_without_an_observation(spark, linear):
    rows = [("a", 0, [1.0, 0.0, 0.5]), ("a", 1, None), ("a", 2, [None, 1.0, 1.0]), ("a", 3, [0.1, 0.2, 0.3])]
    got = {r["t"]: r for r in long_runs.filter_long_df(spark.createDataFrame(rows, "run_id string, t int, y array<double>"), linear, 2).collect()}
    first, second = np.array(got[0]["state"]), np.array(got[1]["state"])
    assert np.abs(linear.phi @ first - second).max() < 1e-12 and got[1]["loglik"] == got[2]["loglik"] == 0 != got[3]["loglik"]
    assert long_runs.filter_long_df(spark.createDataFrame([], "run_id string, t int, y array<double>"), linear).count() == 0


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(70, 3))
    made = {f"s{i:02d}": base @ rng.normal(size=3) + rng.normal(size=70) + 100 for i in range(21)} | {"flat": np.ones(70)}
    rows = [(f"d{t:03d}", k, float(v[t])) for k, v in made.items() for t in range(70) if rng.random() > 0.1]
    return spark.createDataFrame(rows + [("d000", "none", None)], "at string, series_id string, value double").persist()


@pytest.mark.parametrize("span, side", [(16, 4), (512, 256), (1, 1)])
def test_tiles_give_the_correlations_of_the_date_join(wide, span, side):
    want = {(r["a"], r["b"]): (r["corr"], r["n"]) for r in panel.correlation_matrix(wide.filter("value is not null"), "at").collect()}
    got = {(r["a"], r["b"]): (r["corr"], r["n"]) for r in tiles.correlations(wide, "at", span=span, side=side).collect()}
    assert want.keys() == got.keys()
    for k, (c, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None) == (c is None) and (c is None or abs(got[k][0] - c) < 1e-9), k


def test_correlations_work_out_their_rows_once(spark):
    """Means, numbers and tiles read the rows; what the rows come from, joins of large tables, isn't repeated for each."""
    seen = spark.sparkContext.accumulator(0)

    def go(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf.assign(at=pdf["id"] // 5, series_id="s" + (pdf["id"] % 5).astype(str), value=(pdf["id"] * 7 % 11).astype(float)).drop(columns="id")

    df = spark.range(60).mapInPandas(go, "at long, series_id string, value double")
    assert tiles.correlations(df, "at").count() == 15 and seen.value == 60


def test_components_of_wide_panels(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 9)) + rng.normal(size=(60, 9))
    df = spark.createDataFrame([(f"{t:03d}", f"s{i}", float(x[t, i])) for t in range(60) for i in range(9)], "at string, series_id string, value double")
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    got = tiles.components(df, "at", 2, span=16, side=4).collect()
    for c in (1, 2):
        own = sorted((r for r in got if r["component"] == c), key=lambda r: r["series"])
        want = vectors[:, -c] * np.sign(vectors[np.abs(vectors[:, -c]).argmax(), -c])
        assert abs(own[0]["eigenvalue"] - values[-c]) < 1e-6 and abs(own[0]["ratio"] - values[-c] / 9) < 1e-6
        assert np.abs(np.array([r["loading"] for r in own]) - want).max() < 1e-4


@pytest.mark.parametrize("noise", [0.01, 1e-3])
def test_components_far_below_the_first(spark, noise):
    """Series that move almost as one: the second eigenvalue is hundreds to millions of times less than the first."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 1)) * rng.uniform(0.5, 1.5, 12) + noise * rng.normal(size=(40, 1)) * np.tile([2, -2], 6) + noise * rng.normal(size=(40, 12))
    df = spark.createDataFrame([(t, f"s{i:02d}", float(x[t, i])) for t in range(40) for i in range(12)], "at int, series_id string, value double")
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    assert values[-1] > 300 * values[-2]
    got = tiles.components(df, "at", 2, span=32, side=8).collect()
    for c in (1, 2):
        own = sorted((r for r in got if r["component"] == c), key=lambda r: r["series"])
        want = vectors[:, -c] * np.sign(vectors[np.abs(vectors[:, -c]).argmax(), -c])
        assert abs(own[0]["eigenvalue"] / values[-c] - 1) < 1e-6 and np.abs(np.array([r["loading"] for r in own]) - want).max() < 1e-5


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_portmanteau_at_any_split(spark, block):
    """Blocks shorter than the lags, so that a halo reaches over several."""
    z = np.random.default_rng(6).normal(size=(61, 2))
    z[1:] += 0.4 * z[:-1]
    df = spark.createDataFrame([("a", t, [float(v) for v in r]) for t, r in enumerate(z)], "run_id string, t int, y array<double>")
    got = {r["test"]: r for r in lagged.portmanteau_df(df, 6, block=block).collect()}
    for k in ("hosking", "limcleod"):
        q, p, dof = diagnostics.portmanteau(z, 6, k)
        assert abs(got[k]["statistic"] - q) < 1e-8 and abs(got[k]["p_value"] - p) < 1e-9 and got[k]["dof"] == dof


def test_regression_sums(spark):
    rng = np.random.default_rng(7)
    x = np.cumsum(rng.normal(size=200)) + rng.normal(size=200) * 3 + 50
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)] + [("c", t, 1.0) for t in range(30)] + [("a", 500, None)], "series string, at int, value double")
    arch = {r["series"]: r["statistic"] for r in regression.arch_lm(df, "at", ["series"], lags=4).collect()}
    assert abs(arch["a"] - diagnostics.arch_lm(x, 4)[0]) < 1e-6 and arch["c"] is None
    for lags in (1, 3):
        got = {r["series"]: r for r in regression.dickey_fuller(df, "at", ["series"], lags=lags).collect()}
        d = np.diff(x)
        z = np.column_stack([x[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)], np.ones(len(d) - lags)])
        b = np.linalg.lstsq(z, d[lags:], rcond=None)[0]
        e = d[lags:] - z @ b
        t = b[0] / np.sqrt(e @ e / (len(e) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
        assert abs(got["a"]["statistic"] - t) < 1e-6 and got["c"]["statistic"] is None
    plan = regression.arch_lm(df, "at", ["series"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("v"))
    got = sorted(ranged.running_sum(df, [F.col("k").asc()], F.col("v"), "s").collect(), key=lambda r: r["k"])
    assert [r["s"] for r in got] == np.cumsum([r["v"] for r in got]).tolist()
    assert [r["n"] for r in ranged.numbered(df.select("v"), "v", "n").orderBy("v").collect()] == list(range(13))
    assert ranged.numbered(df.limit(0), "k", "n").count() == 0
