import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge import functions as P
from panelforge.kernels import filters, likelihoods
from panelforge.kernels import params as kp
from panelforge.kernels import simulate as ks
from panelforge.operators import aggregate, models, panel, reshape
from panelforge.plans import study
from panelforge.sources import readers, writers
from panelforge.streaming import online


def flag():
    return kp.Params.from_dict({"lambda_r": [[1.0], [0.8], [0.6]], "Phi_f": 0.9, "Phi_h": 0.95, "mu": -1.0, "sigma2": 0.1, "Q_h": 0.1})


# --- columns ---


def test_missing_values(spark):
    d = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (None, -99.99)], "a double, b double")
    got = d.select(
        P.clean("a").alias("c"), P.mean_across(["a", "b"]).alias("m"), P.present_across(["a", "b"]).alias("n"),
        P.sentinel_to_null("b", -99.99).alias("s"), P.finite("a").alias("f"), P.guarded_ratio("b", "a").alias("r")
    ).collect()
    assert [r["c"] for r in got] == [1.0, None, None] and [r["m"] for r in got] == [1.5, 3.0, -99.99] and [r["n"] for r in got] == [2, 2, 1]
    assert [r["s"] for r in got] == [2.0, 3.0, None] and [r["f"] for r in got] == [True, False, False]


def test_lists(spark):
    d = spark.createDataFrame([("[0.1, 0.2]",), ("[0.47 0.61  1]",), ("[]",), ("oops",), (None,), ("[1, x]",)], "s string")
    got = [r["v"] for r in d.select(P.parse_list("s").alias("v")).collect()]
    assert got == [[0.1, 0.2], [0.47, 0.61, 1.0], [], None, None, [1.0, None]]
    assert [r[0] for r in d.select(P.list_mean(P.parse_list("s"))).collect()][2:] == [None, None, None, 1.0]
    e = P.expand_list(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0]), (3, None)], "i int, v array<double>"), "v", keep=False)
    assert e.columns == ["i", "v_0", "v_1"] and [tuple(r) for r in e.orderBy("i").collect()] == [(1, 1.0, 2.0), (2, 3.0, None), (3, None, None)]


def test_names_and_labels(spark):
    d = spark.createDataFrame([("task_00012_BIF_N5_K2_seed77", "PF", 100), ("nonsense", "bif", None), (None, None, None)], "n string, filter_type string, num_particles int")
    got = d.select(*[c.alias(k) for k, c in P.run_name("n").items()], P.filter_config().alias("config")).collect()
    assert got[0]["task"] == 12 and got[0]["seed"] == 77 and not got[0]["metadata_parse_error"] and got[1]["metadata_parse_error"] and got[2]["metadata_parse_error"]
    assert [r["config"] for r in got] == ["PF-100", "BIF", "Unknown"]
    s = spark.createDataFrame([(n,) for n in ("ME3 BM7", "SMALL LoBM", "BIG HiBM", "Market")], "n string")
    a, b = P.portfolio_deciles("n")
    assert [tuple(r) for r in s.select(a, b).collect()] == [(3, 7), (1, 1), (10, 10), (None, None)]
    v = spark.createDataFrame([(1234.5,), (0.0001,), (None,), (12.0,)], "v double")
    assert [tuple(r) for r in v.select(P.shown("v", 2), P.shown_adaptive("v"), P.shown_units("v")).collect()] == [
        ("1234.50", "1234.500", "1.23B"), ("0.00", "1.00e-04", "0.00M"), ("N/A", "N/A", "N/A"), ("12.00", "12.000", "12.00M")
    ]


def test_guarded_correlation_of_a_constant(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (2, 3.0, 6.5), (2, None, 1.0)], "g int, x double, y double")
    got = {r["g"]: r["c"] for r in d.groupBy("g").agg(P.guarded_corr("x", "y").alias("c")).collect()}
    assert got[1] is None and abs(got[2] - np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1]) < 1e-12


# --- panels ---


def test_panels(spark):
    wide = spark.createDataFrame([(0, 1.0, None), (1, 2.0, 4.0), (2, 4.0, 8.0)], "t int, a double, b double")
    long = panel.melt(wide, ["t"])
    assert long.count() == 6 and panel.complete_columns(wide).columns == ["t", "a"]
    assert {r["series_id"] for r in panel.complete_series(long).collect()} == {"a"}
    assert abs(sum(r["value"] for r in panel.demean(long).filter("series_id = 'a'").collect())) < 1e-12
    assert [tuple(r) for r in panel.missing_profile(wide, ["t"]).collect()] == [("b", 1, 100 / 3), ("a", 0, 0.0)]
    assert panel.rich_rows(wide, ["a", "b"]).count() == 2
    d = panel.differences(long.filter("value is not null"), "t", ["series_id"])
    assert all(abs(r["value"] - math.log(2)) < 1e-12 for r in d.collect()) and d.count() == 3
    dense = panel.densify(long.withColumn("run_id", F.lit("r")), "t", "series_id", "value").orderBy("t").collect()
    assert [r["y"] for r in dense] == [[1.0, 0.0], [2.0, 4.0], [4.0, 8.0]]
    assert [r[0] for r in panel.scale_columns(wide, 0.01, ["t"]).select("a").collect()] == [0.01, 0.02, 0.04]
    assert panel.common_dates(long.filter("value is not null"), "t", "series_id").count() == 4


def test_empty_tables(spark):
    e = spark.createDataFrame([], "t int, series_id string, value double, run_id string")
    assert panel.demean(e).collect() == [] and panel.moments(e, ["series_id"]).collect() == [] and panel.densify(e, "t", "series_id", "value").collect() == []
    assert panel.ljung_box(e, "t", ["series_id"], 3).collect() == [] and aggregate.list_stats(spark.createDataFrame([], "k int, v array<double>"), ["k"], "v").collect() == []


def test_list_stats_drop_nan(spark):
    d = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("a", [float("nan"), 1.0]), ("a", None), ("b", [5.0])], "k string, v array<double>")
    got = {r["k"]: r for r in aggregate.list_stats(d, ["k"], "v").collect()}
    assert got["a"]["mean"] == [2.0, 3.0] and got["a"]["n"] == 2 and np.allclose(got["a"]["se"], [1 / math.sqrt(2)] * 2) and got["b"]["se"] == [0.0]


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 5.0), (4, float("nan"))], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (2, 2.5), (None, 5.0), (4, float("nan")), (5, 1.0)], "k int, v double")
    assert sorted((r["k"], r["status"]) for r in aggregate.compare(a, b, ["k"], ["v"]).collect()) == [(2, "differs"), (5, "right only")]


def test_reshaping(spark):
    d = spark.createDataFrame([("BIF", 1.0, 2.0), ("pf", 3.0, 4.0), ("BF", 5.0, 6.0)], "filter_type string, bif_rmse double, pf_rmse double")
    assert [r["rmse"] for r in reshape.consolidate(d, "filter_type", ["BIF", "PF", "BF"]).collect()] == [1.0, 4.0, None]
    n = spark.createDataFrame([((1, (2, "x")),)], "c struct<a:int, b:struct<d:int, e:string>>")
    assert reshape.flatten(n).columns == ["c_a", "c_b_d", "c_b_e"]
    a = spark.createDataFrame([(1, None), (1, 5)], "k int, p int")
    b = spark.createDataFrame([(1, None, "x"), (1, 5, "y")], "k int, p int, t string")
    assert sorted(r["t"] for r in reshape.null_safe_join(a, b, ["k", "p"], ["p"]).collect()) == ["x", "y"]
    marks = reshape.loss_marks(spark.createDataFrame([(1, [5.0, 3.0, 4.0, 1.0]), (2, [1.0]), (3, [])], "r int, l array<double>"), "r", "l", 3.5).collect()
    assert [(r["first_below"], r["n_jumps"], r["max_jump"]) for r in marks] == [(1, 1, 1.0), (0, 0, None), (None, 0, None)]
    assert reshape.ordered_columns(d, ["pf_rmse", "nope"]).columns == ["pf_rmse", "bif_rmse", "filter_type"] and reshape.drop_prefixed(d, "bif_").columns == ["filter_type", "pf_rmse"]


# --- sources ---


def test_blocks_of_a_file(spark, tmp_path):
    path = tmp_path / "returns.csv"
    path.write_text(
        "Some notes\n\nAverage Value Weighted Returns -- Monthly\n\n,SMALL LoBM,ME1 BM2,BIG HiBM\n196307, 1.10,-99.99, 0.5\n196308, 2.20, 0.10,-999\n196309,-99.99,-99.99,-99.99\nCopyright x\n\n"
        "Average Equal Weighted Returns -- Monthly\n,SMALL LoBM,ME1 BM2,BIG HiBM\n196307, 3.00, 1.0, 2.0\n196308, bad, 1.0, 2.0\n"
    )
    found = readers.find_blocks(spark, str(path), ["Average Value Weighted", "Average Equal Weighted"])
    assert [b["header_line"] for b in found] == [5, 12]
    a = readers.read_block(spark, str(path), found[0]["header_line"], found[1]["marker_line"]).collect()
    assert [str(r["Date"]) for r in a] == ["1963-07-01", "1963-08-01"] and a[0]["ME1 BM2"] is None and a[1]["SMALL LoBM"] == 2.2
    b = readers.read_block(spark, str(path), found[1]["header_line"]).collect()
    assert len(b) == 2 and b[1]["SMALL LoBM"] is None
    assert readers.numbered_lines(spark, str(path)).count() == 15


def test_blocks_of_a_latin1_file(spark, tmp_path):
    path = tmp_path / "old.csv"
    path.write_bytes("Émile's Average Returns -- Monthly\n,a,b,c\n196307, 1.0, 2.0, 3.0\n".encode("latin1"))
    found = readers.find_blocks(spark, str(path), ["Average"])
    assert found == [{"name": "Émile's Average Returns -- Monthly", "marker_line": 1, "header_line": 2}]
    assert readers.find_blocks(spark, str(path), ["nothing"])[0]["marker_line"] == 1  # by its --
    (tmp_path / "none.csv").write_text("plain\n")
    assert readers.find_blocks(spark, str(tmp_path / "none.csv"), ["x"]) == []
    (tmp_path / "typed.csv").write_text("a,b\n1,2.5\n")
    assert readers.read_csv(spark, str(tmp_path / "typed.csv"), infer=True).dtypes == [("a", "int"), ("b", "double")]


def test_quantiles_with_an_accuracy(spark):
    d = spark.range(10_001).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    exact, near = ({r["g"]: r for r in aggregate.five_numbers(d, ["g"], "v", a).collect()} for a in (None, 100))
    assert all(abs(exact[g][c] - near[g][c]) <= 10_001 / 100 for g in exact for c in ("least", "lower", "middle", "upper", "greatest"))
    m = {r["g"]: r for r in aggregate.group_stats(d, ["g"], ["v"], ("median",), accuracy=1000).collect()}
    assert all(abs(m[g]["v_median"] - exact[g]["middle"]) <= 11 for g in m)
    assert all(abs(r["v"] - exact[r["g"]]["middle"]) <= 11 for r in aggregate.medians(d, ["g"], 1000).collect())


def test_a_large_panel_is_not_collected(spark, monkeypatch):
    monkeypatch.setattr(models, "PANEL_BYTES", 100)
    d = spark.createDataFrame([(t, [0.1, 0.2, 0.3]) for t in range(10)], "t int, y array<double>")
    with pytest.raises(ValueError, match="more than"):
        models.fit_distributed(d, kp.realistic(3, 1))


def test_a_study_of_fits(spark):
    """Records of fits, resumed; failures are rows; the objective at the estimate is no worse than at the truth."""
    runs = study.grid(spark, [2], [1], [40], ["BIF"], [], 1).withColumn("fix_mu", F.lit(True))
    broken = runs.withColumns({"run_id": F.lit("broken"), "filter_type": F.lit("none")})
    got = {r["run_id"]: r for r in study.run_fits(runs.union(broken), max_steps=200).collect()}
    r = next(v for k, v in got.items() if k != "broken")
    assert got["broken"]["error"] and got["broken"]["success"] is None
    assert r["final_loss"] <= r["loss_at_truth"] + 1e-6 and r["errors"]["mu_bias"] == 0 and r["error"] is None and r["optimizer_name"] == "DampedTrustRegionBFGS"
    assert study.run_fits(runs, done=spark.createDataFrame([(r["run_id"],)], "run_id string")).collect() == []


def test_student_jarque_bera(spark):
    """Residuals from a Student t aren't rejected under their own t; skewed ones are."""
    g = np.random.default_rng(12)
    t5, skewed = g.standard_t(7, (300, 2)) * np.sqrt(5 / 7), g.exponential(size=(300, 2)) - 1
    rows = [("t", i, z.tolist()) for i, z in enumerate(t5)] + [("skewed", i, z.tolist()) for i, z in enumerate(skewed)]
    got = {r["run_id"]: r for r in models.student_jarque_bera_df(spark.createDataFrame(rows, "run_id string, t int, z array<double>"), draws=400).collect()}
    assert got["t"]["p_value"] > 0.05 and got["t"]["n"] == 600 and got["t"]["draws"] == 400 and 2.1 <= got["t"]["dof"] <= 200
    assert got["skewed"]["p_value"] <= got["t"]["p_value"]


def test_prediction_with_the_current_volatility():
    b = filters.Batch.of([flag()])
    f, h, p = np.array([[0.5]]), np.array([[-2.0]]), np.array([[[0.3]]])
    near, own = (filters.predict(b, f, h, p, p, c) for c in (True, False))
    assert np.allclose(near[0], 0.45) and np.allclose(near[1], -1 + 0.95 * -1.0)
    assert np.allclose(near[2], 0.81 * 0.3 + np.exp(-2.0)) and np.allclose(own[2], 0.81 * 0.3 + np.exp(near[1])) and np.allclose(near[3], 0.95**2 * 0.3 + 0.1)
    assert np.isfinite(filters._inv(np.zeros((2, 2, 2)))).all()


def test_robust_objective_penalises_the_edge():
    near = kp.Params.from_dict({"lambda_r": [[1.0], [0.5]], "Phi_f": 0.2, "Phi_h": 0.99, "mu": -1.0, "sigma2": 0.005, "Q_h": 0.1})
    y = np.random.default_rng(0).normal(size=(20, 2))
    plain, robust = (likelihoods.objectives([near], y, boundary_weight=w)[0] for w in (0.0, 10.0))
    assert abs(robust - plain - likelihoods.boundary_penalty(near, weight=10.0)) < 1e-9 and robust > plain


def test_records_arrays_and_dates(spark, tmp_path):
    for run, text in (("task_1", '{"N": 5, "rmse": [0.1, NaN], "config": {"seed": 3}}'), ("task_2", "{broken")):
        (tmp_path / "study" / run).mkdir(parents=True)
        (tmp_path / "study" / run / "metrics.json").write_text(text)
    got = {r["run_label"]: r for r in readers.read_records(spark, str(tmp_path), "N int, rmse array<double>, config struct<seed:int>").collect()}
    assert got["task_1"]["N"] == 5 and got["task_1"]["study_id"] == "study" and not got["task_1"]["json_read_error"] and got["task_2"]["json_read_error"] and got["task_2"]["N"] is None
    np.savez(tmp_path / "a.npz", x=np.arange(6.0).reshape(2, 3))
    assert [(r["name"], r["shape"], r["values"]) for r in readers.read_arrays(spark, str(tmp_path)).collect()] == [("x", [2, 3], [0, 1, 2, 3, 4, 5])]
    (tmp_path / "dates.txt").write_text("2020-01-31\n2020-02-29\n\nnot a date\n")
    assert [str(r["date"]) for r in readers.read_dates(spark, str(tmp_path / "dates.txt")).collect()] == ["2020-01-31", "2020-02-29", "None"]


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.5, None), (2, None, None)], "a_b int, v double, gone array<double>")
    for kind in ("csv", "json", "parquet"):
        writers.write(d.drop("gone"), str(tmp_path / f"x.{kind}"), single=True)
    assert readers.read_csv(spark, str(tmp_path / "x.csv"), "a_b int, v double").count() == 2
    writers.write_arrays(d, str(tmp_path / "arrays"))
    assert spark.read.parquet(str(tmp_path / "arrays")).columns == ["a_b", "v"]
    assert "| 1 | 0.5000 |" in writers.markdown(d.drop("gone")) and r"a\_b & v \\" in writers.latex(d.drop("gone")) and "N/A" in writers.latex(d.drop("gone"))
    with pytest.raises(ValueError):
        readers.require(d, ["a_b", "missing"])


# --- models ---


@pytest.fixture(scope="module")
def simulated(spark):
    params = models.params_df(spark, {"a": flag(), "b": flag().replace(mu=np.array([0.0]))})
    return params, models.simulate_df(params, 60, 2, seed=5).persist()


def test_filters_on_dataframes_are_the_kernels(simulated):
    params, sim = simulated
    p = models.run_params(sim, params)
    y, f, h = ks.simulate(flag(), 60, 6)
    assert np.allclose(np.array([r["y"] for r in sim.filter("run_id = 'a/1'").orderBy("t").collect()]), y)
    for kind in ("BIF", "BF"):
        x = filters.run_filter(filters.Batch.of([flag()]), y[None], kind)
        got = models.filter_df(sim, p, kind).filter("run_id = 'a/1'").orderBy("t").collect()
        assert np.allclose([r["state"] for r in got], x.alpha[0]) and np.allclose([r["loglik"] for r in got], x.loglik[0]) and got[0]["dim"] == 2 and len(got[0]["cov"]) == 4
    s = filters.smooth(filters.Batch.of([flag()]), filters.run_filter(filters.Batch.of([flag()]), y[None]))
    got = models.smooth_df(sim, p).filter("run_id = 'a/1'").orderBy("t").collect()
    assert np.allclose([r["state"] for r in got], s.alpha[0]) and got[0]["lag1_cov"] is None
    acc = models.accuracy_df(models.filter_df(sim, p), sim).collect()
    assert len(acc) == 8 and all(r["rmse"] > 0 for r in acc)


def test_likelihoods_and_residuals(spark, simulated):
    params, sim = simulated
    p = models.run_params(sim, params)
    ll = models.loglik_df(sim, params).collect()
    assert len(ll) == 8
    right = {r["run_id"]: r["loglik"] for r in ll if r["run_id"].split("/")[0] == r["param_id"]}
    total = {r["run_id"]: r["s"] for r in models.filter_df(sim, p).groupBy("run_id").agg(F.sum("loglik").alias("s")).collect()}
    assert all(abs(right[k] - total[k]) < 1e-6 for k in right)
    res = models.residuals_df(sim, models.filter_df(sim, p), p)
    assert res.count() == 240 and 0 < res.first()["factor_share"] < 1
    assert models.multivariate_tests_df(res).count() == 20
    assert models.particle_df(sim, p, 100).count() == models.particle_df(sim, p, 100, smoothed=True).count() == 240


def test_fit_on_dataframes(spark, simulated):
    params, sim = simulated
    start = sim.select("run_id").distinct().crossJoin(models.params_df(spark, {"s": kp.uninformed(3, 1)}).drop("param_id"))
    one = sim.filter("run_id = 'a/0'")
    got = models.fit_df(one, start, max_steps=2).collect()
    assert len(got) == 1 and got[0]["final_params"]["N"] == 3 and got[0]["steps"] >= 1
    r = models.fit_distributed(one, kp.uninformed(3, 1), max_steps=1)
    assert abs(r.final_loss - models.fit_df(one, start, max_steps=1).first()["final_loss"]) < 1e-6


def test_errors_of_parameters(spark):
    a, b = models.params_df(spark, {"x": flag(), "y": flag()}), models.params_df(spark, {"x": flag().replace(mu=np.array([0.0])), "z": flag()})
    got = {r["param"]: r for r in models.param_errors_df(a, b).collect()}
    assert len(got) == 6 and got["mu"]["bias"] == 1.0 and got["Phi_h"]["trace_diff"] == 0.0


def test_study_and_resume(spark):
    runs = study.grid(spark, [3, 2], [1, 3], [30], ["BIF", "PF"], [50], 2)
    assert runs.count() == 12 and runs.filter("K > N").count() == 0
    done = study.run(runs).persist()
    assert done.filter("error is not null").count() == 0 and study.run(runs, done).count() == 0 and study.run(runs, done.limit(5)).count() == 7
    same = {(r["N"], r["K"], r["rep"]): r["seed"] for r in runs.filter("filter_type = 'BIF'").collect()}
    assert all(same[r["N"], r["K"], r["rep"]] == r["seed"] for r in runs.collect())
    t = study.table(done, "rmse_f", ["BIF", "PF-50"]).collect()
    assert len(t) == 3 and "±" in t[0]["BIF"]
    bad = runs.limit(1).withColumn("filter_type", F.lit("EKF"))
    assert "EKF" in study.run(bad).first()["error"]


def test_online_filter_is_the_batch_filter(spark, tmp_path):
    y = ks.simulate(flag(), 20, 3)[0]
    rows = spark.createDataFrame([("r", t, y[t].tolist()) for t in range(20)], "run_id string, t int, y array<double>")
    rows.filter("t < 12").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = online.filter_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), flag())

    def go():
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()

    go()
    rows.filter("t >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # two rows come late
    go()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("t").collect()
    want = filters.run_filter(filters.Batch.of([flag()]), y[None])
    assert [r["t"] for r in got] == list(range(20)) and got[-1]["late"] == 2
    assert np.allclose([r["state"] for r in got], want.alpha[0]) and abs(got[-1]["total_loglik"] - want.loglik.sum()) < 1e-8


def test_complete_likelihood_quality_and_gain(spark, simulated):
    from panelforge.kernels import likelihoods

    params, sim = simulated
    p = models.run_params(sim, params)
    y, f, h = ks.simulate(flag(), 60, 6)
    got = models.complete_loglik_df(sim, p).filter("run_id = 'a/1'").first()
    assert abs(got["joint"] - likelihoods.joint_loglik(flag(), y, f, h)) < 1e-8
    states = models.filter_df(sim, p)
    x = np.array([r["state"] for r in states.filter("run_id = 'a/1'").orderBy("t").collect()])
    q = {r["series"]: r for r in models.fit_quality_df(sim, states, p).filter("run_id = 'a/1'").collect()}
    e = y - x[:, :1] @ flag().lambda_r.T
    assert all(abs(q[i]["r2"] - (1 - (e[:, i] ** 2).sum() / (y[:, i].var() * 60))) < 1e-9 and abs(q[i]["rmse"] - np.sqrt((e[:, i] ** 2).mean())) < 1e-9 for i in range(3))
    gain = models.smoothing_gain_df(states, models.smooth_df(sim, p), sim).collect()
    assert len(gain) == 8 and np.mean([r["gain_pct"] for r in gain if r["kind"] == "f"]) > 0
    assert models.simulation_summary_df(sim).count() == 12


def test_rescaling_and_effects(spark):
    d = spark.createDataFrame([(1, True, 2.0), (1, False, 1.0), (1, None, 50.0), (2, True, 3.0)], "k int, f boolean, v double")
    got = {r["k"]: r for r in aggregate.paired_effect(d, ["k"], "f", "v").collect()}
    assert got[1]["effect_pct"] == 100.0 and got[2]["without_flag"] is None and got[2]["effect_pct"] is None
    assert aggregate.rescaled(d, "v").agg(F.max("v")).first()[0] == 0.5 and aggregate.rescaled(d.filter("v < 5"), "v").agg(F.max("v")).first()[0] == 3.0


def test_runs_in_batches_match_runs_alone(spark):
    p, q = kp.realistic(3, 1), kp.realistic(4, 2)
    runs = {"a": (p, 12), "b": (q, 12), "c": (p, 30), "d": (p, 12), "e": (p, 1)}
    ys = {r: ks.simulate(x, t, i)[0] for i, (r, (x, t)) in enumerate(runs.items())}
    panel = spark.createDataFrame([(r, t, row.tolist()) for r, y in ys.items() for t, row in enumerate(y)], "run_id string, t int, y array<double>")
    params = models.params_df(spark, {r: x for r, (x, _) in runs.items()})
    got = {}
    for r in models.filter_df(panel.orderBy(F.rand(1)), params).collect():
        got.setdefault(r["run_id"], {})[r["t"]] = r["state"]
    for r, (x, t) in runs.items():
        alone = filters.run_filter(filters.Batch.of([x]), ys[r][None]).alpha[0]
        assert np.allclose([got[r][i] for i in range(t)], alone, atol=1e-12)
    assert models.smooth_df(panel.filter("t < 0"), params).count() == 0


def test_whole_runs_however_batches_cut_them():
    p = kp.as_row(kp.realistic(3, 1))
    rows = [{"run_id": r, "t": t, "y": [0.1 * t] * 3, "p": p if t == 0 else None} for r in ("a", "b", "c") for t in range(4)]
    for size in (1, 3, 5, 12):
        cut = (pd.DataFrame(rows[i : i + size]) for i in range(0, len(rows), size))
        found = list(models._whole_runs(cut))
        assert [r.run_id for r in found] == ["a", "b", "c"]
        assert all(r.t.tolist() == [0, 1, 2, 3] and r.y.shape == (4, 3) for r in found)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """A file over many splits gives the lines, and the blocks, that one split gives."""
    path = tmp_path / "many.csv"
    rows = [f"{200001 + i % 12},{i}.5,{i * 2}" for i in range(700)]
    lines = ["a text above", "", "  Average Value Weighted", ",A,B,C", *rows[:400], "", "  Average Equal Weighted", ",A,B,C", *rows[400:], "a text below"]
    path.write_bytes("\r\n".join(lines).encode())
    want = [(i + 1, t) for i, t in enumerate(lines)]
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for size in ("512", "128m"):
        for n in names:
            spark.conf.set(n, size if size != "128m" else "4m")
        spark.conf.set(names[0], size)
        try:
            got = readers.numbered_lines(spark, str(path))
            parts = spark.read.text(str(path)).rdd.getNumPartitions()
            assert (parts > 10) == (size == "512")
            assert sorted((r["line"], r["text"]) for r in got.collect()) == want
            assert [b["header_line"] for b in readers.find_blocks(spark, str(path), ["Average"], least_header=2, least_data=2)] == [4, 407]
        finally:
            for n in names:
                spark.conf.unset(n)


def test_garch_paths_from_sql(spark):
    """The table function gives each partition's path, in the order asked for, and says what it lacks."""
    from panelforge.functions import tables
    from panelforge.kernels import garch

    tables.register(spark)
    rng = np.random.default_rng(3)
    x = {"a": rng.normal(size=30), "b": rng.normal(size=7)}
    spark.createDataFrame([(k, i, float(v)) for k, s in x.items() for i, v in enumerate(s)], "series string, at int, value double").repartition(5).createOrReplaceTempView("returns")
    got = spark.sql("SELECT * FROM garch_path(TABLE(returns) PARTITION BY series ORDER BY (at), 0.01, 0.1, 0.8, 0.5)").collect()
    for k, s in x.items():
        own = sorted((r for r in got if r["series"] == k), key=lambda r: r["i"])
        assert np.allclose([r["variance"] for r in own], garch.variance_path(s * s, 0.01, 0.1, 0.8, 0.5)[:, 0]) and [r["i"] for r in own] == list(range(1, len(s) + 1))
    with pytest.raises(Exception, match="series"):
        spark.sql("SELECT * FROM garch_path(TABLE(SELECT at, value FROM returns) WITH SINGLE PARTITION ORDER BY (at), 0.01, 0.1, 0.8, 0.5)").collect()
