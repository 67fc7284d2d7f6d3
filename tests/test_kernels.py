import math

import numpy as np
import pytest

from panelforge.kernels import diagnostics as D
from panelforge.kernels import filters as Fi
from panelforge.kernels import garch as G
from panelforge.kernels import likelihoods as L
from panelforge.kernels import optimize as O
from panelforge.kernels import params as P
from panelforge.kernels import particle as Q
from panelforge.kernels import simulate as S
from panelforge.kernels import special


def small(**k):
    return P.Params.from_dict({"lambda_r": [[0.9], [0.6], [0.3]], "Phi_f": 0.95, "Phi_h": 0.98, "mu": -1.0, "sigma2": 0.1, "Q_h": 0.05} | k)


def wide():
    return P.Params.from_dict({"lambda_r": [[1, 0], [0.6, 1], [0.5, 0.3], [0.4, 0.8]], "Phi_f": 0.95, "Phi_h": 0.95, "mu": [-1, -0.8], "sigma2": 0.05, "Q_h": 0.1})


# --- parameters ---


def test_params_round_trip_and_checks():
    p = small()
    d, N, K = p.to_dict()
    again = P.Params.from_dict(d, N, K)
    assert all(np.array_equal(getattr(p, f), getattr(again, f)) for f in P.FIELDS) and "N" not in d
    assert np.array_equal(P.as_params(P.as_row(p)).lambda_r, p.lambda_r) and p.replace(mu=np.zeros(1)).mu[0] == 0
    with pytest.raises(KeyError):
        P.Params.from_dict({"lambda_r": [[1.0]]})
    with pytest.raises(ValueError):
        small(mu=[1.0, 2.0])
    with pytest.raises(TypeError):
        P.as_params(3)
    assert small(sigma2=np.diag([0.1, 0.2, 0.3])).sigma2.tolist() == [0.1, 0.2, 0.3]
    assert P.sound(p) == [] and P.sound(p.replace(mu=np.array([np.nan])))


def test_transforms():
    p = wide()
    back = P.untransform(P.transform(p))
    assert all(np.allclose(getattr(back, f), getattr(p, f)) for f in P.FIELDS)
    x = np.array([1e-8, 1e-4, 0.5, 3.0, 800.0])
    assert np.allclose(P.softplus(P.inverse_softplus(x))[1:], x[1:], rtol=1e-3) and np.isfinite(P.inverse_softplus(x)).all()
    assert np.isfinite(P.safe_arctanh(np.array([-2.0, -1, 0, 1, 5]))).all() and math.isnan(P.safe_arctanh(math.nan))
    lam = P.identified(p.replace(lambda_r=np.ones((4, 2)))).lambda_r
    assert lam[0, 1] == 0 and lam[0, 0] == lam[1, 1] == 1
    assert np.allclose(P.flatten(P.unflatten(P.flatten(p) + 1, p)), P.flatten(p) + 1)


@pytest.mark.parametrize("make", [P.stable, lambda n, k: P.uninformed(n, k), P.realistic, lambda n, k: P.random_study(n, k, 3), lambda n, k: P.perturbed(P.stable(n, k))])
def test_generators_are_stable(make):
    p = make(6, 2)
    assert P.sound(p) == [] and L.instability(p) == 0 and (np.linalg.eigvalsh(p.Q_h) > 0).all()


def test_simulator_repeats_and_clusters():
    a, b = S.simulate(small(), 50, 3), S.simulate(small(), 50, 3)
    assert all(np.array_equal(x, y) for x, y in zip(a, b)) and not a[0][0].any() and a[2][0, 0] == -1
    y = S.simulate(small(Q_h=0.1), 5000, 1)[0]
    assert D.autocorrelations(y[1:, 0] ** 2, 1)[0] > 0
    # the legacy stream, drawn one step at a time
    p, g = wide(), np.random.RandomState(11)
    h, f, out = p.mu.copy(), np.zeros(2), []
    for _ in range(5):
        h = p.mu + p.Phi_h @ (h - p.mu) + np.linalg.cholesky(p.Q_h) @ g.normal(size=2)
        f = p.Phi_f @ f + np.exp(h / 2) * g.normal(size=2)
        out.append(p.lambda_r @ f + np.sqrt(p.sigma2) * g.normal(size=4))
    assert np.allclose(S.simulate(p, 6, 11)[0][1:], out)


# --- filters ---


def dense_loglik(p, y, f, h):
    a = p.lambda_r @ np.diag(np.exp(h)) @ p.lambda_r.T + np.diag(p.sigma2)
    r = y - p.lambda_r @ f
    return -0.5 * (np.linalg.slogdet(a)[1] + r @ np.linalg.solve(a, r))


def test_woodbury_and_information():
    p, g = wide(), np.random.default_rng(0)
    obs = Fi._Observation(Fi.Batch.of([p]))
    for _ in range(5):
        y, f, h = g.normal(size=4), g.normal(size=2), g.normal(size=2)
        obs.see(y[None])
        assert abs(obs.value(f[None], h[None])[0][0] - dense_loglik(p, y, f, h)) < 1e-4
        a = p.lambda_r @ np.diag(np.exp(h)) @ p.lambda_r.T + np.diag(p.sigma2)
        assert np.allclose(obs.inner(h[None])[1][0], p.lambda_r.T @ np.linalg.solve(a, p.lambda_r), atol=1e-4)


def test_gradient_and_hessian_by_differences():
    p, g = wide(), np.random.default_rng(1)
    y, f, h, fp, hp = g.normal(size=4), g.normal(size=2), g.normal(size=2), g.normal(size=2), g.normal(size=2)
    wf, wh = np.eye(2) * 2, np.eye(2) * 3

    def cost(x):
        return -dense_loglik(p, y, x[:2], x[2:]) + 0.5 * (x[:2] - fp) @ wf @ (x[:2] - fp) + 0.5 * (x[2:] - hp) @ wh @ (x[2:] - hp)

    x = np.r_[f, h]
    num = np.array([(cost(x + e) - cost(x - e)) / 2e-5 for e in 1e-5 * np.eye(4)])
    assert np.allclose(np.concatenate(Fi.mode_gradient(f, h, fp, hp, wf, wh, y, p.lambda_r, p.sigma2)), num, atol=1e-3)
    ll = lambda x: -dense_loglik(p, y, x[:2], x[2:])
    e = 1e-4 * np.eye(4)
    hess = np.array([[(ll(x + a + b) - ll(x + a - b) - ll(x - a + b) + ll(x - a - b)) / 4e-8 for b in e] for a in e])
    assert np.allclose(Fi.observed_information(p.lambda_r, p.sigma2, h, f, y), hess, atol=1e-3)


@pytest.mark.parametrize("kind", ["BIF", "BF"])
def test_filter_quality(kind):
    p = small()
    y, f, h = S.simulate(p, 400, 123)
    x = Fi.run_filter(Fi.Batch.of([p]), y[None], kind)
    rmse, corr = D.accuracy(np.c_[f, h][20:], x.alpha[0][20:])
    assert corr[0] > 0.7 and corr[1] > 0.4 and rmse[0] < 0.9 and rmse[1] < 1.7
    for c in (x.cov_f, x.cov_h):
        assert np.allclose(c, np.swapaxes(c, -1, -2), atol=1e-8) and (np.linalg.eigvalsh(c) > 0).all()
    assert np.isfinite(x.loglik).all() and not x.clamped[0]
    s = Fi.smooth(Fi.Batch.of([p]), x)
    smoothed = D.accuracy(np.c_[f, h][20:], s.alpha[0][20:])[0]
    assert smoothed[0] < rmse[0] and (smoothed < 1.5).all()
    assert s.lag_f.shape == (1, 399, 1, 1)


def test_both_forms_agree_where_data_dominate():
    p = small()
    y = S.simulate(p, 60, 5)[0]
    a = Fi.run_filter(Fi.Batch.of([p]), y[None], "BIF", init_factor_var=1.0)
    b = Fi.run_filter(Fi.Batch.of([p]), y[None], "BF", init_factor_var=1.0)
    assert np.abs(a.alpha - b.alpha).max() < 1e-2 and np.abs(a.loglik - b.loglik).max() < 1e-2
    c = Fi.run_filter(Fi.Batch.of([p]), y[None], "BF", predict_first=False)
    assert not np.allclose(b.alpha[:, :3], c.alpha[:, :3])
    with pytest.raises(ValueError):
        Fi.run_filter(Fi.Batch.of([p]), y[None], "EKF")


def test_a_batch_is_its_runs():
    ps = [small(mu=m) for m in (-2.0, -1.0, 0.0)]
    ys = np.stack([S.simulate(p, 40, i)[0] for i, p in enumerate(ps)])
    many = Fi.run_filter(Fi.Batch.of(ps), ys)
    for i, p in enumerate(ps):
        one = Fi.run_filter(Fi.Batch.of([p]), ys[i : i + 1])
        assert np.abs(many.alpha[i] - one.alpha[0]).max() < 1e-5


def test_particle_filter():
    p = small()
    y, f, h = S.simulate(p, 300, 9)
    a = Q.particle_filter(p, y, 2000, seed=1)
    rmse, corr = D.accuracy(np.c_[f, h][20:], a.means[20:])
    assert corr[0] > 0.5 and corr[1] > 0.15 and rmse[0] < 4 and rmse[1] < 1.5
    assert np.array_equal(a.loglik, Q.particle_filter(p, y, 2000, seed=1).loglik) and (a.ess <= 2000 + 1e-6).all()
    means, covs = Q.smooth_particles(p, a)
    assert np.isfinite(means).all() and D.accuracy(np.c_[f, h][20:], means[20:])[1][0] > 0.5
    with pytest.raises(ValueError):
        Q.particle_filter(p, y[:, :2])


def test_lyapunov_converges():
    assert abs(Fi.lyapunov(np.array([[0.5]]), np.array([[1.0]]))[0, 0] - 1 / 0.75) < 1e-9


# --- likelihoods and estimation ---


def test_complete_data_likelihood():
    p = wide()
    y, f, h = S.simulate(p, 30, 2)
    by_hand = 0.0
    for t in range(30):
        by_hand += special.norm_logpdf(y[t], p.lambda_r @ f[t], np.sqrt(p.sigma2)).sum()
        if t:
            by_hand += special.norm_logpdf(f[t], p.Phi_f @ f[t - 1], np.exp(h[t] / 2)).sum()
            by_hand += special.norm_logpdf(h[t], p.mu + p.Phi_h @ (h[t - 1] - p.mu), np.sqrt(np.diag(p.Q_h))).sum()
    assert abs(L.joint_loglik(p, y, f, h) - by_hand) < 1e-8


def test_objective_gate_and_prior():
    p = small()
    y = S.simulate(p, 30, 4)[0]
    bad = p.replace(Phi_f=np.array([[1.2]]))
    got = L.objectives([p, bad], y, stability_weight=10.0, priors={})
    plain = -L.logliks([P.identified(p)], y)[0] - L.log_prior(P.identified(p))
    assert abs(got[0] - plain) < 1e-8 and abs(got[1] - (1e10 + 10 * (0.2 + 1e-6))) < 1e-3
    assert L.log_prior(p.replace(mu=np.array([np.nan]))) == -1e10 and L.log_prior(p, mu_mean=5.0) < L.log_prior(p)


@pytest.mark.parametrize("name", O.OPTIMIZERS)
def test_optimizers_descend(name):
    f = lambda v: ((v - np.array([1, 2.0])) ** 2).sum(1)
    r = O.minimize(f, np.zeros(2), name, max_steps=500, rate=20.0 if name == "Adadelta" else 0.05)
    assert r.value < 5 * 0.9
    if name not in ("Adadelta",):
        assert np.abs(r.x - [1, 2]).max() < (0.3 if name == "Adagrad" else 1e-1)
    assert "learning_rate" in O.config(name)


def test_rosenbrock_and_failures():
    f = lambda v: (1 - v[:, 0]) ** 2 + 100 * (v[:, 1] - v[:, 0] ** 2) ** 2
    for name in ("BFGS", "DampedTrustRegionBFGS", "ArmijoBFGS"):
        assert np.abs(O.minimize(f, np.array([-1.0, 1.0]), name, max_steps=300).x - 1).max() < 0.1

    def broken(v):
        raise RuntimeError("no value")

    r = O.minimize(broken, np.zeros(2))
    assert not r.success and "no value" in r.message and r.code == "error"
    with pytest.raises(ValueError):
        O.minimize(f, np.zeros(2), "Newton")


def test_schedules():
    for kind in O.SCHEDULES:
        s = O.schedule(kind, 1e-2, 100, 1e-5, warmup_steps=10)
        assert all(0 < s(i) <= 0.1 + 1e-12 for i in range(150))
    cosine, one = O.schedule("cosine", 1.0, 100, 0.1), O.schedule("one_cycle", 1.0, 100, 0.1)
    assert cosine(0) == 1 and abs(cosine(50) - 0.55) < 1e-12 and abs(cosine(100) - 0.1) < 1e-12 and one(50) == 10 and abs(O.schedule("step_decay", 1.0)(100) - 0.5) < 1e-12
    with pytest.raises(ValueError):
        O.schedule("sawtooth")


def test_fit_improves_and_reports():
    p = small(Q_h=0.1)
    y = S.simulate(p, 80, 42)[0]
    start = P.uninformed(3, 1)
    r = O.fit(y, start, max_steps=4, log=True)
    assert r.final_loss < L.objectives([P.identified(start)], y)[0] and len(r.loss_history) == len(r.param_history) >= 1 and L.instability(r.final_params) == 0
    fixed = O.fit(y, start, max_steps=2, fix_mu=True, true_mu=p.mu)
    assert np.allclose(fixed.final_params.mu, p.mu)
    with pytest.raises(ValueError):
        O.fit(y, start, fix_mu=True)
    failed = O.fit(np.full((5, 3), np.nan), start)
    assert not failed.success and failed.error_message


# --- statistics ---


def test_tails():
    assert abs(special.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-10 and abs(special.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-10 and special.chi2_sf(0, 3) == 1
    assert abs(special.norm_sf(1.959963984540054) - 0.025) < 1e-12 and abs(special.norm_ppf(0.975) - 1.959963984540054) < 1e-9
    assert abs(special.digamma(1.0) + 0.5772156649015329) < 1e-12 and abs(special.digamma(0.5) + 1.9635100260214235) < 1e-12


def test_tests_tell_noise_from_structure():
    g = np.random.default_rng(42)
    white = g.normal(size=(500, 3))
    ar = np.zeros((500, 3))
    for t in range(1, 500):
        ar[t] = 0.5 * ar[t - 1] + white[t]
    for kind in ("hosking", "limcleod"):
        assert D.portmanteau(white, 5, kind)[1] > 0.01 > D.portmanteau(ar, 5, kind)[1]
    assert D.ljung_box(white[:, 0], 10)[1] > 0.01 > D.ljung_box(ar[:, 0], 10)[1]
    assert D.adf(white[:, 0])[1] < 0.01 < 0.05 < D.adf(np.cumsum(white[:, 0]))[1]
    assert D.jarque_bera(white[:, 0])[1] > 0.01 > D.jarque_bera(white[:, 0] ** 3)[1]
    assert D.mardia(white)["kurtosis_p"] > 0.01 and D.mardia(white, own_distances=True)["skewness"] != D.mardia(white)["skewness"]
    assert 4 < D.student_df(g.standard_t(5, 20_000) / np.sqrt(5 / 3)) < 6.5
    arch = np.zeros(800)
    for t in range(1, 800):
        arch[t] = g.normal() * np.sqrt(0.2 + 0.7 * arch[t - 1] ** 2)
    assert D.arch_lm(arch, 5)[1] < 0.01 < D.arch_lm(white[:, 1], 5)[1]


def test_covariance_statistics():
    p = small()
    sigma = D.implied_covariance(p, np.full((4, 1, 1), 0.5))
    assert sigma.shape == (4, 3, 3) and np.allclose(D.average_correlation(np.eye(3)[None] * 2 + 0.0), 0) and 0 < D.factor_share(p, np.full((1, 1, 1), 0.5))[0] < 1
    assert np.allclose(np.exp(D.generalized_variance(sigma)[1]), np.linalg.det(sigma)) and D.n_parameters(95, 5) == 95 * 5 - 15 + 50 + 95 + 5
    rows = {r["param"]: r for r in D.param_errors(p, p.replace(mu=p.mu + 0.5))}
    assert rows["mu"]["bias"] == 0.5 and rows["Phi_f"]["rmse"] == 0 and rows["lambda_r"]["eig_bias"] is None
    got = D.pca(np.random.default_rng(0).normal(size=(200, 4)))
    assert abs(got["cumulative"][-1] - 1) < 1e-12 and got["needed"][0.95] == 4
    assert abs(D.bias_ellipse(np.diag([2.0, 1.0]))["major"] - 2) < 1e-12


def test_garch_dcc_and_weights():
    g, x, h = np.random.default_rng(0), [], 1.0
    for _ in range(3000):
        e = g.normal() * math.sqrt(h)
        x.append(e / 100)
        h = 0.05 + 0.1 * e * e + 0.85 * h
    m = G.fit_garch(np.array(x))
    assert abs(m.alpha - 0.1) < 0.04 and abs(m.beta - 0.85) < 0.06 and abs(m.residuals.std() - 1) < 0.05 and m.wald_p < 0.01
    with pytest.raises(ValueError):
        G.fit_garch(np.zeros(100))
    eps = g.normal(size=(200, 3))
    r, cov = G.dcc_path(eps, np.full((200, 3), 2.0), 0.05, 0.9)
    assert np.allclose(np.diagonal(r, axis1=1, axis2=2), 1) and np.allclose(cov, r * 4) and (np.linalg.eigvalsh(r) > 0).all()
    w = G.minimum_variance(np.diag([1.0, 2.0, 4.0]))
    assert np.allclose(w, np.array([4, 2, 1]) / 7) and np.isfinite(G.minimum_variance(np.ones((2, 2)))).all()
    assert np.isfinite(G.student_loglik(eps, cov, 5.0))


def test_linear_factor_model_improves():
    p = P.Params.from_dict({"lambda_r": [[1.0], [0.7], [0.4]], "Phi_f": 0.8, "Phi_h": 0.1, "mu": -1.0, "sigma2": 0.1, "Q_h": 0.01})
    y, f, _ = S.simulate(p, 300, 1)
    a, b = G.fit_linear_factors(y, 1, rounds=1), G.fit_linear_factors(y, 1, rounds=25)
    assert b.loglik > a.loglik and abs(np.corrcoef(b.states[:, 0], f[:, 0])[0, 1]) > 0.9


def test_recovery_and_boundary():
    f = lambda v: np.where(np.abs(v[:, 0]) > 3, np.nan, ((v - 1) ** 2).sum(1))
    r = O.minimize_with_recovery(f, np.array([2.5, -2.0]), "Adam", max_steps=600, rate=0.5)
    assert r.value < 1e-2 and r.steps <= 600
    p = small()
    assert L.boundary_penalty(p.replace(Phi_f=np.array([[0.5]]), Phi_h=np.array([[0.5]]))) == 0 < L.boundary_penalty(p.replace(sigma2=np.array([0.1, 0.1, 1e-4])))


# --- optimizers end honestly, and names are different methods ---


def rosenbrock(v):
    return 100 * (v[:, 1] - v[:, 0] ** 2) ** 2 + (1 - v[:, 0]) ** 2


@pytest.mark.parametrize("name", [n for n in O.LINE_SEARCH if n != "GradientDescent"])
def test_second_order_methods_solve_rosenbrock(name):
    for start in ([0.0, 0.0], [-1.2, 1.0], [2.0, -3.0]):
        r = O.minimize(rosenbrock, np.array(start), name, max_steps=2000, rtol=1e-8, atol=1e-8)
        assert r.success and r.value < 1e-4 and np.abs(r.x - 1).max() < 2e-2, (name, start, r.code, r.value, r.steps)


def test_a_failed_search_is_no_success():
    rng = np.random.default_rng(0)
    noisy = lambda v: np.abs(v[:, 0]) + 0.3 * np.abs(np.sin(1e6 * v[:, 0])) + 1e-3 * rng.normal(size=len(v))
    r = O.minimize(noisy, np.array([3.0]), "BFGS", max_steps=200, rtol=0, atol=0)
    assert not r.success and r.code in ("line_search_failed", "max_steps_reached")
    uphill = O.minimize(rosenbrock, np.array([0.5, 0.5]), "BFGS", gradient=lambda v: -O.central(rosenbrock, v), max_steps=50)
    assert not uphill.success and uphill.code == "line_search_failed"
    cut = O.minimize(rosenbrock, np.array([-1.2, 1.0]), "NonlinearCG", max_steps=10)
    assert not cut.success and cut.code == "max_steps_reached"


def test_trust_region_names_take_different_steps():
    g, h = np.array([1.0, -2.0]), np.array([[3.0, 1.0], [1.0, 2.0]])
    steps = {n: O.trust_step(n, g, h, 0.3) for n in O.TRUST_REGIONS}
    model = lambda d: g @ d + 0.5 * d @ h @ d
    assert all(np.linalg.norm(d) <= 0.3 + 1e-9 and model(d) < 0 for d in steps.values())
    # the indirect one is the model's least value within the radius, by brute force over the circle
    at = np.linspace(0, 2 * np.pi, 20_001)
    least = min(model(0.3 * np.array([np.cos(a), np.sin(a)])) for a in at)
    assert abs(model(steps["IndirectTrustRegionBFGS"]) - least) < 1e-6
    assert len({tuple(np.round(d, 6)) for d in steps.values()}) == 3
    assert all(np.allclose(O.trust_step(n, g, h, 1e3), -np.linalg.solve(h, g), atol=2e-3) for n in O.TRUST_REGIONS)


# --- multivariate tests ---


def test_portmanteau_has_its_size_and_power():
    """Correlated white noise of unequal scale: rejected in about 5 of 100; any linear transform gives the same statistic."""
    rng = np.random.default_rng(11)
    mix = np.array([[1.0, 0, 0], [0.9, 0.3, 0], [40.0, -3.0, 9.0]])
    rejected = {"hosking": 0, "limcleod": 0}
    for _ in range(200):
        x = rng.normal(size=(400, 3)) @ mix.T
        for kind in rejected:
            rejected[kind] += D.portmanteau(x, 5, kind)[1] < 0.05
    assert all(2 <= n <= 22 for n in rejected.values()), rejected
    x = rng.normal(size=(400, 3))
    for kind in rejected:
        assert abs(D.portmanteau(x, 5, kind)[0] - D.portmanteau(x @ mix.T, 5, kind)[0]) < 1e-6
        ar = np.zeros((400, 3))
        for t in range(1, 400):
            ar[t] = 0.5 * ar[t - 1] + x[t]
        assert D.portmanteau(ar, 5, kind)[1] < 1e-6
    # one series: Hosking's statistic is Ljung and Box's but for n (n + 2) in place of n n
    one = rng.normal(size=(300, 1))
    assert abs(D.portmanteau(one, 4)[0] * 302 / 300 - D.ljung_box(one[:, 0], 4)[0]) < 1e-8
    c, t = x - x.mean(0), len(x)
    inv = np.linalg.inv(c.T @ c / t)
    terms = [np.sum((c[h:].T @ c[:-h] / t @ inv) ** 2) for h in range(1, 6)]
    assert abs(D.portmanteau(x, 5, "hosking", unscaled=True)[0] - t * sum(terms)) < 1e-8
    assert abs(D.portmanteau(x, 5, "limcleod", unscaled=True)[0] - t * t * sum(v / (t - h) for h, v in enumerate(terms, 1))) < 1e-8


def test_mardia_without_a_square_matrix():
    x = np.random.default_rng(3).gamma(2.0, size=(500, 4))
    c = x - x.mean(0)
    g = c @ np.linalg.inv(c.T @ c / 500) @ c.T
    m = D.mardia(x)
    assert abs(m["skewness"] - (g**3).mean()) < 1e-8 and abs(m["kurtosis"] - (np.diag(g) ** 2).mean()) < 1e-8
    assert abs(D.mardia(x, own_distances=True)["skewness"] - np.outer(np.diag(g), np.diag(g)).mean() ** 1.5) < 1e-8
    big = np.random.default_rng(4).normal(size=(200_000, 5))
    assert 0 <= D.mardia(big)["skewness"] < 0.01


def test_random_study_draws_like_the_recipe():
    """Draws of a legacy generator in a stated order; dynamics are scaled only where they are beyond their radius."""
    scaled = 0
    for seed in range(60):
        p = P.random_study(4, 2, seed)
        g = np.random.RandomState(seed)
        lam, a, b = g.normal(0, 1, (4, 2)), g.normal(0, 0.5, (2, 2)), g.normal(0, 0.5, (2, 2))
        mu, s2, q = g.normal(-1, 0.5, (2, 1)), np.exp(g.normal(-1, 0.5, 4)), g.normal(0, 0.2, (2, 2))
        for raw, got, most in ((a, p.Phi_f, 0.8), (b, p.Phi_h, 0.95)):
            size = np.abs(np.linalg.eigvals(raw)).max()
            scaled += size > most
            assert np.allclose(got, raw * most / size if size > most else raw)
        assert np.allclose(p.lambda_r, lam) and np.allclose(p.mu, mu.ravel()) and np.allclose(p.sigma2, s2) and np.allclose(p.Q_h, q @ q.T + 1e-4 * np.eye(2))
    assert 0 < scaled < 120


def test_student_likelihood_against_its_density():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(3, 3))
    cov, y, v = np.stack([a @ a.T + np.eye(3)] * 6), rng.normal(size=(6, 3)), 5.0
    want = 0.0
    for r in y:
        scale = cov[0] * (v - 2) / v  # a Student t with this covariance
        want += math.lgamma((v + 3) / 2) - math.lgamma(v / 2) - 1.5 * math.log(v * math.pi) - 0.5 * np.linalg.slogdet(scale)[1]
        want -= 0.5 * (v + 3) * math.log1p(r @ np.linalg.inv(scale) @ r / v)
    assert abs(G.student_loglik(y, cov, v) - want) < 1e-9


@pytest.mark.parametrize("kind", ["BIF", "BF"])
def test_modes_after_a_shock_are_no_worse_than_bisection(kind):
    """A panel that breaks off (its last month is cut) puts one observation far from its prediction."""
    from panelforge import queries

    base = queries._flag_params()
    y = np.random.default_rng(3).normal(0, 0.1, (6, 3))
    y[5] = -3.62, -3.62, -3.28
    shocks = np.stack([y * np.r_[np.ones(5), s][:, None] for s in (0.3, 1.0, 3.0, 10.0, 30.0)])
    b = Fi.Batch.of([base.replace(mu=base.mu * 0 - 6.0)] * len(shocks))
    seen, mode = [], Fi._mode

    def watched(obs, f, h, w_f, w_h):
        lo, hi, parts = h - 12, h + 12, (f, h, w_f, w_h)
        for _ in range(44):
            mid = (lo + hi) / 2
            m, i_ff = obs.inner(mid)
            best = (obs.b - obs.v[..., 0] * obs.b / m[..., 0] + w_f[..., 0] * f) / (i_ff + w_f)[..., 0]
            p = obs.value(best, mid, m)[1]
            rising = 0.5 * np.exp(mid) * (i_ff[..., 0] - p**2) + w_h[..., 0] * (mid - h) >= 0
            lo, hi = np.where(rising, lo, mid), np.where(rising, mid, hi)
        found = mode(obs, *parts)
        level = lambda f_, h_: -obs.value(f_, h_)[0] + 0.5 * ((f_ - f) ** 2 * w_f[..., 0] + (h_ - h) ** 2 * w_h[..., 0]).sum(-1)
        seen.append(level(*found) - level(best, mid))
        return found

    Fi._mode = watched
    try:
        Fi.run_filter(b, shocks, kind)
    finally:
        Fi._mode = mode
    assert np.max(seen) < 1e-3
