"""GARCH(1,1) with Student errors, dynamic conditional correlations, minimum-variance weights, and a linear factor model."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .optimize import central, minimize
from .special import norm_sf

SCALE = 100.0


@dataclass(frozen=True)
class Garch:
    omega: float
    alpha: float
    beta: float
    nu: float
    loglik: float
    converged: bool
    variance: np.ndarray
    residuals: np.ndarray
    covariance: np.ndarray  #: of (omega, alpha, beta, nu)

    @property
    def wald_p(self) -> float:
        """One-sided p value of alpha + beta = 0."""
        v = self.covariance[1, 1] + self.covariance[2, 2] + 2 * self.covariance[1, 2]
        return norm_sf((self.alpha + self.beta) / math.sqrt(v)) if v > 0 else math.nan


def variance_path(x2: np.ndarray, omega, alpha, beta, start: float) -> np.ndarray:
    """Conditional variances, one column for each parameter set."""
    omega, alpha, beta = np.atleast_1d(omega), np.atleast_1d(alpha), np.atleast_1d(beta)
    out = np.empty((len(x2), len(omega)))
    now = np.full(len(omega), start)
    for t in range(len(x2)):
        out[t] = now
        now = omega + alpha * x2[t] + beta * now
    return out


def _constrained(theta: np.ndarray) -> tuple[np.ndarray, ...]:
    """omega > 0; alpha and beta positive with a sum below 1; nu > 2."""
    t = np.clip(theta, -30, 30)
    total, part = 0.9999 / (1 + np.exp(-t[:, 1])), 1 / (1 + np.exp(-t[:, 2]))
    return np.exp(t[:, 0]), total * part, total * (1 - part), 2.05 + np.exp(t[:, 3])


def _nll(x2: np.ndarray, start: float, omega, alpha, beta, nu) -> np.ndarray:
    h = variance_path(x2, omega, alpha, beta, start)
    lg = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in nu])
    return -(lg - 0.5 * np.log(np.pi * (nu - 2)) - 0.5 * np.log(h) - 0.5 * (nu + 1) * np.log1p(x2[:, None] / ((nu - 2) * h))).sum(0)


def fit_garch(x: np.ndarray, max_steps: int = 60) -> Garch:
    """x around zero. It is scaled by 100 for the fit; variances come back in x's units."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)] * SCALE
    if len(x) < 20 or x.std() < 1e-12:
        raise ValueError("too few or constant values")
    x2, start = x * x, float((x * x).mean())
    f = lambda theta: _nll(x2, start, *_constrained(theta))
    got = minimize(f, np.array([math.log(start * 0.05), 3.0, -2.0, math.log(6.0)]), "BFGS", max_steps=max_steps, rtol=1e-7, atol=1e-6)
    omega, alpha, beta, nu = (float(v[0]) for v in _constrained(got.x[None]))
    natural = np.array([omega, alpha, beta, nu])
    g = lambda pts: _nll(x2, start, *np.maximum(pts, 1e-9).T[:3], np.maximum(pts[:, 3], 2.01))
    hess = np.array([(central(g, natural + e) - central(g, natural - e)) / (2 * np.abs(e).sum()) for e in np.diag(1e-4 * np.maximum(natural, 1e-2))])
    cov = np.linalg.pinv((hess + hess.T) / 2)
    h = variance_path(x2, omega, alpha, beta, start)[:, 0]
    return Garch(omega, alpha, beta, nu, -got.value, got.success, h / SCALE**2, x / np.sqrt(h), cov)


def dcc_path(eps: np.ndarray, sigma: np.ndarray, a: float, b: float, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(R, H), (T, N, N): conditional correlations and covariances of standardised residuals eps with deviations sigma.
    known: how many rows of eps the mean is taken of, all unless given. Q_0 is the mean outer product; each next one takes its share (1 - a - b), a of the last outer product, b of the last Q."""
    t_all, n = eps.shape
    seen = eps[:known]
    mean = seen.T @ seen / len(seen)
    q, r = mean, np.empty((t_all, n, n))
    for t in range(t_all):
        if t:
            q = (1 - a - b) * mean + a * np.outer(eps[t - 1], eps[t - 1]) + b * q
        d = 1 / np.sqrt(np.maximum(np.diag(q), 1e-12))
        r[t] = q * d[:, None] * d[None, :]
        np.fill_diagonal(r[t], 1.0)
    return r, r * sigma[:, :, None] * sigma[:, None, :]


def fit_dcc(eps: np.ndarray, steps: int = 40) -> tuple[float, float, float]:
    """(a, b, log likelihood) by the correlation part of the Gaussian likelihood."""
    def values(points: np.ndarray) -> np.ndarray:
        out = []
        for u, v in np.clip(points, -20, 20):
            total, part = 0.999 / (1 + math.exp(-u)), 1 / (1 + math.exp(-v))
            r, _ = dcc_path(eps, np.ones_like(eps), total * part, total * (1 - part))
            z = np.linalg.solve(r, eps[:, :, None])[:, :, 0]
            out.append(0.5 * float((np.linalg.slogdet(r)[1] + (eps * z).sum(1) - (eps * eps).sum(1)).sum()))
        return np.array(out)

    got = minimize(values, np.array([3.0, -3.0]), "BFGS", max_steps=steps)
    total, part = 0.999 / (1 + math.exp(-got.x[0])), 1 / (1 + math.exp(-got.x[1]))
    return total * part, total * (1 - part), -got.value


def dcc_forecast(eps: np.ndarray, sigma_next: np.ndarray, a: float, b: float) -> np.ndarray:
    """The covariance one step ahead, from the whole path of correlations and the next deviations."""
    r, _ = dcc_path(np.vstack([eps, np.zeros(eps.shape[1])]), np.ones((len(eps) + 1, eps.shape[1])), a, b, len(eps))
    return r[-1] * np.outer(sigma_next, sigma_next)


def ridged(cov: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    try:
        np.linalg.cholesky(cov)
        return cov
    except np.linalg.LinAlgError:
        return cov + ridge * np.eye(len(cov))


def student_loglik(y: np.ndarray, cov: np.ndarray, dof: float) -> float:
    """Sum of multivariate Student densities with covariances cov (T, N, N); steps without a positive determinant are
    left out."""
    n, out = y.shape[1], 0.0
    front = math.lgamma((dof + n) / 2) - math.lgamma(dof / 2) - 0.5 * n * math.log(math.pi * (dof - 2))
    for r, c in zip(y, cov):
        c = ridged(c)
        sign, log = np.linalg.slogdet(c)
        if sign > 0:
            out += front - 0.5 * log - 0.5 * (dof + n) * math.log1p(float(r @ np.linalg.solve(c, r)) / (dof - 2))
    return out


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    """Global minimum-variance weights; a ridge where cov is singular."""
    try:
        w = np.linalg.solve(cov, np.ones(len(cov)))
    except np.linalg.LinAlgError:
        w = np.linalg.solve(cov + 1e-6 * np.eye(len(cov)), np.ones(len(cov)))
    return w / w.sum()


@dataclass(frozen=True)
class LinearFactors:
    lam: np.ndarray
    phi: np.ndarray
    q: np.ndarray
    s2: np.ndarray
    loglik: float
    states: np.ndarray
    covs: np.ndarray


def kalman(y: np.ndarray, lam, phi, q, s2):
    """(states, covs, predicted covs, log likelihood) of a linear Gaussian factor model."""
    k = len(phi)
    x, p, ll = np.zeros(k), np.eye(k), 0.0
    xs, ps, pp = np.empty((len(y), k)), np.empty((len(y), k, k)), np.empty((len(y), k, k))
    for t in range(len(y)):
        x, p = phi @ x, phi @ p @ phi.T + q
        pp[t] = p
        s = lam @ p @ lam.T + np.diag(s2)
        e = y[t] - lam @ x
        gain = np.linalg.solve(s, lam @ p).T
        ll -= 0.5 * (len(e) * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + e @ np.linalg.solve(s, e))
        x, p = x + gain @ e, p - gain @ lam @ p
        p = (p + p.T) / 2
        xs[t], ps[t] = x, p
    return xs, ps, pp, float(ll)


def fit_linear_factors(y: np.ndarray, k: int, rounds: int = 30, tol: float = 1e-5) -> LinearFactors:
    """Expectation maximisation from principal components."""
    y = np.asarray(y, float)
    _, _, v = np.linalg.svd(y - y.mean(0), full_matrices=False)
    lam = v[:k].T * np.sqrt(y.shape[1])
    f = y @ lam / y.shape[1]
    phi = np.linalg.lstsq(f[:-1], f[1:], rcond=None)[0].T
    q, s2, last = np.cov((f[1:] - f[:-1] @ phi.T).T).reshape(k, k) + 1e-6 * np.eye(k), np.maximum((y - f @ lam.T).var(0), 1e-8), -np.inf
    for _ in range(rounds):
        xs, ps, pp, ll = kalman(y, lam, phi, q, s2)
        if ll - last < tol * abs(ll):
            break
        last = ll
        sx, sp, lag = xs.copy(), ps.copy(), np.zeros_like(ps)
        for t in range(len(y) - 2, -1, -1):
            g = np.linalg.solve(pp[t + 1], phi @ ps[t]).T
            sx[t] = xs[t] + g @ (sx[t + 1] - phi @ xs[t])
            sp[t] = ps[t] + g @ (sp[t + 1] - pp[t + 1]) @ g.T
            lag[t + 1] = sp[t + 1] @ g.T
        ff = np.einsum("ti,tj->ij", sx, sx) + sp.sum(0)
        f0, f1 = ff - np.outer(sx[-1], sx[-1]) - sp[-1], ff - np.outer(sx[0], sx[0]) - sp[0]
        c = np.einsum("ti,tj->ij", sx[1:], sx[:-1]) + lag[1:].sum(0)
        lam = np.linalg.solve(ff, sx.T @ y).T
        phi = np.linalg.solve(f0, c.T).T
        q = (f1 - phi @ c.T) / (len(y) - 1)
        q = (q + q.T) / 2 + 1e-9 * np.eye(k)
        s2 = np.maximum((y**2).mean(0) - np.einsum("nk,kn->n", lam, sx.T @ y) / len(y), 1e-8)
    xs, ps, _, ll = kalman(y, lam, phi, q, s2)
    return LinearFactors(lam, phi, q, s2, ll, xs, ps)
