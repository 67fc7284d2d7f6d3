"""Complete-data likelihoods, priors and the estimation objective."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import filters, particle
from .params import Params, identified, untransform
from .special import inverse_gamma_logpdf, norm_logpdf

UNSTABLE = 1e10
EDGE = 1e-6
PRIOR = {
    "mu_mean": 0.0, "mu_var": 1.0, "sigma2_alpha": 3.0, "sigma2_beta": 0.1, "q_h_alpha": 3.0, "q_h_beta": 0.05, "lambda_mean": 0.0, "lambda_var": 1.0,
    "phi_f_mean": 0.0, "phi_f_diag_mean": 0.9, "phi_f_var": 0.5, "phi_h_mean": 0.0, "phi_h_diag_mean": 0.95, "phi_h_var": 0.1,
}


def observation_loglik(p: Params, y: np.ndarray, f: np.ndarray) -> np.ndarray:
    """log p(y_t | f_t), for every t."""
    return norm_logpdf(y, f @ p.lambda_r.T, np.sqrt(p.sigma2)).sum(-1)


def factor_loglik(p: Params, f: np.ndarray, h: np.ndarray) -> np.ndarray:
    """log p(f_t | f_{t-1}, h_t), from t = 1 on."""
    return norm_logpdf(f[1:], f[:-1] @ p.Phi_f.T, np.exp(h[1:] / 2)).sum(-1)


def volatility_loglik(p: Params, h: np.ndarray) -> np.ndarray:
    """log p(h_t | h_{t-1}), from t = 1 on."""
    r = h[1:] - p.mu - (h[:-1] - p.mu) @ p.Phi_h.T
    z = np.linalg.solve(np.linalg.cholesky(p.Q_h), r.T)
    return -0.5 * ((z**2).sum(0) + p.K * np.log(2 * np.pi) + np.linalg.slogdet(p.Q_h)[1])


def joint_loglik(p: Params, y: np.ndarray, f: np.ndarray, h: np.ndarray) -> float:
    """The complete-data log likelihood; the first row has its observation term only."""
    return float(observation_loglik(p, y, f).sum() + factor_loglik(p, f, h).sum() + volatility_loglik(p, h).sum())


def log_prior(p: Params, **changes) -> float:
    """Normal priors on mu, loadings and dynamics (diagonals have a mean of their own), inverse gamma ones on variances.
    A density that isn't finite is -UNSTABLE."""
    c = PRIOR | {k.removeprefix("prior_"): v for k, v in changes.items()}

    def dynamics(phi: np.ndarray, name: str) -> float:
        mean = np.full(phi.shape, c[f"{name}_mean"])
        np.fill_diagonal(mean, c[f"{name}_diag_mean"])
        return norm_logpdf(phi, mean, np.sqrt(c[f"{name}_var"])).sum()

    out = norm_logpdf(p.mu, c["mu_mean"], np.sqrt(c["mu_var"])).sum() + norm_logpdf(p.lambda_r, c["lambda_mean"], np.sqrt(c["lambda_var"])).sum()
    out += inverse_gamma_logpdf(p.sigma2, c["sigma2_alpha"], c["sigma2_beta"]).sum() + inverse_gamma_logpdf(np.diag(p.Q_h), c["q_h_alpha"], c["q_h_beta"]).sum()
    out += dynamics(p.Phi_f, "phi_f") + dynamics(p.Phi_h, "phi_h")
    return float(out) if np.isfinite(out) else -UNSTABLE


def instability(p: Params) -> float:
    """By how much eigenvalues reach beyond the unit circle, in all."""
    sizes = np.abs(np.r_[np.linalg.eigvals(p.Phi_f), np.linalg.eigvals(p.Phi_h)])
    return float(np.maximum(sizes - 1 + EDGE, 0).sum())


def logliks(params: list[Params], y: np.ndarray, kind: str = "BIF", particles: int = 1000, seed: int = 42, seen: dict | None = None) -> np.ndarray:
    """The log likelihood of one panel y (T, N) under each of params. seen gets the mode filters' states as "modes"."""
    if kind == "PF":
        out = []
        for p in params:
            s = particle.particle_filter(p, y, particles, seed=seed).loglik.sum()
            out.append(s if np.isfinite(s) else -np.inf)
        return np.array(out)
    with np.errstate(all="ignore"):
        x = filters.run_filter(filters.Batch.of(params), np.broadcast_to(y, (len(params), *y.shape)), kind)
    if seen is not None:
        seen["modes"] = x.alpha
    return filters.total(x.loglik)


def objectives(
    params: list[Params], y: np.ndarray, kind: str = "BIF", priors: dict | None = None, stability_weight: float = 0.0, transformed: bool = False,
    fixed_mu: np.ndarray | None = None, boundary_weight: float = 0.0, **options,
) -> np.ndarray:
    """The values to minimise: negative log posterior plus weighted instability. Unstable candidates get a large value and
    never reach the likelihood. boundary_weight makes the objective robust: it adds boundary_penalty() at that weight, which
    turns a search away before it meets the gate."""
    done = [identified(untransform(p) if transformed else p) for p in params]
    if fixed_mu is not None:
        done = [p.replace(mu=np.asarray(fixed_mu, float)) for p in done]
    finite = [all(np.isfinite(getattr(p, f)).all() for f in ("lambda_r", "Phi_f", "Phi_h", "mu", "sigma2", "Q_h")) for p in done]
    far = np.array([instability(p) if ok else np.inf for p, ok in zip(done, finite)])
    out = UNSTABLE + np.where(np.isfinite(far), stability_weight * far, 0)
    good = np.flatnonzero(far == 0)
    if len(good):
        try:
            ll = logliks([done[i] for i in good], y, kind, **options)
        except np.linalg.LinAlgError:
            ll = np.full(len(good), -np.inf)
        value = np.where(np.isfinite(ll), -ll, UNSTABLE)
        if priors is not None:
            value = value - np.array([log_prior(done[i], **priors) for i in good])
        if boundary_weight:
            value = value + np.array([boundary_penalty(done[i], weight=boundary_weight) for i in good])
        out[good] = value
    return out


def slopes(
    build: Callable[[np.ndarray], Params], points: np.ndarray, y: np.ndarray, kind: str = "BIF", priors: dict | None = None, boundary_weight: float = 0.0,
    modes: np.ndarray | None = None,
) -> np.ndarray:
    """The exact gradients of objectives(), one a row, at stable points, one a row; build makes parameters of a vector, real or
    complex. What priors and the boundary add is differenced: they are smooth, cheap, and never meet the gate. modes: the
    filter's at these points, if they are known."""
    tangents = 1j * filters.TANGENT * np.eye(points.shape[1])
    with np.errstate(all="ignore"):
        out = -filters.score(filters.Batch.of([build(v) for x in points for v in x + tangents]), y, kind, len(points), modes)
    if priors is not None or boundary_weight:

        def rest(v: np.ndarray) -> float:
            p = build(v)
            return (0.0 if priors is None else -log_prior(p, **priors)) + (boundary_penalty(p, weight=boundary_weight) if boundary_weight else 0.0)

        for row, x in zip(out, points):
            steps = 1e-6 * np.maximum(1, np.abs(x))
            row += [(rest(x + d) - rest(x - d)) / (2 * h) for d, h in zip(np.diag(steps), steps)]
    return out


def boundary_penalty(p: Params, radius: float = 0.95, least_variance: float = 0.01, weight: float = 100.0) -> float:
    """A penalty that grows as eigenvalues near the unit circle and as variances near 0, before the gate closes."""
    sizes = np.abs(np.r_[np.linalg.eigvals(p.Phi_f), np.linalg.eigvals(p.Phi_h)])
    low = np.maximum(least_variance - np.r_[p.sigma2, np.diag(p.Q_h)], 0) / least_variance
    return float(weight * (np.maximum(sizes - radius, 0) ** 2).sum() / (1 - radius) ** 2 + weight * (low**2).sum())
