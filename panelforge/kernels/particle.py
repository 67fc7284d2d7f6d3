"""Bootstrap particle filter with systematic resampling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .filters import lyapunov
from .params import Params


@dataclass(frozen=True)
class Cloud:
    """means (T, 2K), covs (T, 2K, 2K), ess (T,), loglik (T,), and the last particles (2K, P) with their log weights."""

    means: np.ndarray
    covs: np.ndarray
    ess: np.ndarray
    loglik: np.ndarray
    particles: np.ndarray
    log_weights: np.ndarray


def particle_filter(p: Params, y: np.ndarray, particles: int = 1000, resample_below: float = 0.5, seed: int = 42, init_factor_var: float = 1e6) -> Cloud:
    """y (T, N). The likelihood is that of y given f alone, with its constant. A seed gives the same draws whatever the
    parameters: common random numbers. Filter and likelihood are one code path."""
    if particles < 1 or not 0 <= resample_below <= 1:
        raise ValueError("particles must be positive and the threshold a share")
    y = np.asarray(y, float)
    if y.ndim != 2 or y.shape[1] != p.N:
        raise ValueError(f"observations have shape {y.shape}, wanted (T, {p.N})")
    g, k, t_all = np.random.default_rng(seed), p.K, len(y)
    spread = np.linalg.cholesky(lyapunov(p.Phi_h, p.Q_h) + 1e-9 * np.eye(k))
    f = np.sqrt(init_factor_var) * g.normal(size=(k, particles))
    h = p.mu[:, None] + spread @ g.normal(size=(k, particles))
    root, lw = np.linalg.cholesky(p.Q_h + 1e-12 * np.eye(k)), np.full(particles, -np.log(particles))
    const, w_lam = -0.5 * (p.N * np.log(2 * np.pi) + np.log(p.sigma2).sum()), p.lambda_r.T / p.sigma2
    gram, weights = w_lam @ p.lambda_r, None
    means, covs, ess, ll = np.empty((t_all, 2 * k)), np.empty((t_all, 2 * k, 2 * k)), np.empty(t_all), np.empty(t_all)
    for t in range(t_all):
        h = np.clip(p.mu[:, None] + p.Phi_h @ (h - p.mu[:, None]) + root @ g.normal(size=(k, particles)), -50, 50)
        f = p.Phi_f @ f + np.exp(h / 2) * g.normal(size=(k, particles))
        # (y - L f)' D^-1 (y - L f) in K dimensions
        quad = (y[t] ** 2 / p.sigma2).sum() - 2 * (w_lam @ y[t]) @ f + ((gram @ f) * f).sum(0)
        lw = lw + const - 0.5 * quad
        top = lw.max()
        norm = top + np.log(np.exp(lw - top).sum())
        ll[t] = norm
        lw = lw - norm
        weights = np.exp(lw)
        ess[t] = 1 / (weights**2).sum()
        state = np.vstack([f, h])
        means[t] = state @ weights
        centred = state - means[t][:, None]
        covs[t] = (centred * weights) @ centred.T
        u = g.uniform()
        if ess[t] < resample_below * particles:
            at = np.minimum(np.searchsorted(np.cumsum(weights), (u + np.arange(particles)) / particles), particles - 1)
            f, h, lw = f[:, at], h[:, at], np.full(particles, -np.log(particles))
    return Cloud(means, covs, ess, np.where(np.isnan(ll), -np.inf, ll), np.vstack([f, h]), lw)


def smooth_particles(p: Params, x: Cloud, filtered_as_predicted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Backward smoothing of means and covariances as if they were Gaussian. filtered_as_predicted takes the filtered
    covariance in place of the predicted one, a cruder approximation."""
    k = p.K
    big = np.block([[p.Phi_f, np.zeros((k, k))], [np.zeros((k, k)), p.Phi_h]])
    shift = np.r_[np.zeros(k), p.mu - p.Phi_h @ p.mu]
    means, covs = x.means.copy(), x.covs.copy()
    for t in range(len(means) - 2, -1, -1):
        pred = big @ x.means[t] + shift
        noise = np.zeros((2 * k, 2 * k))
        noise[:k, :k], noise[k:, k:] = np.diag(np.exp(np.clip(pred[k:], -50, 50))), p.Q_h
        cov = x.covs[t + 1] if filtered_as_predicted else big @ x.covs[t] @ big.T + noise
        gain = x.covs[t] @ big.T @ np.linalg.pinv(cov)
        means[t] = x.means[t] + gain @ (means[t + 1] - pred)
        covs[t] = x.covs[t] + gain @ (covs[t + 1] - cov) @ gain.T
    return means, covs
