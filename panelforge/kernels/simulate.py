"""The model's simulator."""

from __future__ import annotations

import numpy as np

from .params import Params


def simulate(p: Params, T: int = 100, seed: int | None = None, f0=None, h0=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(returns (T, N), factors (T, K), log volatilities (T, K)). Row 0 is the initial state, with returns of 0.

    Each step draws K log-volatility shocks, K factor shocks and N observation shocks from one legacy stream, so a seed
    gives the sequence it has always given.
    """
    g = np.random.RandomState(seed)
    y, f, h = np.zeros((T, p.N)), np.zeros((T, p.K)), np.zeros((T, p.K))
    f[0] = 0 if f0 is None else f0
    h[0] = p.mu if h0 is None else h0
    draws = g.normal(size=(max(T - 1, 0), 2 * p.K + p.N))
    w = draws[:, : p.K] @ np.linalg.cholesky(p.Q_h).T
    for t in range(1, T):
        h[t] = p.mu + p.Phi_h @ (h[t - 1] - p.mu) + w[t - 1]
        f[t] = p.Phi_f @ f[t - 1] + np.exp(h[t] / 2) * draws[t - 1, p.K : 2 * p.K]
    y[1:] = f[1:] @ p.lambda_r.T + draws[:, 2 * p.K :] * np.sqrt(p.sigma2)
    return y, f, h
