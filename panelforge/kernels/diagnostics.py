"""Residual diagnostics, multivariate tests and model statistics."""

from __future__ import annotations

import math

import numpy as np

from .params import Params
from .special import chi2_sf, digamma, norm_sf

#: MacKinnon (2010), constant and no trend: response surface of the 1, 5 and 10 per cent critical values.
ADF_CRITICAL = {0.01: (-3.43035, -6.5393, -16.786, -79.433), 0.05: (-2.86154, -2.8903, -4.234, -40.040), 0.10: (-2.56677, -1.5384, -2.809, 0.0)}
#: MacKinnon (1994), constant and no trend: polynomials of the normal quantile, below and above -1.61.
ADF_SMALL, ADF_LARGE, ADF_SPLIT, ADF_LEAST, ADF_MOST = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61, -18.83, 2.74


def autocorrelations(x: np.ndarray, lags: int) -> np.ndarray:
    x = np.asarray(x, float) - np.mean(x)
    return np.array([(x[k:] * x[:-k]).sum() for k in range(1, lags + 1)]) / max((x * x).sum(), 1e-300)


def ljung_box(x: np.ndarray, lags: int) -> tuple[float, float]:
    """(statistic, p value) of no autocorrelation up to lags."""
    n, r = len(x), autocorrelations(x, lags)
    q = n * (n + 2) * (r**2 / (n - np.arange(1, lags + 1))).sum()
    return float(q), chi2_sf(q, lags)


def arch_lm(x: np.ndarray, lags: int) -> tuple[float, float]:
    """n R2 of the squares on their own lags."""
    s = np.asarray(x, float) ** 2
    y = s[lags:]
    z = np.column_stack([np.ones(len(y)), *[s[lags - k : len(s) - k] for k in range(1, lags + 1)]])
    e = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    r2 = 1 - (e @ e) / max(((y - y.mean()) ** 2).sum(), 1e-300)
    return float(len(y) * r2), chi2_sf(len(y) * r2, lags)


def jarque_bera(x: np.ndarray) -> tuple[float, float, float, float]:
    """(statistic, p value, skewness, excess kurtosis), population moments."""
    d = np.asarray(x, float) - np.mean(x)
    v = max((d**2).mean(), 1e-300)
    s, k = (d**3).mean() / v**1.5, (d**4).mean() / v**2 - 3
    jb = len(d) / 6 * (s * s + k * k / 4)
    return float(jb), math.exp(-jb / 2), float(s), float(k)


def adf(x: np.ndarray, max_lag: int | None = None) -> tuple[float, float, int]:
    """(statistic, p value, lags) of a unit root with a constant; lags by AIC on a common sample."""
    x = np.asarray(x, float)
    d, n = np.diff(x), len(x)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2) if max_lag is None else max_lag

    def regression(lags: int, drop: int):
        y = d[drop:]
        z = np.column_stack([x[drop:-1], *[d[drop - k : len(d) - k] for k in range(1, lags + 1)], np.ones(len(y))])
        b, *_ = np.linalg.lstsq(z, y, rcond=None)
        e = y - z @ b
        return z, b, e

    def aic(lags: int) -> float:
        z, _, e = regression(lags, most)
        return len(e) * np.log(max((e @ e) / len(e), 1e-300)) + 2 * z.shape[1]

    lags = min(range(most + 1), key=aic)
    z, b, e = regression(lags, lags)
    s2 = (e @ e) / max(len(e) - z.shape[1], 1)
    t = float(b[0] / np.sqrt(s2 * np.linalg.pinv(z.T @ z)[0, 0]))
    if t > ADF_MOST:
        p = 1.0
    elif t < ADF_LEAST:
        p = 0.0
    elif t <= ADF_SPLIT:
        p = 1 - norm_sf(ADF_SMALL[0] + ADF_SMALL[1] * t + ADF_SMALL[2] * t**2)
    else:
        p = 1 - norm_sf(ADF_LARGE[0] + ADF_LARGE[1] * t + ADF_LARGE[2] * t**2 + ADF_LARGE[3] * t**3)
    return t, p, lags


def mardia(x: np.ndarray, own_distances: bool = False) -> dict[str, float]:
    """Multivariate skewness and kurtosis. own_distances takes each row's own distance in the skewness in place of cross
    products, which isn't the standard statistic. The mean cube of all cross products is the sum of the squared third
    moments of whitened columns: K^3 numbers, whatever the number of rows."""
    n, k = x.shape
    c = x - x.mean(0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    live = values > 1e-12 * max(values.max(), 1e-300)
    z = c @ vectors[:, live] / np.sqrt(values[live])
    own = (z * z).sum(1)
    third = np.zeros((z.shape[1] ** 2, z.shape[1]))
    for i in range(0, n, 4096):
        part = z[i : i + 4096]
        third += (part[:, :, None] * part[:, None, :]).reshape(len(part), -1).T @ part
    skew = float(own.mean() ** 3) if own_distances else float(((third / n) ** 2).sum())
    kurt = float((own**2).mean())
    df = k * (k + 1) * (k + 2) / 6
    z_score = (kurt - k * (k + 2)) / math.sqrt(8 * k * (k + 2) / n)
    return {"skewness": skew, "skewness_p": chi2_sf(n * skew / 6, df), "kurtosis": kurt, "kurtosis_z": z_score, "kurtosis_p": 2 * norm_sf(abs(z_score))}


def portmanteau(x: np.ndarray, lags: int, kind: str = "hosking", fitted: int = 0, unscaled: bool = False) -> tuple[float, float, float]:
    """(statistic, p value, degrees of freedom) of no autocorrelation in a multivariate series, by the sum over lags of
    tr(C_h' C_0^-1 C_h C_0^-1), which doesn't depend on the series' scales. hosking: each lag times T^2 / (T - h); limcleod:
    the sum times T, with a correction for the number of series and lags.

    unscaled takes tr(A A') with A = C_h C_0^-1 in its place, times T (hosking) or T^2 / (T - h) a lag (limcleod): another
    convention, whose size is right for uncorrelated series of one scale only."""
    if kind not in ("hosking", "limcleod"):
        raise ValueError(f"no such test: {kind}")
    t, n = x.shape
    c = x - x.mean(0)
    inv = np.linalg.inv(c.T @ c / t)
    q = 0.0
    for h in range(1, lags + 1):
        cov = c[h:].T @ c[:-h] / t
        a = cov @ inv
        term = float((a * a).sum()) if unscaled else float(np.trace(cov.T @ inv @ a))
        q += term * (t * t / (t - h) if (kind == "hosking") != unscaled else t)
    if kind == "limcleod" and not unscaled:
        q += n * n * lags * (lags + 1) / (2 * t)
    df = n * n * lags - fitted
    return q, chi2_sf(q, df), df


def pca(x: np.ndarray, shares: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> dict:
    """Principal components of columns scaled by their deviation, gaps filled by means: eigenvalues, their shares, running
    shares, and how many components reach each of `shares`."""
    x = np.asarray(x, float)
    mean = np.nanmean(x, 0)
    x = np.where(np.isnan(x), mean, x)
    z = (x - mean) / np.maximum(x.std(0), 1e-12)
    values = np.linalg.eigvalsh(z.T @ z / max(len(z) - 1, 1))[::-1]
    ratio = values / values.sum()
    run = np.cumsum(ratio)
    return {"eigenvalues": values, "ratio": ratio, "cumulative": run, "needed": {s: int(np.argmax(run >= s - 1e-12)) + 1 for s in shares}}


def implied_covariance(p: Params, cov_f: np.ndarray) -> np.ndarray:
    """Covariances of returns, (..., N, N), from those of factors."""
    return p.lambda_r @ cov_f @ p.lambda_r.T + np.diag(p.sigma2)


def standardized(p: Params, y: np.ndarray, f: np.ndarray, cov_f: np.ndarray) -> np.ndarray:
    """Residuals whitened by the Cholesky factor of the implied covariance; a row that can't be is NaN."""
    out = np.full(y.shape, np.nan)
    for t in range(len(y)):
        try:
            root = np.linalg.cholesky(implied_covariance(p, cov_f[t]) + 1e-7 * np.eye(p.N))
            out[t] = np.linalg.solve(root, y[t] - p.lambda_r @ f[t])
        except np.linalg.LinAlgError:
            pass
    return out


def generalized_variance(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signed determinant, log determinant) of each matrix."""
    sign, log = np.linalg.slogdet(cov)
    return sign * np.exp(np.minimum(log, 700)), log


def average_correlation(cov: np.ndarray) -> np.ndarray:
    """The mean of the correlations off the diagonal."""
    d = np.sqrt(np.diagonal(cov, axis1=-2, axis2=-1))
    r = cov / (d[..., :, None] * d[..., None, :])
    n = cov.shape[-1]
    return (r.sum((-1, -2)) - np.trace(r, axis1=-2, axis2=-1)) / (n * (n - 1)) if n > 1 else np.full(cov.shape[:-2], np.nan)


def factor_share(p: Params, cov_f: np.ndarray) -> np.ndarray:
    """The part of the total variance that factors carry."""
    common = np.trace(p.lambda_r @ cov_f @ p.lambda_r.T, axis1=-2, axis2=-1)
    return common / (common + p.sigma2.sum())


def n_parameters(N: int, K: int) -> int:
    """Free numbers of the model without mu: NK - K(K+1)/2 + 2K^2 + N + K."""
    return N * K - K * (K + 1) // 2 + 2 * K * K + N + K


def information_criteria(loglik: float, n_params: int, n_obs: int) -> tuple[float, float]:
    return 2 * n_params - 2 * loglik, n_params * math.log(n_obs) - 2 * loglik


def student_df(z: np.ndarray) -> float:
    """Degrees of freedom of a Student t with unit variance: a root of the score in [2.1, 200] by bisection, or, without
    one, of the fourth moment."""
    z2 = np.asarray(z, float).ravel() ** 2

    def score(v: float) -> float:
        u = z2 / (v - 2)
        w = np.log1p(u)
        return float(0.5 * (digamma((v + 1) / 2) - digamma(v / 2) - 1 / (v - 2)) - 0.5 * w.mean() + 0.5 * (v + 1) * (u / (1 + u)).mean() / (v - 2))

    low, high = 2.1, 200.0
    if score(low) * score(high) > 0:
        k = (z2**2).mean() / max(z2.mean() ** 2, 1e-300) - 3
        return 6 / k + 4 if k > 0 else 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if score(low) * score(mid) > 0 else (low, mid)
    return (low + high) / 2


def accuracy(true: np.ndarray, est: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rmse, correlation) of each column; series that differ by one row are aligned at their end. A correlation needs two
    finite pairs and some variance."""
    if abs(len(true) - len(est)) == 1:
        n = min(len(true), len(est))
        true, est = true[-n:], est[-n:]
    if true.shape != est.shape:
        raise ValueError(f"shapes differ: {true.shape} and {est.shape}")
    rmse, corr = np.full(true.shape[1], np.nan), np.full(true.shape[1], np.nan)
    for k in range(true.shape[1]):
        ok = np.isfinite(true[:, k]) & np.isfinite(est[:, k])
        a, b = true[ok, k], est[ok, k]
        if len(a):
            rmse[k] = np.sqrt(((a - b) ** 2).mean())
        if len(a) >= 2 and a.std() > 1e-10 and b.std() > 1e-10:
            corr[k] = np.corrcoef(a, b)[0, 1]
    return rmse, corr


def param_errors(true: Params, est: Params) -> list[dict]:
    """One row for each parameter: bias, MAE, RMSE, Frobenius distance and its share, mean relative error; for square ones
    also errors of sorted eigenvalue sizes, and differences of log determinant (where both are positive) and trace."""
    out = []
    for f in ("lambda_r", "Phi_f", "Phi_h", "mu", "sigma2", "Q_h"):
        a, b = np.asarray(getattr(true, f), float), np.asarray(getattr(est, f), float)
        d, norm = b - a, float(np.linalg.norm(a))
        row = {"param": f, "bias": float(d.mean()), "mae": float(np.abs(d).mean()), "rmse": float(np.sqrt((d**2).mean())), "frob_diff": float(np.linalg.norm(d)),
               "frob_rel_diff": float(np.linalg.norm(d)) / norm if norm > 1e-10 else None, "rel_error": float((np.abs(d) / (np.abs(a) + 1e-8)).mean()),
               "eig_bias": None, "eig_mae": None, "eig_rmse": None, "logdet_diff": None, "trace_diff": None}
        if a.ndim == 2 and a.shape[0] == a.shape[1]:
            e = np.sort(np.abs(np.linalg.eigvals(b))) - np.sort(np.abs(np.linalg.eigvals(a)))
            (s1, l1), (s2, l2) = np.linalg.slogdet(a), np.linalg.slogdet(b)
            row |= {
                "eig_bias": float(e.mean()), "eig_mae": float(np.abs(e).mean()), "eig_rmse": float(np.sqrt((e**2).mean())),
                "logdet_diff": float(l2 - l1) if s1 > 0 and s2 > 0 else None, "trace_diff": float(np.trace(b) - np.trace(a))
            }
        out.append(row)
    return out


def bias_ellipse(bias: np.ndarray) -> dict[str, float]:
    """Axes and angle, in degrees, of a 2 x 2 bias matrix's symmetric part."""
    w, v = np.linalg.eigh((bias + bias.T) / 2)
    return {"major": float(w[1]), "minor": float(w[0]), "angle": float(np.degrees(np.arctan2(v[1, 1], v[0, 1])))}
