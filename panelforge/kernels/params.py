"""Parameters of the dynamic factor stochastic volatility model: container, checks, codecs, generators, transforms.

y = L f + e, e ~ N(0, diag(sigma2)); f' = Phi_f f + diag(exp(h'/2)) u; h' = mu + Phi_h (h - mu) + w, w ~ N(0, Q_h).
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from dataclasses import replace as _replace

import numpy as np

FIELDS = ("lambda_r", "Phi_f", "Phi_h", "mu", "sigma2", "Q_h")
CLIP = 1e-6


@dataclass(frozen=True, eq=False)
class Params:
    N: int
    K: int
    lambda_r: np.ndarray
    Phi_f: np.ndarray
    Phi_h: np.ndarray
    mu: np.ndarray
    sigma2: np.ndarray
    Q_h: np.ndarray

    def replace(self, **changes) -> Params:
        return _replace(self, **changes)

    def to_dict(self) -> tuple[dict[str, np.ndarray], int, int]:
        return {f: getattr(self, f) for f in FIELDS}, self.N, self.K

    @staticmethod
    def from_dict(values: dict, N: int | None = None, K: int | None = None) -> Params:
        """Checks and shapes: missing keys raise KeyError, shapes that don't fit ValueError. A scalar for a square matrix is
        that multiple of the identity; vectors may come as columns. The dictionary isn't changed."""
        missing = [f for f in FIELDS if f not in values]
        if missing:
            raise KeyError(f"missing parameters: {', '.join(missing)}")
        lam = np.atleast_2d(np.asarray(values["lambda_r"], float))
        N, K = values.get("N", N), values.get("K", K)
        N, K = int(N if N is not None else lam.shape[0]), int(K if K is not None else lam.shape[1])
        if lam.shape != (N, K):
            raise ValueError(f"lambda_r has shape {lam.shape}, wanted {(N, K)}")

        def square(name: str) -> np.ndarray:
            x = np.asarray(values[name], float)
            if x.ndim == 0:
                return float(x) * np.eye(K)
            if x.size == K * K:
                return x.reshape(K, K)
            raise ValueError(f"{name} has shape {x.shape}, wanted {(K, K)}")

        def vector(name: str, n: int) -> np.ndarray:
            x = np.asarray(values[name], float)
            if name == "sigma2" and x.ndim == 2 and x.shape == (n, n) and n > 1:
                return np.diag(x).copy()
            if x.ndim == 0:
                return np.full(n, float(x))
            if x.size == n:
                return x.reshape(n)
            raise ValueError(f"{name} has shape {x.shape}, wanted {(n,)}")

        return Params(N, K, lam, square("Phi_f"), square("Phi_h"), vector("mu", K), vector("sigma2", N), square("Q_h"))


def _lists(v):
    """Nested arrays and rows as lists."""
    v = v.tolist() if hasattr(v, "tolist") else v
    return [_lists(x) for x in v] if isinstance(v, (list, tuple)) else v


def as_params(values) -> Params:
    """A Params, a dictionary or a Spark row as checked Params; TypeError for anything else."""
    if isinstance(values, Params):
        return Params.from_dict(values.to_dict()[0], values.N, values.K)
    if hasattr(values, "asDict"):
        values = values.asDict()
    if isinstance(values, dict):
        return Params.from_dict({k: _lists(v) for k, v in values.items()})
    raise TypeError(f"parameters can't be made of {type(values).__name__}")


def as_row(p: Params) -> dict:
    """Plain lists, for a DataFrame."""
    return {"N": p.N, "K": p.K} | {f: getattr(p, f).tolist() for f in FIELDS}


def sound(p: Params, most: float = 5.0) -> list[str]:
    """What is wrong with parameter values: NaN or infinite entries, persistence beyond a bound, variances of 0 or less."""
    said = [f"{f} isn't finite" for f in FIELDS if not np.isfinite(getattr(p, f)).all()]
    said += [f"{f} exceeds {most}" for f in ("Phi_f", "Phi_h") if (np.abs(getattr(p, f)) > most).any()]
    return said + (["sigma2 isn't positive"] if (p.sigma2 <= 0).any() else [])


# --- transforms ---


def safe_arctanh(x):
    return np.arctanh(np.clip(x, -1 + CLIP, 1 - CLIP))


def softplus(x):
    if np.iscomplexobj(x):  # tangents
        return np.where(x.real > 0, x, 0) + np.log1p(np.exp(np.where(x.real > 0, -x, x)))
    return np.logaddexp(0.0, x)


def inverse_softplus(x):
    """log(exp(x) - 1), floored; close to log(x) for small x."""
    x = np.maximum(np.asarray(x, float), 1e-6)
    return np.where(x < 1e-3, np.log(x), x + np.log(-np.expm1(-x)))


def _diagonal(x: np.ndarray, f) -> np.ndarray:
    out = np.array(x, complex if np.iscomplexobj(x) else float)
    np.fill_diagonal(out, f(np.diag(out)))
    return out


def transform(p: Params) -> Params:
    """To unconstrained space: the diagonals of Phi by arctanh, sigma2 and the diagonal of Q_h by inverse softplus. What
    Q_h has off its diagonal is lost."""
    return p.replace(Phi_f=_diagonal(p.Phi_f, safe_arctanh), Phi_h=_diagonal(p.Phi_h, safe_arctanh), sigma2=inverse_softplus(p.sigma2), Q_h=np.diag(inverse_softplus(np.diag(p.Q_h))))


def untransform(p: Params) -> Params:
    return p.replace(Phi_f=_diagonal(p.Phi_f, np.tanh), Phi_h=_diagonal(p.Phi_h, np.tanh), sigma2=softplus(p.sigma2), Q_h=np.diag(softplus(np.diag(p.Q_h))))


def identified(p: Params) -> Params:
    """Loadings lower triangular with a unit diagonal."""
    lam = np.tril(p.lambda_r)
    np.fill_diagonal(lam, 1.0)
    return p.replace(lambda_r=lam)


def flatten(p: Params, free: tuple[str, ...] = FIELDS) -> np.ndarray:
    """The free numbers as a vector; of Q_h the diagonal."""
    return np.concatenate([(np.diag(p.Q_h) if f == "Q_h" else getattr(p, f)).ravel() for f in free])


def unflatten(v: np.ndarray, like: Params, free: tuple[str, ...] = FIELDS) -> Params:
    out, at = {}, 0
    for f in free:
        shape = (like.K,) if f == "Q_h" else getattr(like, f).shape
        n = int(np.prod(shape))
        x = v[at : at + n].reshape(shape)
        out[f], at = np.diag(x) if f == "Q_h" else x, at + n
    return like.replace(**out)


# --- generators ---


def _scaled(a: np.ndarray, radius: float) -> np.ndarray:
    return a * (radius / max(np.abs(np.linalg.eigvals(a)).max(), 1e-12))


def stable(N: int, K: int, seed: int = 42) -> Params:
    """True parameters for experiments: triangular loadings, persistent and stable dynamics, diagonal Q_h."""
    g = np.random.default_rng(seed)
    lam = np.tril(g.normal(0.5, 0.5, (N, K)))
    np.fill_diagonal(lam, 1.0)
    phi_f = g.uniform(0.01, 0.05, (K, K)) + np.diag(g.uniform(0.7, 0.9, K))
    phi_h = g.uniform(0.01, 0.05, (K, K)) + np.diag(g.uniform(0.9, 0.95, K))
    phi_h *= 0.97 / np.linalg.norm(phi_h, 2)
    return Params(N, K, lam, _scaled(phi_f, min(0.95, np.abs(np.linalg.eigvals(phi_f)).max())), phi_h, np.full(K, -1.0), g.uniform(0.05, 0.1, N), np.diag(g.uniform(0.8, 1.0, K)))


def uninformed(N: int, K: int) -> Params:
    """A start that knows nothing but the shapes."""
    lam = np.tril(np.full((N, K), 0.5))
    np.fill_diagonal(lam, 1.0)
    return Params(N, K, lam, 0.8 * np.eye(K), 0.8 * np.eye(K), np.zeros(K), np.full(N, 0.5), 0.2 * np.eye(K))


def realistic(N: int, K: int, seed: int = 42) -> Params:
    """A start for monthly returns."""
    g = np.random.default_rng(seed)
    return identified(Params(N, K, g.normal(0.5, 0.2, (N, K)), 0.3 * np.eye(K), 0.95 * np.eye(K), np.full(K, -6.5), np.full(N, 5e-4), 0.1 * np.eye(K)))


def random_study(N: int, K: int, seed: int) -> Params:
    """Parameters of one replicate: normal loadings, normal dynamics scaled down to a spectral radius where they are beyond
    it, full Q_h."""
    g = np.random.RandomState(seed)
    lam = g.normal(size=(N, K))
    draws = [(g.normal(0, 0.5, (K, K)), most) for most in (0.8, 0.95)]
    phi_f, phi_h = (_scaled(a, most) if np.abs(np.linalg.eigvals(a)).max() > most else a for a, most in draws)
    mu, s2, a = g.normal(-1, 0.5, K), np.exp(g.normal(-1, 0.5, N)), g.normal(0, 0.2, (K, K))
    return Params(N, K, lam, phi_f, phi_h, mu, s2, a @ a.T + 1e-4 * np.eye(K))


def perturbed(p: Params, scale: float = 0.2, seed: int = 0) -> Params:
    """p with normal noise on every entry, brought back into the valid region."""
    g = np.random.default_rng(seed)
    noisy = {f: getattr(p, f) + scale * g.normal(size=getattr(p, f).shape) for f in FIELDS}
    for f, most in (("Phi_f", 0.99), ("Phi_h", 0.999)):
        radius = np.abs(np.linalg.eigvals(noisy[f])).max()
        noisy[f] = noisy[f] * min(1.0, most / max(radius, 1e-12))
    noisy["sigma2"] = np.maximum(noisy["sigma2"], 1e-3)
    noisy["Q_h"] = np.diag(np.maximum(np.diag(noisy["Q_h"]), 1e-3))
    return p.replace(**noisy)


assert tuple(f.name for f in fields(Params))[2:] == FIELDS
