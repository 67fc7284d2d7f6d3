"""Posterior-mode filters, in covariance and in information form, and their smoother, for a batch of runs at once.

With the expected information every matrix is block diagonal in factors and log volatilities, so only K x K blocks are
kept. Arrays lead with the run; runs of one batch share N, K and T. Likelihoods leave out the constant N log(2 pi) / 2 a
step, which `constant` gives.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .params import Params

ROUNDS, SWEEPS, NEWTON, POLISH = 8, 2, 6, 8
AGAIN, FAR = 200, 8.0  #: steps of a second search; the first is doubted where a log volatility ends so far from its prediction
CLOSE = 1e-7  #: a search ends when it moves no further than this, or its gradient is below it
H_MOST = 50.0  #: log volatilities are held within, so that their exponentials stay finite
BIF, BF = "BIF", "BF"


@dataclass(frozen=True)
class Batch:
    """Parameters of R runs, stacked."""

    lam: np.ndarray
    phi_f: np.ndarray
    phi_h: np.ndarray
    mu: np.ndarray
    s2: np.ndarray
    q_h: np.ndarray

    @staticmethod
    def of(params: list[Params]) -> Batch:
        return Batch(*[np.stack([getattr(p, f) for p in params]) for f in ("lambda_r", "Phi_f", "Phi_h", "mu", "sigma2", "Q_h")])


@dataclass(frozen=True)
class Filtered:
    """alpha (R, T, 2K); cov_f, cov_h (R, T, K, K); predicted ones alike; loglik (R, T); clamped (R,)."""

    alpha: np.ndarray
    cov_f: np.ndarray
    cov_h: np.ndarray
    loglik: np.ndarray
    clamped: np.ndarray


def lyapunov(phi: np.ndarray, q: np.ndarray, rounds: int = 30) -> np.ndarray:
    """P = phi P phi' + q, iterated a fixed number of times from q."""
    p = q
    for _ in range(rounds):
        p = phi @ p @ np.swapaxes(phi, -1, -2) + q
    return (p + np.swapaxes(p, -1, -2)) / 2


def _inv(a: np.ndarray) -> np.ndarray:
    """Inverses, or pseudo-inverses where one is singular or its inverse isn't finite."""
    try:
        out = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a)
    bad = ~np.isfinite(out).all((-1, -2))
    return np.where(bad[..., None, None], np.linalg.pinv(np.nan_to_num(a)), out) if bad.any() else out


def predict(b: Batch, f: np.ndarray, h: np.ndarray, p_f: np.ndarray, p_h: np.ndarray, current: bool = True) -> tuple[np.ndarray, ...]:
    """(f, h, P_f, P_h) one step ahead of given ones. current takes the factors' noise from the log volatility before the
    step, another convention than the filters' own, which take the predicted one."""
    f_next, h_next = _mv(b.phi_f, f), b.mu + _mv(b.phi_h, h - b.mu)
    noise = _diag(np.exp(np.clip(h if current else h_next, -H_MOST, H_MOST)))
    return f_next, h_next, b.phi_f @ p_f @ np.swapaxes(b.phi_f, -1, -2) + noise, b.phi_h @ p_h @ np.swapaxes(b.phi_h, -1, -2) + b.q_h


@lru_cache(maxsize=64)
def _eye(k: int, x: float = 1.0) -> np.ndarray:
    return x * np.eye(k)


def _diag(x: np.ndarray) -> np.ndarray:
    return x[..., :, None] * _eye(x.shape[-1])


def _mv(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    if a.shape[-1] == a.shape[-2] == 1:  # one factor: a product costs a tenth of a call to the matrix library
        return a[..., 0] * x
    return (a @ x[..., None])[..., 0]


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^-1 b, for matrices b."""
    return b / a if a.shape[-1] == 1 else np.linalg.solve(a, b)


def _logdet(a: np.ndarray) -> np.ndarray:
    """The logarithm of a determinant; of a complex matrix the analytic one, which tangents need."""
    if a.shape[-1] == 1:
        return np.log(a[..., 0, 0] if np.iscomplexobj(a) else np.abs(a[..., 0, 0]))
    sign, size = np.linalg.slogdet(a)
    return size + np.log(sign) if np.iscomplexobj(a) else size


def _held(h: np.ndarray) -> np.ndarray:
    """Log volatilities within H_MOST; one beyond it is constant, and has no tangent."""
    return np.where(np.abs(h.real) > H_MOST, np.clip(h.real, -H_MOST, H_MOST), h)


class _Observation:
    """One observation's likelihood given (f, h): y ~ N(L f, L diag(e^h) L' + diag(s2)), by Woodbury in K dimensions."""

    def __init__(self, b: Batch) -> None:
        self.dinv = 1 / (b.s2 + 1e-8)
        self.lam_d = b.lam * self.dinv[..., None]
        self.v = np.swapaxes(b.lam, -1, -2) @ self.lam_d
        self.logdet_d = np.log(np.maximum(b.s2, 1e-10)).sum(-1)
        self.k = self.v.shape[-1]

    def of(self, runs: np.ndarray) -> _Observation:
        """That of some of the runs."""
        out = copy.copy(self)
        for name in ("dinv", "lam_d", "v", "logdet_d", "b", "yy"):
            setattr(out, name, getattr(self, name)[runs])
        return out

    def see(self, y: np.ndarray) -> None:
        self.b = _mv(np.swapaxes(self.lam_d, -1, -2), y)
        self.yy = (y * y * self.dinv).sum(-1)

    def inner(self, h: np.ndarray):
        """M = diag(e^-h) + V, and I_ff = V - V M^-1 V, the information on f."""
        m = _diag(1 / (np.exp(h) + 1e-8)) + self.v + _eye(self.k, 1e-6)
        i_ff = self.v - self.v @ _solved(m, self.v)
        return m, (i_ff + np.swapaxes(i_ff, -1, -2)) / 2

    def residual(self, f: np.ndarray):
        """What the likelihood needs of f alone: (L' D^-1 (y - L f), (y - L f)' D^-1 (y - L f))."""
        vf = _mv(self.v, f)
        return self.b - vf, self.yy - 2 * (f * self.b).sum(-1) + (f * vf).sum(-1)

    def fit(self, v: np.ndarray, rr: np.ndarray, h: np.ndarray, m: np.ndarray | None = None):
        """(log likelihood, M^-1 v) at h, for a residual()."""
        if m is None:
            m = _diag(1 / (np.exp(h) + 1e-8)) + self.v + _eye(self.k, 1e-6)
        z = _solved(m, v[..., None])[..., 0]
        logdet = _logdet(m) + h.sum(-1) + self.logdet_d
        return -0.5 * (logdet + rr - (v * z).sum(-1)), z

    def value(self, f: np.ndarray, h: np.ndarray, m: np.ndarray | None = None):
        """(log likelihood, L' A^-1 (y - L f))."""
        v, rr = self.residual(f)
        ll, z = self.fit(v, rr, h, m)
        return ll, v - _mv(self.v, z)

    def information(self, h: np.ndarray, i_ff: np.ndarray | None = None):
        """Expected information blocks of f and of h."""
        if i_ff is None:
            i_ff = self.inner(h)[1]
        e = np.exp(h)
        return i_ff, 0.5 * e[..., :, None] * e[..., None, :] * i_ff**2


def observed_information(lam, s2, h, f, y) -> np.ndarray:
    """The negative Hessian of one observation's log likelihood in (f, h), 2K x 2K."""
    k = len(h)
    a = lam @ np.diag(np.exp(h)) @ lam.T + np.diag(s2)
    inv = np.linalg.inv(a)
    i_ff, p, e = lam.T @ inv @ lam, lam.T @ inv @ (y - lam @ f), np.exp(h)
    out = np.zeros((2 * k, 2 * k))
    out[:k, :k] = i_ff
    out[:k, k:] = i_ff * (p * e)[None, :]
    out[k:, :k] = out[:k, k:].T
    pair = i_ff * np.outer(p, p) - 0.5 * i_ff**2
    out[k:, k:] = np.outer(e, e) * pair + np.diag(0.5 * e * (np.diag(i_ff) - p**2))
    return out


def mode_gradient(f, h, f_pred, h_pred, omega_f, omega_h, y, lam, s2) -> tuple[np.ndarray, np.ndarray]:
    """Gradient, in f and h, of the negative log posterior that the mode search minimises."""
    obs = _Observation(Batch(lam[None], None, None, None, s2[None], None))
    obs.see(y[None])
    m, i_ff = obs.inner(h[None])
    _, p = obs.value(f[None], h[None], m)
    g_h = 0.5 * np.exp(h) * (np.diagonal(i_ff[0]) - p[0] ** 2)
    return omega_f @ (f - f_pred) - p[0], omega_h @ (h - h_pred) + g_h


def _mode(obs: _Observation, f_pred, h_pred, w_f, w_h):
    """The mode of a step's posterior: descent block by block, which comes near it from anywhere, and Newton steps in both
    blocks, which end on it, in turns until the gradient vanishes. A run that is done stops changing, so that its result
    doesn't depend on the runs it is batched with. A run that is then off a mode, or far from the
    prediction, searches again in short steps, and the better end counts."""
    f, h = f_pred, h_pred
    searching = np.ones(len(h), bool)
    for _ in range(ROUNDS):
        f_new, h_new = _descended(obs, f, h, searching, f_pred, h_pred, w_f, w_h)
        f_new, h_new, slope = _polished(obs, f_new, h_new, f_pred, h_pred, w_f, w_h)
        moved = np.maximum(np.abs(f_new - f), np.abs(h_new - h)).max(-1)
        f, h = np.where(searching[:, None], f_new, f), np.where(searching[:, None], h_new, h)
        searching = searching & (slope >= CLOSE) & (moved > 0)
        if not searching.any():
            break
    off = np.flatnonzero(searching | (np.abs(h - h_pred).max(-1) > FAR))
    if len(off):
        o, fp, hp, wf, wh = obs.of(off), f_pred[off], h_pred[off], w_f[off], w_h[off]
        f_new, h_new, _ = _polished(o, *_stepped(o, fp, hp, wf, wh), fp, hp, wf, wh)
        less = _objective(o, f_new, h_new, fp, hp, wf, wh) < _objective(o, f[off], h[off], fp, hp, wf, wh)
        f[off], h[off] = np.where(less[:, None], f_new, f[off]), np.where(less[:, None], h_new, h[off])
    return f, h


def _objective(obs: _Observation, f, h, f_pred, h_pred, w_f, w_h, m=None) -> np.ndarray:
    """The negative log posterior, but for constants."""
    return -obs.value(f, h, m)[0] + 0.5 * ((f - f_pred) * _mv(w_f, f - f_pred) + (h - h_pred) * _mv(w_h, h - h_pred)).sum(-1)


def _stepped(obs: _Observation, f_pred, h_pred, w_f, w_h):
    """Descent in h alone, f being the best for each h, from the prediction in steps of 1 at most. Where an observation is far
    from its prediction, whole Newton steps for a given f end at log volatilities so high that later ones hardly move."""

    def at(h: np.ndarray):
        m, i_ff = obs.inner(h)
        z = _solved(m, obs.b[..., None])[..., 0]
        f = _solved(i_ff + w_f, (obs.b - _mv(obs.v, z) + _mv(w_f, f_pred))[..., None])[..., 0]
        return f, m, i_ff, _objective(obs, f, h, f_pred, h_pred, w_f, w_h, m)

    h, live = h_pred, np.ones(len(h_pred), bool)
    f, m, i_ff, now = at(h)
    for _ in range(AGAIN):
        v = obs.residual(f)[0]
        p = v - _mv(obs.v, _solved(m, v[..., None])[..., 0])
        gradient = 0.5 * np.exp(h) * (np.diagonal(i_ff, axis1=-2, axis2=-1) - p**2) + _mv(w_h, h - h_pred)
        step = -_solved(obs.information(h, i_ff)[1] + w_h, gradient[..., None])[..., 0]
        live = live & (np.abs(step).max(-1) >= CLOSE)
        step = step / np.maximum(np.abs(step).max(-1, keepdims=True), 1)
        better = np.zeros(len(h), bool)
        for _ in range(12):
            new = np.where((live & ~better)[:, None], np.clip(h + step, -H_MOST, H_MOST), h)
            f_new, m_new, i_new, value = at(new)
            took = live & ~better & (value <= now)
            h, f, now = np.where(took[:, None], new, h), np.where(took[:, None], f_new, f), np.where(took, value, now)
            m, i_ff = (np.where(took[:, None, None], a, b) for a, b in ((m_new, m), (i_new, i_ff)))
            better |= took
            step = step / 2
            if (better | ~live).all():
                break
        live = live & better
        if not live.any():
            break
    return f, h


def _descended(obs: _Observation, f, h, searching, f_pred, h_pred, w_f, w_h):
    """Block coordinate descent: f in closed form for given h, then damped Newton steps in h with the expected information
    as curvature; a step that doesn't improve is halved, and dropped in the end. Only runs that are searching change."""
    for _ in range(SWEEPS):
        f_old, h_old = f, h
        m, i_ff = obs.inner(h)
        z = _solved(m, obs.b[..., None])[..., 0]
        f = _solved(i_ff + w_f, (obs.b - _mv(obs.v, z) + _mv(w_f, f_pred))[..., None])[..., 0]
        f = np.where(searching[:, None], f, f_old)
        v, rr = obs.residual(f)
        live = searching
        for nth in range(NEWTON):
            if nth:
                m, i_ff = obs.inner(h)
            ll, z = obs.fit(v, rr, h, m)
            d = h - h_pred
            wd = _mv(w_h, d)
            now = -ll + 0.5 * (d * wd).sum(-1)
            gradient = 0.5 * np.exp(h) * (np.diagonal(i_ff, axis1=-2, axis2=-1) - (v - _mv(obs.v, z)) ** 2) + wd
            step = -_solved(obs.information(h, i_ff)[1] + w_h, gradient[..., None])[..., 0]
            live = live & (np.abs(step).max(-1) >= CLOSE)
            if not live.any():
                break
            scale = np.ones(len(h))
            for _ in range(12):
                new = np.clip(h + scale[:, None] * step, -H_MOST, H_MOST)
                d = new - h_pred
                value = -obs.fit(v, rr, new)[0] + 0.5 * (d * _mv(w_h, d)).sum(-1)
                worse = live & ~(value <= now + 1e-12)
                if not worse.any():
                    break
                scale = np.where(worse, scale / 2, scale)
            h = np.where((live & ~worse)[:, None], new, h)
            live = live & ~worse
        searching = searching & (np.maximum(np.abs(f - f_old), np.abs(h - h_old)).max(-1) >= CLOSE)
        if not searching.any():
            break
    return f, h


def _polished(obs: _Observation, f, h, f_pred, h_pred, w_f, w_h):
    """Newton steps in f and h at once, with the observed information: where a search block by block nears the mode slowly,
    these end within rounding of it. A run takes a step only if its gradient shrinks, and stops otherwise. Also gives the
    greatest slope that is left."""
    k = h.shape[-1]

    def slopes(f: np.ndarray, h: np.ndarray):
        m, i_ff = obs.inner(h)
        v = obs.residual(f)[0]
        p, e = v - _mv(obs.v, _solved(m, v[..., None])[..., 0]), np.exp(h)
        g_h = _mv(w_h, h - h_pred) + 0.5 * e * (np.diagonal(i_ff, axis1=-2, axis2=-1) - p**2)
        return np.concatenate([_mv(w_f, f - f_pred) - p, g_h], -1), i_ff, p, e

    live = np.ones(len(h), bool)
    g, i_ff, p, e = slopes(f, h)
    for _ in range(POLISH):
        pe = p * e
        both = np.zeros((*h.shape[:-1], 2 * k, 2 * k))
        both[..., :k, :k] = i_ff + w_f
        both[..., :k, k:] = i_ff * pe[..., None, :]
        both[..., k:, :k] = np.swapaxes(both[..., :k, k:], -1, -2)
        curve = i_ff * pe[..., :, None] * pe[..., None, :] - 0.5 * e[..., :, None] * e[..., None, :] * i_ff**2
        both[..., k:, k:] = curve + _diag(0.5 * e * (np.diagonal(i_ff, axis1=-2, axis2=-1) - p**2)) + w_h
        try:
            step = -np.linalg.solve(both, g[..., None])[..., 0]
        except np.linalg.LinAlgError:
            break
        f_new, h_new = f + step[..., :k], np.clip(h + np.clip(step[..., k:], -1, 1), -H_MOST, H_MOST)
        g_new, i_new, p_new, e_new = slopes(f_new, h_new)
        live = live & (np.abs(g_new).max(-1) < np.abs(g).max(-1))
        if not live.any():
            break
        f, h, p, e, g = (np.where(live[:, None], a, b) for a, b in ((f_new, f), (h_new, h), (p_new, p), (e_new, e), (g_new, g)))
        i_ff = np.where(live[:, None, None], i_new, i_ff)
    return f, h, np.abs(g).max(-1)


def _followed(obs: _Observation, f, h, f_pred, h_pred, w_f, w_h, steps: int = 2):
    """Newton steps towards the mode, none refused: from a mode of real parameters, the first gives the mode's tangents of
    complex ones exactly, by the implicit function theorem; a second takes off what the mode was short of."""
    k = h.shape[-1]
    for _ in range(steps):
        m, i_ff = obs.inner(h)
        v = obs.residual(f)[0]
        p, e = v - _mv(obs.v, _solved(m, v[..., None])[..., 0]), np.exp(h)
        pe = p * e
        i_diag = np.diagonal(i_ff, axis1=-2, axis2=-1)
        g = np.concatenate([_mv(w_f, f - f_pred) - p, _mv(w_h, h - h_pred) + 0.5 * e * (i_diag - p**2)], -1)
        cross = i_ff * pe[..., None, :]
        curve = i_ff * pe[..., :, None] * pe[..., None, :] - 0.5 * e[..., :, None] * e[..., None, :] * i_ff**2
        both = np.concatenate([
            np.concatenate([i_ff + w_f, cross], -1),
            np.concatenate([np.swapaxes(cross, -1, -2), curve + _diag(0.5 * e * (i_diag - p**2)) + w_h], -1)], -2)
        step = np.linalg.solve(both, g[..., None])[..., 0]
        f, h = f - step[..., :k], h - step[..., k:]
    return f, h


TANGENT = 1e-20  #: how far parameters are moved into the complex plane: far below rounding, so that tangents are exact


def score(b: Batch, y: np.ndarray, kind: str = BIF, points: int = 1, modes: np.ndarray | None = None) -> np.ndarray:
    """The exact slopes of one panel's log likelihood, y (T, N), as (points, directions). b: for each point as many sets of
    parameters as directions, equal in their real parts, each with its direction times TANGENT for its imaginary part. One
    real run a point finds the modes (points, T, 2K), unless they are given; the recursion then carries all tangents at once,
    and needs no search."""
    each = len(b.mu) // points
    if modes is None:
        real = Batch(*[np.ascontiguousarray(x[::each].real) for x in (b.lam, b.phi_f, b.phi_h, b.mu, b.s2, b.q_h)])
        modes = run_filter(real, np.broadcast_to(y, (points, *y.shape)), kind).alpha
    tangents = run_filter(b, np.broadcast_to(y, (len(b.mu), *y.shape)), kind, modes=np.repeat(modes, each, 0))
    return tangents.loglik.imag.sum(-1).reshape(points, each) / TANGENT


def run_filter(
    b: Batch, y: np.ndarray, kind: str = BIF, predict_first: bool = True, init_factor_var: float | None = None, modes: np.ndarray | None = None
) -> Filtered:
    """Filters R runs, y (R, T, N). BIF carries information, BF covariances; both use the same update. The first update
    sees a predicted state, or the initial one without predict_first. init_factor_var: 1 for BIF, 1e6 for BF, unless given.
    modes (R, T, 2K), those of the parameters' real parts, are followed instead of sought, as score() does."""
    r, k = len(y), b.mu.shape[-1]
    if kind not in (BIF, BF):
        raise ValueError(f"no such filter: {kind}")
    var = init_factor_var if init_factor_var is not None else (1.0 if kind == BIF else 1e6)
    p_f, p_h = np.broadcast_to(_eye(k, var), (r, k, k)), lyapunov(b.phi_h, b.q_h)
    w_f, w_h = _inv(p_f + _eye(k, 1e-6)), _inv(p_h + _eye(k, 1e-6))
    return run_filter_from(b, y, np.zeros((r, k)), b.mu.copy(), w_f, w_h, kind, predict_first, modes)


def run_filter_from(
    b: Batch, y: np.ndarray, f: np.ndarray, h: np.ndarray, w_f: np.ndarray, w_h: np.ndarray, kind: str = BIF, predict_first: bool = True,
    modes: np.ndarray | None = None,
) -> Filtered:
    """The recursion from a given state (f, h) with information blocks w_f and w_h."""
    r, t_all, _ = y.shape
    k = b.mu.shape[-1]
    p_f, p_h = _inv(w_f), _inv(w_h)
    obs = _Observation(b)
    number = np.result_type(b.lam, b.mu, b.s2, b.phi_f, b.phi_h, b.q_h)
    alpha, ll = np.empty((r, t_all, 2 * k), number), np.empty((r, t_all), number)
    cov_f, cov_h, clamped = np.empty((r, t_all, k, k), number), np.empty((r, t_all, k, k), number), np.zeros(r, bool)
    tr = lambda x: np.swapaxes(x, -1, -2)
    q_inv = np.linalg.inv(b.q_h + _eye(k, 1e-8))
    for t in range(t_all):
        if t or predict_first:
            f, h = _mv(b.phi_f, f), b.mu + _mv(b.phi_h, h - b.mu)
            clamped |= (np.abs(h) > H_MOST).any(-1)
            h = _held(h)
            if kind == BIF:
                i_f = _diag(np.exp(-h) + 1e-8)
                w_f = i_f - i_f @ b.phi_f @ _solved(w_f + tr(b.phi_f) @ i_f @ b.phi_f, tr(b.phi_f) @ i_f)
                w_h = q_inv - q_inv @ b.phi_h @ _solved(w_h + tr(b.phi_h) @ q_inv @ b.phi_h, tr(b.phi_h) @ q_inv)
                w_f, w_h = (w_f + tr(w_f)) / 2, (w_h + tr(w_h)) / 2
            else:
                p_f = b.phi_f @ p_f @ tr(b.phi_f) + _diag(np.exp(h))
                p_h = b.phi_h @ p_h @ tr(b.phi_h) + b.q_h
        if kind == BF:
            w_f, w_h = _inv((p_f + tr(p_f)) / 2 + _eye(k, 1e-8)), _inv((p_h + tr(p_h)) / 2 + _eye(k, 1e-8))
        obs.see(y[:, t])
        if modes is None:
            f_new, h_new = _mode(obs, f, h, w_f, w_h)
        else:
            f_new, h_new = _followed(obs, modes[:, t, :k], modes[:, t, k:], f, h, w_f, w_h)
        m, i_ff = obs.inner(h_new)
        fit = obs.value(f_new, h_new, m)[0]
        j_f, j_h = obs.information(h_new, i_ff)
        u_f, u_h = w_f + j_f + _eye(k, 1e-6), w_h + j_h + _eye(k, 1e-6)
        penalty = sum(
            0.5 * (_logdet(u + _eye(k, 1e-8)) - _logdet(w + _eye(k, 1e-8)) + (d * _mv(w, d)).sum(-1))
            for u, w, d in ((u_f, w_f, f_new - f), (u_h, w_h, h_new - h))
        )
        ll[:, t] = fit - penalty
        f, h, w_f, w_h = f_new, h_new, u_f, u_h
        p_f, p_h = _inv(w_f), _inv(w_h)
        alpha[:, t, :k], alpha[:, t, k:], cov_f[:, t], cov_h[:, t] = f, h, p_f, p_h
    return Filtered(alpha, cov_f, cov_h, ll, clamped)


def total(ll: np.ndarray) -> np.ndarray:
    """Each run's log likelihood; NaN, infinite and absurd ones are -inf."""
    s = ll.sum(-1)
    return np.where(np.isfinite(s) & (np.abs(s) < 1e10), s, -np.inf)


def constant(N: int, T: int) -> float:
    """What log likelihoods here leave out."""
    return -0.5 * N * T * np.log(2 * np.pi)


@dataclass(frozen=True)
class Smoothed:
    """alpha (R, T, 2K), cov_f and cov_h (R, T, K, K), and lag-one covariances, (R, T - 1, K, K) each."""

    alpha: np.ndarray
    cov_f: np.ndarray
    cov_h: np.ndarray
    lag_f: np.ndarray
    lag_h: np.ndarray


def smooth(b: Batch, x: Filtered) -> Smoothed:
    """Rauch-Tung-Striebel, backward from the last filtered state. One observation is smoothed as it is filtered."""
    k, t_all = b.mu.shape[-1], x.alpha.shape[1]
    if t_all == 0:
        raise RuntimeError("nothing was filtered")
    alpha, c_f, c_h = x.alpha.copy(), x.cov_f.copy(), x.cov_h.copy()
    lag_f, lag_h = np.empty((len(alpha), t_all - 1, k, k)), np.empty((len(alpha), t_all - 1, k, k))
    tr = lambda a: np.swapaxes(a, -1, -2)
    for t in range(t_all - 2, -1, -1):
        f, h = x.alpha[:, t, :k], x.alpha[:, t, k:]
        h_pred = np.clip(b.mu + _mv(b.phi_h, h - b.mu), -H_MOST, H_MOST)
        for part, phi, cov, out, lag, pred, noise in (
            (slice(0, k), b.phi_f, x.cov_f, c_f, lag_f, _mv(b.phi_f, f), _diag(np.exp(h_pred))),
            (slice(k, 2 * k), b.phi_h, x.cov_h, c_h, lag_h, h_pred, b.q_h),
        ):
            p = phi @ cov[:, t] @ tr(phi) + noise
            gain = cov[:, t] @ tr(phi) @ np.linalg.pinv(p)
            alpha[:, t, part] = x.alpha[:, t, part] + _mv(gain, alpha[:, t + 1, part] - pred)
            c = cov[:, t] + gain @ (out[:, t + 1] - p) @ tr(gain)
            lag[:, t] = out[:, t + 1] @ tr(gain)
            out[:, t] = (c + tr(c)) / 2
    return Smoothed(alpha, c_f, c_h, lag_f, lag_h)


def full(cov_f: np.ndarray, cov_h: np.ndarray) -> np.ndarray:
    """Blocks as one (..., 2K, 2K) matrix."""
    k = cov_f.shape[-1]
    out = np.zeros((*cov_f.shape[:-2], 2 * k, 2 * k))
    out[..., :k, :k], out[..., k:, k:] = cov_f, cov_h
    return out
