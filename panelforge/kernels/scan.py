"""Linear Gaussian filtering and smoothing as associative scans.

A step of the recursion is an element; two neighbouring runs of steps combine into one element, whatever comes before them.
So a run's steps reduce block by block, and each block is finished alone once it knows the state before it. Elements are
batched: arrays lead with the step. Filtering elements are (A, b, C, eta, J), smoothing elements (E, g, L).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Element = tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Linear:
    """x' = phi x + w, w ~ N(0, q); y = lam x + e, e ~ N(0, diag(s2)). The first step predicts from N(0, 1)."""

    lam: np.ndarray
    phi: np.ndarray
    q: np.ndarray
    s2: np.ndarray

    @staticmethod
    def of(lam, phi, q, s2) -> Linear:
        return Linear(*[np.atleast_2d(np.asarray(x, float)) for x in (lam, phi, q)], np.atleast_1d(np.asarray(s2, float)))

    @property
    def k(self) -> int:
        return len(self.phi)


def _t(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def _mv(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (a @ x[..., None])[..., 0]


def filtering_elements(m: Linear, y: np.ndarray) -> Element:
    """One element a row of y (T, N); a row with a NaN is a step without an observation."""
    k, n = m.k, len(y)
    seen = np.isfinite(y).all(1)
    y = np.where(seen[:, None], y, 0.0)
    s = m.lam @ m.q @ m.lam.T + np.diag(m.s2)
    gain = np.linalg.solve(s, m.lam @ m.q).T
    keep = np.eye(k) - gain @ m.lam
    back = np.linalg.solve(s, m.lam @ m.phi).T  # phi' lam' S^-1
    pick = seen[:, None, None]
    return (
        np.where(pick, keep @ m.phi, m.phi), y @ gain.T, np.where(pick, keep @ m.q, m.q), y @ back.T,
        np.where(pick, back @ m.lam @ m.phi, np.zeros((n, k, k))),
    )


def combine_filtering(x: Element, y: Element) -> Element:
    """x then y."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = x, y
    eye = np.eye(a1.shape[-1])
    left = _t(np.linalg.solve(_t(eye + c1 @ j2), _t(a2)))  # A2 (I + C1 J2)^-1
    right = _t(np.linalg.solve(eye + c1 @ j2, a1))  # A1' (I + J2 C1)^-1
    return left @ a1, _mv(left, b1 + _mv(c1, e2)) + b2, left @ c1 @ _t(a2) + c2, _mv(right, e2 - _mv(j2, b1)) + e1, right @ j2 @ a1 + j1


def combine_smoothing(x: Element, y: Element) -> Element:
    """Two runs of backward steps: x first, that is the later one in time; then y."""
    (e1, g1, l1), (e2, g2, l2) = x, y
    return e2 @ e1, _mv(e2, g1) + g2, e2 @ l1 @ _t(e2) + l2


def prefix(e: Element, combine) -> Element:
    """All running combinations of elements, by pairs: as many combinations as twice the elements, in few batches."""
    n = len(e[0])
    if n == 1:
        return e
    m = n // 2
    pairs = prefix(combine(tuple(x[0 : 2 * m : 2] for x in e), tuple(x[1 : 2 * m : 2] for x in e)), combine)
    out = tuple(np.empty_like(x) for x in e)
    rest = combine(tuple(x[: (n - 1) // 2] for x in pairs), tuple(x[2::2] for x in e)) if n > 2 else tuple(x[:0] for x in e)
    for o, first, p, r in zip(out, e, pairs, rest):
        o[0], o[1::2], o[2::2] = first[0], p, r
    return out


def reduced(e: Element, combine) -> Element:
    """All elements as one, by pairs."""
    while len(e[0]) > 1:
        m = len(e[0]) // 2
        pairs = combine(tuple(x[0 : 2 * m : 2] for x in e), tuple(x[1 : 2 * m : 2] for x in e))
        e = tuple(np.concatenate([p, x[2 * m :]]) for p, x in zip(pairs, e))
    return e


def of_state(x: np.ndarray, p: np.ndarray) -> Element:
    """A known state as a filtering element, to be combined with what follows it."""
    k = len(x)
    return tuple(v[None] for v in (np.zeros((k, k)), x, p, np.zeros(k), np.zeros((k, k))))


def filtered(m: Linear, y: np.ndarray, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states, covs, log likelihoods) of the steps that follow the state (x, p)."""
    own = prefix(tuple(np.concatenate(v) for v in zip(of_state(x, p), filtering_elements(m, y))), combine_filtering)
    states, covs = own[1], own[2]
    ahead, spread = states[:-1] @ m.phi.T, m.phi @ covs[:-1] @ m.phi.T + m.q
    s = m.lam @ spread @ m.lam.T + np.diag(m.s2)
    e = y - ahead @ m.lam.T
    ll = -0.5 * (y.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(s)[1] + (e * np.linalg.solve(s, np.nan_to_num(e)[..., None])[..., 0]).sum(-1))
    return states[1:], (covs[1:] + _t(covs[1:])) / 2, np.where(np.isfinite(e).all(1), ll, 0.0)


def smoothing_elements(m: Linear, states: np.ndarray, covs: np.ndarray, last: bool) -> Element:
    """One element a step, in the order of time: from the smoothed state after it to its own. last: the last one has none
    after it, and is smoothed as it is filtered."""
    ahead = m.phi @ covs @ m.phi.T + m.q
    e = _t(np.linalg.solve(ahead, m.phi @ covs))
    g, spread = states - _mv(e, states @ m.phi.T), covs - e @ m.phi @ covs
    if last:
        e, g, spread = e.copy(), g.copy(), spread.copy()
        e[-1], g[-1], spread[-1] = 0, states[-1], covs[-1]
    return e, g, spread
