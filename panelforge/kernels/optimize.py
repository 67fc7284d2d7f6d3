"""Learning-rate schedules, optimizers by name, and the fitting loop."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from . import likelihoods
from .filters import BF, BIF
from .params import FIELDS, Params, flatten, identified, sound, transform, unflatten, untransform

SCHEDULES = ("cosine", "exponential", "linear", "warmup_cosine", "constant", "cyclic", "step_decay", "one_cycle")


def schedule(
    kind: str = "cosine", init_lr: float = 1e-3, decay_steps: int = 1000, min_lr: float = 1e-6, warmup_steps: int = 0, cycle_period: int = 100,
    step_size_factor: float = 0.5, step_interval: int = 100, peak_lr: float | None = None,
) -> Callable[[int], float]:
    """The learning rate of each step. peak_lr is ten times init_lr unless given."""
    peak = 10 * init_lr if peak_lr is None else peak_lr

    def cosine(step: float, top: float, over: float) -> float:
        part = min(max(step / max(over, 1), 0.0), 1.0)
        return min_lr + (top - min_lr) * 0.5 * (1 + math.cos(math.pi * part))

    def line(step: float, a: float, b: float, over: float) -> float:
        return a + (b - a) * min(max(step / max(over, 1), 0.0), 1.0)

    half = decay_steps // 2
    kinds: dict[str, Callable[[int], float]] = {
        "cosine": lambda s: cosine(s, init_lr, decay_steps),
        "exponential": lambda s: max(min_lr, init_lr * 0.9 ** (s / max(decay_steps // 10, 1))),
        "linear": lambda s: line(s, init_lr, min_lr, decay_steps),
        "warmup_cosine": lambda s: line(s, init_lr, peak, warmup_steps) if s < warmup_steps else cosine(s - warmup_steps, peak, decay_steps - warmup_steps),
        "constant": lambda s: init_lr,
        "cyclic": lambda s: min_lr + (init_lr - min_lr) * max(0.0, 1 - abs(s / cycle_period - 2 * math.floor(1 + s / (2 * cycle_period)) + 1)),
        "step_decay": lambda s: max(min_lr, init_lr * step_size_factor ** (s // step_interval)),
        "one_cycle": lambda s: line(s, init_lr, peak, half) if s < half else cosine(s - half, peak, half),
    }
    if kind not in kinds:
        raise ValueError(f"no such schedule: {kind}")
    return kinds[kind]


#: Second-order methods search along a direction; the others step by a rule of the gradient's history.
LINE_SEARCH = ("BFGS", "NonlinearCG", "DogLegBFGS", "ArmijoBFGS", "DampedTrustRegionBFGS", "IndirectTrustRegionBFGS", "GradientDescent")
RULES = ("Adam", "AdamW", "SGD", "RMSProp", "Adagrad", "Adadelta", "Adafactor", "Lion")
OPTIMIZERS = LINE_SEARCH + RULES
DEFAULT_OPTIMIZER = {"PF": "ArmijoBFGS", "BIF": "DampedTrustRegionBFGS", "BF": "DampedTrustRegionBFGS"}
CONFIG = {
    "BFGS": {"use_inverse": False}, "Adam": {"b1": 0.9, "b2": 0.999, "eps": 1e-8}, "AdamW": {"b1": 0.9, "b2": 0.999, "eps": 1e-8, "weight_decay": 1e-4},
    "SGD": {"momentum": 0.9, "nesterov": True}, "RMSProp": {"decay": 0.9, "eps": 1e-8}, "Adagrad": {"eps": 1e-8}, "Adadelta": {"rho": 0.9, "eps": 1e-8},
    "Adafactor": {"decay": 0.8, "eps": 1e-30}, "Lion": {"b1": 0.9, "b2": 0.99},
}


def config(name: str, learning_rate: float = 1e-3, rtol: float = 1e-5, atol: float = 1e-5) -> dict:
    if name not in OPTIMIZERS:
        raise ValueError(f"no such optimizer: {name}; there are {', '.join(OPTIMIZERS)}")
    return {"learning_rate": learning_rate, "rtol": rtol, "atol": atol} | CONFIG.get(name, {})


class Rule:
    """One step rule: gradient and learning rate in, change of the point out."""

    def __init__(self, name: str) -> None:
        self.name, self.c, self.n, self.m, self.v = name, CONFIG[name], 0, 0.0, 0.0

    def step(self, x: np.ndarray, g: np.ndarray, lr: float) -> np.ndarray:
        c, name = self.c, self.name
        self.n += 1
        if name in ("Adam", "AdamW"):
            self.m = c["b1"] * self.m + (1 - c["b1"]) * g
            self.v = c["b2"] * self.v + (1 - c["b2"]) * g * g
            d = self.m / (1 - c["b1"] ** self.n) / (np.sqrt(self.v / (1 - c["b2"] ** self.n)) + c["eps"])
            return -lr * (d + c.get("weight_decay", 0.0) * x)
        if name == "SGD":
            self.m = c["momentum"] * self.m + g
            return -lr * (g + c["momentum"] * self.m if c["nesterov"] else self.m)
        if name == "RMSProp":
            self.v = c["decay"] * self.v + (1 - c["decay"]) * g * g
            return -lr * g / (np.sqrt(self.v) + c["eps"])
        if name == "Adagrad":
            self.v = self.v + g * g
            return -lr * g / (np.sqrt(self.v) + c["eps"])
        if name == "Adadelta":
            self.v = c["rho"] * self.v + (1 - c["rho"]) * g * g
            d = -np.sqrt((self.m + c["eps"]) / (self.v + c["eps"])) * g
            self.m = c["rho"] * self.m + (1 - c["rho"]) * d * d
            return lr * d
        if name == "Adafactor":
            decay = 1 - self.n ** -c["decay"]
            self.v = decay * self.v + (1 - decay) * (g * g + c["eps"])
            d = g / np.sqrt(self.v)
            return -lr * d / max(1.0, float(np.sqrt(np.mean(d * d))))
        d = np.sign(c["b1"] * self.m + (1 - c["b1"]) * g)  # Lion
        self.m = c["b2"] * self.m + (1 - c["b2"]) * g
        return -lr * d


@dataclass
class Minimum:
    x: np.ndarray
    value: float
    steps: int
    success: bool
    code: str
    message: str = ""
    losses: list[float] = field(default_factory=list)
    points: list[np.ndarray] = field(default_factory=list)


def central(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, h: float = 1e-5) -> np.ndarray:
    """The gradient by central differences; f takes many points, one a row, and is called once. Where a value is that of an
    unstable point, beyond the gate, the step is shrunk until one side is within, and that side alone is used."""
    steps = h * np.maximum(1, np.abs(x))
    both = f(np.vstack([x + np.diag(steps), x - np.diag(steps)]))
    up, down = both[: len(x)], both[len(x) :]
    out = (up - down) / (2 * steps)
    beyond = np.flatnonzero((up >= likelihoods.UNSTABLE) | (down >= likelihoods.UNSTABLE))
    if not len(beyond):
        return out
    here = float(f(x[None])[0])
    if here >= likelihoods.UNSTABLE:
        return out
    for i in beyond:
        e, step, ends = np.eye(len(x))[i], steps[i], (up[i], down[i])
        for _ in range(8):
            if min(ends) < likelihoods.UNSTABLE:
                break
            step /= 8
            ends = f(np.vstack([x + step * e, x - step * e]))
        sides = [s * (v - here) / step for s, v in zip((1, -1), ends) if v < likelihoods.UNSTABLE]
        out[i] = float(np.mean(sides)) if sides else 0.0
    return out


def within(feasible: Callable[[np.ndarray], bool], x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d, cut so that x + d is feasible: numbers whose own change would leave the region stop short of its edge, the others
    take their whole step; if that leaves it yet, all of it is halved."""
    if feasible(x + d):
        return d
    d = d.copy()
    for i in np.flatnonzero(d):
        e = np.eye(len(x))[i]
        for _ in range(60):
            if feasible(x + d[i] * e):
                break
            d[i] /= 2
        else:
            d[i] = 0.0
    for _ in range(60):
        if feasible(x + d):
            return d
        d = d / 2
    return np.zeros_like(d)


#: Trust regions: the step of a model within a radius, by name.
TRUST_REGIONS = ("DogLegBFGS", "DampedTrustRegionBFGS", "IndirectTrustRegionBFGS")


def trust_step(name: str, g: np.ndarray, hessian: np.ndarray, radius: float) -> np.ndarray:
    """A step of the quadratic model within radius. DogLegBFGS: along the gradient to the model's least value there, then
    towards the Newton point. DampedTrustRegionBFGS: the Newton step of the Hessian with 1 / radius on its diagonal, cut to
    the radius. IndirectTrustRegionBFGS: the model's minimum within the radius, its damping found by bisection."""
    values, vectors = np.linalg.eigh((hessian + hessian.T) / 2)
    values, slope = np.maximum(values, 1e-12), vectors.T @ g

    def damped(x: float) -> np.ndarray:
        return -vectors @ (slope / (values + x))

    newton = damped(0.0)
    if name == "DampedTrustRegionBFGS":
        step = damped(1 / radius)
        return step * min(1.0, radius / max(np.linalg.norm(step), 1e-300))
    if np.linalg.norm(newton) <= radius:
        return newton
    if name == "IndirectTrustRegionBFGS":
        low, high = 0.0, np.linalg.norm(g) / radius
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.linalg.norm(damped(mid)) > radius else (low, mid)
        return damped(high)
    cauchy = -g * (g @ g) / max(g @ hessian @ g, 1e-300)
    if np.linalg.norm(cauchy) >= radius:
        return -g * radius / np.linalg.norm(g)
    leg = newton - cauchy
    a, b, c = leg @ leg, 2 * cauchy @ leg, cauchy @ cauchy - radius**2
    return cauchy + leg * (-b + math.sqrt(max(b * b - 4 * a * c, 0.0))) / (2 * a)


def _bfgs(hessian: np.ndarray, s: np.ndarray, y: np.ndarray, damped: bool) -> np.ndarray:
    """The updated Hessian; left alone where the curvature isn't positive, unless damped in Powell's way."""
    q = hessian @ s
    sq, sy = float(s @ q), float(s @ y)
    if damped and sy < 0.2 * sq:
        theta = 0.8 * sq / max(sq - sy, 1e-300)
        y, sy = theta * y + (1 - theta) * q, 0.2 * sq
    if sy <= 1e-12 or sq <= 1e-300:
        return hessian
    return hessian + np.outer(y, y) / sy - np.outer(q, q) / sq


def minimize(
    f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, name: str = "BFGS", gradient: Callable[[np.ndarray], np.ndarray] | None = None,
    max_steps: int = 100, rate: Callable[[int], float] | float = 1e-2, rtol: float = 1e-5, atol: float = 1e-5, log: bool = False,
    feasible: Callable[[np.ndarray], bool] | None = None, curvature: Callable[[np.ndarray], np.ndarray] | None = None,
) -> Minimum:
    """Minimises f, which takes points as rows of a matrix. The best point seen is returned.

    BFGS and ArmijoBFGS are two names of one method, quasi-Newton steps with a backtracking search for Armijo's condition.
    Success is a step within the tolerances, in the point and in the value, or that none would gain more than them; reaching
    max_steps isn't, nor is a search without a better point (line_search_failed) or a vanished radius (radius_vanished). What f raises
    ends the run without success, and is said in `message`. Steps stop short of the edge of what is feasible, if that is given.
    curvature gives a Hessian to start with, and a fresh one where a search ends with a slope left: it goes on from there, and
    a radius counts as vanished only if it does so again.
    """
    if name not in OPTIMIZERS:
        raise ValueError(f"no such optimizer: {name}; there are {', '.join(OPTIMIZERS)}")
    slope = gradient or (lambda v: central(f, v))
    inside = (lambda v, d: within(feasible, v, d)) if feasible else (lambda v, d: d)
    lr = rate if callable(rate) else (lambda _: rate)
    x = np.asarray(x, float)
    best = Minimum(x, np.inf, 0, False, "max_steps_reached")

    def capped(g: np.ndarray) -> np.ndarray:
        """Gradients of rules have norm 1 at most; a gradient beyond 1e10 anywhere is cut first."""
        g = np.clip(g, -1e10, 1e10)
        return g * min(1.0, 1.0 / max(float(np.linalg.norm(g)), 1e-300))

    def searched(d: np.ndarray) -> tuple[np.ndarray, float] | None:
        """The first halving of d that meets Armijo's condition; all are evaluated in two calls."""
        scales, trial = 0.5 ** np.arange(30), np.zeros(0)
        for upto in (6, 30):
            trial = np.r_[trial, f(x + scales[len(trial) : upto, None] * d)]
            ok = np.flatnonzero(trial <= value + 1e-4 * scales[:upto] * (g @ d))
            if len(ok):
                return x + scales[ok[0]] * d, float(trial[ok[0]])
        return None

    def least(d: np.ndarray) -> tuple[np.ndarray, float] | None:
        """Nearly the least value along d, which conjugate directions need: the best of halvings and doublings, then of a
        grid around it, twice."""
        scales = 2.0 ** np.arange(4, -30, -1)
        for _ in range(3):
            trial = f(x + scales[:, None] * d)
            at = int(np.nanargmin(trial))
            if trial[at] > value + 1e-4 * scales[at] * (g @ d):
                return None
            best_scale, best_value = scales[at], float(trial[at])
            wide = scales[max(at - 1, 0)], scales[min(at + 1, len(scales) - 1)]
            scales = np.unique(np.r_[np.linspace(*wide, 16), best_scale])
        return x + best_scale * d, best_value

    try:
        value, g = float(f(x[None])[0]), slope(x)
        best.x, best.value = x, value
        if not np.isfinite(value):
            best.code, best.message = "nonfinite", "the start has no finite value"
            return best
        rule, n = (Rule(name) if name in RULES else None), len(x)
        second = name in TRUST_REGIONS or name in ("BFGS", "ArmijoBFGS")
        bend = curvature if second and curvature else lambda _: np.eye(n)
        hessian, direction, radius, skipped, since, ended_well = bend(x), -g, 1.0, 0, np.inf, False

        def renewed(well: bool = False) -> bool:
            """Whether a search that would end here, well or not, goes on with a fresh Hessian: it has a slope left, and gained
            since the last one."""
            nonlocal hessian, radius, since, ended_well
            worth = 0.5 * float(g @ np.linalg.solve(hessian, g)) if np.isfinite(g).all() else 0.0
            gained = since - value > rtol * (1 + abs(value))
            ended_well = well or ended_well and not gained
            if not second or well and not curvature or not gained or np.abs(g).max() <= atol and worth <= atol:
                return False
            hessian, radius, since = bend(x), 1.0, value
            return True

        for step in range(max_steps):
            best.steps = step + 1
            if log:
                best.losses.append(value)
                best.points.append(x)
            if not np.isfinite(g).all():
                skipped += 1
                if skipped > 10:
                    best.code, best.message = "nonfinite", "too many gradients that aren't finite"
                    break
                g = np.nan_to_num(g, nan=0.0, posinf=0.0, neginf=0.0)
            if not rule and np.abs(g).max() <= atol * 1e-2:
                best.success, best.code = True, "successful"
                break
            moved = True
            if rule:
                new = x + inside(x, rule.step(x, capped(g), lr(step)))
                new_value = float(f(new[None])[0])
            elif name in TRUST_REGIONS:
                d = inside(x, trust_step(name, g, hessian, radius))
                new, promised = x + d, -(g @ d + 0.5 * d @ hessian @ d)
                new_value = float(f(new[None])[0])
                ratio = (value - new_value) / max(promised, 1e-300) if np.isfinite(new_value) else -1.0
                if ratio < 0.25:
                    radius = 0.25 * min(radius, float(np.linalg.norm(d)))
                elif ratio > 0.75 and np.linalg.norm(d) > 0.8 * radius or name.startswith("Damped") and ratio > 0.75:
                    radius = min(2 * radius, 1e6)
                moved = ratio > 1e-4
                if radius < 1e-14 and renewed():
                    continue
                if radius < 1e-14:
                    best.success = ended_well or promised <= atol + rtol * abs(value)
                    best.code = "successful" if best.success else "radius_vanished"
                    break
            else:
                if name == "GradientDescent":
                    d = -g / max(1.0, float(np.linalg.norm(g)))
                elif name == "NonlinearCG":
                    d = direction if direction @ g < 0 else -g
                else:
                    d = -np.linalg.solve(hessian, g)
                    d = d if d @ g < 0 else -g
                short = inside(x, d)
                d = short if short @ g < 0 else d
                found = least(d) if name == "NonlinearCG" else searched(d)
                if found is None and abs(g @ d) <= atol + rtol * abs(value):  # nothing worth a step is left
                    if renewed(True):
                        continue
                    best.success, best.code = True, "successful"
                    break
                if found is None and not np.array_equal(d, -g):  # once more from the gradient alone
                    hessian, direction = np.eye(n), -g
                    found = searched(-g)
                if found is None and renewed():
                    continue
                if found is None and ended_well:
                    best.success, best.code = True, "successful"
                    break
                if found is None:
                    best.code, best.message = "line_search_failed", "no step along the direction improves the value"
                    break
                new, new_value = found
            new_g = slope(new) if moved or name in TRUST_REGIONS and np.isfinite(new_value) else g
            if name == "NonlinearCG":
                beta = max(0.0, float(new_g @ (new_g - g) / max(g @ g, 1e-300)))
                direction = -new_g + beta * direction if (step + 1) % max(n, 2) else -new_g
            elif not rule and name != "GradientDescent" and np.isfinite(new_g).all():
                hessian = _bfgs(hessian, new - x, new_g - g, name.startswith("Damped"))
            if not moved:
                continue
            near = np.abs(new - x).max() <= atol + rtol * np.abs(new).max()
            done = near and abs(new_value - value) <= atol + rtol * abs(new_value)
            x, value, g = new, new_value, new_g
            if value < best.value:
                best.x, best.value = x, value
            if done and not (rule and step < 5) and not renewed(True):
                best.success, best.code = True, "successful"
                break
    except Exception as e:
        best.success, best.code, best.message = False, "error", f"{type(e).__name__}: {e}"
    return best


LEAST_SHARE = 1e-4  #: of a series' variance, at least, that a fit leaves to its own noise, unless it starts below
CURVED = 40  #: free numbers up to which fits take Hessians from differences of exact gradients


def _slope(x: np.ndarray, ways: tuple, seen: dict) -> np.ndarray:
    """The exact gradient; the filter's modes are known where the value was worked out last."""
    slopes, build, *rest = ways
    return slopes(build, x[None], *rest, modes=seen["modes"] if seen.get("at") == x.tobytes() else None)[0]


def _curvature(x: np.ndarray, ways: tuple) -> np.ndarray:
    """The Hessian by central differences of exact gradients, all points at once, made positive: eigenvalues by their sizes."""
    slopes, build, *rest = ways
    steps = 1e-4 * np.maximum(1, np.abs(x))
    g = slopes(build, np.vstack([x + np.diag(steps), x - np.diag(steps)]), *rest)
    hessian = (g[: len(x)] - g[len(x) :]) / (2 * steps[:, None])
    if not np.isfinite(hessian).all():
        return np.eye(len(x))
    values, vectors = np.linalg.eigh((hessian + hessian.T) / 2)
    sizes = np.maximum(np.abs(values), 1e-6 * max(np.abs(values).max(), 1e-6))
    return (vectors * sizes) @ vectors.T


@dataclass
class Fit:
    filter_type: str
    optimizer_name: str
    uses_transformations: bool
    fix_mu: bool
    prior_config_name: str
    success: bool
    result_code: str
    final_loss: float
    steps: int
    time_taken: float
    error_message: str
    final_params: Params
    loss_history: list[float]
    param_history: list[Params]


def fit(
    y: np.ndarray, start: Params, kind: str = "BIF", optimizer: str | None = None, transformed: bool = True, fix_mu: bool = False, true_mu=None,
    priors: dict | None = None, stability_weight: float = 1000.0, max_steps: int = 50, learning_rate: Callable[[int], float] | float = 1e-2,
    free: tuple[str, ...] = FIELDS, log: bool = False, evaluate=None, gradients=None, **options,
) -> Fit:
    """Estimates parameters on one panel y (T, N). fix_mu holds mu at true_mu, which it needs. evaluate, if given, works
    out the objective for many candidates, (list of Params) -> values, and gradients its exact slopes, as likelihoods.slopes() does;
    both may do so on a cluster. Mode filters' fits take exact slopes, and Hessians by their differences."""
    name = optimizer or DEFAULT_OPTIMIZER.get(kind)
    if name is None:
        raise ValueError(f"no such filter: {kind}")
    if fix_mu and true_mu is None:
        raise ValueError("fix_mu needs true_mu")
    free = tuple(f for f in free if not (fix_mu and f == "mu"))
    start = identified(start.replace(mu=np.asarray(true_mu, float)) if fix_mu else start)
    began, base = time.perf_counter(), transform(start) if transformed else start
    back = (lambda p: identified(untransform(p))) if transformed else identified
    fixed = np.asarray(true_mu, float) if fix_mu else None

    exact, seen = evaluate is None and kind in (BIF, BF), {}

    def values(points: np.ndarray) -> np.ndarray:
        candidates = [unflatten(v, base, free) for v in points]
        if evaluate is not None:
            return np.asarray(evaluate([back(c) for c in candidates]), float)
        seen.clear()
        more = {"seen": seen} if exact and len(points) == 1 else {}
        out = likelihoods.objectives(candidates, y, kind, priors, stability_weight, transformed, fixed, **options, **more)
        if seen:
            seen["at"] = points[0].tobytes()  # where a gradient is asked for next, as a rule
        return out

    def build(v: np.ndarray) -> Params:
        p = back(unflatten(v, base, free))
        return p if fixed is None else p.replace(mu=fixed)

    floor = np.minimum(LEAST_SHARE * y.var(0), start.sigma2) if y.ndim == 2 and y.shape[1] == start.N else 0.0

    def feasible(v: np.ndarray) -> bool:
        if not np.isfinite(v).all():
            return False
        p = build(v)
        # without these bounds the likelihood has none: a series that a factor fits exactly, or volatilities beyond any data
        bounded = (p.sigma2 >= floor).all() and (np.abs(p.mu) <= 30).all() and (np.diag(p.Q_h) <= 100).all()
        return bool(bounded) and likelihoods.instability(p) == 0

    wrong = sound(start) + ([] if np.isfinite(y).all() and y.ndim == 2 and y.shape[1] == start.N else ["the observations aren't a finite (T, N) array"])
    if wrong:
        got = Minimum(flatten(base, free), math.inf, 0, False, "error", "; ".join(wrong))
    else:
        exact = exact or gradients is not None
        ways = (gradients or likelihoods.slopes, build, y, kind, priors, options.get("boundary_weight", 0.0))
        slope = (lambda v: _slope(v, ways, seen)) if exact else None
        bend = (lambda v: _curvature(v, ways)) if exact and flatten(base, free).size <= CURVED else None
        got = minimize(values, flatten(base, free), name, slope, max_steps, learning_rate, log=log, feasible=feasible, curvature=bend)
    return Fit(kind, name, transformed, fix_mu, "none" if priors is None else "custom", got.success, got.code, got.value, got.steps, time.perf_counter() - began, got.message,
               back(unflatten(got.x, base, free)), got.losses, [back(unflatten(v, base, free)) for v in got.points])


def minimize_with_recovery(
    f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, name: str = "Adam", max_steps: int = 200, rate: float = 1e-2, patience: int = 20,
    least_rate: float = 1e-6, **options
) -> Minimum:
    """Runs of `patience` steps from the best point so far: a run that fails or doesn't improve by a thousandth halves the
    rate, and the next begins at the best point. Values that aren't finite count as very large."""
    def safe(points: np.ndarray) -> np.ndarray:
        return np.nan_to_num(f(points), nan=1e10, posinf=1e10, neginf=1e10)

    best = Minimum(np.asarray(x, float), float(safe(np.asarray(x, float)[None])[0]), 0, False, "max_steps_reached")
    while best.steps < max_steps:
        got = minimize(safe, best.x, name, max_steps=min(patience, max_steps - best.steps), rate=rate, **options)
        best.steps += max(got.steps, 1)
        gained = got.value < best.value - 1e-3 * max(1.0, abs(best.value))
        if got.value < best.value:
            best.x, best.value = got.x, got.value
        if got.success and not gained:
            best.success, best.code = True, "successful"
            break
        if not gained:
            rate /= 2
            if rate < least_rate:
                best.code = "stalled"
                break
    return best
