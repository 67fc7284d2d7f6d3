"""SQL for the models of one factor, for DuckDB: the filters' recursions, their smoother, likelihoods and residuals.

A recursive query takes one step of the mode search, or closes one time step, a round. With one factor all blocks are
numbers, the observation's likelihood needs two sums over series, and the mode in the log volatility is the root of one
equation, here found by bisection where the kernels take Newton steps.
"""

from __future__ import annotations

#: The model that the filter queries use: N = 3 series, one factor.
LAM, PHI_F, PHI_H, MU, S2, Q_H = (1.0, 0.8, 0.6), 0.2, 0.9, -4.0, 0.01, 0.1
HALVINGS, REACH = 44, 12.0  #: of the search for a mode, within so much of the prediction

#: Demeaned monthly log returns of revenue by return flag and region, dense: d(run_id, t, y1, y2, y3).
DENSE = """
cells AS (SELECT 'region-' || n_regionkey AS run_id, strftime(o_orderdate, '%Y-%m') AS month, l_returnflag AS s, sum(l_extendedprice * (1 - l_discount)) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3),
diffs AS (SELECT run_id, month, s, ln(v) - lag(ln(v)) OVER (PARTITION BY run_id, s ORDER BY month) AS v FROM cells),
rets AS (SELECT run_id, month, s, v - avg(v) OVER (PARTITION BY run_id, s) AS v FROM diffs WHERE v IS NOT NULL),
d AS (SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY month) - 1)::INT AS t, y1, y2, y3 FROM (SELECT run_id, month,
  coalesce(max(v) FILTER (s = 'A'), 0) AS y1, coalesce(max(v) FILTER (s = 'N'), 0) AS y2, coalesce(max(v) FILTER (s = 'R'), 0) AS y3 FROM rets GROUP BY 1, 2))"""


def _constants() -> dict[str, str]:
    dinv = 1 / (S2 + 1e-8)
    p_h = Q_H * sum(PHI_H ** (2 * j) for j in range(31))
    return {
        "V": repr(sum(x * x for x in LAM) * dinv), "LOGD": f"(3 * ln({S2}))", "PH0": repr(p_h), "QI": repr(1 / (Q_H + 1e-8)), "PF": repr(PHI_F), "PV": repr(PHI_H), "Q": repr(Q_H),
        "B": f"({dinv!r} * ({LAM[0]} * y1 + {LAM[1]} * y2 + {LAM[2]} * y3))", "YY": f"({dinv!r} * (y1 * y1 + y2 * y2 + y3 * y3))", "ITS": str(HALVINGS), "REACH": repr(REACH),
    }


#: Predictions from a state (f, h) with posterior information (uf, uh): the information filter's, and the covariance filter's.
_NEXT = {
    "BIF": (
        "(exp(-hp) + 1e-8) - (exp(-hp) + 1e-8) ** 2 * {PF} ** 2 / (uf + {PF} ** 2 * (exp(-hp) + 1e-8))",
        "{QI} - {QI} ** 2 * {PV} ** 2 / (uh + {PV} ** 2 * {QI})", "1 / (1 + 1e-6)", "1 / ({PH0} + 1e-6)",
    ),
    "BF": (
        "1 / ({PF} ** 2 / uf + exp(hp) + 1e-8)", "1 / ({PV} ** 2 / uh + {Q} + 1e-8)", "1 / (1e6 + 1e-6)", "1 / ({PH0} + 1e-6)",
    ),
}


def filtered(kind: str = "BIF", mus: dict[str, float] | None = None) -> str:
    """CTEs up to x(run_id, param_id, t, f, h, fp, hp, wf, wh, uf, uh, ll): a row for each time step of each run."""
    next_f, next_h, first_f, first_h = _NEXT[kind]
    models = ", ".join(f"('{name}', {mu!r}::DOUBLE)" for name, mu in (mus or {"shared": MU}).items())
    text = f"""
s AS (SELECT run_id, t, {{B}} AS b, {{YY}} AS yy, count(*) OVER (PARTITION BY run_id) AS n FROM d),
start AS (SELECT DISTINCT run_id, param_id, mu, {first_f} AS uf, {first_h} AS uh FROM s, (VALUES {models}) m(param_id, mu)),
r(run_id, param_id, mu, t, it, lo, hi, fp, hp, wf, wh) AS (
  SELECT run_id, param_id, mu, 0, 0, hp - {{REACH}}, hp + {{REACH}}, 0::DOUBLE, hp, {next_f}, {next_h} FROM (SELECT *, mu AS hp FROM start)
  UNION ALL
  SELECT run_id, param_id, mu, CASE WHEN it < {{ITS}} THEN t ELSE t + 1 END, CASE WHEN it < {{ITS}} THEN it + 1 ELSE 0 END,
    CASE WHEN it < {{ITS}} THEN CASE WHEN slope < 0 THEN h ELSE lo END ELSE hn - {{REACH}} END,
    CASE WHEN it < {{ITS}} THEN CASE WHEN slope < 0 THEN hi ELSE h END ELSE hn + {{REACH}} END,
    CASE WHEN it < {{ITS}} THEN fp ELSE {{PF}} * f END, CASE WHEN it < {{ITS}} THEN hp ELSE hn END,
    CASE WHEN it < {{ITS}} THEN wf ELSE {next_f.replace('hp', 'hn')} END, CASE WHEN it < {{ITS}} THEN wh ELSE {next_h.replace('hp', 'hn')} END
  FROM (SELECT *, wf + iff + 1e-6 AS uf, wh + 0.5 * exp(2 * h) * iff ** 2 + 1e-6 AS uh, mu + {{PV}} * (h - mu) AS hn,
      0.5 * exp(h) * (iff - (v - {{V}} * v / m) ** 2) + wh * (h - hp) AS slope
    FROM (SELECT *, b - {{V}} * f AS v FROM (SELECT *, (b - {{V}} * b / m + wf * fp) / (iff + wf) AS f
      FROM (SELECT *, {{V}} - {{V}} ** 2 / m AS iff FROM (SELECT *, 1 / (exp(h) + 1e-8) + {{V}} + 1e-6 AS m
        FROM (SELECT r.*, s.b, s.n, (lo + hi) / 2 AS h FROM r JOIN s USING (run_id, t)))))))
  WHERE it < {{ITS}} OR t + 1 < n),
x AS (SELECT run_id, param_id, t, f, h, fp, hp, wf, wh, uf, uh,
    -0.5 * (ln(m) + h + {{LOGD}} + yy - 2 * f * b + {{V}} * f * f - v * v / m)
    - 0.5 * (ln(uf + 1e-8) - ln(wf + 1e-8) + (f - fp) ** 2 * wf) - 0.5 * (ln(uh + 1e-8) - ln(wh + 1e-8) + (h - hp) ** 2 * wh) AS ll
  FROM (SELECT *, wf + iff + 1e-6 AS uf, wh + 0.5 * exp(2 * h) * iff ** 2 + 1e-6 AS uh, b - {{V}} * f AS v
    FROM (SELECT *, (b - {{V}} * b / m + wf * fp) / (iff + wf) AS f FROM (SELECT *, {{V}} - {{V}} ** 2 / m AS iff
      FROM (SELECT *, 1 / (exp(h) + 1e-8) + {{V}} + 1e-6 AS m FROM (SELECT r.*, s.b, s.yy, (lo + hi) / 2 AS h FROM r JOIN s USING (run_id, t) WHERE it = {{ITS}}))))))"""
    return f"WITH RECURSIVE {DENSE}," + text.format(**_constants())


def states(kind: str, digits: int) -> str:
    return f"""{filtered(kind)}
SELECT run_id, t, 'f' AS kind, 0 AS k, round(f, {digits}) AS value FROM x UNION ALL SELECT run_id, t, 'h', 0, round(h, {digits}) FROM x"""


def smoothed(digits: int) -> str:
    """The backward pass, the last step first."""
    c = _constants()
    return f"""{filtered()},
z AS (SELECT *, max(t) OVER (PARTITION BY run_id) AS last, {MU} + {c['PV']} * (h - {MU}) AS hq FROM x),
g AS (SELECT *, {c['PF']} / uf / ({c['PF']} ** 2 / uf + exp(hq)) AS gf, {c['PV']} / uh / ({c['PV']} ** 2 / uh + {c['Q']}) AS gh FROM z),
b(run_id, t, f, h) AS (SELECT run_id, t, f, h FROM g WHERE t = last
  UNION ALL SELECT g.run_id, g.t, g.f + gf * (b.f - {c['PF']} * g.f), g.h + gh * (b.h - hq) FROM b JOIN g ON g.run_id = b.run_id AND g.t = b.t - 1)
SELECT run_id, t, 'f' AS kind, 0 AS k, round(f, {digits}) AS value FROM b UNION ALL SELECT run_id, t, 'h', 0, round(h, {digits}) FROM b"""


def logliks(mus: dict[str, float], digits: int) -> str:
    return f"""{filtered("BIF", mus)}
SELECT run_id, param_id, 'BIF' AS filter_type, round(sum(ll), {digits}) AS loglik, round(-1.5 * count(*) * ln(2 * pi()), {digits}) AS loglik_constant FROM x GROUP BY 1, 2"""


def residuals(digits: int) -> str:
    """Residuals whitened by the Cholesky factor, and statistics of the covariance that factors imply."""
    a, b, c = LAM
    common = a * a + b * b + c * c
    return f"""{filtered()},
e AS (SELECT run_id, t, 1 / uf AS c, y1 - {a} * f AS e1, y2 - {b} * f AS e2, y3 - {c} * f AS e3 FROM x JOIN d USING (run_id, t)),
l1 AS (SELECT *, sqrt({a * a!r} * c + {S2} + 1e-7) AS l11 FROM e), l2 AS (SELECT *, {a * b!r} * c / l11 AS l21, {a * c!r} * c / l11 AS l31 FROM l1),
l3 AS (SELECT *, sqrt({b * b!r} * c + {S2} + 1e-7 - l21 ** 2) AS l22 FROM l2), l4 AS (SELECT *, ({b * c!r} * c - l31 * l21) / l22 AS l32 FROM l3),
l5 AS (SELECT *, sqrt({c * c!r} * c + {S2} + 1e-7 - l31 ** 2 - l32 ** 2) AS l33, e1 / l11 AS z1 FROM l4), l6 AS (SELECT *, (e2 - l21 * z1) / l22 AS z2 FROM l5)
SELECT run_id, t, round(z1, {digits}) AS z1, round(z2, {digits}) AS z2, round((e3 - l31 * z1 - l32 * z2) / l33, {digits}) AS z3,
  round(2 * ln({S2}) + ln({S2} + {common!r} * c), {digits}) AS logdet,
  round(({a * b!r} * c / sqrt(({a * a!r} * c + {S2}) * ({b * b!r} * c + {S2})) + {a * c!r} * c / sqrt(({a * a!r} * c + {S2}) * ({c * c!r} * c + {S2}))
    + {b * c!r} * c / sqrt(({b * b!r} * c + {S2}) * ({c * c!r} * c + {S2}))) / 3, {digits}) AS avg_corr,
  round({common!r} * c / ({common!r} * c + {3 * S2!r}), {digits}) AS factor_share
FROM l6"""


def quality(digits: int) -> str:
    cells = " UNION ALL ".join(f"SELECT run_id, {i} AS series, y{i + 1} AS y, {x} * f AS x FROM x JOIN d USING (run_id, t)" for i, x in enumerate(LAM))
    return f"""{filtered()}
SELECT run_id, series, round(1 - sum((y - x) ** 2) / (var_pop(y) * count(*)), {digits}) AS r2, round(sqrt(sum((y - x) ** 2) / count(*)), {digits}) AS rmse FROM ({cells}) GROUP BY 1, 2"""


def components(digits: int) -> str:
    """Eigenvalues of the 3 x 3 correlation matrix, by the trigonometric solution of its cubic, in the order of their size."""
    return f"""WITH {DENSE},
c AS (SELECT run_id, count(*) AS n, corr(y1, y2) AS p, corr(y1, y3) AS q, corr(y2, y3) AS r FROM d GROUP BY 1),
m AS (SELECT *, sqrt((p * p + q * q + r * r) / 3) AS s FROM c),
a AS (SELECT *, acos(greatest(-1, least(1, p * q * r / s ** 3))) / 3 AS phi FROM m),
v AS (SELECT run_id, n, k, (1 + 2 * s * cos(phi + (CASE k WHEN 1 THEN 0 WHEN 2 THEN 4 ELSE 2 END) * pi() / 3)) AS e FROM a, (VALUES (1), (2), (3)) t(k))
SELECT run_id, k AS component, round(e * n / (n - 1), {digits}) AS eigenvalue, round(e / 3, {digits}) AS ratio,
  round(sum(e) OVER (PARTITION BY run_id ORDER BY k) / 3, {digits}) AS cumulative FROM v"""
