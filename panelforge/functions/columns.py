"""Scalar and array expressions. NULL means missing; NaN is turned into NULL where a statistic must skip it."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Col) -> Column:
    """x, NULL where it is NaN."""
    return F.when(F.isnan(_c(x)), F.lit(None)).otherwise(_c(x))


def finite(x: Col) -> Column:
    return _c(x).isNotNull() & ~F.isnan(_c(x)) & (F.abs(_c(x)) < float("inf"))


def sentinel_to_null(x: Col, *values: float) -> Column:
    return F.when(_c(x).isin(*values), F.lit(None)).otherwise(_c(x))


def guarded_ratio(a: Col, b: Col, least: float = 1e-9, other: float | None = math.inf) -> Column:
    """a / b where b exceeds `least`; else `other`."""
    return F.when(_c(b) > least, _c(a) / _c(b)).otherwise(F.lit(other).cast("double"))


def guarded_corr(x: Col, y: Col, least: float = 1e-10) -> Column:
    """Correlation aggregate; NULL where either side hardly varies. Sums only, so that a constant side doesn't raise."""
    both = _c(x).isNotNull() & _c(y).isNotNull()
    a, b = F.when(both, _c(x)), F.when(both, _c(y))
    return F.when((F.stddev_pop(a) > least) & (F.stddev_pop(b) > least), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def sem(x: Col, ddof: int = 1) -> Column:
    """Standard error of the mean."""
    return (F.stddev_samp(_c(x)) if ddof else F.stddev_pop(_c(x))) / F.sqrt(F.count(_c(x)))


def mean_across(columns: Sequence[Col]) -> Column:
    """Mean over columns of a row; NULL and NaN are skipped, NULL if nothing is left."""
    return list_mean(F.array(*[clean(_c(c).cast("double")) for c in columns]))


def present_across(columns: Sequence[Col]) -> Column:
    """How many columns of a row aren't NULL."""
    out = F.lit(0)
    for c in columns:
        out = out + _c(c).isNotNull().cast("int")
    return out


# --- arrays ---


def list_mean(x: Col) -> Column:
    """Mean of an array's elements that aren't NULL; NULL for none."""
    full = F.filter(_c(x), lambda v: v.isNotNull())
    return F.when(F.size(full) > 0, F.aggregate(full, F.lit(0.0), lambda a, v: a + v) / F.size(full))


def parse_list(x: Col) -> Column:
    """'[0.1, 0.2]' or '[0.1 0.2]' as array<double>; NULL for anything else. An element that is no number is NULL."""
    body = F.trim(F.regexp_extract(_c(x), r"^\s*\[(.*)\]\s*$", 1))
    parts = F.split(F.regexp_replace(body, r"\s*,\s*|\s+", ","), ",")
    listed = F.when(body == "", F.array().cast("array<double>")).otherwise(F.transform(parts, lambda v: v.try_cast("double")))
    return F.when(_c(x).rlike(r"^\s*\[.*\]\s*$"), listed)


def expand_list(df: DataFrame, column: str, n: int | None = None, keep: bool = True) -> DataFrame:
    """Columns column_0, column_1, ... of an array; as many as the longest has, unless n is given."""
    n = n if n is not None else (df.agg(F.max(F.size(column))).first()[0] or 0)
    out = df.select("*", *[F.get(column, F.lit(i)).alias(f"{column}_{i}") for i in range(n)])
    return out if keep else out.drop(column)


# --- labels and names ---


def case_map(x: Col, names: Mapping, default: Col | None = None) -> Column:
    """Each value's display name; `default`, or the value itself, for others."""
    out = None
    for k, v in names.items():
        out = F.when(_c(x) == k, F.lit(v)) if out is None else out.when(_c(x) == k, F.lit(v))
    rest = _c(x) if default is None else (F.lit(default) if isinstance(default, str) else default)
    return rest if out is None else out.otherwise(rest)


def rank_map(x: Col, order: Sequence, default: int = 99) -> Column:
    """A value's place in a stated order."""
    return case_map(x, {v: i for i, v in enumerate(order)}, F.lit(default))


def filter_config(filter_type: Col = "filter_type", particles: Col = "num_particles") -> Column:
    """'BIF', 'BF', 'PF-<n>' or 'Unknown'."""
    kind = F.upper(_c(filter_type))
    return F.when(kind.isin("BIF", "BF"), kind).when((kind == "PF") & _c(particles).isNotNull(), F.concat(F.lit("PF-"), _c(particles).cast("long").cast("string"))).otherwise("Unknown")


def run_name(name: Col) -> dict[str, Column]:
    """Fields of 'task_00012_BIF_N5_K2_seed77'; NULL fields and an error flag where the name isn't so."""
    pattern = r"^task_(\d+)_([A-Za-z]+)_N(\d+)_K(\d+)_seed(\d+)$"
    ok = _c(name).rlike(pattern)
    part = lambda i, kind: F.when(ok, F.regexp_extract(_c(name), pattern, i).cast(kind))
    return {"task": part(1, "int"), "filter_type": part(2, "string"), "N": part(3, "int"), "K": part(4, "int"), "seed": part(5, "long"), "metadata_parse_error": ~F.coalesce(ok, F.lit(False))}


#: The corner portfolios have names of their own: (size decile, value decile).
CORNERS = {"SMALL LoBM": (1, 1), "SMALL HiBM": (1, 10), "BIG LoBM": (10, 1), "BIG HiBM": (10, 10)}


def portfolio_deciles(name: Col) -> tuple[Column, Column]:
    """(size decile, value decile) of 'ME3 BM7' and of the corners; NULL for other names."""
    pattern = r"^ME(\d+) BM(\d+)"
    out = []
    for i in (0, 1):
        c = case_map(name, {k: v[i] for k, v in CORNERS.items()}, F.when(_c(name).rlike(pattern), F.regexp_extract(_c(name), pattern, i + 1).cast("int")))
        out.append(c.cast("int"))
    return out[0], out[1]


def shown(x: Col, digits: int = 4, missing: str = "N/A") -> Column:
    return F.when(_c(x).isNotNull(), F.format_string(f"%.{digits}f", _c(x).cast("double"))).otherwise(missing)


def shown_adaptive(x: Col) -> Column:
    """Three decimals from 0.01 on, scientific below; N/A for missing."""
    v = _c(x).cast("double")
    return F.when(v.isNull(), "N/A").when((F.abs(v) >= 0.01) | (v == 0), F.format_string("%.3f", v)).otherwise(F.format_string("%.2e", v))


def shown_units(millions: Col) -> Column:
    """Millions as '1.50B' from a thousand on, else '12.00M'."""
    v = _c(millions).cast("double")
    return F.when(v.isNull(), "N/A").when(v >= 1000, F.format_string("%.2fB", v / 1000)).otherwise(F.format_string("%.2fM", v))


def seed_of(*parts: Col) -> Column:
    """A seed from the first 8 hex digits of a sha256 of parts joined by '|'."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[_c(p).cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


# --- densities and transforms ---


def norm_logpdf(x: Col, mean: Col | float = 0.0, sd: Col | float = 1.0) -> Column:
    m, s = (v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in (mean, sd))
    s = F.greatest(s, F.lit(1e-10))
    return F.lit(-0.5 * math.log(2 * math.pi)) - F.log(s) - F.pow((_c(x) - m) / s, F.lit(2.0)) / 2


def inverse_gamma_logpdf(x: Col, shape: float, scale: float) -> Column:
    v = F.greatest(_c(x), F.lit(1e-10))
    return F.lit(shape * math.log(scale) - math.lgamma(shape)) - (shape + 1) * F.log(v) - scale / v


def safe_arctanh(x: Col) -> Column:
    return F.atanh(F.greatest(F.least(_c(x), F.lit(1 - 1e-6)), F.lit(-1 + 1e-6)))


def softplus(x: Col) -> Column:
    return F.greatest(_c(x), F.lit(0.0)) + F.log1p(F.exp(-F.abs(_c(x))))


def inverse_softplus(x: Col) -> Column:
    v = F.greatest(_c(x), F.lit(1e-6))
    return F.when(v < 1e-3, F.log(v)).otherwise(v + F.log(-F.expm1(-v)))
