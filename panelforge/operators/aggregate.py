"""Grouped statistics of study results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, guarded_ratio, list_mean, sem


def _quantiles(x: Column, at: Sequence[float], accuracy: int | None) -> Column:
    """Exact and interpolated, for which a group's distinct values are counted in one task; or, for groups of any size, a
    sketch whose ranks are wrong by 1 / accuracy of the group at most."""
    if accuracy is None:
        return F.percentile(x, F.array(*map(F.lit, at)))
    return F.percentile_approx(x, F.array(*map(F.lit, at)), accuracy)


def group_stats(
    df: DataFrame, by: Sequence[str], values: Sequence[str], stats: Sequence[str] = ("mean", "std", "median", "count", "se"), null_as_zero: bool = False,
    accuracy: int | None = None,
) -> DataFrame:
    """<value>_<stat> for each value; NaN is skipped like NULL. null_as_zero counts missing as 0, which biases means.
    accuracy: of medians, see _quantiles(); exact unless given."""
    def of(v: str) -> dict[str, Column]:
        x = clean(F.col(v).cast("double"))
        x = F.coalesce(x, F.lit(0.0)) if null_as_zero else x
        return {
            "mean": F.avg(x), "std": F.stddev_samp(x), "median": F.median(x) if accuracy is None else _quantiles(x, (0.5,), accuracy)[0],
            "count": F.count(x), "se": sem(x), "min": F.min(x), "max": F.max(x)
        }

    return df.groupBy(*by).agg(*[of(v)[s].alias(f"{v}_{s}") for v in values for s in stats])


def success_rate(df: DataFrame, by: Sequence[str], success: str) -> DataFrame:
    """Runs, successes and their share in per cent; unknown outcomes aren't successes."""
    ok = F.coalesce(F.col(success), F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if(ok).alias("successes"), (F.count_if(ok) * 100.0 / F.count("*")).alias("success_rate"))


def list_stats(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(keys, mean, se, n): element-wise over arrays; arrays with a NaN or NULL are left out; errors use the population
    deviation. Sums run over single elements, so no group is gathered."""
    whole = df.filter(F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x)))
    each = whole.select(*by, F.posexplode(column).alias("__i", "__x")).groupBy(*by, "__i").agg(
        F.avg("__x").alias("m"), (F.stddev_pop("__x") / F.sqrt(F.count("__x"))).alias("s"), F.count("__x").alias("n")
    )
    packed = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__i", "m", "s"))).alias("a"), F.max("n").alias("n"))
    return packed.select(*by, F.transform("a", lambda v: v["m"]).alias("mean"), F.transform("a", lambda v: v["s"]).alias("se"), "n")


def medians(df: DataFrame, by: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Medians of all numeric columns that aren't keys, exact unless an accuracy is given."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c not in by]
    middle = (lambda c: F.median(c)) if accuracy is None else (lambda c: _quantiles(F.col(c), (0.5,), accuracy)[0])
    return df.groupBy(*by).agg(*[middle(c).alias(c) for c in numeric])


def five_numbers(df: DataFrame, by: Sequence[str], value: str, accuracy: int | None = None) -> DataFrame:
    """Least, lower quartile, median, upper quartile, greatest; exact unless an accuracy is given."""
    q = _quantiles(F.col(value), (0.0, 0.25, 0.5, 0.75, 1.0), accuracy)
    return df.groupBy(*by).agg(q.alias("q")).select(*by, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("least", "lower", "middle", "upper", "greatest"))])


def mean_band(df: DataFrame, by: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    """Mean with a normal interval."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.avg(value) - z * sem(value)).alias("low"), (F.avg(value) + z * sem(value)).alias("high"))


def against_baseline(df: DataFrame, by: Sequence[str], arm: str, baseline, value: str) -> DataFrame:
    """(keys, arm, mean, baseline, rel_diff_pct): each arm's mean against the baseline arm's within the keys."""
    means = df.groupBy(*by, arm).agg(F.avg(value).alias("mean"))
    base = means.filter(F.col(arm) == baseline).select(*by, F.col("mean").alias("baseline"))
    return means.join(base, list(by), "left").withColumn("rel_diff_pct", guarded_ratio(100.0 * (F.col("mean") - F.col("baseline")), F.abs("baseline"), 1e-12, None))


def significant_bias(df: DataFrame, by: Sequence[str], bias: str, times: float = 2.0) -> DataFrame:
    """Groups whose mean bias exceeds so many deviations, with a flag; ranked by relative size."""
    s = df.groupBy(*by).agg(F.avg(bias).alias("mean_bias"), F.stddev_samp(bias).alias("std_bias"))
    return s.withColumn("significant", F.coalesce(F.abs("mean_bias") > times * F.col("std_bias"), F.lit(False))).orderBy(F.desc(F.abs("mean_bias")), *by)


def pass_rates(df: DataFrame, by: Sequence[str], passed: str) -> DataFrame:
    """Tested, passed and the share; errors (NULL) aren't tested."""
    return df.groupBy(*by).agg(F.count(passed).alias("tested"), F.count_if(F.col(passed)).alias("passed"), F.avg(F.col(passed).cast("double")).alias("pass_rate"))


def shares(df: DataFrame, by: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """How many rows, and which share, meet each condition."""
    exprs = [e for n, c in conditions.items() for e in (F.count_if(c).alias(f"n_{n}"), (F.count_if(c) / F.count("*")).alias(f"share_{n}"))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *exprs) if by else df.agg(F.count("*").alias("n"), *exprs)


def stability(df: DataFrame, by: Sequence[str], value: str, n: int = 10) -> DataFrame:
    """Groups with the largest ratio of mean to median; a median near 0 counts as infinite."""
    s = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"))
    return s.withColumn("ratio", guarded_ratio("mean", "median")).orderBy(F.desc("ratio"), *by).limit(n)


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(keys, column, left, right, status): cells that differ beyond tolerance, or rows and values on one side only. NULL
    keys match each other; NaN and NULL are equal to themselves."""
    left = a.select(*keys, *[F.col(v).cast("double").alias(f"l_{v}") for v in values], F.lit(True).alias("__l"))
    right = b.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[F.col(v).cast("double").alias(f"r__{v}") for v in values], F.lit(True).alias("__r"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"r_{k}"))
        on = same if on is None else on & same
    both = left.join(right, on, "full")
    cells = F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"l_{v}").alias("left"), F.col(f"r__{v}").alias("right")) for v in values])
    out = both.select(*[F.coalesce(k, f"r_{k}").alias(k) for k in keys], "__l", "__r", F.explode(cells).alias("c")).select(*keys, "__l", "__r", "c.*")
    l_, r_ = F.col("left"), F.col("right")
    same = l_.eqNullSafe(r_) | (F.abs(l_ - r_) <= atol + rtol * F.abs(r_))
    status = F.when(F.col("__r").isNull(), "left only").when(F.col("__l").isNull(), "right only").when(~F.coalesce(same, F.lit(False)), "differs")
    return out.withColumn("status", status).filter("status is not null").drop("__l", "__r")


def rescaled(df: DataFrame, value: str, by: float = 100.0, most: float = 10.0) -> DataFrame:
    """value divided throughout where its mean or deviation shows that it is in other units; else as it is."""
    one = df.agg((F.abs(F.avg(value)) > most).alias("m"), (F.stddev_samp(value) > most).alias("s"))
    large = one.select((F.coalesce("m", F.lit(False)) | F.coalesce("s", F.lit(False))).alias("__large"))
    return df.crossJoin(large).withColumn(value, F.when(F.col("__large"), F.col(value) / by).otherwise(F.col(value))).drop("__large")


def paired_effect(df: DataFrame, by: Sequence[str], flag: str, value: str) -> DataFrame:
    """(keys, with_flag, without_flag, effect_pct): means by a boolean, side by side; rows whose flag is unknown are in
    neither."""
    g = df.groupBy(*by).agg(F.avg(F.when(F.col(flag), F.col(value))).alias("with_flag"), F.avg(F.when(~F.col(flag), F.col(value))).alias("without_flag"))
    return g.withColumn("effect_pct", guarded_ratio(100.0 * (F.col("with_flag") - F.col("without_flag")), F.abs("without_flag"), 1e-12, None))


def with_unobserved(df: DataFrame, by: Sequence[str], values: Sequence[str], stats: Sequence[str] = ("median", "count")) -> DataFrame:
    """group_stats over every combination of the keys' values, also those that no row has: their statistics are NULL, their
    counts 0. NULL keys are values like others. Only the keys' distinct values are crossed."""
    seen = group_stats(df, by, values, stats)
    every = None
    for k in by:
        axis = df.select(k).distinct()
        every = axis if every is None else every.crossJoin(axis)
    renamed = seen.select(*[F.col(k).alias(f"__{k}") for k in by], *[c for c in seen.columns if c not in by])
    same = None
    for k in by:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = one if same is None else same & one
    out = every.join(renamed, same, "left").drop(*[f"__{k}" for k in by])
    counts = {f"{v}_count": F.coalesce(f"{v}_count", F.lit(0)) for v in values if "count" in stats}
    return out.withColumns(counts) if counts else out


def mean_by_prefix(df: DataFrame, kinds: Sequence[str], name: str) -> DataFrame:
    """<kind>_<name>_mean for each kind: the mean over its columns <kind>_<name>_0, _1, ...; NULLs are left out. A kind
    without such columns gets NULL."""
    def mean(k: str) -> Column:
        found = [F.col(c).cast("double") for c in df.columns if c.startswith(f"{k}_{name}_") and c.rsplit("_", 1)[1].isdigit()]
        return list_mean(F.array(*found)) if found else F.lit(None).cast("double")

    return df.withColumns({f"{k}_{name}_mean": mean(k) for k in kinds})
