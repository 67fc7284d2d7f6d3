"""Regressions of series on their own lags, from mergeable sums alone.

A window gives each row its lags; products are summed by partial aggregates, so only (lags + 2)^2 numbers a series meet; the
normal equations are solved in the plan by a Cholesky factor of fixed order, unrolled into columns. No Python worker runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def factored(sums: DataFrame, order: int, prefix: str = "__c") -> DataFrame:
    """sums with the Cholesky factor of the symmetric matrix in columns {prefix}{i}_{j}, j <= i < order, as {prefix}l{i}_{j}. A
    pivot that is not above 1e-12 of its diagonal is no number: what it would give is null."""
    for i in range(order):
        for j in range(i + 1):
            x = F.col(f"{prefix}{i}_{j}")
            for k in range(j):
                x = x - F.col(f"{prefix}l{i}_{k}") * F.col(f"{prefix}l{j}_{k}")
            if i == j:
                x = F.when(x > 1e-12 * F.col(f"{prefix}{i}_{i}"), F.sqrt(x))
            else:
                x = x / F.col(f"{prefix}l{j}_{j}")
            sums = sums.withColumn(f"{prefix}l{i}_{j}", x)
    return sums


def _moments(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows where all columns are there: their number as n, and the covariances of every two as __c{i}_{j}, j <= i."""
    whole = df
    for c in columns:
        whole = whole.filter(F.col(c).isNotNull())
    pairs = [F.covar_pop(columns[i], columns[j]).alias(f"__c{i}_{j}") for i in range(len(columns)) for j in range(i + 1)]
    return whole.groupBy(*by).agg(F.count("*").alias("n"), *pairs)


def _lagged(df: DataFrame, at: str, by: Sequence[str], x: Column, lags: int, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at)
    return df.withColumn(f"{name}0", x).select("*", *[F.lag(f"{name}0", k).over(w).alias(f"{name}{k}") for k in range(1, lags + 1)])


def arch_lm(df: DataFrame, at: str, by: Sequence[str], value: str = "value", lags: int = 5) -> DataFrame:
    """(by, n, statistic): n R2 of the squares on their own lags, with a constant. A series whose squares' lags are collinear
    has no statistic; nulls are left out before lags are taken."""
    rows = _lagged(df.filter(F.col(value).isNotNull()), at, by, F.col(value) * F.col(value), lags, "__s")
    own = factored(_moments(rows, by, [f"__s{k}" for k in range(1, lags + 1)] + ["__s0"]), lags + 1)
    explained = sum((F.col(f"__cl{lags}_{j}") ** 2 for j in range(lags)), F.lit(0.0))
    return own.select(*by, "n", (F.col("n") * explained / F.col(f"__c{lags}_{lags}")).alias("statistic"))


def dickey_fuller(df: DataFrame, at: str, by: Sequence[str], value: str = "value", lags: int = 1) -> DataFrame:
    """(by, n, lags, statistic, aic): the t value of the level in the regression of the difference on the level before, `lags`
    differences before and a constant. aic is of this regression; fewer lags are other calls."""
    w = Window.partitionBy(*by).orderBy(at)
    level = df.filter(F.col(value).isNotNull()).withColumn("__x", F.lag(value).over(w))
    rows = _lagged(level, at, by, F.col(value) - F.col("__x"), lags, "__d")
    # the level comes last of the regressors, so that its own share is one entry of the factor
    own = factored(_moments(rows, by, [f"__d{k}" for k in range(1, lags + 1)] + ["__x", "__d0"]), lags + 1)
    y = lags + 1
    last = [F.col(f"__c{y}_{i}") for i in range(lags + 1)]
    for i in range(lags + 1):
        for k in range(i):
            last[i] = last[i] - F.col(f"__z{k}") * F.col(f"__cl{i}_{k}")
        last[i] = last[i] / F.col(f"__cl{i}_{i}")
        own = own.withColumn(f"__z{i}", last[i])
    rest = F.col(f"__c{y}_{y}") - sum((F.col(f"__z{i}") ** 2 for i in range(lags + 1)), F.lit(0.0))
    own = own.withColumn("__rest", rest)
    free = F.col("n") - lags - 2
    t = F.when((F.col("__rest") > 0) & (free > 0), F.col(f"__z{lags}") / F.sqrt(F.col("__rest") / free))
    aic = F.when(F.col("__rest") > 0, F.col("n") * F.log("__rest") + 2 * (lags + 2))
    return own.select(*by, "n", F.lit(lags).alias("lags"), t.alias("statistic"), aic.alias("aic"))
