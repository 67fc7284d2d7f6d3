"""Panels in long form (keys, date or t, value): centring, gaps, moments, correlations, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guarded_corr, portfolio_deciles, present_across
from .ranged import running_sum


def melt(df: DataFrame, ids: Sequence[str], series: str = "series_id", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], series, value)


def demean(df: DataFrame, by: str = "series_id", value: str = "value") -> DataFrame:
    """value less its series' mean: means are aggregated and joined back, so no series is sorted or held in one task."""
    means = df.groupBy(by).agg(F.avg(value).alias("__mean"))
    return df.join(means, by).withColumn(value, F.col(value) - F.col("__mean")).drop("__mean")


def scale_columns(df: DataFrame, by: float, but: Sequence[str]) -> DataFrame:
    """Every column but those named, multiplied."""
    return df.select(*[c if c in but else (F.col(c) * by).alias(c) for c in df.columns])


def market_mean(df: DataFrame, at: str, value: str = "value") -> DataFrame:
    """Each date's mean over series; missing values are skipped."""
    return df.groupBy(at).agg(F.avg(value).alias("row_mean"))


def rich_rows(df: DataFrame, columns: Sequence[str], more_than: int = 1) -> DataFrame:
    """Rows with more than so many columns present."""
    return df.filter(present_across(columns) > more_than)


def missing_profile(df: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """(column, missing, share): most missing first. One aggregate over the table, then one row is turned."""
    columns = [c for c in df.columns if c not in ids]
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = one.unpivot(["__n"], columns, "column", "missing")
    return long.select("column", "missing", F.try_divide(F.col("missing") * 100.0, F.col("__n")).alias("share")).orderBy(F.desc("missing"), "column")


def complete_columns(df: DataFrame) -> DataFrame:
    """df without the columns that have any gap. The driver gets one row of counts."""
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if not gaps[c]])


def complete_series(df: DataFrame, series: str = "series_id", value: str = "value") -> DataFrame:
    """Long form: without the series that have any gap."""
    return df.join(df.filter(F.col(value).isNull()).select(series).distinct(), series, "left_anti")


def differences(df: DataFrame, at: str, by: Sequence[str], value: str = "value", log: bool = True) -> DataFrame:
    """First difference, of logs unless told otherwise, within a series; the first row of each is left out."""
    x = F.log(value) if log else F.col(value)
    return df.withColumn("__x", x).withColumn(value, F.col("__x") - F.lag("__x").over(Window.partitionBy(*by).orderBy(at))).drop("__x").filter(F.col(value).isNotNull())


def moments(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, population deviation, skewness, excess kurtosis, least, greatest. Constant groups have no shape."""
    live = F.stddev_pop(value) > 1e-10
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.when(live, F.skewness(value)).alias("skew"),
        F.when(live, F.kurtosis(value)).alias("kurt"), F.min(value).alias("min"), F.max(value).alias("max"),
    )


def lag_correlation(df: DataFrame, at: str, by: Sequence[str], value: str = "value", lag: int = 1) -> DataFrame:
    """Correlation of a series with itself, lag rows before."""
    back = df.withColumn("__lag", F.lag(value, lag).over(Window.partitionBy(*by).orderBy(at)))
    return back.groupBy(*by).agg(guarded_corr(value, "__lag").alias("autocorr"))


def correlation_matrix(df: DataFrame, at: str, series: str = "series_id", value: str = "value") -> DataFrame:
    """(a, b, corr, n) for a <= b: pairs meet on their date; sums are combined before their shuffle."""
    a, b = df.select(at, F.col(series).alias("a"), F.col(value).alias("x")), df.select(at, F.col(series).alias("b"), F.col(value).alias("y"))
    return a.join(b, at).filter("a <= b").groupBy("a", "b").agg(guarded_corr("x", "y").alias("corr"), F.count("*").alias("n"))


def jarque_bera(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Statistic and p value; chi-squared with two degrees of freedom has an elementary tail."""
    m = moments(df, by, value)
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4)
    return m.select(*by, "n", "skew", "kurt", jb.alias("jb"), F.exp(-jb / 2).alias("p_value"))


def ljung_box(df: DataFrame, at: str, by: Sequence[str], lags: int, value: str = "value", squares: bool = False) -> DataFrame:
    """The portmanteau statistic of a series, or of its squares, up to lags. One window gives all lags."""
    x = F.col(value) * F.col(value) if squares else F.col(value)
    means = df.groupBy(*by).agg(F.avg(x).alias("__m"), F.count(x).alias("__n"))
    c = df.join(means, list(by)).withColumn("__d", x - F.col("__m"))
    w = Window.partitionBy(*by).orderBy(at)
    lagged = c.select("*", *[(F.col("__d") * F.lag("__d", k).over(w)).alias(f"__p{k}") for k in range(1, lags + 1)])
    sums = lagged.groupBy(*by).agg(F.max("__n").alias("n"), F.sum(F.col("__d") ** 2).alias("__v"), *[F.sum(f"__p{k}").alias(f"__s{k}") for k in range(1, lags + 1)])
    q = sum(((F.coalesce(F.col(f"__s{k}"), F.lit(0.0)) / F.col("__v")) ** 2 / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return sums.filter(F.col("__v") > 0).select(*by, "n", (F.col("n") * (F.col("n") + 2) * q).alias("q"))


def densify(df: DataFrame, at: str, series: str, value: str, run: str = "run_id", fill: float = 0.0) -> DataFrame:
    """Long to dense: (run, t, y array<double>), series in the order of their names, t from 0. Cells that are missing are
    filled. Only names and dates are crossed, never rows."""
    cells = df.groupBy(run, at, series).agg(F.first(value).alias("__v"))
    grid = cells.select(run, at).distinct().join(cells.select(run, series).distinct(), run)
    whole = grid.join(cells, [run, at, series], "left")
    packed = whole.groupBy(run, at).agg(F.array_sort(F.collect_list(F.struct(F.col(series).alias("s"), F.coalesce("__v", F.lit(fill)).alias("v")))).alias("__a"))
    t = (F.row_number().over(Window.partitionBy(run).orderBy(at)) - 1).alias("t")
    return packed.select(run, t, F.transform("__a", lambda x: x["v"]).alias("y"))


def cumulative_share(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Running sum and its share of the whole, largest `order` first. Without `by` rows are dealt by ranges, whose sums are
    carried on, so that no task holds the whole table."""
    if not by:
        run = running_sum(df, [F.desc(order)], F.col(value), "running")
        return run.join(F.broadcast(df.agg(F.sum(value).alias("__all")))).withColumn("running_share", F.col("running") / F.col("__all")).drop("__all")
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    run = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.select("*", run.alias("running"), (run / F.sum(value).over(Window.partitionBy(*by))).alias("running_share"))


def skip_first(df: DataFrame, at: str, by: Sequence[str], n: int = 10) -> DataFrame:
    """Without the first n rows of each group."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(at))).filter(F.col("__i") > n).drop("__i")


def common_dates(df: DataFrame, at: str, by: str) -> DataFrame:
    """Rows of the dates that every group has."""
    groups = df.agg(F.count_distinct(by).alias("__all"))
    shared = df.groupBy(at).agg(F.count_distinct(by).alias("__n")).join(groups, F.col("__n") == F.col("__all")).select(at)
    return df.join(shared, at, "left_semi")


def grid_correlation(pairs: DataFrame) -> DataFrame:
    """(size_decile, value_decile, mean_corr, n): each portfolio cell's mean correlation with the other series. pairs: (a,
    b, corr) for a <= b, a and b names that hold deciles."""
    ends = pairs.filter("a != b and corr is not null").select(F.explode(F.array("a", "b")).alias("name"), "corr")
    size, value = portfolio_deciles("name")
    return ends.groupBy(size.alias("size_decile"), value.alias("value_decile")).agg(F.avg("corr").alias("mean_corr"), F.count("*").alias("n"))
