"""Flattening, consolidation, pivots, orders and unions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten(df: DataFrame, depth: int = 8) -> DataFrame:
    """Nested structs as columns a_b_c."""
    def leaves(kind: T.StructType, at: tuple[str, ...]):
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType) and len(at) < depth:
                yield from leaves(f.dataType, (*at, f.name))
            else:
                yield (*at, f.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias("_".join(path)) for path in leaves(df.schema, ())])


def ordered_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The columns named, as far as they exist, then the others by name."""
    return df.select(*[c for c in first if c in df.columns], *sorted(c for c in df.columns if c not in first))


def drop_prefixed(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(tuple(prefixes))])


def consolidate(df: DataFrame, kind: str, kinds: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Columns <kind>_<name> as one column <name>, taken by the row's kind whatever its case. Names are found among the
    columns unless given; a kind without such a column gives NULL."""
    low = [k.lower() for k in kinds]
    if names is None:
        names = sorted({m[2] for c in df.columns if (m := re.match(rf"({'|'.join(low)})_(.+)$", c))})
    out = df
    for n in names:
        value: Column | None = None
        for k in low:
            if f"{k}_{n}" in df.columns:
                hit = F.lower(kind) == k
                value = F.when(hit, F.col(f"{k}_{n}")) if value is None else value.when(hit, F.col(f"{k}_{n}"))
        out = out.withColumn(n, value if value is not None else F.lit(None))
    return out.drop(*[f"{k}_{n}" for k in low for n in names])


def heatmap(df: DataFrame, rows: str, columns: str, value: str, over: Sequence) -> DataFrame:
    """Means as rows x columns; the columns' values are stated, so that no job must find them."""
    return df.groupBy(rows).pivot(columns, list(over)).agg(F.avg(value)).orderBy(rows)


def matrix_of(df: DataFrame, prefix: str) -> DataFrame:
    """(i, j, mean) of columns <prefix>_i_j."""
    found = [c for c in df.columns if re.fullmatch(rf"{re.escape(prefix)}_\d+_\d+.*", c)]
    long = df.agg(*[F.avg(c).alias(c) for c in found]).unpivot([], found, "name", "mean")
    pattern = rf"^{re.escape(prefix)}_(\d+)_(\d+)"
    return long.select(F.regexp_extract("name", pattern, 1).cast("int").alias("i"), F.regexp_extract("name", pattern, 2).cast("int").alias("j"), "mean")


def stack(*tables: DataFrame) -> DataFrame:
    """One below the other, by name; columns that a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def beside(a: DataFrame, b: DataFrame, on: str = "t") -> DataFrame:
    """Tables next to each other, on a shared row number."""
    return a.join(b, on, "full")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def loss_marks(df: DataFrame, run: str, history: str, threshold: float) -> DataFrame:
    """(run, first_below, n_jumps, max_jump) of a history of losses in an array: the first step below a threshold, and rises
    from one step to the next."""
    x = F.col(history)
    steps = F.when(F.size(x) > 1, F.zip_with(F.slice(x, F.lit(2), F.size(x) - 1), F.slice(x, F.lit(1), F.size(x) - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))
    at = F.filter(F.transform(x, lambda v, i: F.when(v < threshold, i)), lambda i: i.isNotNull())
    rises = F.filter(steps, lambda d: d > 0)
    return df.select(run, F.get(at, F.lit(0)).alias("first_below"), F.size(rises).alias("n_jumps"), F.array_max(rises).alias("max_jump"))


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], nullable: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join whose nullable keys match each other when NULL."""
    right = b.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = None
    for k in keys:
        same = a[k].eqNullSafe(right[f"__r_{k}"]) if k in nullable else a[k] == right[f"__r_{k}"]
        on = same if on is None else on & same
    return a.join(right, on, how).drop(*[f"__r_{k}" for k in keys])


def without_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is still to do."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def first_per_group(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__i = 1").drop("__i")
