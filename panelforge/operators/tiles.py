"""Products of all pairs of series, tile by tile: correlations and principal components of wide panels.

Cells are dealt into tiles, a span of dates by a block of series. Tiles of one span meet by pairs of blocks, each pair once,
and give partial sums of products; sums of spans merge. No date is a key of a join, no task holds more than two tiles, and
series that miss dates are compared on the dates they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .ranged import numbered

SPAN, SIDE = 512, 256  #: dates and series of a tile
PRODUCTS = 3  #: of the matrix with its directions, at most, before these are made orthogonal again; odd, so that signs stay
APART = 1e5  #: how many times the first direction may outgrow the last wanted one by these products
LOST = 1e-13  #: of the first eigenvalue: what rounding may leave of a residual
SENT = 8 << 20  #: bytes of directions, at most, that are sent to every task
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def tiles(df: DataFrame, at: str, series: str, value: str, span: int = SPAN, side: int = SIDE) -> DataFrame:
    """(span, block, cells): cells are (date within the span, series within the block, value). df: a value a date and series at
    most; nulls are left out."""
    df = df.filter(F.col(value).isNotNull())
    rows = df.join(numbered(df, at, "__t"), at).join(numbered(df, series, "__i"), series)
    cell = F.struct((F.col("__t") % span).cast("int").alias("t"), (F.col("__i") % side).cast("int").alias("i"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(F.expr(f"__t div {span}").alias("span"), F.expr(f"__i div {side}").alias("block")).agg(F.collect_list(cell).alias("cells"))


def pair_sums(df: DataFrame, at: str, series: str = "series_id", value: str = "value", span: int = SPAN, side: int = SIDE) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) for i <= j, numbers of series: sums over the dates that both have."""
    own = tiles(df, at, series, value, span, side)
    a, b = (own.select("span", F.col("block").alias(f"block_{k}"), F.col("cells").alias(f"cells_{k}")) for k in "ab")
    met = a.join(b, "span").filter("block_a <= block_b")

    def dense(cells) -> tuple[np.ndarray, np.ndarray]:
        x, m = np.zeros((span, side)), np.zeros((span, side))
        at_, of, v = (np.array([c[k] for c in cells]) for k in ("t", "i", "v"))
        x[at_, of], m[at_, of] = v, 1
        return x, m

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                (x, mx), (y, my) = dense(r.cells_a), dense(r.cells_b)
                sums = (mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y)
                i, j = np.nonzero(sums[0])
                keep = (r.block_a < r.block_b) | (i <= j)
                i, j = i[keep], j[keep]
                yield pd.DataFrame({"i": r.block_a * side + i, "j": r.block_b * side + j} | {k: s[i, j] for k, s in zip(_SUMS, sums)})

    cells = met.mapInPandas(go, "i long, j long, " + ", ".join(f"{k} double" for k in _SUMS))
    return cells.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in _SUMS])


def correlations(df: DataFrame, at: str, series: str = "series_id", value: str = "value", span: int = SPAN, side: int = SIDE) -> DataFrame:
    """(a, b, corr, n) for every two series that share a date, a <= b by name; a pair without spread has none. Values are taken
    from their series' mean first, so that sums of squares lose no digits. df is worked out once: means, numbers and tiles all read it."""
    df = kept(df.select(at, series, value))
    means = df.groupBy(series).agg(F.avg(value).alias("__m"))
    centred = df.join(means, series).select(at, series, (F.col(value) - F.col("__m")).alias(value))
    sums = pair_sums(centred, at, series, value, span, side)
    vx, vy = (F.col(f"s{k}{k}") - F.col(f"s{k}") ** 2 / F.col("n") for k in "xy")
    corr = F.when((vx > 1e-20) & (vy > 1e-20), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    names = numbered(df.filter(F.col(value).isNotNull()), series, "i").select(F.col(series).alias("a"), "i")
    other = names.select(F.col("a").alias("b"), F.col("i").alias("j"))
    return sums.join(names, "i").join(other, "j").select("a", "b", corr.alias("corr"), F.col("n").cast("long").alias("n"))


def _inner(df: DataFrame, n: int, *pairs: tuple[str, str]) -> list[np.ndarray]:
    """For pairs of arrays the n x n sums of their elements' products, which are symmetric: a row of sums a partition is sent."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(pairs), n, n))
        for pdf in batches:
            if len(pdf):
                sums += [np.stack(pdf[a]).T @ np.stack(pdf[b]) for a, b in pairs]
        yield pd.DataFrame({"sums": [sums.ravel().tolist()]})

    sums = sum((np.array(r["sums"]).reshape(len(pairs), n, n) for r in df.mapInPandas(go, "sums array<double>").collect()), np.zeros((len(pairs), n, n)))
    return list((sums + np.swapaxes(sums, 1, 2)) / 2)


def _turned(df: DataFrame, column: str, by: np.ndarray, less: np.ndarray | None = None) -> DataFrame:
    """(a, v): an array times a matrix; less `v` times another, if given."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[column]) @ by
                yield pd.DataFrame({"a": pdf["a"], "v": list(x if less is None else x - np.stack(pdf["v"]) @ less)})

    return df.mapInPandas(go, f"a {df.schema['a'].dataType.simpleString()}, v array<double>")


def _orthonormal(gram: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """What makes vectors of these products, turned, orthonormal: each scaled to length 1, so that small ones count, then all
    moved least. Fewer vectors than directions: the rest is nothing."""
    own = turn.T @ gram @ turn
    length = np.sqrt(np.maximum(np.diag(own), 0))
    scale = np.where(length > 0, 1 / np.maximum(length, 1e-300), 0.0)
    values, vectors = np.linalg.eigh(own * scale[:, None] * scale)
    root = np.where(values > 1e-10, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    return (turn * scale) @ (vectors * root) @ vectors.T


def components(df: DataFrame, at: str, k: int, series: str = "series_id", value: str = "value", rounds: int = 300, tol: float = 1e-8, more: int = 8, **sizes) -> DataFrame:
    """(component, series, loading, eigenvalue, ratio): the first k principal components of the correlation matrix of wide
    panels, by block power iteration on its rows. The matrix is a table of pairs; an iteration is a join on a series' number and
    a sum, and only 2 (k + more)^2 numbers a partition come to the driver: `more` directions are iterated beside the first k, which makes these
    settle sooner. They are settled when a product with the matrix leaves nothing but a multiple of them, to `tol` of it. Pairs that
    share no date, or have no spread, count as uncorrelated.
    Signs: the loading of greatest size is positive."""
    spark = df.sparkSession
    pairs = correlations(df, at, series, value, **sizes)
    both = pairs.filter("corr is not null").select("a", "b", "corr").union(pairs.filter("a != b and corr is not null").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    matrix = kept(both)
    trace = matrix.filter("a = b").agg(F.sum("corr").alias("s")).first()["s"] or 1.0
    wide = k + more
    hashed = [F.pmod(F.xxhash64(F.col("a"), F.lit(c)), F.lit(2001)).cast("double") / 1000 - 1 for c in range(wide)]
    held = kept(matrix.select("a").distinct().withColumn("w", F.array(*hashed)))
    small = held.count() * wide * 8 <= SENT
    mix, products = _orthonormal(*_inner(held, wide, ("w", "w")), np.eye(wide)), 1
    for _ in range(rounds):
        names = [f"w{c}" for c in range(wide)]
        v = _turned(held, "w", mix)
        w = v.select("a", *[F.col("v")[c].alias(n) for c, n in enumerate(names)])
        for _ in range(products):
            w = w.withColumnRenamed("a", "b")
            w = matrix.join(F.broadcast(w) if small else w, "b").groupBy("a").agg(*[F.sum(F.col("corr") * F.col(n)).alias(n) for n in names])
        held = kept(v.join(w.select("a", F.array(*names).alias("w")), "a"))
        # the directions' own plane is solved for its eigenvectors first: a large eigenvalue's then leaves the others' products
        gram, own = _inner(held, wide, ("w", "w"), ("v", "w"))
        values, turn = np.linalg.eigh(own)
        order = np.argsort(-np.abs(values))
        values, turn = values[order], turn[:, order]
        left = _turned(held, "w", turn[:, :k], turn[:, :k] * values[:k])
        off = np.sqrt(np.diag(*_inner(left, min(k, wide), ("v", "v"))))
        size = np.sign(values) * np.abs(values) ** (1 / products)
        v = _turned(held, "v", turn)
        if (off <= tol * np.abs(values[:k]) + LOST * np.abs(values[0])).all():
            break
        mix = _orthonormal(gram, turn)
        products = PRODUCTS if (np.abs(size[0]) ** PRODUCTS <= APART * np.abs(size[:k]).min() ** PRODUCTS) else 1
    each = v.select("a", F.posexplode(F.slice("v", 1, k)).alias("c", "x"))
    sign = each.groupBy("c").agg(F.signum(F.max_by("x", F.abs("x"))).alias("sign"))
    values = spark.createDataFrame([(c, float(s)) for c, s in enumerate(size[:k])], "c int, eigenvalue double")
    out = each.join(sign, "c").join(F.broadcast(values), "c")
    return out.select((F.col("c") + 1).alias("component"), F.col("a").alias("series"), (F.col("x") * F.col("sign")).alias("loading"), "eigenvalue", (F.col("eigenvalue") / trace).alias("ratio"))
