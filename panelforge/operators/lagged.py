"""Lagged cross-covariances of runs of any length, and the portmanteau tests that need nothing else.

Steps are dealt into blocks; a block also gets the last steps of the one before it, its halo, and sums the products of its
own steps with those before. Sums of blocks merge: only N x N numbers a lag meet, whatever the run's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.special import chi2_sf

BLOCK = 4096


def cross_covariances(panel: DataFrame, lags: int, run: str = "run_id", block: int = BLOCK) -> DataFrame:
    """(run, h, i, j, t, value) for h from 0 to lags: the sum over steps of (y_t - m)_i (y_{t-h} - m)_j, divided by the number
    of steps, t. panel: (run, t, y), t without gaps; a row with a null or NaN is no step, and its products are left out."""
    rows = panel.select(run, F.col("t").cast("long").alias("t"), "y").filter(F.forall("y", lambda x: x.isNotNull() & ~F.isnan(x)))
    means = rows.select(run, F.posexplode("y")).groupBy(run, "pos").agg(F.avg("col").alias("m"), F.count("*").alias("n")).groupBy(run).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("m"), F.max("n").alias("n"))
    centred = rows.join(means, run).select(run, "t", "n", F.zip_with("y", "m", lambda a, b: a - b).alias("y"))
    home = F.expr(f"t div {block}")
    # the last steps of a block are a halo of the next ones, of as many as the lags reach into
    reach = range(1, -(-lags // block) + 1)
    halos = [F.when(F.expr(f"t + {lags} >= (t div {block} + {b}) * {block}"), home + b) for b in reach]
    dealt = centred.withColumn("home", home).withColumn("b", F.explode(F.filter(F.array(home, *halos), lambda x: x.isNotNull())))

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["home"] == key[1]]
        if not len(own):
            return pd.DataFrame(columns=["run", "h", "i", "j", "t", "s"])
        first = pdf["t"].min()
        y = np.zeros((int(pdf["t"].max() - first) + 1, len(own["y"].iloc[0])))
        y[(pdf["t"] - first).to_numpy()] = np.array(pdf["y"].tolist(), float)  # steps that are missing add nothing
        at = (own["t"] - first).to_numpy()
        parts = []
        for h in range(lags + 1):
            back = at[at >= h]
            s = y[back].T @ y[back - h]
            i, j = np.indices(s.shape)
            parts.append(pd.DataFrame({"run": key[0], "h": h, "i": i.ravel(), "j": j.ravel(), "t": int(own["n"].iloc[0]), "s": s.ravel()}))
        return pd.concat(parts)

    kind = panel.schema[run].dataType.simpleString()
    cells = dealt.groupBy(run, "b").applyInPandas(sums, f"run {kind}, h int, i int, j int, t long, s double")
    return cells.groupBy(F.col("run").alias(run), "h", "i", "j", "t").agg((F.sum("s") / F.col("t")).alias("value"))


def portmanteau_df(panel: DataFrame, lags: int, run: str = "run_id", fitted: int = 0, block: int = BLOCK) -> DataFrame:
    """(run, test, lags, statistic, dof, p_value): Hosking's and Li and McLeod's tests of no autocorrelation in runs of any
    length. A run whose covariance is singular has no statistic."""
    packed = cross_covariances(panel, lags, run, block).groupBy(run, "t").agg(F.array_sort(F.collect_list(F.struct("h", "i", "j", "value"))).alias("c"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, t, cells in zip(pdf[run], pdf["t"], pdf["c"]):
                n = round((len(cells) / (lags + 1)) ** 0.5)
                c = np.array([x["value"] for x in cells], float).reshape(lags + 1, n, n)
                dof, hosking, plain = n * n * lags - fitted, None, None
                if np.linalg.cond(c[0]) < 1e12:
                    inv = np.linalg.inv(c[0])
                    terms = np.array([np.trace(x.T @ inv @ x @ inv) for x in c[1:]])
                    hosking, plain = float((terms * t * t / (t - np.arange(1, lags + 1))).sum()), float(t * terms.sum() + n * n * lags * (lags + 1) / (2 * t))
                out += [(name, k, lags, q, dof, None if q is None else chi2_sf(q, dof)) for k, q in (("hosking", hosking), ("limcleod", plain))]
            yield pd.DataFrame(out, columns=[run, "test", "lags", "statistic", "dof", "p_value"])

    kind = panel.schema[run].dataType.simpleString()
    return packed.mapInPandas(go, f"{run} {kind}, test string, lags int, statistic double, dof int, p_value double")
