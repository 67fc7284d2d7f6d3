"""Linear state-space runs of any length, spread over tasks in time.

A run's steps are dealt into blocks of FAN consecutive ones. Each block reduces to one element of a few K x K matrices, in its
own task; the elements are rows, and are scanned in the same way, block by block, until one block is left; then every block
learns the state before it, or after it when smoothing, and finishes alone. No task holds more than FAN rows of a run, and
what is shuffled beside the rows is one element a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import scan
from ..kernels.scan import Linear

FAN = 4096
_STATES = "run_id string, t long, state array<double>, cov array<double>, loglik double"
_ELEMENT = "run_id string, i long, e array<double>"


def _packed(e: scan.Element) -> list[list[float]]:
    return np.concatenate([x.reshape(len(x), -1) for x in e], 1).tolist()


def _element(rows: list, k: int, parts: tuple[int, ...]) -> scan.Element:
    """Elements of packed rows; parts: 2 for a matrix, 1 for a vector."""
    flat = np.array(rows, float).reshape(len(rows), -1)
    cuts = np.cumsum([k**p for p in parts])[:-1]
    return tuple(x.reshape(len(rows), *[k] * p) for x, p in zip(np.split(flat, cuts, 1), parts))


FILTERING, SMOOTHING = (2, 1, 2, 1, 2), (2, 1, 2)


def _carried(elements: DataFrame, k: int, parts: tuple[int, ...], combine: Callable, fan: int, blocks: int) -> DataFrame:
    """(run_id, i, e): for each element, all before it in the order of i combined, none for the first. elements: (run_id, i, e)
    with i from 0 on; blocks: how many a run has at most."""
    schema = _ELEMENT

    def before(pdf: pd.DataFrame, carry: list | None) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        own = _element(pdf["e"].tolist(), k, parts)
        if carry is not None:
            own = tuple(np.concatenate([c, x]) for c, x in zip(_element([carry], k, parts), own))
        done = _packed(scan.prefix(own, combine))
        return pd.DataFrame({"run_id": pdf["run_id"], "i": pdf["i"], "e": [None, *done[:-1]] if carry is None else done[:-1]})

    dealt = elements.withColumn("b", F.expr(f"i div {fan}"))
    if blocks <= fan:
        return elements.groupBy("run_id").applyInPandas(lambda pdf: before(pdf, None), schema)

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = scan.reduced(_element(pdf.sort_values("i")["e"].tolist(), k, parts), combine)
        return pd.DataFrame({"run_id": [key[0]], "i": [key[1]], "e": _packed(own)})

    above = _carried(dealt.groupBy("run_id", "b").applyInPandas(whole, schema), k, parts, combine, fan, -(-blocks // fan))

    def finished(key: tuple, pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        return before(pdf, carry["e"].iloc[0] if len(carry) else None)

    return dealt.groupBy("run_id", "b").cogroup(above.withColumnRenamed("i", "b").groupBy("run_id", "b")).applyInPandas(_some(finished, _ELEMENT), schema)


def _some(finish: Callable, schema: str) -> Callable:
    """finish, for groups that have rows on the left, with a carry that is missing or null as none."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return finish(key, left, right[right["e"].notna()]) if len(left) else pd.DataFrame(columns=names)

    return run


def _y(pdf: pd.DataFrame, n: int) -> np.ndarray:
    return np.array([[np.nan] * n if v is None else [np.nan if x is None else x for x in v] for v in pdf["y"]], float).reshape(len(pdf), n)


def _blocks(df: DataFrame, fan: int) -> int:
    """How many blocks the longest run has."""
    return int(df.agg(F.coalesce(F.max(F.expr(f"t div {fan}")), F.lit(0)).alias("b")).first()["b"]) + 1


def filter_long_df(panel: DataFrame, m: Linear, fan: int = FAN) -> DataFrame:
    """(run_id, t, state, cov, loglik): the Kalman filter of runs (run_id, t, y), t from 0 on without gaps; y is an array, and
    one that is null or holds a null or NaN is a step without an observation, whose log likelihood is 0. The first step
    predicts from a state of mean 0 and unit covariance."""
    n, k = m.lam.shape
    rows = panel.select(F.col("run_id").cast("string").alias("run_id"), F.col("t").cast("long").alias("t"), "y").withColumn("b", F.expr(f"t div {fan}"))

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = scan.reduced(scan.filtering_elements(m, _y(pdf.sort_values("t"), n)), scan.combine_filtering)
        return pd.DataFrame({"run_id": [key[0]], "i": [key[1]], "e": _packed(own)})

    def finished(key: tuple, pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        start = scan.of_state(np.zeros(k), np.eye(k))
        if len(carry):
            start = scan.combine_filtering(start, _element([carry["e"].iloc[0]], k, FILTERING))
        x, p, ll = scan.filtered(m, _y(pdf, n), start[1][0], start[2][0])
        return pd.DataFrame({"run_id": key[0], "t": pdf["t"].to_numpy(), "state": list(x), "cov": list(p.reshape(len(p), -1)), "loglik": ll})

    elements = rows.groupBy("run_id", "b").applyInPandas(whole, _ELEMENT)
    before = _carried(elements, k, FILTERING, scan.combine_filtering, fan, _blocks(rows, fan)).withColumnRenamed("i", "b")
    return rows.groupBy("run_id", "b").cogroup(before.groupBy("run_id", "b")).applyInPandas(_some(finished, _STATES), _STATES)


def smooth_long_df(states: DataFrame, m: Linear, fan: int = FAN) -> DataFrame:
    """(run_id, t, state, cov): the Rauch-Tung-Striebel smoother of filter_long_df() states. Blocks are scanned from the last
    step backward."""
    k = m.k
    last = states.groupBy("run_id").agg(F.max("t").alias("last"))
    rows = states.select("run_id", "t", "state", "cov").join(last, "run_id").withColumn("back", F.col("last") - F.col("t")).withColumn("b", F.expr(f"back div {fan}"))
    schema = "run_id string, t long, state array<double>, cov array<double>"

    def own(pdf: pd.DataFrame) -> scan.Element:
        """Elements from the last step backward."""
        x, p = np.array(pdf["state"].tolist(), float), np.array(pdf["cov"].tolist(), float).reshape(-1, k, k)
        return tuple(v[::-1] for v in scan.smoothing_elements(m, x[::-1], p[::-1], pdf["back"].iloc[0] == 0))[0:3]

    def in_time(pdf: pd.DataFrame) -> scan.Element:
        return own(pdf.sort_values("back"))

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "i": [key[1]], "e": _packed(scan.reduced(in_time(pdf), scan.combine_smoothing))})

    def finished(key: tuple, pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("back")
        e = in_time(pdf)
        if len(carry):
            e = tuple(np.concatenate([c, x]) for c, x in zip(_element([carry["e"].iloc[0]], k, SMOOTHING), e))
        _, x, p = (v[-len(pdf) :] for v in scan.prefix(e, scan.combine_smoothing))
        return pd.DataFrame({"run_id": key[0], "t": pdf["t"].to_numpy(), "state": list(x), "cov": list(((p + np.swapaxes(p, -1, -2)) / 2).reshape(len(p), -1))})

    elements = rows.groupBy("run_id", "b").applyInPandas(whole, _ELEMENT)
    after = _carried(elements, k, SMOOTHING, scan.combine_smoothing, fan, _blocks(rows.select(F.col("back").alias("t")), fan)).withColumnRenamed("i", "b")
    return rows.groupBy("run_id", "b").cogroup(after.groupBy("run_id", "b")).applyInPandas(_some(finished, schema), schema)
