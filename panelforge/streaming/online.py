"""The information filter as a streaming operator.

Input (run_id, t, y), output one row for each accepted row. State for each run: the mode, both information blocks, the
last t, the log likelihood and how many rows came late. Rows of a batch are applied in the order of t; rows at or before
the last t are late, counted and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..kernels import filters
from ..kernels.params import Params

OUT = "run_id string, t int, state array<double>, loglik double, total_loglik double, late bigint"
STATE = "f array<double>, h array<double>, cov_f array<double>, cov_h array<double>, t int, loglik double, late bigint"


class Carry:
    """One run's state between observations."""

    def __init__(self, p: Params) -> None:
        self.b, self.k = filters.Batch.of([p]), p.K
        self.f, self.h = np.zeros(p.K), np.array(p.mu, float)
        self.cov_f, self.cov_h = np.eye(p.K), filters.lyapunov(p.Phi_h, p.Q_h)
        self.t, self.loglik, self.late = -1, 0.0, 0

    def step(self, y: np.ndarray) -> float:
        """One prediction and update; the same arithmetic as the batch filter's."""
        k, b = self.k, self.b
        w_f, w_h = (np.linalg.inv(c + 1e-6 * np.eye(k) if self.t < 0 else c)[None] for c in (self.cov_f, self.cov_h))
        part = filters.run_filter_from(b, y[None, None, :], self.f[None], self.h[None], w_f, w_h)
        self.f, self.h = part.alpha[0, -1, :k], part.alpha[0, -1, k:]
        self.cov_f, self.cov_h = part.cov_f[0, -1], part.cov_h[0, -1]
        self.loglik += float(part.loglik[0, -1])
        return float(part.loglik[0, -1])

    def row(self) -> tuple:
        return (self.f.tolist(), self.h.tolist(), self.cov_f.ravel().tolist(), self.cov_h.ravel().tolist(), int(self.t), float(self.loglik), int(self.late))

    def restore(self, row) -> None:
        f, h, cov_f, cov_h, self.t, self.loglik, self.late = row
        self.f, self.h = np.array(f), np.array(h)
        self.cov_f, self.cov_h = np.array(cov_f).reshape(self.k, self.k), np.array(cov_h).reshape(self.k, self.k)

    def take(self, run_id: str, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t, y in sorted(zip(pdf["t"], pdf["y"]), key=lambda r: r[0]):
            if t <= self.t:
                self.late += 1
                continue
            ll = self.step(np.array(y, float))
            self.t = int(t)
            rows.append((run_id, self.t, [*self.f.tolist(), *self.h.tolist()], ll, self.loglik, self.late))
        return pd.DataFrame(rows, columns=["run_id", "t", "state", "loglik", "total_loglik", "late"])


class OnlineFilter(StatefulProcessor):
    def __init__(self, params: Params) -> None:
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("carry", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        carry = Carry(self.params)
        if self.state.exists():
            carry.restore(self.state.get())
        got = [r for r in rows if len(r)]
        if got:
            yield carry.take(key[0], pd.concat(got))
            self.state.update(carry.row())

    def close(self) -> None:
        pass


def filter_stream(rows: DataFrame, params: Params) -> DataFrame:
    """rows: a stream (run_id, t, y). Needs the RocksDB state store."""
    return rows.groupBy("run_id").transformWithStateInPandas(OnlineFilter(params), OUT, "Append", "None")
