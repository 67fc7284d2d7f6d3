"""Table functions that SQL can call once register() has named them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


class GarchPath:
    """garch_path(TABLE(t) PARTITION BY series ORDER BY (at), omega, alpha, beta, start): (series, i, variance) of each partition's
    values: conditional variances at stated parameters, from i = 1 on. t has columns series and value; rows come in the order
    that the call states, and only the last variance is held. Null values are left out."""

    def __init__(self) -> None:
        self.now, self.i = None, 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, omega: AnalyzeArgument, alpha: AnalyzeArgument, beta: AnalyzeArgument, start: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in rows.dataType.fields} if rows.isTable else {}
        for name in ("series", "value"):
            if name not in kinds:
                raise ValueError(f"garch_path needs a table with a column {name}")
        return AnalyzeResult(schema=StructType([StructField("series", kinds["series"]), StructField("i", IntegerType()), StructField("variance", DoubleType())]))

    def eval(self, row: Row, omega, alpha, beta, start) -> Iterator[tuple]:
        if row["value"] is None:
            return
        self.now = float(start) if self.now is None else self.now
        self.i += 1
        yield row["series"], self.i, self.now
        self.now = float(omega) + float(alpha) * float(row["value"]) ** 2 + float(beta) * self.now


def register(spark: SparkSession) -> None:
    spark.udtf.register("garch_path", udtf(GarchPath))
