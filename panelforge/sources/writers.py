"""Writers. Spark's commit protocol makes output whole or absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shown

TABLE_ROWS = 10_000  #: a table for reading has no more


def write(df: DataFrame, path: str, single: bool = False, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Parquet, CSV or JSON by the path's ending; without one, Parquet. single: one file."""
    kind = path.rsplit(".", 1)[-1] if path.rsplit("/", 1)[-1].count(".") else "parquet"
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"no such format: {kind}")
    out = (df.coalesce(1) if single else df).write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)


def write_arrays(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Array columns as Parquet; columns that are NULL throughout are left out."""
    full = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    df.select(*[c for c in df.columns if full[c]]).write.mode(mode).parquet(path)


def _rows(df: DataFrame, digits: int) -> tuple[list[str], list[list[str]]]:
    text = df.select(*[shown(c, digits).alias(c) if t in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c, t in df.dtypes])
    got = text.limit(TABLE_ROWS + 1).collect()
    if len(got) > TABLE_ROWS:
        raise ValueError(f"a table of more than {TABLE_ROWS} rows isn't for reading")
    return df.columns, [list(r) for r in got]


def markdown(df: DataFrame, digits: int = 4) -> str:
    names, rows = _rows(df, digits)
    return "\n".join("| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *rows]) + "\n"


def latex(df: DataFrame, digits: int = 4, caption: str = "", label: str = "") -> str:
    """A booktabs table."""
    names, rows = _rows(df, digits)
    def plain(s: str) -> str:
        return "".join("\\" + c if c in "_%&#$" else c for c in s)

    body = " \\\\\n".join(" & ".join(map(plain, r)) for r in rows)
    head = [r"\begin{table}[htbp]", r"\centering"] + ([rf"\caption{{{caption}}}"] if caption else []) + ([rf"\label{{{label}}}"] if label else [])
    table = [rf"\begin{{tabular}}{{{'l' * len(names)}}}", r"\toprule", " & ".join(map(plain, names)) + r" \\", r"\midrule", body + r" \\", r"\bottomrule"]
    return "\n".join([*head, *table, r"\end{tabular}", r"\end{table}", ""])
