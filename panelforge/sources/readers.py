"""Readers: CSV with stated types, multi-block CSV, JSON run records, dense arrays, date lists."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept

NULLS = ("-99.99", "-999", "-99.9900")


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, date: str | None = None, date_format: str = "yyyy-MM-dd", infer: bool = False
) -> DataFrame:
    """CSV with a header. Without a schema every column is a string, so that no pass is spent on guessing, unless infer asks
    for it."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", infer)).csv(path)
    return df.withColumn(date, F.try_to_date(F.col(date).cast("string"), date_format)) if date else df


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


# --- several tables in one file ---


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of one file, from 1, whatever the splits it is read in: lines are counted by split, and a line's number is
    that of its split's first line and its place among the split's rows. Lines end with a newline, with or without a carriage
    return before it. A file that isn't UTF-8 throughout is taken for Latin-1, in which every byte is a character."""
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"))
    rows = kept(raw.withColumn("id", F.monotonically_increasing_id()))  # ids are of one reading
    splits = rows.groupBy("split").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("utf8"))
    before = splits.alias("a").join(splits.alias("b"), F.expr("b.split < a.split"), "left").groupBy("a.split", "a.first").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    both = rows.join(F.broadcast(before), "split").crossJoin(F.broadcast(splits.agg(F.bool_and("utf8").alias("utf8"))))
    text = F.when(F.col("utf8"), F.col("raw").cast("string")).otherwise(F.decode("raw", "ISO-8859-1"))
    lines = both.select((F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), F.regexp_replace(text, r"\r$", "").alias("text"))
    # what follows the last newline is a line too, if an empty one, which the reader leaves out
    ends = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("raw") + 1).alias("bytes"), F.max("size").alias("size")).filter("bytes = size")
    return lines.union(ends.select((F.col("n") + 1).alias("line"), F.lit("").alias("text")))


def find_blocks(
    spark: SparkSession, path: str, keywords: Sequence[str], least_header: int = 3, least_data: int = 3, look_back: int = 5, apart: int = 2
) -> list[dict]:
    """Blocks of a file: {name, marker_line, header_line}. A title has a keyword or is set off by '--'; a header has commas
    below it in the data's number and stands within look_back lines after its title. Titles closer than `apart` are one.
    Titles and the blocks found are collected; headers and data lines are joined to the titles' surroundings only."""
    commas = F.length("text") - F.length(F.replace("text", F.lit(",")))
    said = F.col("text").rlike("|".join(f"(?i){re.escape(k)}" for k in keywords)) if keywords else F.lit(False)
    lines = numbered_lines(spark, path)
    titles = lines.filter((said | F.trim("text").rlike(r"^--.*--$|--")) & (commas < least_header) & (F.trim("text") != "")).select("line", "text").orderBy("line")
    kept: list[dict] = []
    for r in titles.collect():
        if not kept or r["line"] - kept[-1]["marker_line"] > apart:
            kept.append({"name": r["text"].strip().strip("-").strip(), "marker_line": r["line"]})
    if not kept:
        return []

    def after(df: DataFrame, column: str) -> DataFrame:
        return df.select("*", F.explode(F.sequence(F.col(column) + 1, F.col(column) + look_back)).alias("line"))

    numeric = F.ltrim("text").rlike(r"^\d")
    heads = lines.filter((commas >= least_header) & ~numeric).select("line")
    data = lines.filter((commas >= least_data) & numeric).select("line")
    marks = spark.createDataFrame([(k["marker_line"],) for k in kept], "marker int")
    first = after(marks, "marker").join(heads, "line").groupBy("marker").agg(F.min("line").alias("header"))
    found = {r["marker"]: r["header"] for r in after(first, "header").join(data, "line", "left_semi").select("marker", "header").distinct().collect()}
    return [k | {"header_line": found[k["marker_line"]]} for k in kept if k["marker_line"] in found]


def read_block(spark: SparkSession, path: str, header_line: int, before_line: int | None = None, nulls: Sequence[str] = NULLS, date_format: str = "yyyyMM") -> DataFrame:
    """One block as (Date, <series> double): rows whose first cell is a numeric date, other cells cast where they can be,
    null tokens and failures NULL; rows with more than one value, in the order of dates."""
    lines = numbered_lines(spark, path)
    header = lines.filter(F.col("line") == header_line).first()["text"]
    names = [n.strip() for n in header.split(",")][1:]
    body = lines.filter((F.col("line") > header_line) & (F.col("line") < (before_line or 2**31 - 1)))
    cells = body.select(F.transform(F.split("text", ","), F.trim).alias("c")).filter(F.get("c", F.lit(0)).rlike(r"^\d+$"))
    date = F.try_to_date(F.get("c", F.lit(0)), date_format)
    values = [F.when(F.get("c", F.lit(i + 1)).isin(*nulls), F.lit(None)).otherwise(F.get("c", F.lit(i + 1)).try_cast("double")).alias(n) for i, n in enumerate(names)]
    out = cells.select(date.alias("Date"), *values).filter("Date is not null")
    present = sum((F.col(f"`{n}`").isNotNull().cast("int") for n in names), F.lit(0))
    return out.filter(present > F.lit(min(1, len(names) - 1))).orderBy("Date")


# --- run records ---


def read_records(spark: SparkSession, base: str, schema: str | None = None, name: str = "metrics*.json") -> DataFrame:
    """JSON records below a folder, one file each, with study_id and run_label from the path. With a schema, a file that
    can't be read gives a row with json_read_error and no values."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("allowNonNumericNumbers", True)
    if schema:
        df = reader.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(base)
        df = df.withColumn("json_read_error", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")
    else:
        df = reader.json(base)
    path = F.input_file_name()
    return df.withColumns({"study_id": F.regexp_extract(path, r"/([^/]+)/[^/]+/[^/]+$", 1), "run_label": F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)})


def read_arrays(spark: SparkSession, path: str, glob: str = "*.np[yz]") -> DataFrame:
    """(path, name, shape, values) of NPY and NPZ files, flat and row-major. Pickled objects are refused."""
    def load(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                for n, a in got.items() if hasattr(got, "items") else [("array", got)]:
                    rows.append((p, n, list(a.shape), a.astype(float).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["path", "name", "shape", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(load, "path string, name string, shape array<int>, values array<double>")


def read_dates(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """(t, date) of a text file with one date a line."""
    lines = numbered_lines(spark, path).filter(F.trim("text") != "")
    return lines.select((F.col("line") - 1).alias("t"), F.try_to_date(F.trim("text"), date_format).alias("date"))
