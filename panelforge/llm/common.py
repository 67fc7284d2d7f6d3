"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space. bytes.split() cuts at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the session. Where none is set, a local session gets one of its
    own; a cluster's is refused, as its executors couldn't read what the driver's machine holds."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _on_storage(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lost executors don't lose it, and its plan is cut.

    Results are lazy and may read a staged table until the session's end, so tables go when the driver's JVM exits; those
    that a loop has superseded go at once by `dropped`.
    """
    spark = df.sparkSession
    run = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"
    path = f"{run}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _on_storage(spark, run)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        files, at = _on_storage(df.sparkSession, path)
        files.delete(at, True)


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: bytes) -> list[bytes]:
    return text.split()


def utf8(column) -> list[bytes | None]:
    """An Arrow string column as bytes objects."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """Python stages get their rows in batches of few bytes, so that workers stay small however long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def bare(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns named, under the names given: extra columns and clashing names stay behind."""
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
