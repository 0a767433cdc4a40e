"""The folder that driver and executors share, and rows that are kept there or sent to all tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a list of keys or numbers that goes to every task.
SMALL_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset, a temporary folder takes its
    place on one machine, as in tests; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: driver and executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that losing executors loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, most: int = SMALL_ROWS) -> bool:
    """Whether df, which should be cheap to count, has at most so many rows."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, of narrow rows and cheap to count, with a hint to broadcast it if it has `most` rows or fewer."""
    return F.broadcast(df) if is_small(df, most) else df


def file_row() -> Column:
    """A key of each row of a table that is read from Parquet files: the file, by 96 bits of hashes of its path, and the row's
    number there."""
    path = F.col("_metadata.file_path")
    return F.struct(F.xxhash64(path).alias("file"), F.hash(path).alias("check"), F.col("_metadata.row_index").alias("row"))
