"""What several operators share: reading tables, folds, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.graph import components
from loomtext.operators.shared import deleted, file_row, saved, shared_folder, small  # noqa: F401


#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches for Python workers hold BATCH_ROWS rows at most: with Spark's 10,000, texts of 100 KB would make 1 GB
    each in the worker and in its executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of DataFrames made here are deleted after an action on them: for steps that are saved, each at once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of the column's text, so that what a worker makes of them stays small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, mod 5; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5, F.lit(-1))


def utf8(column: str) -> Column:
    """The text as bytes; a null text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v): pairs of longs. Returns (node, component): for every node of an edge the smallest node that can be
    reached."""
    return components(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")))
