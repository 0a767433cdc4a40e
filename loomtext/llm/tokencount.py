"""Token counts of whole texts by transducers whose transitions carry the counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import table
from loomtext.llm.transducer import TokenCounter

#: Code points that one step handles, so that its arrays stay small beside the batch.
SLICE = 500_000


def slices(texts: list[str], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts that hold up to `most` code points, or one text."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


@lru_cache(1)
def shared_counter(vocabulary: str) -> TokenCounter:
    """A Python worker keeps what it has compiled for its next tasks."""
    return TokenCounter(vocabulary)


def _counter(vocabulary: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_counter(vocabulary)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = [n for a, b in slices(texts) for n in counter.count(texts[a:b]).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """docs(doc_id, text), other columns ignored. Returns (doc_id, n_bytes, n_tokens, over_limit), a row for each row.

    vocabulary: the path of a byte-level BPE file, the same on all executors. A null text counts as empty: no bytes,
    no tokens. Ids may be null or repeat. An empty table gives no rows. There is no shuffle: a text is counted where
    it is read, in slices, so that memory is bounded by the longest text."""
    texts = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("text", F.lit("")).alias("text")
    )
    return texts.mapInArrow(_counter(vocabulary), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
