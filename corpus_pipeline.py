"""A corpus from raw documents to packed sequences. Each stage's rows are written as Parquet, and the next reads them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, langid, nearcopies, packing, secrets
from loomtext.llm.common import bounded_batches, deleted, file_row, shared_folder, table

#: Texts of this many characters or more go if their language's filter knows less than this share of their n-grams.
LONG_ENOUGH, LEAST_COVERAGE = 40, 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Those without a letter go, and those too long to be chance that no filter covers.
    The decision is a function of the text, so it is made where the text is and nothing is shuffled. Null and empty texts have
    no letter and go, whatever their other columns say; repeated rows, also of equal or null ids, stay or go together; of rows
    without a language nothing is learned. Without any language to learn all texts with a letter stay; an empty table stays one."""
    bounded_batches(spark)
    model = langid.model_of(docs)
    return langid.kept(docs, model, LONG_ENOUGH, LEAST_COVERAGE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts whose sets of 5-word shingles overlap by 0.8 or more;
    of repeated ids one row, rows without an id all. Null and empty texts are copies of each other; an empty table stays one."""
    bounded_batches(spark)
    return nearcopies.representatives(docs, key=file_row() if docs.inputFiles() else None)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Rows with a null id or text stay, repeated rows are judged each on their
    own; either table may be empty."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null, repeated rows and an empty table as they are."""
    bounded_batches(spark)
    return secrets.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' token ids in sequences of up to 2,048. A null or empty text is its end token; repeated
    rows, also of equal or null ids, are packed each on their own; an empty table gives no rows."""
    bounded_batches(spark)
    return packing.digest(packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("secret_spans", secret_spans), ("sequences", sequences)]
#: SQL can express none of language, fingerprints, alignment and packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: as the stages define them for null ids and texts, repeated rows and empty tables. What a
    stage wrote is deleted when the next one's rows are written; the last one's stay in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(written := f"{folder}/{i}_{name}")
        docs = spark.read.parquet(written)
        if before:
            deleted(spark, before)
        before = written
    return docs
