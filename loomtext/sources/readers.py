"""Reading files into documents (source, format, block, text) and writing results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Suffixes that are read, and how (fixed values).
FORMATS = {"txt": "text", "md": "text", "csv": "rows", "json": "flat"}


def whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """source, format, text of all files below a folder with a suffix that is read; blank files and bytes that are no
    text are left out. One row a file, read on the executors."""
    suffixes = ",".join(FORMATS)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{suffixes}}}").format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    # Bytes that are no text become the replacement character, which is taken out.
    text = F.btrim(F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit("")), F.lit(" \t\r\n"))
    return files.select(name.alias("source"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("format"), text.alias("text")).where("text <> ''")


def flattened(value, prefix: str = "") -> list[str]:
    """Lines `path: value` of parsed JSON; places in lists in brackets."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flattened(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flattened(v, f"{prefix}[{i}]")]
    return [f"{prefix}: {value}" if prefix else str(value)]


@F.pandas_udf(StringType())
def json_lines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON text as lines of paths and values; text that isn't JSON stays as it is."""
    import json

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else "\n".join(flattened(json.loads(t)))
        except ValueError:
            return t

    for texts in batches:
        yield texts.map(one)


@F.pandas_udf(ArrayType(StringType()))
def csv_rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The rows of CSV texts below their headers, fields joined by commas; rows without anything in them are left out. Quoted
    fields may hold commas and line ends."""
    import csv
    import io

    for texts in batches:
        yield texts.map(lambda t: [",".join(r) for r in list(csv.reader(io.StringIO(t or "")))[1:] if any(x.strip() for x in r)])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """source, format, block, text: a block for each row of a CSV file (without its header, fields joined by commas, blank
    rows dropped), one for any other file."""
    files = whole_files(spark, folder)
    rows = files.where("format = 'csv'").select("source", "format", F.posexplode(csv_rows("text")).alias("block", "text"))
    rest = files.where("format <> 'csv'").select("source", "format", F.lit(0).alias("block"), F.when(F.col("format") == "json", json_lines("text")).otherwise(F.col("text")).alias("text"))
    return rows.unionByName(rest)


def ensured(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a JSON folder; built and written first if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        build().write.json(folder)
    return spark.read.json(folder)


def eval_set(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """question, ground_truth, contexts of a file that holds one JSON array; the first `limit` of them."""
    rows = spark.read.schema("question string, ground_truth string, contexts array<string>").option("multiLine", True).json(path)
    return rows.limit(limit) if limit is not None else rows


def built_eval_set(sections: DataFrame, cases: DataFrame) -> DataFrame:
    """sections(source, header, chunk), cases(question, ground_truth, picks array<struct<source, header>>): question,
    ground_truth, contexts, the chunks of the picked sections in the order of the picks. Picks without a section give none."""
    picks = cases.select("question", "ground_truth", F.posexplode_outer("picks").alias("at", "pick"))
    found = picks.join(sections, (F.col("pick.source") == F.col("source")) & (F.col("pick.header") == F.col("header")), "left")
    held = F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("at", "chunk"))))
    return found.groupBy("question", "ground_truth").agg(F.transform(held, lambda x: x["chunk"]).alias("contexts"))


def write_sidecar(chunks: DataFrame, folder: str) -> None:
    """All chunks, with an id each, beside an index."""
    chunks.write.mode("overwrite").json(folder)


def sidecar(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The chunks of a sidecar, to be joined by id."""
    return spark.read.schema(schema).json(folder)


def numbered(spark: SparkSession, folder: str) -> DataFrame:
    """documents() with ids doc-0, doc-1, ... in the order of sources and blocks. Files are counted by source, so that only
    the list of sources is put in one order."""
    rows = documents(spark, folder)
    order = W.orderBy("source", "format").rowsBetween(W.unboundedPreceding, -1)
    first = rows.groupBy("source", "format").agg(F.count("*").alias("n")).select("source", "format", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    within = W.partitionBy("source", "format").orderBy("block", "text")
    number = F.col("first") + F.row_number().over(within) - 1
    return rows.join(first, ["source", "format"]).select(F.concat(F.lit("doc-"), number.cast("string")).alias("id"), "source", "format", "block", "text")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """question, contexts, answer, reference of a file with a JSON object on each line; blank lines are skipped."""
    return spark.read.schema("question string, contexts array<string>, answer string, reference_answer string").json(path).where("question is not null")


def product_sentences(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of products as sentences, beside typed columns."""
    rows = spark.read.csv(path, header=True, schema="product string, category string, price_usd double, stock int, region string")
    return rows.withColumn("text", F.format_string("%s is a %s product at %.2f USD with %d in stock in %s.", "product", "category", "price_usd", "stock", "region"))


def write_report(scores: DataFrame, folder: str) -> None:
    """Mean of each metric(metric, score) as JSON, a small table."""
    scores.groupBy("metric").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(folder)


def write_markdown(scores: DataFrame, folder: str) -> None:
    """The same means as a Markdown table."""
    means = scores.groupBy("metric").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n"))
    row = F.format_string("| %s | %s | %d |", "metric", F.col("mean").cast("string"), "n")
    lines = F.concat(F.array(F.lit("| metric | mean | n |"), F.lit("|-|-|-|")), F.transform(F.array_sort(F.collect_list(F.struct("metric", row.alias("line")))), lambda x: x["line"]))
    means.agg(F.array_join(lines, "\n").alias("value")).coalesce(1).write.mode("overwrite").text(folder)  # a row for each metric


def append_trace(records: DataFrame, folder: str) -> None:
    records.write.mode("append").json(folder)
