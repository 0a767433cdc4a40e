"""Files that come into a folder, as chunks in a stored collection, each file once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.operators.chunk import markdown_chunks
from loomtext.sources.stored import Collection

#: Of a collection that files are ingested into.
CHUNKS = "id string, source string, chunk_index int, text string"


def chunked(files: DataFrame, cut: Column) -> DataFrame:
    """files(source, text): id (source and number), source, chunk_index, text."""
    rows = files.select("source", F.posexplode(cut).alias("chunk_index", "text"))
    return rows.select(F.concat_ws("#", "source", F.col("chunk_index").cast("string")).alias("id"), "source", "chunk_index", "text")


def created(spark: SparkSession, folder: str, buckets: int = 64) -> Collection:
    """A collection for chunks; those of a file share a bucket."""
    schema = spark.createDataFrame([], CHUNKS).schema
    return Collection.create(spark, folder, schema, "id", "source", buckets)


def merged(collection: Collection, files: DataFrame, batch: int | None = None, name: str = "files", size: int = 600, overlap: int = 80) -> int | None:
    """files(source, text). A file's chunks take the place of those it had; a batch that was merged before changes nothing."""
    files = files.groupBy("source").agg(F.max("text").alias("text"))
    split = markdown_chunks(size, overlap)
    chunks = chunked(files, split("text"))
    return collection.replace(chunks, files.select("source"), None if batch is None else name, batch)


def ingested(spark: SparkSession, folder: str, collection: Collection, checkpoint: str, suffix: str = "md", name: str = "files", files: int = 1000) -> StreamingQuery:
    """Takes in the files below the folder that no run with this checkpoint has seen, then ends. The checkpoint says which
    files a batch holds, and the collection which batches it has merged, so that a run that dies between the two repeats a batch
    without effect. Blank files remove what they held before."""
    raw = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").option("maxFilesPerTrigger", files).format("binaryFile").load(folder)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    # The path below the folder names a file.
    below = F.regexp_extract("path", r"^(?:[a-z0-9]+:/*)?(.*)$", 1)
    base = folder.split(":", 1)[-1].strip("/")
    source = F.regexp_replace(F.ltrim(F.replace(below, F.lit(base), F.lit(""))), "^/+", "")
    rows = raw.select(source.alias("source"), text.alias("text"))
    query = rows.writeStream.foreachBatch(lambda df, batch: merged(collection, df, batch, name) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
