"""Queries over collections that are stored, changed and opened again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomtext.jobs.registry import query, table
from loomtext.operators.shared import saved, shared_folder
from loomtext.sources.stored import Collection
from loomtext.streaming import ingest, sessions


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"


@query("collection_changes", """with d as (select doc_id, lang, source, n_chars, 'first' as state from documents qualify row_number() over (partition by doc_id order by lang desc, source desc, n_chars desc) = 1),
u as (select doc_id, lang, source, n_chars + 1 as n_chars, 'changed' as state from d where lang = 'en'),
m as (select * from d where lang <> 'en' or lang is null union all select * from u),
x as (select * from m where coalesce(source, '') not in ('src3', 'src7')),
a as (select -1 - item_id as doc_id, null as lang, 'benchmark' as source, length(text) as n_chars, 'added' as state from benchmark)
select * from x union all select * from a""")
def collection_changes(spark, d):
    """All documents merged in; those in English merged again, changed; those of two sources deleted by a filter; passages of
    the benchmark appended, twice, of which the second time changes nothing; then the collection is opened anew."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), F.lit("first").alias("state"))
    Collection.create(spark, folder := _folder(spark), docs.schema, "doc_id", buckets=16)
    held = Collection(spark, folder)
    held.upsert(docs)
    held.upsert(docs.where("lang = 'en'").withColumns({"n_chars": F.col("n_chars") + 1, "state": F.lit("changed")}))
    held.delete(spec={"source": {"$in": ["src3", "src7"]}})
    more = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit("benchmark").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit("added").alias("state"))
    held.append(more)
    held.append(more.withColumn("state", F.lit("added again")))
    found = saved(Collection(spark, folder).rows())
    held._files.fs.delete(held._files.path(folder), True)
    return found


@query("ingested_chunks", "select concat_ws('/', lang, source) as source, count(distinct doc_id) as documents from documents where source in ('src1', 'src2') and text is not null group by 1")
def ingested_chunks(spark, d):
    """Documents of two sources as files, merged twice under one batch number and once, shorter, under the next: of how many
    documents the collection holds the last text, by language and source."""
    held = ingest.created(spark, folder := _folder(spark), 16)
    docs = table(spark, d, "documents").where(F.col("source").isin("src1", "src2")).withColumn("source", F.concat_ws("/", "lang", "source"))
    files = docs.select(F.concat_ws("#", "source", F.col("doc_id").cast("string")).alias("source"), "text")
    ingest.merged(held, files, 0)
    ingest.merged(held, files.withColumn("text", F.concat("text", F.lit("\n\nmore"))), 0)  # replayed: no effect
    ingest.merged(held, files.withColumn("text", F.concat(F.lit("start "), F.substring("text", 1, 50))), 1)
    chunks = saved(held.rows())
    held._files.fs.delete(held._files.path(folder), True)
    return chunks.where("text like 'start %'").groupBy(F.substring_index("source", "#", 1).alias("source")).agg(F.countDistinct("source").alias("documents"))


@query("session_values", "select conv_id::varchar as session, turn as seq, role as name, lag(text) over (partition by conv_id, role order by turn) as value from conversations")
def session_values(spark, d):
    """Conversations as a stream of commands: each turn sets its role's value, and the reply is the value before."""
    turns = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{d}/conversation[s].parquet")  # a pattern may name a file
    commands = turns.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("seq"), F.col("turn").alias("at"), F.lit("set").alias("op"), F.col("role").alias("name"), F.col("text").alias("value"))
    folder, name = _folder(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    sessions.with_store(spark)
    try:
        replies = sessions.sessions(commands).select("session", "seq", "name", "value")
        replies.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/replies").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(replies.schema).parquet(f"{folder}/replies")
