import json
import tempfile
import time

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from loomtext.operators import telemetry
from loomtext.streaming import sessions as S


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    S.with_store(spark)
    yield tempfile.mkdtemp(prefix="spark-")
    spark.conf.set(name, before)


def fed(spark, store, rows):
    """Another file for the stream."""
    spark.createDataFrame([(a, b, 1000 * b, *c) for a, b, *c in rows], S.COMMANDS).coalesce(1).write.mode("append").parquet(f"{store}/in")


def replies(spark, store, **more):
    """What a run that goes on from the checkpoint answers to the files it hasn't seen."""
    stream = spark.readStream.schema(S.COMMANDS).parquet(f"{store}/in")
    got = []
    S.sessions(stream, **more).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination(180)
    return {(r.session, r.seq): r.value for r in got}


def test_sessions_go_on_after_a_restart(spark, store):
    tools = {"add": lambda a, b: a + b, "fail": lambda: 1 / 0}
    fed(spark, store, [("s", 1, "set", "k", "v1"), ("s", 2, "get", "k", None), ("s", 3, "set", "k", "v2"), ("t", 1, "get", "k", None), ("s", 4, "message", "user", "hi"), ("s", 5, "tool", "add", '{"a": 2, "b": 3}'), ("s", 6, "tool", "none", "{}"), ("s", 7, "tool", "fail", None), ("s", 8, "what", None, None)])
    first = replies(spark, store, tools=tools)
    assert first == {("s", 1): None, ("s", 2): "v1", ("s", 3): "v1", ("t", 1): None, ("s", 4): "hi", ("s", 5): "5", ("s", 6): "error: unknown tool 'none'", ("s", 7): "error: division by zero", ("s", 8): "error: unknown command 'what'"}
    fed(spark, store, [("s", 10, "get", "k", None), ("s", 11, "delete", "k", None), ("s", 12, "get", "k", None), ("s", 13, "history", None, None), ("t", 2, "history", None, None), ("s", 14, "delete", "k", None)])
    second = replies(spark, store, tools=tools)  # only the new file, with the state of the first run
    assert (second["s", 10], second["s", 11], second["s", 12], second["s", 14]) == ("v2", "v2", None, None)
    history = json.loads(second["s", 13])
    assert [m["content"] for m in history["messages"]] == ["hi", "add -> 5", "none -> error: unknown tool 'none'", "fail -> error: division by zero"]
    assert history["tool_calls"][0] == {"name": "add", "args": {"a": 2, "b": 3}, "result": "5"} and json.loads(second["t", 2]) == {"messages": [], "tool_calls": []}
    fed(spark, store, [("s", 20, "clear", None, None), ("s", 21, "history", None, None)])
    assert json.loads(replies(spark, store, tools=tools)["s", 21]) == {"messages": [], "tool_calls": []}


def test_values_expire(spark, store):
    fed(spark, store, [("s", 1, "set", "k", "v"), ("s", 2, "get", "k", None), ("s", 4, "set", "l", "x"), ("s", 5, "get", "k", None)])
    assert replies(spark, store, expire_ms=3000) == {("s", 1): None, ("s", 2): "v", ("s", 4): None, ("s", 5): None}
    fed(spark, store, [("s", 6, "get", "l", None), ("s", 7, "set", "k", "w"), ("s", 8, "get", "l", None), ("s", 9, "get", "k", None)])
    assert replies(spark, store, expire_ms=3000) == {("s", 6): "x", ("s", 7): None, ("s", 8): None, ("s", 9): "w"}


@pytest.mark.parametrize(("least", "strict", "most", "again"), [(0.3, False, 8, True), (0.3, True, 5, False)])
def test_streamed_cache_equals_the_fold(spark, store, least, strict, most, again):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("label", "vec_id", "embedding").where("label < 3")
    cuts = np.quantile([r.vec_id for r in rows.collect()], [0, 0.3, 0.6, 1.0]).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = rows.where((F.col("vec_id") >= a) & ((F.col("vec_id") < b) | ((F.col("vec_id") == b) & F.lit(b == cuts[-1]))))
        part.orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(f"{store}/v")
        time.sleep(1.1)  # files are taken by their times
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{store}/v")
    got, batches = {}, []

    def take(df, number):
        batches.append(number)
        got.update({(r.label, r.vec_id): r.hit for r in df.collect()})

    S.semantic_cache(stream, "label", "vec_id", "embedding", least, strict, most, again).writeStream.foreachBatch(take).option("checkpointLocation", f"{store}/c").trigger(availableNow=True).start().awaitTermination(180)
    expected = {(r.label, r.vec_id): r.hit for r in telemetry.semantic_cache(rows, "label", "vec_id", "embedding", least, strict, most, again).collect()}
    assert len(batches) == 3 and got == expected and {True, False} <= set(got.values())
