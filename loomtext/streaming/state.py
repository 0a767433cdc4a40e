"""Streams of events: limits with state for each client, rolled-up windows, session histories, caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)


def rolled_up(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts, means and errors by window and type; a window closes when the watermark has passed it."""
    return (
        stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "mean", "errors")
    )


def limited(stream: DataFrame, capacity: float, rate: float, idle_ms: int = 3_600_000) -> DataFrame:
    """A token bucket for each user_id over event time: user_id, event_id, allowed. The state is two numbers; a client that
    stays away for idle_ms is forgotten, which is the same as a full bucket if capacity / rate is no longer than that."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for t in rows["ts"].astype("int64") / (1e9 if rows["ts"].dtype == "datetime64[ns]" else 1e6):
            tokens = min(capacity, tokens + (0 if last is None else max(0.0, t - last) * rate))
            last = t if last is None else max(last, t)
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((float(tokens), float(last)))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    return stream.groupBy("user_id").applyInPandasWithState(
        fold, "user_id long, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def histories(stream: DataFrame, most: int = 50) -> DataFrame:
    """Per user the last `most` event types, as they come: user_id, n, recent."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, recent = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        n, recent = n + len(rows), (list(recent) + rows["event_type"].tolist())[-most:]
        state.update((n, recent))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "recent": [",".join(recent)]})

    return stream.groupBy("user_id").applyInPandasWithState(fold, "user_id long, n long, recent string", "n long, recent array<string>", "update", GroupStateTimeout.NoTimeout)


def first_seen(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark: an exact cache's misses."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
