"""Request logs: percentiles, running totals, replays of caches and limits, segments over a threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replayed(df: DataFrame, key: str, order: str) -> DataFrame:
    """An exact cache over an ordered workload: a key's first request is a miss, later ones are hits."""
    return df.withColumn("hit", F.row_number().over(W.partitionBy(key).orderBy(order)) > 1)


def segments(df: DataFrame, by: str, order: str, over: F.Column, least: int = 3) -> DataFrame:
    """Runs of at least `least` rows in a row that meet a condition: by, first, last, length."""
    w = W.partitionBy(by).orderBy(order)
    numbered = df.select(by, order, over.alias("over"), F.row_number().over(w).alias("pos"))
    island = F.col("pos") - F.row_number().over(W.partitionBy(by, "over").orderBy(order))
    runs = numbered.withColumn("island", island).where("over").groupBy(by, "island")
    return runs.agg(F.min("pos").cast("long").alias("first"), F.max("pos").cast("long").alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def folded(df: DataFrame, key: str, order: str, columns: list[str], schema: str, begin: Callable[[], object], step: Callable[[object, tuple], list[tuple]], end: Callable[[object, object], list[tuple]] | None = None, ascending: bool = True) -> DataFrame:
    """Folds each key's rows in order. A key's rows stream through one task, in order, and only the state that begin() makes and
    step(state, row) changes is held, so a key may have any number of rows. step gives the rows of the result for a row
    (key, order, columns), end(key, state) those after a key's last row."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, begun = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                if not begun or row[0] != held:
                    if begun and end:
                        out += end(held, state)
                    held, state, begun = row[0], begin(), True
                out += step(state, row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if begun and end and (last := end(held, state)):
            yield pd.DataFrame(last, columns=names)

    rows = df.select(key, order, *columns).where(F.col(key).isNotNull())
    at = F.col(order).asc() if ascending else F.col(order).desc()
    return rows.repartition(key).sortWithinPartitions(F.col(key), at).mapInPandas(run, schema)


def token_bucket(df: DataFrame, client: str, seconds: str, order_id: str, capacity: float, rate: float) -> DataFrame:
    """Whether each call is allowed: a client's bucket begins full, gains `rate` tokens a second up to its capacity, and a call
    takes one if it is there. Calls of a client are taken by time, then id. client, id, allowed."""
    kinds = dict(df.dtypes)

    def step(state: list, row: tuple) -> list[tuple]:
        at = row[2]
        tokens = min(capacity, state[0] + (at - state[1]) * rate) if state[1] is not None else capacity
        allowed = tokens >= 1
        state[:] = [tokens - allowed, at]
        return [(row[0], row[3], allowed)]

    ordered = df.withColumn("_at", F.struct(seconds, order_id))
    return folded(ordered, client, "_at", [seconds, order_id], f"{client} {kinds[client]}, {order_id} {kinds[order_id]}, allowed boolean", lambda: [capacity, None], step)


class _Cache:
    """Unit vectors of entries, oldest first, `most` at most."""

    def __init__(self, most: int):
        self.most, self.orders = most, []
        self.vectors: np.ndarray | None = None

    def asked(self, order, vector, least: float, strict: bool, replace: bool) -> bool:
        v = np.asarray(vector, float)
        v = v / (np.linalg.norm(v) or 1.0)
        s = self.vectors[: len(self.orders)] @ v if self.orders else np.zeros(0)
        near = s > least if strict else s >= least
        if near.any():
            if replace:
                i = int(np.argmax(near))
                self.vectors[i], self.orders[i] = v, order
            return True
        if self.vectors is None:
            self.vectors = np.zeros((self.most, len(v)))
        if len(self.orders) == self.most:
            self.vectors[:-1] = self.vectors[1:].copy()
            self.orders.pop(0)
        self.vectors[len(self.orders)] = v
        self.orders.append(order)
        return False


def semantic_cache(df: DataFrame, by: str, order: str, vector: str, least: float, strict: bool, most: int, replace: bool = False) -> DataFrame:
    """A cache by similarity over an ordered stream for each `by`: hit if an entry's cosine reaches `least` (strict: is above
    it); a miss is stored, the oldest of more than `most` goes; replace: a hit takes the place of the first entry that is near
    enough. by, order, hit. The state is the entries."""
    kinds = dict(df.dtypes)
    step = lambda cache, row: [(row[0], row[1], cache.asked(row[1], row[2], least, strict, replace))]
    return folded(df, by, order, [vector], f"{by} {kinds[by]}, {order} {kinds[order]}, hit boolean", lambda: _Cache(most), step)


def semantic_cache_entries(df: DataFrame, by: str, order: str, vector: str, least: float, strict: bool, most: int, replace: bool = False) -> DataFrame:
    """The entries that the cache holds in the end, to be kept as a table and merged by key: by, key (md5 of `by` and the
    entry's order), order, place."""
    kinds = dict(df.dtypes)

    def step(cache: _Cache, row: tuple) -> list[tuple]:
        cache.asked(row[1], row[2], least, strict, replace)
        return []

    end = lambda key, cache: [(key, md5(f"{key}::{o}".encode()).hexdigest(), o, i) for i, o in enumerate(cache.orders)]
    return folded(df, by, order, [vector], f"{by} {kinds[by]}, key string, {order} {kinds[order]}, place long", lambda: _Cache(most), step, end)


def fitted_history(df: DataFrame, session: str, turn: str, cost: str, budget: int) -> DataFrame:
    """Turns kept within a budget, newest first; a turn that doesn't fit is passed over and older ones are still tried:
    session, turns kept (in order), tokens used. Costs are 1 or more, so that at most `budget` turns are kept."""
    kinds = dict(df.dtypes)

    def step(state: list, row: tuple) -> list[tuple]:
        if state[0] + row[2] > budget:
            return []
        state[0] += row[2]
        state[1].append(int(row[1]))
        return []

    end = lambda key, state: [(key, sorted(state[1]), int(state[0]))]
    return folded(df, session, turn, [cost], f"{session} {kinds[session]}, kept array<bigint>, used long", lambda: [0, []], step, end, ascending=False)
