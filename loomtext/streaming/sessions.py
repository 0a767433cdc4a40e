"""Keyed state of sessions and caches over streams, in lists and maps that Spark keeps beside the stream's checkpoint: a run that
ends and begins again goes on with what it held."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtext.operators.telemetry import _Cache

#: What lists and maps of state are kept in.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMMANDS = "session string, seq long, at long, op string, name string, value string"
REPLIES = "session string, seq long, op string, name string, value string"


def with_store(spark: SparkSession) -> None:
    """Streams begun from now on keep their state in a store that lists and maps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class SemanticCache(StatefulProcessor):
    """Entries of a key, oldest first, as a list."""

    def __init__(self, least: float, strict: bool, most: int, replace: bool, by: str, order: str):
        self.least, self.strict, self.most, self.replace, self.by, self.order = least, strict, most, replace, by, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", f"{self.order} long, vector array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cache = _Cache(self.most)
        if self.entries.exists():
            held = list(self.entries.get())
            cache.orders = [int(o) for o, _ in held]
            cache.vectors = np.zeros((self.most, len(held[0][1])))
            cache.vectors[: len(held)] = [list(v) for _, v in held]
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        before = [(o, tuple(cache.vectors[i])) for i, o in enumerate(cache.orders)] if self.replace else list(cache.orders)
        hits = [cache.asked(int(o), v, self.least, self.strict, self.replace) for o, v in zip(batch["at"], batch["vector"], strict=True)]
        after = [(o, tuple(cache.vectors[i])) for i, o in enumerate(cache.orders)] if self.replace else list(cache.orders)
        if before != after:
            self.entries.put([(o, cache.vectors[i].tolist()) for i, o in enumerate(cache.orders)])
        yield pd.DataFrame({"key": [key[0]] * len(batch), "at": batch["at"].to_numpy(), "hit": hits})

    def close(self) -> None:
        pass


def semantic_cache(stream: DataFrame, by: str, order: str, vector: str, least: float, strict: bool, most: int, replace: bool = False) -> DataFrame:
    """The stream's form of telemetry.semantic_cache(): by, order, hit. Batches come in the order of their rows; within a batch rows
    are taken by `order`, whole numbers. A null `by` is a key like any other. State: `most` entries a key."""
    kinds = dict(stream.dtypes)
    rows = stream.selectExpr(f"`{by}` as key", f"cast(`{order}` as long) as at", f"cast(`{vector}` as array<double>) as vector")
    out = rows.groupBy("key").transformWithStateInPandas(SemanticCache(least, strict, most, replace, by, order), f"key {kinds[by]}, at long, hit boolean", "append", "none")
    return out.selectExpr(f"key as `{by}`", f"cast(at as {kinds[order]}) as `{order}`", "hit")


class Sessions(StatefulProcessor):
    """Values by name, messages and tool calls of a session."""

    def __init__(self, tools: dict[str, Callable], expire_ms: int | None):
        self.tools, self.expire_ms = tools, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "name string", "value string, at long")
        self.messages = handle.getListState("messages", "role string, content string")
        self.calls = handle.getListState("calls", "name string, args string, result string")

    def _call(self, name: str, args: str) -> str:
        if name not in self.tools:
            return f"error: unknown tool '{name}'"
        try:
            return str(self.tools[name](**json.loads(args or "{}")))
        except Exception as e:  # a tool that fails is an answer
            return f"error: {e}"

    def _history(self) -> str:
        messages = [{"role": r, "content": c} for r, c in self.messages.get()] if self.messages.exists() else []
        calls = [{"name": n, "args": json.loads(a or "{}"), "result": r} for n, a, r in self.calls.get()] if self.calls.exists() else []
        return json.dumps({"messages": messages, "tool_calls": calls}, ensure_ascii=False)

    def _old(self, at: int, since: int) -> bool:
        return self.expire_ms is not None and at - since >= self.expire_ms

    def _done(self, op: str, at: int, name: str | None, value: str | None) -> str | None:
        if op in ("get", "set", "delete"):
            key = (name or "",)
            held = self.values.getValue(key) if self.values.exists() and self.values.containsKey(key) else None
            if op == "set":
                self.values.updateValue(key, (value, at))
            elif held and (op == "delete" or self._old(at, held[1])):
                self.values.removeKey(key)
            return held[0] if held and not self._old(at, held[1]) else None
        if op == "message":
            self.messages.appendValue((name, value))
            return value
        if op == "tool":
            result = self._call(name, value)
            self.calls.appendValue((name, value, result))
            self.messages.appendValue(("tool", f"{name} -> {result}"))
            return result
        if op == "history":
            return self._history()
        if op == "clear":
            for state in (self.values, self.messages, self.calls):
                state.clear()
            return None
        return f"error: unknown command '{op}'"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        nothing = lambda x: None if x is None or x != x else x
        out = [(key[0], int(seq), op, nothing(name), self._done(op, int(at), nothing(name), nothing(value))) for seq, at, op, name, value in batch[["seq", "at", "op", "name", "value"]].itertuples(index=False)]
        if self.expire_ms is not None and self.values.exists():
            now = int(batch["at"].max())
            for gone in [k for k, v in self.values.iterator() if self._old(now, v[1])]:
                self.values.removeKey(gone)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in REPLIES.split(", ")])

    def close(self) -> None:
        pass


def sessions(commands: DataFrame, tools: dict[str, Callable] | None = None, expire_ms: int | None = None) -> DataFrame:
    """commands(session, seq, at, op, name, value), in batches in order, within a batch by seq; at: milliseconds. A reply for each:

    set, get, delete: the value that the name had before, null if none; message: a message of role `name`; tool: what the tool
    `name` gives for its arguments `value` (JSON), or an error, kept as a call and a message; history: messages and calls as
    JSON; clear: the session is forgotten. Any other op is an error. expire_ms: values not set
    again for so long are forgotten, by the commands' own times, so that a replay answers alike."""
    return commands.groupBy("session").transformWithStateInPandas(Sessions(tools or {}, expire_ms), REPLIES, "append", "none")
