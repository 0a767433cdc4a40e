"""Running sums and row numbers within groups without a task for each group: rows are dealt by ranges of group and order, every
task sums what it has, and what a group's earlier tasks hold is added. Between tasks go one row for each of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.shared import saved


class _Sums:
    """Sums within the groups of one task's rows, batch after batch."""

    def __init__(self, by: int, sums: int):
        self.by, self.key, self.first, self.single = by, None, None, True
        self.total = np.zeros(sums, np.uint64)

    def of(self, batch: pa.RecordBatch, carry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums up to each row, and values, as columns. carry: what the task's first group had before."""
        n = batch.num_rows
        starts = np.zeros(n, bool)
        for column in batch.columns[: self.by]:
            code = column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            starts[1:] |= code[1:] != code[:-1]
        key = [c[0].as_py() for c in batch.columns[: self.by]]
        if self.first is None:
            self.first = self.key = key
            if carry is not None:
                self.total = carry.copy()
        if key != self.key:
            self.total[:], self.single = 0, False
        values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in batch.columns[self.by :]])
        sums = np.cumsum(values, axis=1, dtype=np.uint64)
        heads = np.flatnonzero(starts)
        group = np.cumsum(starts)
        before = np.concatenate([-self.total.reshape(-1, 1), sums[:, heads] - values[:, heads]], axis=1)
        sums -= before[:, group]
        self.total, self.single = sums[:, -1].copy(), self.single and not len(heads)
        self.key = [c[-1].as_py() for c in batch.columns[: self.by]]
        return sums, values


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, str], before: dict[str, str] | None = None) -> DataFrame:
    """df and, for each (name, column) of sums, the sum of that column of longs over its group's rows up to this one in the
    order given, itself included; for those of before, itself left out. Sums wrap around at 64 bits, nulls count as nothing.
    Rows that agree in group and order come in any order, in one task: end the order with what tells rows apart.

    by: columns that dictionaries can hold (numbers, strings, binaries); nulls are one group; without any, all rows are one. An empty df gives no rows."""
    before = before or {}
    wanted = list(dict.fromkeys([*sums.values(), *before.values()]))
    if not by:
        whole = "group_of_rows"
        while whole in df.columns:
            whole += "_"
        return running(df.withColumn(whole, F.lit(0)), [whole], order, sums, before).drop(whole)
    keys = [F.col(f"`{c}`") for c in by]
    place = "task_of_rows"
    while place in df.columns:
        place += "_"
    dealt = saved(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(place, F.spark_partition_id()))
    kinds = dict(df.dtypes)
    group = ", ".join(f"k{i}: {kinds[c]}" for i, c in enumerate(by))
    value = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(f"v{i}") for i, c in enumerate(wanted)]

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, task = _Sums(len(by), len(wanted)), None
        for batch in batches:
            if batch.num_rows:
                task = batch.column(batch.num_columns - 1)[0].as_py()
                state.of(pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]))
        if task is not None:
            ends = [pa.StructArray.from_arrays([pa.array([k], t) for k, t in zip(key, types, strict=True)], names) for key in (state.first, state.key) for types in [batch.schema.types[: len(by)]] for names in [batch.schema.names[: len(by)]]]
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), *ends, pa.array([state.single]), pa.array([state.total.view(np.int64).tolist()])], ["task", "first", "last", "single", "total"])

    keyed = [c.alias(f"k{i}") for i, c in enumerate(keys)]
    found = dealt.select(*keyed, *value, place).mapInArrow(borders, f"task int, first struct<{group}>, last struct<{group}>, single boolean, total array<long>").collect()
    carried, key, total = {}, None, np.zeros(len(wanted), np.uint64)
    for r in sorted(found, key=lambda r: r.task):
        own = np.array(r.total, np.int64).view(np.uint64)
        if key == r.first:
            carried[r.task] = total
            own = own + total if r.single else own
        key, total = r.last, own

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sums(len(by), len(wanted))
        for batch in batches:
            if batch.num_rows:
                rows, columns = batch.column(0), batch.columns[1:-1]
                upto, values = state.of(pa.RecordBatch.from_arrays(columns, batch.schema.names[1:-1]), carried.get(batch.column(batch.num_columns - 1)[0].as_py()))
                out = [upto[wanted.index(c)] for c in sums.values()] + [upto[wanted.index(c)] - values[wanted.index(c)] for c in before.values()]
                yield pa.RecordBatch.from_arrays([rows, *(pa.array(x.view(np.int64)) for x in out)], ["held", *(f"s{i}" for i in range(len(out)))])

    held = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("held")
    rows = dealt.select(held, *keyed, *value, place)
    names = [*sums, *before]
    out = rows.mapInArrow(summed, f"held {rows.schema['held'].dataType.simpleString()}, " + ", ".join(f"s{i} long" for i in range(len(names))))
    return out.select("held.*", *[F.col(f"s{i}").alias(x) for i, x in enumerate(names)])


def numbered(df: DataFrame, by: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df and a row number within each group, from 1."""
    one = "one_of_rows"
    while one in df.columns:
        one += "_"
    return running(df.withColumn(one, F.lit(1).cast("long")), by, order, {name: one}).drop(one)
