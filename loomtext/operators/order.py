"""Values at given ranks of groups. Rows are numbered by ranges of group and value, so that neither a large group nor one value
far from the others puts all rows into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.running import numbered
from loomtext.operators.shared import saved, small


def at_ranks(df: DataFrame, by: str, value: str, ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """by, n and a column for each of ranks(n), the value at that place (from 1) of the group's values in order. Null values
    don't count; a group without others has no row. A null group is one group. Values are numbers."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"))
    sizes = saved(rows.groupBy("g").agg(F.count("*").alias("n")))
    wanted = ranks(F.col("n"))
    asked = sizes.select(F.col("g").alias("h"), F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in wanted.items()])).alias("x"))
    # Equal values are told apart by a number, so that one value of most rows is spread over tasks too.
    placed = numbered(rows.withColumn("u", F.monotonically_increasing_id()), ["g"], ["v", "u"], "place")
    found = placed.join(small(asked), F.col("g").eqNullSafe(F.col("h")) & (F.col("place") == F.col("x.rank")))
    wide = found.groupBy("g").agg(*[F.max(F.when(F.col("x.name") == k, F.col("v"))).alias(k) for k in wanted])
    return wide.join(sizes.select(F.col("g").alias("h"), "n"), F.col("g").eqNullSafe(F.col("h"))).select(F.col("g").alias(by), "n", *wanted)


def nearest_rank(df: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """The value at place round(p n) (half to even) of its group, from 1 and within the group: by, n, percentile."""
    return at_ranks(df, by, value, lambda n: {"percentile": F.greatest(F.lit(1), F.least(F.bround(F.lit(p) * n).cast("long"), n))})


def interpolated(df: DataFrame, by: str, value: str, percentiles: dict[str, float]) -> DataFrame:
    """by, n and percentiles between the two values next to the place p (n - 1)."""
    place = lambda p, n: F.lit(p) * (n - 1)
    found = at_ranks(df, by, value, lambda n: {f"{k}_{end}": f(place(p, n)) + 1 for k, p in percentiles.items() for end, f in (("low", F.floor), ("high", F.ceil))})
    share = lambda p: place(p, F.col("n")) - F.floor(place(p, F.col("n")))
    return found.select(by, "n", *[(F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * share(p)).alias(k) for k, p in percentiles.items()])
