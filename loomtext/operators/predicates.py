"""A small filter language over columns, as nested dictionaries, compiled to column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LEAVES = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: F.coalesce(~c.isin(list(v)), F.lit(True)),
}


def where(spec: dict, lists: tuple[str, ...] = ()) -> Column:
    """{"field": value}, {"field": {"$op": value}}, {"$and": [...]} or {"$or": [...]}; several fields mean all of them.
    Null fields pass $ne and $nin and fail everything else. Leaves reach the scan as pushed filters. lists: fields whose values
    are lists; `$in` matches none of them, as a list is no member, and `$overlaps` those that share an element."""
    if not spec:
        return F.lit(True)
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            parts.append(reduce(Column.__and__ if key == "$and" else Column.__or__, [where(x, lists) for x in value]))
        elif isinstance(value, dict):
            if len(value) != 1:
                raise ValueError(f"one operator for each condition; join them with $and: {value}")
            (op, v), = value.items()
            if key in lists and op in ("$in", "$nin", "$overlaps"):
                shares = F.coalesce(F.arrays_overlap(F.col(key), F.array(*map(F.lit, v))), F.lit(False))
                parts.append({"$in": F.lit(False), "$nin": F.lit(True), "$overlaps": shares}[op])
                continue
            if op not in _LEAVES:
                raise ValueError(f"unknown operator {op}")
            parts.append(_LEAVES[op](F.col(key), v))
        else:
            parts.append(F.col(key) == value)
    return reduce(Column.__and__, parts)


def last_of(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row of each key: the last by `order`, or by all columns."""
    whole = F.struct(*rows.columns)
    at = F.struct(F.col(order), whole) if order else whole
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, at).alias("_row")).select("_row.*")


def upserted(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of new replace those of old with the same key; of rows of new that share a key, the last by `order` (or by all
    columns)."""
    new = last_of(new, key, order)
    return old.join(new, key, "left_anti").unionByName(new)


def appended(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of new whose key old lacks are added, one for each key."""
    return old.unionByName(last_of(new, key, order).join(old, key, "left_anti"))


def without(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys, key, "left_anti")


def created(df: DataFrame, name: str, metric: str = "cosine") -> None:
    """A collection: a table that carries its metric as a property."""
    spark = df.sparkSession
    df.write.mode("errorifexists").saveAsTable(name)
    if not metric.isidentifier():
        raise ValueError(f"no metric: {metric}")
    spark.sql(f"alter table identifier(:name) set tblproperties ('metric' = '{metric}')", args={"name": name})


def metric_of(spark: SparkSession, name: str) -> str | None:
    found = {r.key: r.value for r in spark.sql("show tblproperties identifier(:name)", args={"name": name}).collect()}
    return found.get("metric")


def collections(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def dropped(spark: SparkSession, name: str) -> None:
    spark.sql("drop table if exists identifier(:name)", args={"name": name})
