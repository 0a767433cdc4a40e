"""Entity graphs: adjacency, components, edges inside communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.operators.shared import saved


def adjacency(edges: DataFrame) -> DataFrame:
    """edges(src, dst, relation, pos): both directions, the last relation of a pair wins."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "pos")
    return edges.select("src", "dst", "relation", "pos").unionByName(back).groupBy("src", "dst").agg(F.max_by("relation", "pos").alias("relation"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(src, dst) of any type that has an order. Returns (node, component): for every node of an edge the smallest node
    that can be reached. Rounds of large-star and small-star; minima are aggregated before they are joined back, every join
    is between two plain exchanges, so that a hub's rows can be split over tasks, and each round is kept in the shared folder."""

    def smallest(rows: DataFrame) -> DataFrame:
        return saved(rows.groupBy("u").agg(F.min("v").alias("m")))

    def mark(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    u, v = F.col("src"), F.col("dst")
    pairs = saved(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    alone, e = pairs.where("u = v").select(F.col("u").alias("node")), pairs.where("u <> v")
    before = mark(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = saved(both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        low = smallest(large)
        e = saved(
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))


def internal_edges(adjacent: DataFrame, component: DataFrame, cap: int = 15) -> DataFrame:
    """Edges with both ends in a community, once each (src < dst); up to cap of each, by name, as the report shows them."""
    a = component.select(F.col("node").alias("src"), F.col("component"))
    b = component.select(F.col("node").alias("dst"), F.col("component").alias("other"))
    inside = adjacent.where("src < dst").join(a, "src").join(b, "dst").where("component = other")
    return inside.withColumn("n", F.row_number().over(W.partitionBy("component").orderBy("src", "dst"))).where(F.col("n") <= cap).select("component", "src", "dst", "relation")
