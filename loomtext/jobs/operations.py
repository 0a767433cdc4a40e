"""Queries over request logs, conversations and the graph of parts and suppliers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.jobs.registry import query, table
from loomtext.operators import graph as N
from loomtext.operators import order as R
from loomtext.operators import telemetry as O
from loomtext.operators.shared import saved


@query("latency_nearest_rank", """with r as (select event_type, value, row_number() over (partition by event_type order by value, event_id) as r, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, n, value as percentile from r where r = greatest(1, least(round_even(0.95 * n, 0)::bigint, n))""")
def latency_nearest_rank(spark, d):
    return R.nearest_rank(table(spark, d, "events"), "event_type", "value", 0.95)


@query("latency_interpolated", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(avg(value), 6) as mean from events group by event_type")
def latency_interpolated(spark, d):
    e = table(spark, d, "events")
    p = R.interpolated(e, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    mean = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return p.join(mean, "event_type").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "mean")


@query("latency_median", "select user_id, count(value) as n, round(median(value), 6) as median from events group by user_id having count(value) > 0")
def latency_median(spark, d):
    return R.interpolated(table(spark, d, "events"), "user_id", "value", {"median": 0.5}).select("user_id", "n", F.round("median", 6).alias("median"))


@query("stage_report", """with s as (select unnest([{'stage': 'quantity', 'v': l_quantity}, {'stage': 'price', 'v': l_extendedprice}, {'stage': 'discount', 'v': l_discount}], recursive := true) from lineitem),
r as (select stage, v, row_number() over (partition by stage order by v) as r, count(*) over (partition by stage) as n from s where v is not null)
select stage, max(n) as n, round(avg(v), 4) as mean, max(v) filter (r = greatest(1, least(round_even(0.95 * n, 0)::bigint, n))) as p95 from r group by stage""")
def stage_report(spark, d):
    """Count, mean and 95th percentile of each stage of a request; stages are the fields of a map."""
    stages = F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x) for k, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount")) for i, x in enumerate((k, c))])
    s = table(spark, d, "lineitem").select(F.explode(stages).alias("stage", "v"))
    mean = s.groupBy("stage").agg(F.round(F.avg("v"), 4).alias("mean"))
    return R.nearest_rank(s, "stage", "v", 0.95).join(mean, "stage").select("stage", "n", "mean", F.col("percentile").alias("p95"))


@query("tier_averages", "select o_orderpriority as tier, count(*) as n, round(avg(o_totalprice), 4) as mean_total, round(avg(lines), 4) as mean_lines, round(avg(first_ms), 4) as mean_first from orders join (select l_orderkey, count(*) as lines, min(l_extendedprice) as first_ms from lineitem group by l_orderkey) on l_orderkey = o_orderkey group by o_orderpriority")
def tier_averages(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.min("l_extendedprice").alias("first"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    mean = lambda c, n: F.round(F.avg(c), 4).alias(n)
    return o.groupBy(F.col("o_orderpriority").alias("tier")).agg(F.count("*").alias("n"), mean("o_totalprice", "mean_total"), mean("lines", "mean_lines"), mean("first", "mean_first"))


@query("operations_rollup", "select coalesce(event_type, 'all') as event_type, count(*) as n, count(distinct user_id) as users, round(avg((event_type = 'error')::int), 6) as error_rate, round(max(value), 6) as largest from events group by grouping sets ((), (event_type))")
def operations_rollup(spark, d):
    return (
        table(spark, d, "events").rollup("event_type")
        .agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.avg((F.col("event_type") == "error").cast("int")).alias("e"), F.round(F.max("value"), 6).alias("largest"))
        .select(F.coalesce("event_type", F.lit("all")).alias("event_type"), "n", "users", F.round("e", 6).alias("error_rate"), "largest")
    )


@query("drift_alerts", "with m as (select event_type, avg(value) filter (ts < timestamp '2024-01-16') as b, avg(value) filter (ts >= timestamp '2024-01-16') as c from events group by event_type) select event_type, round(b, 6) as before, round(c, 6) as after, abs(c - b) / b > 0.05 as drifted from m")
def drift_alerts(spark, d):
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    m = table(spark, d, "events").groupBy("event_type").agg(F.avg(F.when(~late, F.col("value"))).alias("b"), F.avg(F.when(late, F.col("value"))).alias("c"))
    return m.select("event_type", F.round("b", 6).alias("before"), F.round("c", 6).alias("after"), (F.abs(F.col("c") - F.col("b")) / F.col("b") > 0.05).alias("drifted"))


@query("running_cost", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as cost, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as calls from events")
def running_cost(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("cost"), F.count("*").over(w).alias("calls"))


@query("exact_cache_replay", """with k as (select sha256(regexp_replace(trim(lower(text), ' '), '[ \t\n\x0B\f\r]+', ' ', 'g')) as key, role, conv_id, turn from conversations)
select role, count(*) as requests, count(*) - count(distinct key) as hits, round((count(*) - count(distinct key)) * 2.12, 4) as seconds_saved from k group by role""")
def exact_cache_replay(spark, d):
    """Each role has a cache of its own; a text's first request is a miss. Counts by key, so no key's rows meet in one task."""
    key = F.sha2(F.regexp_replace(F.btrim(F.lower("text"), F.lit(" ")), r"\s+", " ").cast("binary"), 256)
    per = table(spark, d, "conversations").groupBy("role", key.alias("key")).agg(F.count("*").alias("n"))
    hits = F.sum("n") - F.count("*")
    return per.groupBy("role").agg(F.sum("n").alias("requests"), hits.alias("hits"), F.round(hits * 2.12, 4).alias("seconds_saved"))


@query("cache_hits_in_order", "select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) > 1 as hit from events")
def cache_hits_in_order(spark, d):
    e = table(spark, d, "events").select("event_id", F.struct("user_id", "event_type").alias("key"), F.struct("ts", "event_id").alias("at"))
    return O.replayed(e, "key", "at").select("event_id", "hit")


@query("token_bucket_limits")
def token_bucket_limits(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("seconds", F.col("us") / 1e6)
    return O.token_bucket(e, "user_id", "seconds", "event_id", 2.0, 1 / 7200)


@query("sliding_limits", "select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) > 3 as limited from events")
def sliding_limits(spark, d):
    w = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)
    return table(spark, d, "events").select("event_id", (F.count("*").over(w) > 3).alias("limited"))


@query("semantic_cache_replay")
def semantic_cache_replay(spark, d):
    return O.semantic_cache(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.6, False, 512)


@query("semantic_cache_refreshed")
def semantic_cache_refreshed(spark, d):
    """A hit takes the place of the entry that it hit; few entries, so that old ones go."""
    return O.semantic_cache(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.3, False, 8, replace=True)


@query("semantic_cache_entries")
def semantic_cache_entries(spark, d):
    return O.semantic_cache_entries(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", 0.3, True, 8)


@query("active_segments", """with n as (select user_id, event_id, value > 30 as o, row_number() over (partition by user_id order by event_id) as p from events),
i as (select user_id, p, p - row_number() over (partition by user_id, o order by event_id) as g from n where o)
select user_id, min(p) as first, max(p) as last, count(*) as length from i group by user_id, g having count(*) >= 3""".replace("from n where o)", "from (select *, row_number() over (partition by user_id, o order by event_id) as q from n) where o)").replace("p - row_number() over (partition by user_id, o order by event_id) as g", "p - q as g"))
def active_segments(spark, d):
    e = table(spark, d, "events")
    return O.segments(e, "user_id", "event_id", F.coalesce(F.col("value") > 30, F.lit(False)), 3)


@query("modality_fusion", """with e as (select user_id, event_id, case when event_type in ('view', 'click') then 'image' when event_type = 'purchase' then 'audio' else 'text' end as m, value from events),
r as (select *, row_number() over (partition by user_id order by value desc, event_id) as r from e)
select user_id, string_agg('[' || m || '] ' || event_id, ' | ' order by r) as evidence, count(distinct m) as kinds from r where r <= 5 group by user_id""")
def modality_fusion(spark, d):
    m = F.when(F.col("event_type").isin("view", "click"), "image").when(F.col("event_type") == "purchase", "audio").otherwise("text")
    order = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    r = table(spark, d, "events").select("user_id", "event_id", m.alias("m"), "value").withColumn("r", F.row_number().over(order)).where("r <= 5")
    line = F.concat(F.lit("["), F.col("m"), F.lit("] "), F.col("event_id").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("r", line.alias("line"))))
    return r.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), " | ").alias("evidence"), F.countDistinct("m").alias("kinds"))


def _edges(spark, d):
    """Suppliers and parts of all order lines: s<id> - p<id>, the line's flag as the relation."""
    line = table(spark, d, "lineitem")
    name = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    return line.select(name("l_suppkey", "s").alias("src"), name("l_partkey", "p").alias("dst"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


_EDGES = "e as (select 's' || l_suppkey as src, 'p' || l_partkey as dst, l_returnflag as relation, l_orderkey * 10 + l_linenumber as pos from lineitem)"
_ADJ = f"{_EDGES}, b as (select src, dst, relation, pos from e union all select dst, src, relation, pos from e), adj as (select src, dst, arg_max(relation, pos) as relation from b group by src, dst)"


@query("entity_adjacency", f"with {_ADJ} select src, count(*) as degree, count(*) filter (relation = 'R') as returned from adj group by src")
def entity_adjacency(spark, d):
    return N.adjacency(_edges(spark, d)).groupBy("src").agg(F.count("*").alias("degree"), F.count_if(F.col("relation") == "R").alias("returned"))


# The reach of every node is too large a table for SQL over all lines: tests compare these two with plain code.
@query("entity_components")
def entity_components(spark, d):
    return N.components(_edges(spark, d)).groupBy("component").agg(F.count("*").alias("nodes"))


@query("community_edges")
def community_edges(spark, d):
    adjacent = saved(N.adjacency(_edges(spark, d)))
    return N.internal_edges(adjacent, N.components(adjacent))


@query("fitted_history")
def fitted_history(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", T.estimated_tokens("text").alias("cost"))
    return O.fitted_history(c, "conv_id", "turn", "cost", 60).select("conv_id", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), "used")


@query("agent_loads", "select conv_id, sum(t)::bigint as single, max(s)::bigint as peak from (select conv_id, sum(greatest(1, floor(length(text) / 4))) as t, sum(greatest(1, floor(length(text) / 4))) as s from conversations group by conv_id, role) group by conv_id")
def agent_loads(spark, d):
    """Tokens of one agent that sees a whole conversation, and the largest of agents that each see one role's turns."""
    per = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.sum(T.estimated_tokens("text")).alias("t"))
    return per.groupBy("conv_id").agg(F.sum("t").alias("single"), F.max("t").alias("peak"))


@query("last_values", "select user_id, arg_max(event_type, (ts, event_id)) as last_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts from events group by user_id")
def last_values(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))
