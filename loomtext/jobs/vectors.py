"""Queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import vector as V
from loomtext.jobs.registry import query, table
from loomtext.operators import dense as D
from loomtext.operators import graphindex as G
from loomtext.operators.predicates import where
from loomtext.operators.shared import saved

DIMS = 64


def _queries(v):
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _knn_sql(score: str, k: int, rule: str = "true", least: str = "true") -> str:
    return f"""
with v as (select vec_id, label, embedding::double[] as e from embeddings), q as (select vec_id as query_id, e as qe from v where vec_id % 50 = 0),
s as (select query_id, vec_id, round({score}, 6) as score from q, v where query_id <> vec_id and {rule}),
r as (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where {least})
select query_id, rank, vec_id, score from r where rank <= {k}"""


@query("knn_cosine_top10", _knn_sql("list_cosine_similarity(qe, e)", 10))
def knn_cosine(spark, d):
    v = table(spark, d, "embeddings")
    return D.knn(v, _queries(v), 10)


@query("knn_l2_top10", _knn_sql("-list_distance(qe, e)", 10))
def knn_l2(spark, d):
    v = table(spark, d, "embeddings")
    return D.knn(v, _queries(v), 10, "l2")


@query("knn_ip_top10", _knn_sql("list_inner_product(qe, e)", 10))
def knn_ip(spark, d):
    v = table(spark, d, "embeddings")
    return D.knn(v, _queries(v), 10, "ip")


@query("knn_filtered", _knn_sql("list_cosine_similarity(qe, e)", 5, "(label in (1, 2, 3) or label >= 8)"))
def knn_filtered(spark, d):
    v = table(spark, d, "embeddings")
    return D.knn(v.where(where({"$or": [{"label": {"$in": [1, 2, 3]}}, {"label": {"$gte": 8}}]})), _queries(v), 5)


@query("threshold_gate", _knn_sql("list_cosine_similarity(qe, e)", 5, least="score >= 0.45"))
def threshold_gate(spark, d):
    v = table(spark, d, "embeddings")
    return D.knn(v, _queries(v), 5, least=0.45)


@query("cosine_is_inner_product", "with v as (select vec_id, embedding::double[] as e, lead(embedding::double[]) over (order by vec_id) as f from embeddings) select count(*) as pairs, max(abs(list_cosine_similarity(e, f) - list_inner_product(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))), list_transform(f, lambda x: x / sqrt(list_inner_product(f, f)))))) < 1e-9 as same from v where f is not null")
def cosine_is_inner_product(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    gap = F.abs(V.cosine("embedding", "next") - V.dot(V.unit("embedding"), V.unit("next")))
    return v.join(after, "vec_id").agg(F.count("*").alias("pairs"), (F.max(gap) < 1e-9).alias("same"))


@query("label_separation", """
with v as (select vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as e from embeddings),
p as (select a.label = b.label as same, list_inner_product(a.e, b.e) as c from v a join v b on a.vec_id < b.vec_id)
select round(avg(c) filter (same), 6) as within, round(avg(c) filter (not same), 6) as between, round(avg(c) filter (same) - avg(c) filter (not same), 6) as gap from p""")
def label_separation(spark, d):
    return D.group_means(table(spark, d, "embeddings"), "label")


@query("result_diversity", _knn_sql("list_cosine_similarity(qe, e)", 5).replace("select query_id, rank, vec_id, score from r where rank <= 5", "select a.query_id, round(1 - avg(list_cosine_similarity(x.e, y.e)), 6) as diversity from r a join r b on a.query_id = b.query_id and a.rank < b.rank join v x on x.vec_id = a.vec_id join v y on y.vec_id = b.vec_id where b.rank <= 5 group by a.query_id"))
def result_diversity(spark, d):
    v = table(spark, d, "embeddings")
    near = D.knn(v, _queries(v), 5).join(v.select("vec_id", "embedding"), "vec_id")
    a, b = near.alias("a"), near.alias("b")  # five rows for each query on either side
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")))
    return pairs.groupBy(F.col("a.query_id").alias("query_id")).agg(F.round(1 - F.avg(V.cosine(F.col("a.embedding"), F.col("b.embedding"))), 6).alias("diversity"))


@query("mmr_top3")
def mmr_top3(spark, d):
    v = table(spark, d, "embeddings")
    return D.mmr(D.knn(v, _queries(v), 10), v, 3)


@query("lsh_recall")
def lsh_recall(spark, d):
    """Recall of the neighbours found in buckets, and the share of all pairs of query and row that were compared."""
    v = table(spark, d, "embeddings")
    found = D.recall(D.lsh_knn(v, _queries(v), 10, DIMS), D.knn(v, _queries(v), 10))
    n, asked = v.count(), _queries(v).count()
    share = D.compared(v, _queries(v), DIMS, D.Buckets(DIMS)).select(F.round(F.col("n") / F.lit(n * asked), 4).alias("compared"))
    return found.crossJoin(share)  # a row each


#: Neighbours, candidates and rows kept that the sweep tries: the first two make an index, the last is a walk's.
GRAPHS = [(4, 16, 16), (4, 16, 48), (8, 32, 12), (8, 32, 24), (16, 64, 12), (16, 64, 24)]


@query("graph_index_sweep")
def graph_index_sweep(spark, d):
    """For each setting of an index by proximity graphs, recall of 10 neighbours and the share of pairs compared; chosen is the
    cheapest setting with a recall of 0.95, or the one of best recall if none has it."""
    v = table(spark, d, "embeddings")
    asked, exact = _queries(v), saved(D.knn(v, _queries(v), 10))
    pairs = v.count() * asked.count()
    rows = []
    for neighbours, candidates in dict.fromkeys(g[:2] for g in GRAPHS):
        index = G.indexed(v, DIMS, neighbours, candidates)
        for kept in (k for *g, k in GRAPHS if tuple(g) == (neighbours, candidates)):
            near, compared = G.graph_knn(index, asked, 10, DIMS, kept)
            reached, many = D.recall(near, exact).first()[0] or 0.0, compared.agg(F.sum("compared")).first()[0] or 0
            rows.append((neighbours, candidates, kept, float(reached), round(many / max(pairs, 1), 4)))
    enough = [r for r in rows if r[3] >= 0.95] or [max(rows, key=lambda r: r[3])]
    best = min(enough, key=lambda r: (r[4], r))
    return spark.createDataFrame([(*r, r == best) for r in rows], "neighbours int, candidates int, kept int, recall double, compared double, chosen boolean")


#: Cells and probed cells that the sweep tries.
SWEEP = [(16, 4), (16, 8), (16, 12), (64, 8), (64, 16), (64, 32), (64, 48)]


@query("index_sweep")
def index_sweep(spark, d):
    """For each setting of an index by cells, recall of 10 neighbours and the share of pairs compared; chosen is the cheapest
    setting with 98 % of the best recall."""
    v = table(spark, d, "embeddings")
    asked, exact, n = _queries(v), saved(D.knn(v, _queries(v), 10)), v.count()
    pairs = n * asked.count()
    centres = {c: D.trained_cells(v, DIMS, c) for c in {c for c, _ in SWEEP}}
    rows = None
    for cells, probes in SWEEP:
        near, scored = D.cell_knn(v, asked, 10, centres[cells], probes)
        share = scored.select(F.round(F.when(F.col("n") > 0, F.col("n")) / F.lit(pairs), 4).alias("compared"))
        row = D.recall(near, exact).crossJoin(share).select(F.lit(cells).alias("cells"), F.lit(probes).alias("probes"), "recall", "compared")  # a row each
        rows = row if rows is None else rows.unionByName(row)
    rows = saved(rows)
    best = rows.agg(F.max("recall")).first()[0] or 0.0
    cheapest = rows.where(F.col("recall") >= 0.98 * best).orderBy("compared", "cells", "probes").select("cells", "probes").first()
    chosen = (F.col("cells") == cheapest.cells) & (F.col("probes") == cheapest.probes) if cheapest else F.lit(False)
    return rows.withColumn("chosen", chosen)


@query("pca_2d")
def pca_2d(spark, d):
    return D.principal(table(spark, d, "embeddings"), DIMS)


@query("vector_norms", "select label, count(*) as n, round(avg(sqrt(list_inner_product(embedding::double[], embedding::double[]))), 6) as mean_norm from embeddings group by label")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(V.norm("embedding")), 6).alias("mean_norm"))
