import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from loomtext.jobs import vectors as V
from loomtext.operators import dense as D
from loomtext.operators import graphindex as G

LARGE = "/root/testdata/sf0.1"


def measured(spark, folder, shard_rows=G.SHARD_ROWS):
    v = spark.read.parquet(f"{folder}/embeddings.parquet")
    asked = v.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    index = G.indexed(v, 64, shard_rows=shard_rows)
    near, compared = G.graph_knn(index, asked, 10, 64)
    exact = D.knn(v, asked, 10)
    assert near.groupBy("query_id").count().where("count <> 10").count() == 0 and near.where("query_id = vec_id").count() == 0
    share = compared.agg(F.sum("compared")).first()[0] / (v.count() * asked.count())
    return D.recall(near, exact).first()[0], share, index.count()


def test_recall_and_what_is_compared(spark):
    recall, share, shards = measured(spark, LARGE)
    assert recall >= 0.95 and share < 0.2 and shards == 1
    small_recall, small_share, _ = measured(spark, SMALL)
    assert small_recall >= 0.95 and share < small_share / 1.5  # of more rows a smaller share
    recall, _, shards = measured(spark, LARGE, 600)
    assert recall >= 0.95 and shards == 4


def test_walks_of_wide_search_are_exact():
    rng = np.random.default_rng(1)
    x = G._unit(rng.normal(size=(300, 8)))
    links = G.linked(x, 6, 20)
    assert links.shape == (300, 12) and all(i not in links[i] and len(set(r := links[i][links[i] >= 0])) == len(r) for i in range(300))
    for q in G._unit(rng.normal(size=(20, 8))):
        found, score, compared = G.walked(x, links, np.array([0]), q, 200)
        assert found[:5].tolist() == np.argsort(-(x @ q), kind="stable")[:5].tolist() and compared <= 300
        assert (np.diff(score) <= 0).all()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.1]), (6, [1.0, 0.1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = G.indexed(v, 2)
    near, compared = G.graph_knn(index, v.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"), 3, 2)
    assert [(r.rank, r.vec_id) for r in near.orderBy("rank").collect()][:2] == [(1, 6), (2, 6)] and compared.first().compared == 5
    none = G.indexed(v.limit(0), 2)
    assert G.graph_knn(none, v.select(F.col("vec_id").alias("query_id"), "embedding"), 3, 2)[0].count() == 0


def test_sweep(spark):
    rows = V.graph_index_sweep(spark, SMALL).collect()
    assert len(rows) == len(V.GRAPHS) and sum(r.chosen for r in rows) == 1 and next(r for r in rows if r.chosen).recall >= 0.95
