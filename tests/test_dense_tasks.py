"""Approximate searches inside tasks: the pairs that plain code names, none of which becomes a row."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from loomtext.jobs import catalog
from loomtext.operators import dense


def vectors(spark):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(-1, None), (-2, [1.0, 2.0]), (-3, [None] * 64), (None, [1.0] * 64)], v.schema)
    return v.unionByName(odd)


def best(q, ids, m, named, k):
    """Of the query with number q, its k nearest by cosine among those named."""
    score = np.round(dense.similarity("cosine", m[q : q + 1], m)[0], 6)
    return sorted((-score[i], ids[i]) for i in range(len(ids)) if named[i] and i != q)[:k]


def shared(m, q, planes, tables, probes):
    """Rows that share a bucket with row q, or are in a bucket next to its own."""
    normals = np.random.default_rng(7).standard_normal((tables * planes, m.shape[1]))
    far = (m @ normals.T).reshape(len(m), tables, planes)
    named = np.zeros(len(m), bool)
    for t in range(tables):
        bits = far[:, t] > 0
        named |= (bits == bits[q]).all(1)
        for p in np.argsort(np.abs(far[q, t]))[:probes]:
            named |= (bits == (bits[q] ^ (np.arange(planes) == p))).all(1)
    return named


@pytest.mark.parametrize("most", [0, dense.MOST_NUMBERS])
def test_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(dense, "ROWS", 37)
    v = vectors(spark)
    asked = v.where("vec_id % 9 = 0 or vec_id < 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = v.where("vec_id >= 0").orderBy("vec_id").collect()
    ids, m = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    of = dense.Buckets(64, 7, 3, 2)
    named = {ids[q]: shared(m, q, 7, 3, 2) for q in range(len(ids)) if ids[q] % 9 == 0}
    got = dense.lsh_knn(v, asked, 4, 64, 7, 3, 2, most=most).collect()
    want = [(i, r + 1, x, -s) for i, n in named.items() for r, (s, x) in enumerate(best(ids.index(i), ids, m, n, 4))]
    assert sorted(map(tuple, got)) == sorted(want)
    n = dense.compared(v, asked, 64, of, most=most).first().n
    assert n == sum(x.sum() - 1 for x in named.values()) and 0 < n < len(named) * len(ids) / 2
    assert dense.compared(v.limit(0), asked, 64, of).first().n == dense.compared(v, asked.limit(0), 64, of).first().n == 0
    assert dense.lsh_knn(v, asked.limit(0), 4, 64).count() == dense.lsh_knn(v.limit(0), asked, 4, 64).count() == 0


def test_no_pairs_of_buckets_are_joined(spark):
    """What is compared is not made into rows: the only join is of found and exact neighbours."""
    plan = catalog.queries()["lsh_recall"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" not in plan and plan.count("Join LeftOuter") == 1 and "Join Inner, (" not in plan


@pytest.mark.parametrize("most", [0, dense.MOST_NUMBERS])
def test_cells(spark, monkeypatch, most):
    monkeypatch.setattr(dense, "ROWS", 37)
    v = vectors(spark)
    asked = v.where("vec_id % 9 = 0 or vec_id < 0").select(F.col("vec_id").alias("query_id"), "embedding")
    rows = v.where("vec_id >= 0").orderBy("vec_id").collect()
    ids, m = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    centres = dense.trained_cells(v, 64, 9)
    near, scored = dense.cell_knn(v, asked, 4, centres, 3, most)
    of = (m @ centres.T).argmax(1)
    named = {ids[q]: np.isin(of, np.argsort(-(m[q] @ centres.T), kind="stable")[:3]) for q in range(len(ids)) if ids[q] % 9 == 0}
    want = [(i, r + 1, x, -s) for i, n in named.items() for r, (s, x) in enumerate(best(ids.index(i), ids, m, n, 4))]
    assert sorted(map(tuple, near.collect())) == sorted(want)
    assert scored.first().n == sum(n.sum() - n[ids.index(i)] for i, n in named.items())
    assert dense.cell_knn(v.limit(0), asked, 4, centres, 3)[0].count() == dense.cell_knn(v, asked.limit(0), 4, centres, 3)[1].first().n == 0


def test_no_pairs_of_cells_are_joined(spark):
    v = vectors(spark)
    near, scored = dense.cell_knn(v, v.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding"), 4, np.eye(64)[:4], 2)
    assert all("Join" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (near, scored))
