import numpy as np
from conftest import MIDDLE
from pyspark.sql import functions as F

from loomtext.llm import topk


def plain(ids, vectors, asked, k=5):
    v = np.floor(256 * np.asarray(vectors, float)).astype(np.int64)
    out = []
    for i in asked:
        s = v @ v[list(ids).index(i)]
        order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k]
        out += [(i, r + 1, ids[j], int(s[j])) for r, j in enumerate(order)]
    return out


def test_query(spark):
    rows = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()
    ids = [r.vec_id for r in rows]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.query(spark, MIDDLE).collect())
    assert got == plain(ids, [r.embedding for r in rows], sorted(i for i in ids if i % 50 == 0))


def test_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{MIDDLE}/embeddings.parquet')")
    want = con.execute(topk.SQL).df()
    got = topk.query(spark, MIDDLE).toPandas()
    assert sorted(map(tuple, got[want.columns].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist())) and len(got) > 0


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BYTES", 40 * 8 * 20)
    monkeypatch.setattr(topk, "QUERY_BYTES", 7 * 8 * 20)
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (300, 20)) / 4
    v[50:120] = v[50]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_inner_products(df, F.col("vec_id") % 10 == 0).collect())
    assert got == plain(range(300), v, range(0, 300, 10))


def test_many_dimensions_and_equal_rows(spark, monkeypatch):
    """Blocks hold as many bytes at 768 and 4,096 dimensions as at 64; equal rows spread over them."""
    assert topk.CANDIDATE_BYTES // (8 * 64) == 65536 and topk.QUERY_BYTES // (8 * 64) == 16384
    monkeypatch.setattr(topk, "CANDIDATE_BYTES", 1 << 18)
    held = []
    monkeypatch.setattr(topk, "_searched", lambda dims, k, old=topk._searched: held.append(dims) or old(dims, k))
    rng = np.random.default_rng(3)
    for dims in (768, 4096):
        v = rng.integers(-2, 3, (120, dims)) / 8
        v[20:90] = v[20]
        df = spark.createDataFrame([(i if i < 80 else 20, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_inner_products(df, F.col("vec_id") == 3).collect())
        s = np.floor(256 * v).astype(np.int64) @ np.floor(256 * v[3]).astype(np.int64)
        ids = [i if i < 80 else 20 for i in range(120)]
        order = sorted((j for j in range(120) if ids[j] != 3), key=lambda j: (-s[j], ids[j]))[:5]
        assert [(r[2], r[3]) for r in got] == [(ids[j], int(s[j])) for j in order]
    assert held == [768, 4096]


def test_bounds_drop_nothing():
    rng = np.random.default_rng(2)
    for scale in (10, 1000, 1 << 24):
        c = (rng.standard_normal((70, 500)) * scale * np.geomspace(1, 0.01, 70)[:, None]).astype(np.int64)
        q = c[:, :20].T.copy()
        ids = np.arange(500)
        s = q @ c
        for i, got, score in topk.best(ids[:20], q, ids, c, 5):
            order = [j for j in np.lexsort((ids, -s[i])) if j != i][:5]
            assert got.tolist() == order and score.tolist() == s[i][order].tolist()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [-1.0, 2.0]), (6, [-1.0, 2.0]), (7, [])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_inner_products(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 5, 65536), (0, 2, 6, 0), (0, 3, 6, 0), (0, 4, 7, 0)]
    assert topk.top_inner_products(df.limit(0), F.lit(True)).count() == topk.top_inner_products(df, F.lit(False)).count() == 0
