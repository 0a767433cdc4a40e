"""Every query that has SQL against DuckDB over the smallest tables; the others against plain versions."""

import math

import duckdb
import pytest
from conftest import SMALL

from loomtext.jobs import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(df.columns) == sorted(want.columns)
    columns = list(want.columns)
    want = [[None if isinstance(x, float) and math.isnan(x) else x for x in r] for r in want.astype(object).to_numpy().tolist()]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want)


def test_token_bucket(spark):
    got = {r.event_id: r.allowed for r in catalog.queries()["token_bucket_limits"](spark, SMALL).collect()}
    events = sorted(((r.user_id, r.ts.timestamp(), r.event_id) for r in spark.read.parquet(f"{SMALL}/events.parquet").collect()))
    state, want = {}, {}
    for u, t, i in events:
        tokens, last = state.get(u, (2.0, t))
        tokens = min(2.0, tokens + (t - last) / 7200)
        want[i] = tokens >= 1
        state[u] = (tokens - want[i], t)
    assert sum(got[i] != want[i] for i in want) == 0 and not all(want.values())


def test_fitted_history(spark):
    got = {r.conv_id: (r.kept, r.used) for r in catalog.queries()["fitted_history"](spark, SMALL).collect()}
    by = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, max(1, len(r.text) // 4)))
    for c, turns in by.items():
        kept, used = [], 0
        for t, n in sorted(turns, reverse=True):
            if used + n <= 60:
                kept.append(t)
                used += n
        assert got[c] == (",".join(map(str, sorted(kept))), used)


def test_recursive_chunks_keep_all_words(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {}
    for r in catalog.queries()["chunk_recursive"](spark, SMALL).orderBy("doc_id", "chunk_index").collect():
        assert 0 < len(r.chunk) <= 300
        got.setdefault(r.doc_id, []).append(r.chunk)
    for i, t in texts.items():
        at = 0
        for c in got[i]:
            at = max(at, t.find(c[-20:], max(0, at - 60)))
            assert at >= 0
        assert t.strip().startswith(got[i][0][:20]) and t.strip().endswith(got[i][-1][-20:])


def test_mmr(spark):
    import numpy as np

    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    cos = lambda a, b: float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    got = {}
    for r in catalog.queries()["mmr_top3"](spark, SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q, found in got.items():
        pool = sorted((i for i in v if i != q), key=lambda i: (-round(cos(q, i), 6), i))[:10]
        chosen = []
        while len(chosen) < 3:
            value = lambda i: (round(0.5 * round(cos(q, i), 6) - 0.5 * max((round(cos(i, j), 6) for j in chosen), default=0), 6), round(cos(q, i), 6), -i)
            chosen.append(max((i for i in pool if i not in chosen), key=value))
        assert found == chosen


def test_lsh_recall_and_pca(spark):
    assert catalog.queries()["lsh_recall"](spark, SMALL).first().recall >= 0.9
    import numpy as np

    p = np.array([[r.pc1, r.pc2] for r in catalog.queries()["pca_2d"](spark, SMALL).collect()])
    v = np.array([r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()], float)
    s = np.linalg.svd(v - v.mean(0), compute_uv=False)
    assert np.allclose(np.sqrt((p**2).sum(0)), s[:2], rtol=1e-4)
