import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from loomtext.llm import whitening
from loomtext.llm.whitening import BITS, count_above, fitted, null_vectors, polynomial, polynomial_modulo, roots, whitened


def integers(vectors):
    return [[math.floor(whitening.SCALE * c) + whitening.SHIFT for c in v] for v in vectors]


def exact_polynomial(m):
    """det(xI - m) by the Faddeev-LeVerrier recursion in whole numbers."""
    d = len(m)
    m = np.array([[int(x) for x in r] for r in m], object)
    c, a = [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        a = m.dot(a) + c[-1] * np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        c.append(-m.dot(a).trace() // k)
    return c[::-1]


def scatter_of(x):
    n, s = len(x), np.array(x, object).sum(axis=0)
    return n * np.array(x, object).T.dot(np.array(x, object)) - np.outer(s, s)


def test_polynomial(spark):
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 9):
        m = scatter_of(rng.integers(-50, 50, (20, d)).tolist())
        expected = exact_polynomial(m)
        assert polynomial(spark, m) == expected
        p = whitening.primes(3)[-1]
        assert polynomial_modulo(m, p).tolist() == [c % p for c in expected]
    sparse = np.zeros((4, 4), object)
    sparse[0, 3] = sparse[3, 0] = 2  # pivots of zero
    sparse[1, 1] = 5
    assert polynomial_modulo(sparse, 97).tolist() == [c % 97 for c in exact_polynomial(sparse)]
    assert polynomial(spark, np.zeros((3, 3), object)) == [0, 0, 0, 1]


def product(zeros):
    poly = [1]
    for z in zeros:
        poly = [a - z * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    return poly


def test_roots_with_multiplicity():
    zeros = [0, 0, 1, 7, 7, 7, 1000, 10**20, 10**20 + 1]
    poly = product(zeros)
    assert [count_above(poly, x) for x in (0, 1, 6, 7, 10**20)] == [7, 6, 6, 3, 1]
    found = roots(poly, 32)
    assert [(round(Fraction(r, 1 << BITS)), k) for r, k in found] == [(10**20 + 1, 1), (10**20, 1), (1000, 1), (7, 3), (1, 1)]
    assert all(abs(Fraction(r, 1 << BITS) - round(Fraction(r, 1 << BITS))) < Fraction(1, 10**50) for r, _ in found)
    assert sum(k for _, k in roots(poly, 3)) >= 3
    close = product([3 * 2**60, 3 * 2**60 + 1])
    assert [k for _, k in roots(close, 2)] == [1, 1]
    assert roots([0, 0, 1], 5) == [] and roots([-2, 0, 1][:1], 5) == []
    irrational = roots([1, -3, 1], 2)  # (3 + sqrt 5) / 2 and (3 - sqrt 5) / 2
    assert [r / 2**BITS for r, _ in irrational] == pytest.approx([(3 + 5**0.5) / 2, (3 - 5**0.5) / 2], rel=1e-15)


def test_null_vectors():
    m = np.array([[2, 1, 0], [1, 2, 0], [0, 0, 3]], object)  # 3 twice, 1
    two, one = null_vectors(m, 3 << BITS, 2), null_vectors(m, 1 << BITS, 1)
    assert np.abs(two @ two.T - np.eye(2)).max() < 1e-15 and np.abs(two @ m.astype(float) - 3 * two).max() < 1e-14
    assert one[0] == pytest.approx([0.5**0.5, -(0.5**0.5), 0], abs=1e-15) or one[0] == pytest.approx([-(0.5**0.5), 0.5**0.5, 0], abs=1e-15)


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, 0.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double").repartition(3)


def check(df, vectors, model):
    x = np.array(integers(vectors), object)
    n, s = len(x), x.sum(axis=0)
    assert model.n == n and model.trace == int(scatter_of(x).trace())
    v = scatter_of(x).astype(float) / n**2
    e = np.linalg.eigvalsh(v)[::-1]
    k = len(model.values)
    assert np.array([float(Fraction(r, n * n << BITS)) for r in model.values]) == pytest.approx(e[:k], rel=1e-6)
    assert np.abs(model.vectors @ v - np.array(e[:k])[:, None] * model.vectors).max() < 1e-6 * e[0]
    rows = {r.vec_id: r for r in whitened(df, model).collect()}
    got = np.array([rows[i].whitened_ for i in range(n)])
    assert np.abs(np.cov(got.T, bias=True) - np.eye(k)).max() < 1e-9 and model.identity_error < 1e-9
    centred = np.array([[float(Fraction(n * int(c) - int(t), n)) for c, t in zip(r, s, strict=True)] for r in x])
    assert got == pytest.approx(centred @ model.matrix(), abs=1e-9)
    assert [int(rows[i].deviation) for i in range(n)] == [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s, strict=True)) for r in x]


def test_against_plain(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(60, 7)) * rng.uniform(0.2, 9, 7)).tolist()
    df = frame(spark, vectors)
    model = fitted(df)
    assert len(model.values) == 7
    check(df, vectors, model)
    assert len(fitted(df, most=3).values) == 3


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    vectors = [[1e9 + a, -3e7 * b, c] for a, b, c in rng.normal(size=(40, 3)).tolist()]
    df = frame(spark, vectors)
    check(df, vectors, fitted(df))


def test_rank_and_ties(spark):
    """A dimension that is constant, one that repeats another, and equal variances in two others."""
    vectors = [[a, a, 3.0, b, c] for a in (-1.0, 1.0) for b in (-2.0, 2.0) for c in (-2.0, 2.0)]
    df = frame(spark, vectors)
    model = fitted(df)
    assert len(model.values) == 3 and model.explained() == pytest.approx([0.4, 0.4, 0.2])
    check(df, vectors, model)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(20, 3)).tolist()
    odd = [None, [], [None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0], [1e300, 1.0, 2.0], [1.0, 2.0]]
    df = frame(spark, good + odd + good[:3], [*range(20), *[None] * len(odd), 0, None, 0])
    model = fitted(df)
    assert model.n == 23
    rows = whitened(df, model).collect()
    assert len(rows) == 23 and sum(r.vec_id == 0 for r in rows) == 3 and sum(r.vec_id is None for r in rows) == 1
    empty = frame(spark, [])
    assert fitted(empty).n == 0 and whitened(empty, fitted(empty)).collect() == []
    same = frame(spark, [[1.0, 2.0]] * 4)
    assert fitted(same).values == [] and [r.whitened_ for r in whitened(same, fitted(same)).collect()] == [[]] * 4


def test_query_on_embeddings(spark):
    e = pq.read_table(f"{SMALL}/embeddings.parquet")
    ids, x = e["vec_id"].to_pylist(), np.array(integers(e["embedding"].to_pylist()), float)
    centred = x - x.mean(axis=0)
    value, vector = np.linalg.eigh(centred.T @ centred / len(x))
    value, vector = value[::-1], vector[:, ::-1]
    expected = centred @ vector[:, :32] / np.sqrt(value[:32])
    rows = whitening.query(spark, SMALL).toPandas()
    got = rows.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert got.shape == expected.shape and np.abs(got * np.sign((got * expected).sum(axis=0)) - expected).max() < 1e-6
    assert rows.groupby("component").explained.first().to_numpy() == pytest.approx(value[:32] / value.sum(), rel=1e-9)
    assert (rows.n == len(ids)).all() and (rows.identity_error < 1e-9).all()
