"""Questions in blocks: the same results as in one, of whole documents, with only the best rows kept."""

import re
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from loomtext.functions import text
from loomtext.jobs import catalog, retrieval
from loomtext.operators import impact, lexical, scoring


@pytest.mark.parametrize("many", [2, 1 << 30])  # with and without a matrix of the words that many questions hold
def test_blocks_of_questions(spark, monkeypatch, many):
    monkeypatch.setattr(impact.Index, "of", None)  # no pairs of questions and documents become rows
    monkeypatch.setattr(scoring, "MANY", many)
    docs, questions = retrieval.docs_and_questions(spark, SMALL)
    questions = questions.unionByName(spark.createDataFrame([(-1, "no such words zzzz"), (-2, None)], questions.schema))
    named = questions.withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    whole = lexical.Collection.of(docs)
    weights = lexical.saved(whole.bm25_weights(lexical.query_terms(named)))
    assert weights.count() > 500
    got = scoring.search_in_blocks(docs, text.tokens("text"), weights, lambda m: lexical.Bm25(m, whole.mean_length), 5, ["doc_id"], most=100)
    want = lexical.bm25_top(docs, questions, 5)
    assert sorted(map(tuple, got.collect())) == sorted((f"q{q}", *x) for q, *x in map(tuple, want.collect()))
    assert sorted(map(tuple, lexical.bm25_top(docs, named, 5, most=0).collect())) == sorted(map(tuple, got.collect()))
    assert lexical.bm25_top(docs, named.limit(0), 5, most=-1).count() == 0


def test_work_of_turns(spark):
    """Figures of the search that bm25_turns does, not of another one."""
    cut = lambda rows, key: [(key(r), text_of) for r in rows for text_of in [Counter(re.findall("[a-z0-9]+", (r.text or "").lower()))]]
    docs = cut(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), lambda r: r.doc_id)
    turns = cut(spark.read.parquet(f"{SMALL}/conversations.parquet").where("role = 'user'").collect(), lambda r: (r.conv_id, r.turn))
    df = Counter(w for _, d in docs for w in d)
    pairs = sum(bool(t.keys() & d.keys()) for _, t in turns for _, d in docs)
    postings = sum(df[w] for _, t in turns for w in t)
    asked = sum(any(w in df for w in t) for _, t in turns)
    assert tuple(catalog.queries()["bm25_turns_work"](spark, SMALL).first()) == (asked, postings, postings, pairs, pairs)


@pytest.mark.parametrize("digits", [None, 1])
def test_best_of_slices(digits):
    """A question's best k, ties by ids, whatever the slices."""
    import numpy as np

    rng = np.random.default_rng(5)
    s = np.where(rng.random((7, 400)) < 0.2, -np.inf, rng.choice([0.25, 0.251, 0.3, -1.0, 0.0], (7, 400)))
    s[3] = -np.inf
    ids = rng.permutation(400)
    best = scoring.Best(7, 6, 1)
    for at in range(0, 400, 33):
        best.add(s[:, at : at + 33], [ids[at : at + 33]], digits)
    q, (of,), value = best.rows()
    want = [(i, d, -v) for i in range(7) for v, d in sorted((-(x if digits is None else round(x, digits)), int(d)) for x, d in zip(s[i], ids, strict=True) if x > -np.inf)[:6]]
    assert list(zip(q.tolist(), of.tolist(), value.tolist(), strict=True)) == want
