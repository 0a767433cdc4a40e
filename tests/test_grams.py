"""Runs of tokens: trigrams counted once for a text, and shares of an answer's runs that its context has."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from loomtext.functions import text
from loomtext.jobs import catalog
from loomtext.operators import grams


def test_tokens_of_a_text_are_made_once(spark):
    """With an expression of each trigram's own this text takes 20,000 passes of its tokens."""
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 12, 20_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (3, "a B c"), (4, ""), (5, None)], "doc_id long, text string")
    got = docs.select("doc_id", text.ngrams(text.tokens("text")).alias("g")).select("doc_id", F.size("g").alias("n"), F.size(F.array_distinct("g")).alias("d"))
    want = list(zip(words, words[1:], words[2:], strict=False))
    assert {r.doc_id: (r.n, r.d) for r in got.collect()} == {1: (len(want), len(set(want))), 2: (0, 0), 3: (1, 1), 4: (0, 0), 5: (0, 0)}


def plain(a, q, n):
    a, q = a or [], q or []
    runs = lambda w: list(zip(*(w[i:] for i in range(n)), strict=False))
    of, within = (runs(a), runs(q)) if runs(a) else ([w for w in a if w not in text.STOPWORDS], q)
    return sum(x in set(within) for x in of) / len(of) if of else 1.0


@pytest.mark.parametrize("most", [1, 50, 1 << 18])
def test_supported_runs(spark, monkeypatch, most):
    monkeypatch.setattr(grams, "SLICE", most)
    rng = np.random.default_rng(2)
    some = lambda n: [("a", "b", "of", "c1", "the")[x] for x in rng.integers(0, 5, n)]
    rows = [(i, some(rng.integers(0, 9)), some(rng.integers(0, 30))) for i in range(80)]
    rows += [(100, None, ["a"]), (101, ["a", "b"], None), (102, ["a", "b", "a"], None), (103, ["of", "the"], ["of"]), (104, [], []), (105, ["b", "c1"], ["b"])]
    rows += [(106, some(3000), some(3000))]
    df = spark.createDataFrame(rows, "id long, a array<string>, q array<string>").coalesce(1)
    for n in (3, 5):
        got = {r.id: r.share for r in grams.supported(df, text.STOPWORDS, n).collect()}
        assert got == {i: plain(a, q, n) for i, a, q in rows}
        assert grams.supported(df.limit(0), text.STOPWORDS, n).count() == 0


def test_faithfulness_takes_numbers_for_lists(spark):
    """No list is searched for each of another's elements, and no text is cut anew there."""
    plan = catalog.queries()["trigram_faithfulness"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "lambda" not in plan
