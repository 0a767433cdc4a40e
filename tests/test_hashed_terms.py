"""TF-IDF over more terms than go to the tasks as they are: by hash, with the same results and without joined postings."""

import pytest
from conftest import SMALL

from loomtext.jobs import retrieval
from loomtext.operators import lexical


def test_terms_by_hash(spark, monkeypatch):
    docs, questions = retrieval.docs_and_questions(spark, SMALL)
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "", ""), (-2, "", "", ""), (-3, "of of of zzzz", "", "")], docs.schema))
    want = sorted(map(tuple, lexical.tfidf_cosine_top(docs, questions, 4).collect()))
    monkeypatch.setattr(lexical, "postings", None)
    got = sorted(map(tuple, lexical.tfidf_cosine_top(docs, questions, 4, most_idf=0).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, want, strict=True))
    assert lexical.tfidf_cosine_top(docs.where("doc_id = -1"), questions, 4, most_idf=-1).count() == 0


@pytest.mark.parametrize("most_terms", [0])
def test_more_terms_than_that_are_joined(spark, most_terms):
    docs, questions = retrieval.docs_and_questions(spark, SMALL)
    want = sorted(map(tuple, lexical.tfidf_cosine_top(docs, questions, 4).collect()))
    got = sorted(map(tuple, lexical.tfidf_cosine_top(docs, questions, 4, most_idf=0, most_terms=most_terms).collect()))
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 2e-6 for x, y in zip(got, want, strict=True))
