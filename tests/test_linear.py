import time
from collections import Counter
from math import sqrt

from conftest import SMALL
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import chunk as C
from loomtext.operators import dense as D
from loomtext.operators import lexical as L


def test_slices_are_those_of_python(spark):
    texts = ["", "a", "ab" * 7, "line\nbreaks\r\n and ünï 😀 cödé " * 5, " " * 30, "x" * 20, "x" * 21]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    for size, overlap in ((10, 0), (10, 3), (10, 9), (1, 0), (400, 60)):
        got = {r.i: r.s for r in df.select("i", C.slices(F.col("t"), size, overlap).alias("s")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == [t[k : k + size] for k in range(0, len(t), size - overlap)], (i, size, overlap)
        early = {r.i: r.s for r in df.select("i", C.windows(F.col("t"), size, overlap).alias("s")).collect()}
        for i, t in enumerate(texts):
            expected = [t[k : k + size].strip() for k in range(0, len(t), size - overlap) if k == 0 or k < len(t) - overlap]
            assert early[i] == [x for x in expected if x], (i, size, overlap)


def test_long_texts_are_cut_in_linear_time(spark):
    took = []
    for many in (1, 4, 1):
        df = spark.createDataFrame([("word " * (2_000_000 // 4 * many),)], "t string").cache()
        df.count()
        began = time.time()
        assert df.select(F.size(C.windows(F.col("t"), 400, 60)).alias("n")).first().n > many * 7000
        took.append(time.time() - began)
    assert took[1] < 10 * max(took[2], 0.3)  # 10 million characters; sixteen times as long if it were quadratic


def test_cosine_of_short_and_long_lists(spark):
    lists = [[], [1], [1, 1, 2], [255, 0, 0], [i % 256 for i in range(3000)], [i * i % 256 for i in range(5000)]]
    rows = [(i, j, a, b) for i, a in enumerate(lists) for j, b in enumerate(lists)]
    df = spark.createDataFrame(rows, "i int, j int, a array<int>, b array<int>")
    for r in df.select("i", "j", T.bag_cosine(F.col("a"), F.col("b")).alias("c")).collect():
        a, b = Counter(lists[r.i]), Counter(lists[r.j])
        size = sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        assert abs(r.c - (sum(a[k] * b[k] for k in a) / size if size else 0)) < 1e-12


def test_postings_count_terms(spark):
    texts = [(1, "a b a"), (2, ""), (3, None), (None, "b " * 1000), (4, "a b a")]
    got = sorted((r.doc_id or 0, r.dl, r.term, r.tf) for r in L.postings(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == [(0, 1000, "b", 1000), (1, 3, "a", 2), (1, 3, "b", 1), (4, 3, "a", 2), (4, 3, "b", 1)]
    assert L.postings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_document_has_a_rank_in_both_lists(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    questions = spark.createDataFrame([(1, "the and of"), (2, "zzzz"), (3, "")], "query_id long, query string")
    rows = L.ranked_everywhere(docs, questions).collect()
    n = docs.count()
    for q in (1, 2, 3):
        own = [r for r in rows if r.query_id == q]
        for name in ("words", "vectors"):
            order = sorted(own, key=lambda r, name=name: (-r[name], r.doc_id))
            assert [r[f"{name}_rank"] for r in order] == list(range(1, n + 1))
    best = {r.doc_id: r.score for r in L.bm25_top(docs, questions, 5).where("query_id = 1").collect()}
    assert best == {r.doc_id: r.words for r in rows if r.query_id == 1 and r.doc_id in best}
    assert all(r.words == 0 for r in rows if r.query_id > 1)
    assert L.ranked_everywhere(docs.limit(0), questions).count() == 0


def test_filters_rank_by_their_value(spark):
    docs = spark.createDataFrame([(1, "about cats", "cats"), (2, "cats cats", "cats"), (3, "dogs", "cats"), (4, "cats", "dogs"), (5, None, "cats")], "doc_id long, text string, topic string")
    got = D.filtered_by_value(docs, " topic = cats ", 3).collect()
    assert [(r.rank, r.doc_id) for r in sorted(got)] == [(1, 2), (2, 1), (3, 3)] and got[0].field == "topic"
    for spec in ("topic", "= cats", "nothing=cats", "", None, "topic=", "topic=birds"):
        assert D.filtered_by_value(docs, spec, 3).collect() == []


def test_the_sweep_names_its_choice(spark):
    from loomtext.jobs import chunking

    rows = chunking.chunk_sweep_chosen(spark, SMALL).collect()
    assert len(rows) == 10 and {r.strategy for r in rows} == {"slices", "sentences"}
    assert [r.proxy for r in rows if r.chosen] == [max(r.proxy for r in rows)]
