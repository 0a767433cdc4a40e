import random
from collections import defaultdict

import pytest

from loomtext.operators import impact
from loomtext.operators.lexical import top

IMPACTS, WEIGHTS = "doc_id long, term string, x double", "query_id string, term string, w double"


def plain(impacts, weights, k):
    held, score = defaultdict(list), defaultdict(float)
    for d, t, x in impacts:
        held[t].append((d, x))
    for q, t, w in weights:
        for d, x in held[t]:
            score[q, d] += w * x
    by = defaultdict(list)
    for (q, d), s in score.items():
        by[q].append((-round(s, 6), d))
    return sorted((q, i + 1, d, -s) for q, rows in by.items() for i, (s, d) in enumerate(sorted(rows)[:k]))


def made(seed, docs, words):
    """Word 0 is in every document, and a third of all postings are its; the others are rare."""
    rng = random.Random(seed)
    rows = [(d, "w0", rng.choice([0.25, 0.5, 0.5, 1.0])) for d in range(docs)]
    rows += [(d, f"w{w}", rng.choice([0.3, 0.7, 1.9])) for d in range(docs) for w in {int(1 + rng.expovariate(0.08)) % words for _ in range(2)} - {0}]
    return rows


@pytest.mark.parametrize("shares", [(0.0,), (0.6, 0.3, 0.0)])
def test_search_equals_all_pairs(spark, shares):
    rng = random.Random(4)
    rows = made(3, 600, 60)
    asked = [(f"q{q}", f"w{w}", 0.1 if w == 0 else rng.choice([0.5, 2.0, 4.0])) for q in range(25) for w in {0, *(rng.randrange(1, 60) for _ in range(4))}]
    asked += [("common", "w0", 1.0), ("rare", "w59", 3.0), ("nowhere", "absent", 1.0)]
    asked += [("less", "w0", -0.2), ("less", "w3", 1.0), ("below", "w0", -1.0)]  # weights below zero, with and without others
    index = impact.Index.of(spark.createDataFrame(rows, IMPACTS), levels=8, segment=64)
    assert index.segments.where("term = 'w0'").count() > 8
    found = index.search(spark.createDataFrame(asked, WEIGHTS), 5, seeds=2, shares=shares)
    got = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in top(found.scores, 5).collect())
    want = plain(rows, asked, 5)
    assert [x[:3] for x in got] == [x[:3] for x in want] and all(abs(x[3] - y[3]) < 1e-9 for x, y in zip(got, want, strict=True))
    work = found.work().first()
    assert work.postings_read < work.postings and work.pairs_scored <= work.pairs_met and work.questions == len({q for q, t, _ in asked if t != "absent"})


def test_long_lists_of_common_words_are_not_read(spark):
    rows = made(8, 2000, 200)
    asked = [(f"q{q}", t, w) for q in range(1, 40) for t, w in (("w0", 0.05), (f"w{q}", 5.0))]
    found = impact.Index.of(spark.createDataFrame(rows, IMPACTS), segment=100).search(spark.createDataFrame(asked, WEIGHTS), 3)
    work = found.work().first()
    assert sorted(r[:3] for r in map(tuple, top(found.scores, 3).collect())) == [x[:3] for x in plain(rows, asked, 3)]
    assert work.postings_read < work.postings / 5 and work.pairs_scored < 39 * 2000 / 5


def test_nothing_to_search(spark):
    none, some = spark.createDataFrame([], IMPACTS), spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], IMPACTS)
    asked = spark.createDataFrame([("q", "a", 1.0)], WEIGHTS)
    assert impact.Index.of(none).search(asked, 3).scores.count() == 0
    assert impact.Index.of(some).search(asked.limit(0), 3).scores.count() == 0
    assert sorted(map(tuple, impact.Index.of(some).search(asked, 1).scores.collect())) == [("q", 1, 1.0), ("q", 2, 1.0)]
    assert impact.Index.of(none).search(asked, 3).work().first() == (0, 0, 0, 0, 0)
