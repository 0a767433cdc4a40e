import random
import re
import tracemalloc
import zlib
from collections import Counter
from itertools import product
from math import exp, isclose, log, log10

import numpy as np
import public_tokenizers
from conftest import MIDDLE
from pyspark.sql import functions as F

from loomtext.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(s):
    for marks in product([0, 1], repeat=len(s) - 1):
        at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(s)]
        yield [s[a:b] for a, b in zip(at, at[1:], strict=False)]


def test_forward_and_expected_counts_over_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", *(f"<0x{b:02X}>" for b in range(256))]
    p = np.arange(1, len(pieces) + 1, dtype=float)
    p /= p.sum()
    model, of = lattice.Lattice(pieces, np.log(p)), dict(zip(pieces, p, strict=True))
    for word in ("a", "abab", "babba", "aébab", "", "ßß"):
        total, counts = 0.0, Counter()
        for cut in segmentations("▁" + word):
            if any(x not in of and (len(x) > 1 or x in "ab▁") for x in cut):
                continue
            used = [y for x in cut for y in ([x] if x in of else [f"<0x{b:02X}>" for b in x.encode()])]
            weight = float(np.prod([of[x] for x in used]))
            total += weight
            for x in used:
                counts[x] += weight
        assert isclose(exp(model.forward(word)), total, rel_tol=1e-9)
        into = np.zeros(len(pieces))
        model.expect(word, 3, into)
        assert all(isclose(into[i], 3 * counts[x] / total, rel_tol=1e-9, abs_tol=1e-12) for i, x in enumerate(pieces))


def test_long_words_need_little_memory(monkeypatch):
    pieces, logs = lattice.vocabulary(PATH)
    model = lattice.Lattice(pieces, logs)
    word = "".join(random.Random(3).choice("abcdeé日") for _ in range(3000))
    kept, again = np.zeros(len(pieces)), np.zeros(len(pieces))
    model.expect(word, 2, kept)
    before, other = model.forward(word), lattice.Lattice(pieces, logs[::-1])
    for w in (word, "", "an ordinary word", "日é"):
        assert model.forward_both(w, other) == (model.forward(w), other.forward(w))
    monkeypatch.setattr(lattice, "LONG_WORD", 100)
    model.expect(word, 2, again)
    assert np.allclose(kept, again, rtol=1e-9, atol=1e-12) and model.forward(word) == before
    total, word = [0.0] * len(pieces), word * 20
    tracemalloc.start()
    model.expect(word, 1, total)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * len(word) + 2e6


def plain(docs):
    """By id: tokens, known tokens, training tokens and base score."""
    words = {i: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in docs.items()}
    c = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in words.items()}


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    want = plain(texts)
    got = {r.doc_id: r for r in lattice.query(spark, MIDDLE).collect()}
    assert set(got) == set(want)
    for i, (n, known, train, base) in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and isclose(r.base_score, base, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and r.score < 0
    for i, score in plain_model(texts).items():
        assert isclose(got[i].score, score, rel_tol=1e-6)


def plain_model(docs):
    """By id: the score, without Spark."""
    words = {i: (t or "").encode().lower().split() for i, t in docs.items()}
    c, ends = Counter(), 0
    for i, ws in words.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(ws)
            ends += 1
    pieces, logs = lattice.vocabulary(PATH)
    for _ in range(lattice.ROUNDS):
        total, model = np.zeros(len(pieces)), lattice.Lattice(pieces, logs)
        for w in c:
            model.expect(w.decode(), 1, total)
        logs = np.log((total + lattice.SMOOTH) / (total.sum() + lattice.SMOOTH * len(pieces)))
    model, n, once = lattice.Lattice(pieces, logs), sum(c.values()), sum(x == 1 for x in c.values())
    end = (ends + lattice.SMOOTH) / (n + ends + 2 * lattice.SMOOTH)
    rest, known = once / (n + 1), {}
    for w in {w for ws in words.values() for w in ws}:
        known[w] = log10(1 - end) + np.logaddexp(log((1 - rest) * c[w] / n) if c[w] else -np.inf, log(rest) + model.forward(w.decode())) / log(10)
    return {i: sum(known[w] for w in ws) + log10(end) for i, ws in words.items()}


def test_probabilities_sum_to_one():
    """Over all words of a vocabulary whose pieces make but few words, and the end."""
    pieces, p = ["▁a", "▁ab", "b"], np.array([0.4, 0.2, 0.4])
    model = lattice.Lattice(pieces, np.log(p))
    words = ["a" + "b" * i for i in range(60)]
    c = np.array([5, 3, 1] + [0] * 57)
    log_p, end = lattice.mixed(c, np.array([model.forward(w) for w in words]), 9, 1, 4)
    assert isclose(np.exp(log_p).sum() + exp(end), 1, rel_tol=1e-6)


def test_small_dictionaries_give_the_same(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").limit(60)
    held = F.col("doc_id") % 3 == 0
    a, b = (sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lattice.lattice_scores(docs, PATH, held, most_words=m).collect()) for m in (300, 10**6))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "ab Ab  aB"), (3, "ab Ab  aB"), (None, "ab"), (4, "é" * 20000), (5, "word " * 20000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, c int")
    got = sorted(((r.doc_id or -1), r.n_tokens, r.n_known, r.train_tokens) for r in lattice.lattice_scores(docs, PATH, F.col("doc_id") == 2).collect())
    n = 3 + 3 + 1 + 1 + 20000 + 6
    assert got == [(-1, 2, 2, n), (1, 1, 1, n), (2, 1, 1, n), (3, 4, 4, n), (3, 4, 4, n), (4, 2, 2, n), (5, 20001, 20001, n)]
    assert lattice.lattice_scores(docs.limit(0), PATH, F.lit(False)).count() == 0
    untaught = lattice.lattice_scores(docs, PATH, F.lit(True)).collect()
    assert len(untaught) == 7 and all(r.n_known == 0 and r.train_tokens == 0 and r.score > -log(10) * 1e7 for r in untaught)


def test_the_vocabularys_own_score(spark):
    """lattice_score is the vocabulary's marginal, and the whole score where nothing is learned."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").limit(40)
    held = F.col("doc_id") % 4 == 0
    plainly = {r.doc_id: r for r in lattice.lattice_scores(docs, PATH, held, rounds=0, remembered=False).collect()}
    learned = {r.doc_id: r for r in lattice.lattice_scores(docs, PATH, held).collect()}
    model = lattice.Lattice(*lattice.vocabulary(PATH))
    texts = {r.doc_id: r.text.encode().lower().split() for r in docs.collect()}
    n, ends = sum(len(w) for i, w in texts.items() if i % 4), sum(1 for i in texts if i % 4)
    end = (ends + lattice.SMOOTH) / (n + ends + 2 * lattice.SMOOTH)
    for i, words in texts.items():
        want = sum(log(1 - end) + model.forward(w.decode()) for w in words) + log(end)
        assert isclose(plainly[i].score, want / log(10), rel_tol=1e-9)
        assert isclose(plainly[i].lattice_score, learned[i].lattice_score, rel_tol=1e-9) and isclose(plainly[i].score, plainly[i].lattice_score, rel_tol=1e-12)
    better = sum(learned[i].score > learned[i].lattice_score for i in texts)
    assert better >= 0.9 * len(texts)


def test_many_words_at_once_are_as_each_alone(monkeypatch):
    pieces, logs = lattice.vocabulary(PATH)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeétion日🙂") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    words += ["", "a", "" * 60, "🙂" * 64, "word" * 16, "x" * 65, "ab" * 3000, "▁a▁"]
    seldom = np.log(np.random.default_rng(6).dirichlet(np.full(len(pieces), 0.05)) + 1e-12)
    own, other = lattice.Lattice(pieces, logs), lattice.Lattice(pieces, seldom)
    monkeypatch.setattr(lattice, "TOGETHER", 100)
    for many, one in zip(own.forward_many(words, [own, other]), (own.forward, other.forward), strict=True):
        assert np.allclose(many, [one(w) for w in words], rtol=1e-11, atol=1e-11)
    for model in (own, other):
        many, alone = np.zeros(len(pieces)), np.zeros(len(pieces))
        model.expect_many(words, many)
        for w in words:
            model.expect(w, 1, alone)
        assert np.allclose(many, alone, rtol=1e-9, atol=1e-12)
    assert own.forward_many([], [own]) == [[]]
