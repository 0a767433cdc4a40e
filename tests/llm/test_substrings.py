import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import substrings
from loomtext.llm.substrings import COVER, PERIOD, WINDOW, _blocks, without_repeats


def plain(texts, window=WINDOW):
    """(n_words, n_removed, kept) of each text, by a table of all windows."""
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_cover_reaches_every_pair_of_residues():
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + s) % PERIOD in COVER and (j + s) % PERIOD in COVER for s in range(PERIOD))


@given(st.integers(0, 120), st.integers(0, 40), st.lists(st.integers(0, 2), min_size=60, max_size=160))
@settings(max_examples=100, deadline=None)
def test_equal_windows_share_an_anchor(a, b, words):
    """Any two equal windows hold an anchor at the same shift, and windows() of that anchor gives both back."""
    n = len(words)
    starts = [i for i in range(n - WINDOW + 1)]
    at = set(substrings.anchors(n).tolist())
    for i in starts[:: max(1, len(starts) // 8)]:
        for j in starts[:: max(1, len(starts) // 8)]:
            shift = [s for s in range(PERIOD) if i + s in at and j + s in at]
            assert shift
            assert i in substrings.windows(np.array([i + shift[0]]), n)


def test_runs_hash_equal_words_equally():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    words[3000:3100] = words[100:200]
    runs = substrings.Runs()
    starts = np.arange(len(words) - 14)
    for lane in (0, 1):
        h = runs.of(words, starts, 15, lane)
        assert (h[3000:3086] == h[100:186]).all() and len(np.unique(h)) == len(h) - 86


def test_blocks_are_the_words(monkeypatch):
    monkeypatch.setattr(substrings, "STEP_BYTES", 16)
    text = b"a bb\tccc\n\n  dddddddddddddddddddddddddddd e\x0b\x0cf \xc2\xa0g" * 9 + b"  "
    assert [w for block in _blocks(text) for w in block] == text.split()


def passages():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    run = lambda n: [word() for _ in range(n)]
    shared, line = run(80), run(34)
    texts = [None, "", " \t\n", "one two", " ".join(line), " ".join(line)]
    texts += [" ".join(run(rng.randrange(1, 50)) + shared[rng.randrange(10) : 80 - rng.randrange(10)] + run(rng.randrange(50))) for _ in range(30)]
    texts += [" ".join(run(60))] * 4  # copies
    texts += ["same " * 36, "same " * 35, "tick tock " * 40]  # windows that repeat inside a row
    texts += ["  ".join(run(20) + line + [word()]) for _ in range(5)]  # a run of 34: a word too short
    texts += [" ".join(run(5000) + shared + run(3000)), "ünï cödé  " * 3 + " ".join(shared)]
    return texts


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(substrings, "STEP_BYTES", 4096)
    monkeypatch.setattr(substrings, "HELD", 500)
    texts = passages()
    docs = spark.createDataFrame([(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, place int").repartition(5)
    got = {r.place: r for r in without_repeats(docs).collect()}
    assert len(got) == len(texts) and set(docs.columns) < set(next(iter(got.values())).asDict())
    for i, (n, gone, kept) in enumerate(plain(texts)):
        assert (got[i].n_words_, got[i].n_removed, got[i].kept) == (n, gone, kept), i
        assert (got[i].text, got[i].n_words, got[i].doc_id) == (texts[i], "x", i if i % 7 else None)


def test_shorter_windows(spark):
    texts = passages()[6:30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (PERIOD, 24):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(docs, window).collect()}
        assert [got[i] for i in range(len(texts))] == plain(texts, window)
    with pytest.raises(ValueError, match="windows"):
        without_repeats(docs, PERIOD - 1)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = {d.doc_id: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, (n, gone, kept) in zip(docs, plain([d.text for d in docs]), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.query(spark, SMALL).collect()}
    assert got == expected and any(gone for _, gone, _ in expected.values())
