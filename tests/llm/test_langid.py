import random
import numpy as np
from conftest import MIDDLE

from loomtext.llm import langid


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    got = langid.query(spark, MIDDLE).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_bit_slices_equal_separate_filters():
    rng = np.random.default_rng(1)
    bits, hashes = 10, 3
    sets = [rng.integers(0, 1 << 63, 60).astype(np.uint64) for _ in range(3)]
    masks, own = np.zeros(1 << bits, np.uint64), [set() for _ in sets]
    for i, s in enumerate(sets):
        for p in langid.cells(s, bits, hashes).ravel():
            masks[p] |= np.uint64(1 << i)
            own[i].add(int(p))
    asked = np.concatenate([*sets, rng.integers(0, 1 << 63, 500).astype(np.uint64)])
    where = langid.cells(asked, bits, hashes)
    mask = np.bitwise_and.reduce(masks[where], axis=0)
    for i, o in enumerate(own):
        assert [bool(m >> i & 1) for m in mask.tolist()] == [all(int(p) in o for p in w) for w in where.T]


def test_texts_alone_or_together():
    """What a text's n-grams are doesn't depend on its neighbours."""
    texts = ["Ab c", "", "É! é", "12 34", "x", "straße İstanbul ΣΑΣ"]
    h, owner = langid.grams(texts)
    for i, t in enumerate(texts):
        assert langid.grams(["", t, ""])[0].tolist() == h[owner == i].tolist()


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(30)] + [(i, "der hund und die katze " * 3, "de") for i in range(30, 60)]
    rows += [(60, None, "en"), (61, "", "de"), (62, "123 !!", None), (63, "漢字", None), (None, "the dog", "en"), (1, rows[1][1], "en"), (64, "und die " * 50000, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = langid.predicted(docs, langid.model_of(docs)).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows)
    assert by[0] == by[1] == by[None] == "en" and by[30] == by[64] == "de" and by[60] == by[61] == by[62] == "und" and by[63] in ("de", "en")
    empty = docs.limit(0)
    assert langid.predicted(empty, langid.model_of(empty)).count() == 0
    assert {r.lang_pred for r in langid.predicted(docs, langid.model_of(empty)).collect()} == {"und"}


def test_hundreds_of_languages(spark):
    """Filters of 150 languages, each with words of its own, in three mask words a cell."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzäöüéèñçßøåæœðþłşğıžčšđ"))
    words = [["".join(rng.choice(letters, 6)) for _ in range(20)] for _ in range(150)]
    rows = [(i, " ".join(rng.choice(words[i % 150], 12)), f"l{i % 150:03}") for i in range(150 * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.masks.shape == (3, 1 << 18) and model.languages == [f"l{i:03}" for i in range(150)]
    got = {r.doc_id: r.lang_pred for r in langid.predicted(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.99 * len(rows)


def test_filters_against_sets(spark):
    """The whole way by plain sets of cells: n-grams that enough texts hold, their cells, corrected counts, the answer."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, bits=14)
    of_text = {i: langid.grams([t])[0].tolist() for i, t, _ in rows}
    cells = lambda h: [((h + i * ((h >> 40) | 1)) % (1 << 64)) & (1 << 14) - 1 for i in range(3)]
    filled = {}
    for lang in sorted({x for _, _, x in rows}):
        texts = [set(of_text[i]) for i, _, x in rows if x == lang]
        counts = {}
        for s in texts:
            for h in s:
                counts[h] = counts.get(h, 0) + 1
        filled[lang] = {c for h, n in counts.items() if n >= 0.02 * len(texts) for c in cells(h)}
    got = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    for i, t, _ in rows[:300]:
        right = {}
        for lang, has in filled.items():
            wrong = (len(has) / (1 << 14)) ** 3
            n = sum(all(c in has for c in cells(h)) for h in of_text[i])
            right[lang] = max(0.0, (n - len(of_text[i]) * wrong) / (1 - wrong))
        if any(map(str.isalpha, t)) and max(right.values()) > 0:
            assert right[got[i].lang_pred] >= max(right.values()) - 1e-6 and abs(got[i].score - right[got[i].lang_pred] / sum(right.values())) < 1e-6


def test_rows_that_share_an_id_are_drawn_one_by_one(spark):
    rng = random.Random(8)
    speak = {"en": "the and of to in that", "de": "der und die von zu das"}
    for doc_id in (7, None):
        rows = [(doc_id, " ".join(rng.choices(speak[x].split(), k=30)), x) for x in speak for _ in range(50)]
        model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=5)
        assert model.predict(["the of that in and", "das die der und von"])[0] == ["en", "de"]
