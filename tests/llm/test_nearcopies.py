import numpy as np
from conftest import MIDDLE

import corpus_pipeline
from loomtext.llm import nearcopies, simhash


def plain(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """Of (id, set) pairs in order of ids, the least id of each component, by comparing all pairs."""
    label = {i: i for i, _ in rows}
    for n, (i, s) in enumerate(rows):
        for j, t in rows[:n]:
            if s == t or 5 * len(s & t) >= 4 * len(s | t) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if c == b else c for k, c in label.items()}
    return set(label.values())


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = sorted((r.doc_id, plain(r.text)) for r in docs.select("doc_id", "text").collect())
    want = kept(rows)
    distinct = len({frozenset(s) for _, s in rows})
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, MIDDLE).collect()} == want and len(want) < distinct


def test_odd_rows_and_chains(spark):
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join([*base[3 * k :], *(f"n{i}" for i in range(3 * k))]) for k in range(12)]  # ends are far apart, neighbours near
    rows = [(i + 10, t) for i, t in enumerate(chain)] + [(12, chain[2]), (1, None), (2, " \t"), (3, "one two"), (4, "ONE  two"), (None, chain[0]), (5, "x " * 50000), (6, " ".join(f"v{i}" for i in range(200)))]
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, node string")
    out = nearcopies.representatives(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1, 3, 5, 6, 10]
    assert nearcopies.representatives(docs.limit(0)).count() == 0


def test_repeated_ids_and_any_columns(spark, tmp_path):
    """Of rows that share an id one stays, whichever way they are keyed; names and types of other columns don't matter."""
    far = " ".join(f"v{i}" for i in range(50))
    rows = [(1, "a b c d e f g", 1.0), (1, "A b  c d e f g", 2.0), (1, far, 3.0), (1, far, 3.0), (2, far.upper(), 4.0), (3, "q r s t u v", 5.0)]
    docs = spark.createDataFrame([(i, t, x, x, x, {"k": x}) for i, t, x in rows], "doc_id long, text string, kept_id double, row_key double, first double, tags map<string, double>")
    docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    for df in (docs.coalesce(1), read):
        out = corpus_pipeline.near_copies(spark, df, "")
        assert out.columns == docs.columns
        assert sorted((r.doc_id, r.text, r.row_key) for r in out.collect()) == [(1, rows[0][1], 1.0), (1, far, 3.0), (3, "q r s t u v", 5.0)]
    comp = sorted((r.doc_id, r.component_id) for r in nearcopies.components(docs).collect())
    assert comp == [(1, 1)] * 4 + [(2, 1), (3, 3)]


def test_bands_are_those_of_single_sets():
    """Steps run over many sets at once; each set's values are those that it has alone."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (5, 0, 20_000, 1, 0, 300, 8192, 8191, 2)]
    together = nearcopies.bands(sets)
    for s, values in zip(sets, together, strict=True):
        assert (nearcopies.bands([s])[0] == values).all()
        if len(s):
            assert len(set(values.tolist())) == nearcopies.BANDS


def test_sketches_tell_similarity():
    """Bits of two sets differ as often as half their distance; pairs at 0.8 stay under the limit, pairs at 0.65 don't."""
    rng = np.random.default_rng(3)
    for similarity, under in ((1.0, True), (0.8, True), (0.65, False), (0.0, False)):
        n = 300
        common = round(2 * n * similarity / (1 + similarity))
        h = rng.integers(0, 1 << 64, 2 * n, np.uint64)
        a, b = nearcopies.sketches([np.sort(h[:n]), np.sort(h[n - common : 2 * n - common])])
        apart = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        p = (1 - 0.8) / 2
        limit = nearcopies.BITS * p + nearcopies.DEVIATIONS * np.sqrt(nearcopies.BITS * p * (1 - p))
        assert (apart <= limit) == under and abs(apart / nearcopies.BITS - (1 - similarity) / 2) < 0.06


def test_group_that_drifts_apart(spark):
    """Copies with one to eight changed words each, and copies of those: the components of all pairs, though most copies of
    the group are far from each other."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(140)]

    def changed(words, n):
        words = list(words)
        for i in rng.integers(0, len(words), n):
            words[i] = f"x{rng.integers(1 << 40)}"
        return words

    texts = [changed(base, 1 + i % 8) for i in range(160)]
    texts += [changed(texts[i], 1) for i in range(7, 160, 8)]
    rows = [(i, " ".join(t)) for i, t in enumerate(rng.permutation(texts).tolist())]
    got = {r.doc_id for r in nearcopies.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept([(i, plain(t)) for i, t in rows]) and 10 < len(got) < 150


def test_sets_too_many_for_the_tasks_are_joined(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SENT", 0)
    base = [f"w{i}" for i in range(120)]
    chain = [" ".join([*base[3 * k :], *(f"n{i}" for i in range(3 * k))]) for k in range(5)]
    rows = [*enumerate(chain), (7, chain[1]), (8, " ".join(f"v{i}" for i in range(90)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in nearcopies.components(docs).collect()) == [*((i, 0) for i in range(5)), (7, 0), (8, 8)]


def test_texts_near_at_anchors_are_compared(spark):
    """What is repeated decides the fingerprints of these texts, what is not their sets: operator 1 brings pairs together that
    share no band's value, and the sets decide."""
    often = "these five words come again " * 60
    rows = [(i, often + " ".join(f"t{i}x{j}" for j in range(12))) for i in range(4)]
    rows += [(4, " ".join(f"v{j}" for j in range(60))), (5, None)]
    prints = [simhash.fingerprint(t.encode()) for _, t in rows[:4]]
    assert all((a ^ b).bit_count() <= 2 for a in prints for b in prints)
    values = nearcopies.bands(nearcopies.Shingles(5).sets([t.encode() for _, t in rows[:4]]))
    assert any(not (a == b).any() for i, a in enumerate(values) for b in values[:i])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least, want in ((0.1, [0, 0, 0, 0, 4, 5]), (0.8, [0, 1, 2, 3, 4, 5])):
        assert [r.component_id for r in sorted(nearcopies.components(docs, least=least).collect())] == want
