import random

import numpy as np
from conftest import MIDDLE

from loomtext.llm import decontaminate as d


def edits(p, t):
    """Fewest edits between p and any stretch of t."""
    row = [0] * (len(t) + 1)
    for c in p:
        new = [row[0] + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def changed(rng, text, n):
    s = list(text)
    for _ in range(n):
        j = rng.randrange(len(s))
        s[j : j + 1] = rng.choice(([rng.choice("abcdefgh")], [], [s[j], rng.choice("abcdefgh")]))
    return "".join(s)


def noise(rng, n):
    return "".join(rng.choice("abcdefgh") for _ in range(n))


def test_whole_items_of_the_tables(spark):
    docs = {r.doc_id: d.plain(r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    items = {r.item_id: d.plain(r.text) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in d.query(spark, MIDDLE).collect()}
    holds = {(i, k) for i, t in docs.items() for k, p in items.items() if p in t}
    assert holds and holds <= set(got)
    for (i, k), r in got.items():
        p, words = items[k], docs[i].split(" ")
        stretch = " ".join(words[r.first_word : r.end_word])
        if (i, k) in holds:
            assert r.edits == 0 and r.windows == r.of_windows and p in stretch
        else:
            last = max(0, len(p) - d.WINDOW)
            windows = [p[a : a + d.WINDOW] for a in {*range(0, last, d.STRIDE), last}]
            assert min(edits(w, stretch) for w in windows) == r.edits


def test_edits_against_all_alignments(spark):
    rng = random.Random(1)
    item = noise(rng, 96)
    texts = [noise(rng, rng.randint(0, 50)) + changed(rng, item, n) + noise(rng, rng.randint(0, 50)) for n in range(13) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: r.edits for r in d.leaks(docs, bench).collect()}
    budget = int(96 * d.RATE)
    want = {i: e for i, t in enumerate(texts) if (e := edits(item, t)) <= budget}
    assert got == want and 20 < len(want) < len(texts)


def test_bands_of_repeating_texts():
    index = d.Index.of([(1, "ab" * 48), (2, "a" * 60)])
    assert {index.items[index.of_item[w]] for w, _ in index.bands(d.codes("ab" * 3000))} == {1}
    assert {index.items[index.of_item[w]] for w, _ in index.bands(d.codes("a" * 3000))} == {2}


def test_parts_of_a_large_benchmark(spark):
    rng = random.Random(2)
    items = [(i, noise(rng, 120)) for i in range(20)]
    docs = spark.createDataFrame([(i, t.upper()) for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.leaks(docs, bench, most_bytes=300 * d.BYTES_A_CHARACTER).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(20)]


def test_odd_rows(spark):
    rng = random.Random(3)
    p = noise(rng, 150)
    rows = [(1, None), (2, ""), (3, p), (3, p), (None, p), (4, noise(rng, 200000) + p + "x" * 200000), (5, "ok"), (6, p[:60]), (7, p[20:])]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(1, p, "e"), (1, "short", "e"), (2, None, "e"), (None, "q" * 40, "e")], "item_id long, text string, edits string")
    got = d.leaks(docs, bench).collect()
    assert sorted(((r.doc_id or -1), r.item_id) for r in got) == [(-1, 1), (3, 1), (3, 1), (4, 1), (7, 1)]
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 5, 6]
    assert d.leaks(docs.limit(0), bench).count() == d.leaks(docs, bench.limit(0)).count() == 0
    assert d.banded(np.array([1, 2]), np.array([], np.int64), 0, 3, 1) is None


def test_passages_of_long_items_and_short_items(spark):
    rng = random.Random(5)
    item = noise(rng, 300)
    texts = [noise(rng, 40) + item[a : a + n] + noise(rng, 40) for n in (83, 90, 100, 110, 120) for a in range(0, 301 - n, 7)]
    others = [(-1, "It is: Forty  two!"), (-2, "forty twos"), (-3, "aforty two"), (-4, "nothing"), (-5, "forty two"), (-6, noise(rng, 400))]
    docs = spark.createDataFrame(list(enumerate(texts)) + others, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "Forty two"), (3, "forty TWO"), (4, " ")], "item_id long, text string")
    got = d.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(-5, 2), (-5, 3), (-1, 2), (-1, 3)] + [(i, 1) for i in range(len(texts))]
    assert {(r.first_word, r.end_word) for r in got if r.doc_id == -1} == {(2, 4)}


def test_neighbours_do_not_matter(spark):
    """A text's findings are the same beside any other texts of its batch: repeated passages, edits, places of all kinds."""
    rng = random.Random(7)
    item, long = noise(rng, 60), noise(rng, 250)
    middle = [changed(rng, item, 3), item, changed(rng, long, 4)[20:180], "ab" * 70, item[:40] + item]
    texts = [" ".join([item, noise(rng, 30), item, middle[i % 5], noise(rng, rng.randint(1, 30)), long[40:150]]) for i in range(20)]
    finder = d.Finder(d.Index.of([(1, item), (2, long), (3, "ab" * 40), (4, "forty two")]))
    alone = [next(finder.findings([t])) for t in texts]
    assert all({f.item for f in found} >= {1, 2} for found in alone)
    assert all((f.begin, f.edits) == (0, 0) for found in alone for f in found if f.item == 1)
    for _ in range(60):
        around = [noise(rng, rng.randint(0, 120)) if rng.random() < 0.5 else rng.choice(texts)[rng.randint(0, 90) :] for _ in range(6)]
        i, at = rng.randrange(len(texts)), rng.randrange(len(around) + 1)
        assert list(finder.findings([*around[:at], texts[i], *around[at:]]))[at] == alone[i]


def test_index_is_small():
    """An index takes at most BYTES_A_CHARACTER bytes for each character of its items."""
    rng = random.Random(8)
    for n in (30, 90, 700):
        index = d.Index.of((i, noise(rng, n)) for i in range(60_000 // n))
        assert index.nbytes < d.BYTES_A_CHARACTER * len(index.code) + 20_000
        assert all(len(index.pattern(w)) == index.window(w)[2] for w in range(int(index.of_windows.sum())))
