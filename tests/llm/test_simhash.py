import numpy as np
import xxhash
from conftest import MIDDLE

from loomtext.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(rows):
    """Of (id, fingerprint) pairs, by comparing all pairs."""
    ids = np.array([i for i, _ in rows])
    fp = np.array([f for _, f in rows], np.uint64)
    label = ids.copy()
    near = np.array([np.bitwise_count(fp ^ f) <= 2 for f in fp])
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return dict(zip(ids.tolist(), label.tolist(), strict=True))
        label = new


def test_against_all_pairs(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = simhash.query(spark, MIDDLE).collect()
    want = {d: plain(t) for d, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{f:016x}" for d, f in want.items()}
    assert {r.doc_id: r.component_id for r in got} == components(sorted(want.items()))


def test_every_near_pair_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    f = rng.integers(-(1 << 63), 1 << 63, 300)
    flips = [sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 3), replace=False)) for _ in f]
    g = f ^ np.array(flips)
    home = dict(zip(*simhash.anchors(f, 0), strict=True))
    assert len(home) == len(f)
    met = set(zip(*(x.tolist() for x in simhash.anchors(g, 2)), strict=True))
    assert all((i, int(home[i])) in met for i in range(len(f)))


def test_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, a), (4, a), (5, a.upper()), (6, "one two"), (None, a), (None, "alone here now"), (7, "x " * 50000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect() if r.component_id)
    comp = {i: c for i, _, c in got}
    assert len(got) == 9
    assert comp[1] == comp[2] == comp[3] == 1 and comp[4] == comp[5] == comp[-1] == 4 and comp[6] == 6 and comp[7] == 7
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    from loomtext.llm.common import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_rows_without_an_id_link_others(spark):
    """Two texts three or four bits apart, each within two bits of a third that only a row without an id holds."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(400)]

    def near(text, low, high):
        while True:
            words = text.split()
            for i in rng.integers(0, len(words), 2):
                words[i] = f"n{rng.integers(1 << 30)}"
            other = " ".join(words)
            if low <= (plain(text) ^ plain(other)).bit_count() <= high:
                return other

    middle = " ".join(base)
    while True:
        a, b = near(middle, 1, 2), near(middle, 1, 2)
        if (plain(a) ^ plain(b)).bit_count() > 2:
            break
    rows = [(9, a), (None, middle), (7, b), (3, "else where now"), (None, "alone and far away")]
    got = {r.doc_id or r.fingerprint: r.component_id for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9] == got[7] == got[f"{plain(middle):016x}"] == 7 and got[3] == 3 and got[f"{plain('alone and far away'):016x}"] is None
    only = spark.createDataFrame([(7, b), (None, middle)], "doc_id long, text string")
    assert {r.component_id for r in simhash.simhash_components(only).collect()} == {7}


def test_anchors_are_not_sent_to_the_driver(spark):
    """61 lookups of a fingerprint are sized as the fingerprint: their join is stated, at Spark's own limit for broadcasts."""
    fps = spark.range(300).selectExpr("id * 7919 as fp").union(spark.createDataFrame([(1,), (7918,)], "fp long"))
    found = simhash.links(fps.distinct())
    assert found.where("u = 1 and v = 0 or u = 0 and v = 1").count() == 1
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
