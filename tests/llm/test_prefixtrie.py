import hashlib
import random
import zlib

import duckdb
import numpy as np
from conftest import SMALL

from loomtext.llm import prefixtrie
from loomtext.llm.prefixtrie import FACTORS, conversation_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, n_convs int"


def plain(rows):
    """The trie by sets of all beginnings."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = set()
    for top, inside in members.items():
        d, below = len(top), [n for n in members if n[: len(top)] == top]
        kids = [n for n in below if len(n) == d + 1]
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in inside if len(built[c]) == d)))
        out.add((min(inside), d, min(members[top[:-1]]) if d else None, len(inside), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def trie(spark, rows, tasks=5):
    df = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA).repartition(tasks)
    return conversation_trie(df)


def conversations():
    rng = random.Random(11)
    said = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, " c  d e\t"]))
    rows = []
    for c in [*range(30), 41, 47, 83, -3, -21, -40, 60, 1 << 40]:  # 41, 47 and 83 have no base
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, *said()))
    same = [("user", "hello there"), ("assistant", "hi"), ("user", "x y z"), ("assistant", "ok then"), ("user", "bye")]
    for c in range(100, 140):  # many copies, some cut short
        rows += [(c, t, *s) for t, s in enumerate(same[: 5 if c % 3 else 4])]
    rows += [(500, 1, "user", "tie b"), (500, 1, "user", "tie a"), (500, 1, None, "tie c"), (500, 1, "user", "tie a")]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None)]
    return rows


def test_against_plain(spark):
    rows = conversations()
    result = trie(spark, rows)
    assert result.columns == COLUMNS
    got = [tuple(r) for r in result.collect()]
    expected = plain(rows)
    assert set(got) == expected and len(got) == len(expected)


def test_long_conversations_in_small_tasks(spark, monkeypatch):
    """A conversation of most rows, one that leaves it late, and sums carried from task to task."""
    monkeypatch.setattr(prefixtrie, "PACK", 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        long = [(t, "user" if t % 2 else "assistant", f"w{t % 7} w") for t in range(150)]
        rows = [(20, *s) for s in long] + [(21, *s) for s in long[:120]] + [(22, *s) for s in long[:119]] + [(22, 119, "user", "other")]
        rows += [(c, t, "user", "same") for c in range(40, 60) for t in range(3)]
        got = {tuple(r) for r in trie(spark, rows).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows)


def test_empty_tables(spark):
    assert trie(spark, []).collect() == [] and trie(spark, [(None, 1, "user", "x")]).collect() == []


def test_powers():
    at = np.array([0, 1, 65535, 65536, 3_000_000, 1 << 25], np.int64)
    for lane, f in enumerate(FACTORS):
        assert prefixtrie._Powers().of(lane, at).tolist() == [pow(f, int(i), 1 << 64) for i in at]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    expected = con.execute(prefixtrie.SQL).fetchall()
    got = prefixtrie.query(spark, SMALL).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == set(expected) and len(got) == len(expected)
