import itertools
import random
import zlib
from collections import Counter, defaultdict

from conftest import MIDDLE
from pyspark.sql import functions as F

from loomtext.llm import reshard


def test_flow_against_all_ways():
    rng = random.Random(1)
    for _ in range(40):
        supply = [rng.randint(0, 3) for _ in range(3)]
        demand = [0, 0]
        for _ in range(sum(supply)):
            demand[rng.randrange(2)] += 1
        cost = [[rng.randint(0, 4) for _ in range(2)] for _ in range(3)]
        ways = [w for w in itertools.product(*(range(s + 1) for s in supply)) if sum(w) == demand[0]]
        least = min(sum(a * c[0] + (s - a) * c[1] for a, s, c in zip(w, supply, cost, strict=True)) for w in ways)
        flow = reshard.min_cost_flow(supply, demand, cost)
        assert [sum(f) for f in flow] == supply and [sum(f) for f in zip(*flow, strict=True)] == demand
        assert sum(f * c for fs, cs in zip(flow, cost, strict=True) for f, c in zip(fs, cs, strict=True)) == least


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = reshard.query(spark, MIDDLE).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert len(rows) == len(texts) and gapless(rows) and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    new, old = Counter(), Counter()
    for r in rows:
        new[r.shard] += r.size
        old[r.old_shard] += r.size
    total, largest = sum(new.values()), max(r.size for r in rows)
    share = total / reshard.NEW
    assert set(new) == set(range(reshard.NEW)) and all(abs(b - share) < 2 * largest for b in new.values())
    moved = sum(r.size for r in rows if r.shard != r.old_shard)
    assert moved <= sum(max(0, b - share) for b in old.values()) + reshard.NEW * 2 * largest


def test_many_blocks_are_as_even(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).cast("int").alias("old_shard"))
    got = reshard.assigned(rows, 9, block_rows=20).collect()
    assert gapless(got) and len(got) == 5000
    assert all(abs(n - 5000 / 9) <= 8 for n in Counter(r.shard for r in got).values())


def test_only_changed_shards_are_written(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    old = F.when(F.col("doc_id") < 100, 0).when(F.col("doc_id") < 190, 1).otherwise(2)
    written, untouched = reshard.resharded(docs, old, 3, f"{tmp_path}/new", size=F.lit(10).cast("long"))
    wrote = {r.shard: r["count"] for r in written.groupBy("shard").count().collect()}
    assert wrote == {1: 100, 2: 100}
    assert spark.read.parquet(f"{tmp_path}/new").count() == 200
    assert sorted(r.doc_id for r in untouched.collect()) == list(range(100)) and gapless(written.collect() + untouched.collect())


def test_rewriting_keeps_every_row(spark, tmp_path):
    """Null ids, repeated rows, columns whose names the operator uses itself; by a key of the files' and by a saved one."""
    rows = [(None if i % 5 == 0 else i % 7, None if i % 11 == 0 else "x" * (i % 4), i, i * 0.5, f"s{i % 3}", i, [i], {"k": i}) for i in range(240)] * 2
    names = "doc_id long, text string, shard int, slot double, old_shard string, first int, block array<int>, at map<string, int>"
    spark.createDataFrame(rows, names).repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for n, key in enumerate((reshard.file_row(), None)):
        written, untouched = reshard.resharded(docs, F.lit(2), 4, f"{tmp_path}/new{n}", key)
        got = written.unionByName(untouched)
        assert gapless(got.collect()) and {r.old_shard for r in got.collect()} == {2} and len({r.shard for r in got.collect()}) == 4
        kept = got.select("doc_id", "text", "shard_", "slot_", "old_shard_", "first", "block", "at").collect()
        assert sorted(map(repr, (tuple(r) for r in kept))) == sorted(map(repr, rows))
        files = defaultdict(list)
        for r in spark.read.parquet(f"{tmp_path}/new{n}").select("shard", "slot", F.input_file_name().alias("f")).collect():
            files[r.f].append(r.slot)
        assert all(s == sorted(s) for s in files.values())
    nothing = reshard.resharded(docs.limit(0), F.lit(2), 4, f"{tmp_path}/none")
    assert nothing[0].unionByName(nothing[1]).count() == 0


def test_more_columns_stay(spark):
    rows = [(i % 3, 10 + i % 5, i % 4, i, i, i, i, i, i, i) for i in range(200)] + [(1, 10, None, 0, 0, 0, 0, 0, 0, 0)] * 50
    names = "doc_id long, size long, old_shard int, block int, at int, local int, before int, first int, begins int, slot int"
    got = reshard.assigned(spark.createDataFrame(rows, names), 5, block_rows=20).collect()
    assert gapless(got) and sorted(map(repr, (tuple(r)[:-2] for r in got))) == sorted(map(repr, rows))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (5, "y" * 500000)]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, shard int").drop("shard")
    got = reshard.assigned(reshard.sizes(docs, reshard.hashed("doc_id", 4)), 5).collect()
    assert len(got) == len(rows) and gapless(got)
    assert reshard.assigned(reshard.sizes(docs.limit(0), reshard.hashed("doc_id", 4)), 5).count() == 0


def test_rows_of_no_size_have_places(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else 0, i % 2) for i in range(30)], "doc_id int, size long, old_shard int")
    got = reshard.assigned(rows, 3).collect()
    assert sorted(r.doc_id for r in got) == list(range(30)) and sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(3) for i in range(10)]
