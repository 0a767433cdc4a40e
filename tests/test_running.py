import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators.running import numbered, running


@pytest.fixture
def apart(spark):
    """Small groups stay in as many tasks as there are shuffle partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def rows(n=400):
    rng = random.Random(5)
    keys = [None, 1, 2, 2, 2, 2, 2, 2, 2, 3]  # a group of most rows, and nulls
    return [(rng.choice(keys), rng.choice(["a", "b"]), i, rng.choice([None, rng.randrange(-(1 << 62), 1 << 62)])) for i in range(n)]


def wrapped(x):
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def test_running_sums_cross_tasks(spark, apart):
    data = rows()
    df = spark.createDataFrame(data, "k long, s string, i int, v long").repartition(7)
    out = running(df, ["k", "s"], [F.desc("i")], {"upto": "v"}, {"prior": "v"})
    assert out.columns == ["k", "s", "i", "v", "upto", "prior"]
    got = {(r.k, r.s, r.i): (r.v, r.upto, r.prior) for r in out.collect()}
    assert len(got) == len(data)
    for k, s, i, v in data:
        later = [w or 0 for k2, s2, j, w in data if (k2, s2) == (k, s) and j > i]
        assert got[k, s, i] == (v, wrapped(sum(later) + (v or 0)), wrapped(sum(later)))


def test_one_group_over_all_tasks(spark, apart):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("g").alias("g"))
    got = numbered(df.repartition(6), ["g"], ["x"], "place")
    assert sorted((r.x, r.place) for r in got.collect()) == [(x, x + 1) for x in range(1000)]
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_without_groups_and_rows(spark):
    df = spark.createDataFrame([(3, 1), (1, 5)], "x int, one_of_rows int")
    assert sorted(numbered(df, [], ["x"], "n").collect()) == [(1, 5, 1), (3, 1, 2)]
    assert numbered(df.limit(0), ["x"], ["x"], "n").collect() == []
