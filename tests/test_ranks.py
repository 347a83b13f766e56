"""Distributed places and running sums against windows and lists; ties over partition borders; hot and null groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geoquarry.operators import ranks as R


@pytest.fixture(autouse=True)
def small_partitions(spark):
    """Small tables are dealt over several partitions as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def some_rows(n=4000):
    rng = random.Random(5)
    return [(None if i % 3 == 0 else f"g{rng.randrange(5)}", rng.choice([None, *range(6)]), rng.randrange(100) if i % 7 else None, i) for i in range(n)]


def test_places_of_groups_with_ties(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "g string, k int, v long, i long").repartition(5)
    got = defaultdict(list)
    for r in R.ranked(df, [F.col("k").desc_nulls_last()], ["g"]).collect():
        got[r.g].append((r.place, r.k))
    want = defaultdict(list)
    for g, k, _, _ in rows:
        want[g].append(k)
    assert set(got) == set(want)
    for g, own in got.items():
        assert [p for p, _ in sorted(own)] == list(range(len(own)))
        assert [k for _, k in sorted(own)] == sorted(want[g], key=lambda k: (k is None, -(k or 0)))


def test_equal_keys_are_spread(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(2).cast("long").alias("v"))
    dealt = R.dealt(df, [F.col("k").asc()])
    assert dealt.select("__part").distinct().count() == 4
    assert sorted(r.reached for r in R.running_sum(df, "v", [F.col("k").asc()]).collect()) == list(range(2, 40_002, 2))


def test_running_sums_equal_windows(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, "g string, k int, v long, i long")
    for within in ([], ["g"]):
        got = {r.i: r.reached for r in R.running_sum(df, "v", [F.col("k").asc_nulls_first(), F.col("i").asc()], within).collect()}
        reached = defaultdict(int)
        for g, _, v, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[3])):
            key = g if within else 0
            reached[key] += v or 0
            assert got[i] == reached[key]


def test_no_single_task_window(spark):
    df = spark.range(1000).withColumn("v", F.lit(1.5))
    for out in (R.ranked(df, [F.col("id").asc()]), R.running_sum(df, "v", [F.col("id").asc()])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    assert R.running_sum(df, "v", [F.col("id").asc()]).agg(F.max("reached")).first()[0] == 1500.0
    assert R.ranked(df.limit(0), [F.col("id").asc()]).count() == 0 and R.running_sum(df.limit(0), "v", [F.col("id").asc()]).count() == 0


def test_deep_pages(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(50)]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k int, i long").repartition(3)
    order = [F.asc_nulls_last("k"), F.desc("i")]
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    for limit, offset in ((10, 0), (100, 2450), (1, 4999), (50, 4990), (7, 6000), (3000, 1000)):
        for near in (0, 10_000):
            assert [tuple(r) for r in R.page(df, order, limit, offset, near).collect()] == want[offset : offset + limit]
    # of the partitions only those of the page send rows on
    out = R.page(df, order, 10, 2500, 0)
    assert "TakeOrdered" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 10
