"""Stratified interleaving: law, mixture, brute force over small buckets, odd rows."""

import random
import zlib
from collections import Counter

from geoquarry.llm import sharding as S


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, shard string, b int")


def check(got, n, shards=16):
    sizes = Counter(r.shard for r in got)
    assert len(got) == n and max(sizes.values(), default=0) - min((sizes[k] for k in range(shards)), default=0) <= 1
    for k in sizes:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))


def test_mixture_and_law(spark):
    rng = random.Random(4)
    rows = [(i, f"text {i % 7}", "hot" if i % 3 == 0 else f"s{rng.randrange(12)}" if i % 11 else None) for i in range(3001)]
    docs = table(spark, rows)
    got = S.interleave(docs, bucket_rows=50).collect()
    check(got, 3001)
    for source, n in Counter(r[2] for r in rows).items():
        own = Counter(r.shard for r in got if r.source == source)
        assert max(own.values()) - min(own[k] for k in range(16)) <= 2 + n // 400
    one = {r.doc_id: (r.shard, r.slot) for r in S.interleave(docs, bucket_rows=10**6).collect()}
    assert one == {r.doc_id: (r.shard, r.slot) for r in got}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "é", "a"), (3, "é", "a"), (None, "x" * 100_000, "b")]
    got = S.interleave(table(spark, rows)).collect()
    check(got, 5)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert S.interleave(table(spark, rows).limit(0)).count() == 0
    single = [(i, "t", f"s{i}") for i in range(320)]
    spread = S.interleave(table(spark, single), bucket_rows=20).collect()
    check(spread, 320)
