"""Nearest labelled examples: exact search, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from geoquarry.llm import toxicity as T


def test_search_equals_a_full_scan():
    rng = random.Random(2)
    vocabulary = [f"t{i}".encode() for i in range(40)]
    examples = [(i, rng.randrange(2), {rng.randrange(40): rng.randrange(1, 5) for _ in range(rng.randrange(5))}) for i in range(700)]
    index = T.build_index(examples, vocabulary, np.append(1 + np.random.default_rng(1).random(40), 1.2))
    weights = index.postings.full()
    for _ in range(60):
        t, w = index.vector(" ".join(f"t{rng.randrange(45)}" for _ in range(rng.randrange(9))))
        if not len(t):
            continue
        ((places, cosines),), _ = index.postings.nearest([(t, w)], T.K)
        full = np.round(w @ weights[t], 12)
        order = sorted((-s, i) for i, s in enumerate(full) if s > 0)[: T.K]
        assert [i for _, i in order] == places.tolist()
        assert [-s for s, _ in order] == pytest.approx(cosines)


def test_bounds_leave_blocks_unscored():
    rng = np.random.default_rng(5)
    # forty groups of examples, each with terms of its own and a few that all share
    rows = [(i, i % 2, {int(t): 1 for t in [*rng.choice(20, 8, False), *(20 + 10 * (i % 40) + rng.choice(10, 5, False))]}) for i in range(1600)]
    index = T.build_index(rows, [f"t{i}".encode() for i in range(420)], np.concatenate([0.2 + 0.1 * rng.random(20), 2 + rng.random(400), [0.2]]))
    weights = index.postings.full()
    vectors = [index.vector(" ".join(f"t{t}" for t in rows[i][2])) for i in range(64)]
    found, blocks = index.postings.nearest(vectors, T.K)
    for (t, w), (places, _) in zip(vectors, found, strict=True):
        full = np.round(w @ weights[t], 12)
        assert [i for _, i in sorted((-s, i) for i, s in enumerate(full) if s > 0)[: T.K]] == places.tolist()
    assert 0 < blocks < 0.5 * len(vectors) * index.postings.blocks


def test_calibrated_on_held_out_rows(tables):
    docs, labels = tables
    rows = T.score(docs, T.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    bins = {}
    for r in rows:
        bins.setdefault(min(int(r.score * 10), 9), []).append((r.score, r.toxic))
    error = sum(abs(sum(s for s, _ in b) - sum(y for _, y in b)) for b in bins.values()) / len(rows)
    assert error < 0.05


def test_repeated_ids_give_one_example(spark, tables):
    docs, labels = tables
    more = docs.unionByName(docs.withColumn("text", T.F.concat(T.F.lit("zz "), "text")))
    a, b = (T.fit(x, labels.unionByName(labels)) for x in (more, more.orderBy(T.F.desc("text"))))
    assert sorted(a.ids) == sorted(set(a.ids)) and a.vocabulary == b.vocabulary and (a.ids == b.ids).all()


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    common = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1200):
        toxic = rng.random() < 0.2
        words = [rng.choice(common) for _ in range(rng.randrange(20, 60))]
        for _ in range(rng.randrange(2, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile,", "nasty", "badroot" + rng.choice("abcdefgh")]))
        docs.append((i, " ".join(words), "x"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = T.score(docs, T.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in own) / len(own) > 0.97
    assert all(r.evidence for r in own if r.predicted == 1)


def test_held_out_labels_are_not_used(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", T.F.when(T.held_out(), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in T.score(docs, T.fit(docs, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, tables):
    docs, labels = tables
    index = T.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (2, 1, None), (4, 0, 1)], labels.schema)))
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "vile nasty " * 20_000, "x"), (3, "vile", "x"), (None, "vile nasty", "x")], docs.schema)
    got = T.score(odd, index).collect()
    assert [r.predicted for r in got] == [0, 0, 1, 1, 1] and got[4].held_out is False and all(0 <= r.score <= 1 for r in got)
    assert T.score(docs.limit(0), index).count() == 0
    none = T.fit(docs.limit(0), labels.limit(0))
    assert T.score(odd, none).where("predicted = 1").count() == 0


def test_rare_terms_are_searched(spark):
    rng = random.Random(8)
    common = [f"word{i}" for i in range(200)]
    text = lambda *more: " ".join([rng.choice(common) for _ in range(12)] + list(more))
    # three toxic examples of a language of its own: far too few for any threshold on z or on a share
    rare = [text("schlimm", "boese", "gemein") for _ in range(3)]
    docs = [(i, text()) for i in range(400)] + [(i, text("vile", "nasty")) for i in range(400, 500)] + [(i, t) for i, t in zip((501, 502, 503), rare, strict=True)]
    labels = [(i, 1, int(i >= 400)) for i, _ in docs if zlib.crc32(str(i).encode()) % 5]
    known = {i for i, _, _ in labels}
    index = T.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {w for i, t in docs if i in known for w in T.terms(t)} == set(index.vocabulary)
    assert all(x > 0 for x in index.idf)
    score, evidence = index.score("schlimm boese gemein")
    assert score >= 0.5 and set(evidence) & {501, 502, 503}
    score, evidence = index.score("word7")
    assert score < 0.5 and evidence
