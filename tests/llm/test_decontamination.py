"""Spaced seeds: substitutions, fragments, odd rows."""

import itertools
import random

from geoquarry.llm import common, decontamination as D

ITEMS = [(1, " ".join(f"alpha{i}" for i in range(40))), (2, " ".join(f"Beta{i}" for i in range(20))), (3, "too short"), (4, None), (1, " ".join(f"gamma{i}" for i in range(30)))]


def run(spark, rows, items=ITEMS):
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, item_id int, k1 string")
    return [(r.doc_id, r.contaminated, r.n_items, r.item_id, r.matched) for r in D.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()]


def test_cases(spark):
    rng = random.Random(1)
    noise = lambda n: " ".join(f"n{rng.randrange(10**8)}" for _ in range(n))
    one = ITEMS[0][1].split()
    swapped = [w if i % 5 else "swap" for i, w in enumerate(one)]  # 80 % stands
    worse = [w if i % 3 else "swap" for i, w in enumerate(one)]  # 66 % stands
    rows = [
        (1, None), (2, ""), (3, f"{noise(30)} {ITEMS[0][1]} {noise(9)}"), (4, f"{noise(8)} {' '.join(swapped)}\n{noise(8)}"), (5, f"{noise(8)} {' '.join(worse)}"),
        (6, f"{noise(50)} {' '.join(one[:9])} {noise(50)}"), (7, ITEMS[1][1].upper()), (8, f"{ITEMS[1][1]} {noise(3)} {ITEMS[0][1]}"), (9, "it is too short"), (9, "too  long short"), (12, "too"),
        (None, ITEMS[4][1]), (10, " ".join(one[:30])), (11, "the " * 30_000),
    ]
    got = run(spark, rows)
    assert sorted(got, key=str) == sorted(
        [
            (1, False, 0, None, None), (2, False, 0, None, None), (3, True, 1, 1, 40), (4, True, 1, 1, 32), (5, False, 0, None, None), (6, False, 0, None, None), (7, True, 1, 2, 20),
            (8, True, 2, 1, 40), (9, True, 1, 3, 2), (9, False, 0, None, None), (12, False, 0, None, None), (None, True, 1, 1, 30), (10, True, 1, 1, 30), (11, False, 0, None, None),
        ],
        key=str,
    )


def test_empty_tables(spark):
    assert run(spark, [(1, "a b c")], [(1, None)]) == [(1, False, 0, None, None)]
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert D.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_shuffle_joins_give_the_same(spark, monkeypatch):
    rows = [(i, f"x y z {ITEMS[i % 2][1]} q") for i in range(20)] + [(99, "nothing here at all to be found in this text")]
    want = sorted(run(spark, rows))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(run(spark, rows)) == want


def test_some_seed_survives_any_quarter_of_substitutions():
    rng = random.Random(6)
    for n in [*range(1, 17), 18, 20, 23, 24, 27, 32, 40, 60, 100]:
        masks = D.MASKS[:3] if n >= D.LONG else (D.MASKS[D.SHORT[n]],)
        every = itertools.combinations(range(n), n // 4) if n <= 16 else (rng.sample(range(n), n // 4) for _ in range(3000))
        for gone in map(set, every):
            assert any(not gone & {i + o for o in mask} for mask in masks for i in range(n - mask[-1])), (n, gone)


def test_recall_at_the_limit_of_every_length(spark):
    """All texts that hold three quarters of an item on one diagonal are found, against a comparison on all diagonals."""
    rng = random.Random(7)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 33)]
    rows = []
    for n, text in items:
        for gone in (n // 4, n // 4 + 1):
            for _ in range(6):
                words = text.split()
                for k in rng.sample(range(n), min(gone, n)):
                    words[k] = "other"
                rows.append((len(rows), " ".join(["pad"] * rng.randrange(4) + words + ["pad"] * rng.randrange(4))))
    got = {r[0]: r[1] for r in run(spark, rows, items)}
    for i, text in rows:
        words, best = text.split(), False
        for n, item in items:
            own = item.split()
            best |= any(4 * sum(0 <= d + k < len(words) and words[d + k] == w for k, w in enumerate(own)) >= 3 * n for d in range(-n, len(words)))
        assert got[i] == best, text


def test_blocks_of_seeds_give_the_same(spark, monkeypatch):
    rows = [(i, f"x y z {ITEMS[i % 2][1]} q") for i in range(20)] + [(99, "nothing here at all to be found in this text")]
    want = sorted(run(spark, rows))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 3000)
    assert sorted(run(spark, rows)) == want


def test_clashing_names_and_copies(spark):
    docs = spark.createDataFrame([(i, ITEMS[1][1], 1, 2, 3, 4) for i in range(50)] + [(99, None, 1, 2, 3, 4)], "doc_id long, text string, k1 int, k2 int, n int, first int")
    rows = D.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert sum(r.contaminated for r in rows) == 50 and all((r.k1, r.k2, r.n, r["first"]) == (1, 2, 3, 4) for r in rows)
