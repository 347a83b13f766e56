"""Near-duplicate groups against brute force over all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest

from geoquarry.llm import components, near_dedup, setsketch
from geoquarry.llm.components import connected_components
from geoquarry.llm.shingles import shingle_set


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def check(spark, rows):
    got = near_dedup.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, regs string, n_shingles int")).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got) and len(got) == len(rows)


def family(rng, size, length, rates):
    """Copies of one text with words replaced at various rates."""
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    return [" ".join(f"x{rng.randrange(10**9)}" if rng.random() < rng.choice(rates) else w for w in base) for _ in range(size)]


def test_groups_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "one", "One", "a b c d", "A b\tc D", "a b c d e", "é É", "word " * 5000]
    for _ in range(6):
        texts += family(rng, 12, 60, [0, 0.01, 0.03, 0.06, 0.1])
    texts += family(rng, 60, 40, [0.02, 0.04, 0.08])
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"y{rng.randrange(10**9)}" for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    texts += [texts[20]] * 40
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_small_tables(spark):
    check(spark, [(5, "a b c d e f")])
    check(spark, [(7, None), (8, None)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, "A b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()), key=str)
    assert got == [(False, 3, 3, True), (False, 3, 3, True), (False, 9, 3, False), (True, None, None, True)]


def test_repeated_ids_lose_no_text(spark):
    v, u, z = "a b c d e f g h", "k l m n o p q", "r s t u v w"
    rows = [(1, v, "x"), (2, v, "x"), (2, u, "x"), (2, u, "x"), (3, "", "x"), (3, None, "x"), (None, v, "x"), (4, z, "x"), (4, u, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of_text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).where("doc_id is not null").collect()))
    assert got == sorted([(1, 4, 1), (2, 4, 1), (2, 3, 2), (2, 3, 2), (3, 0, 3), (3, 0, 3), (4, 2, 4), (4, 3, 2)])
    kept = near_dedup.stage_near_dedup(spark, docs, "").collect()
    assert sorted(map(str, kept)) == sorted(str(type(kept[0])(doc_id=i, text=t, of_text="x")) for i, t in [(1, v), (2, u), (4, z), (3, ""), (3, None), (None, v)])


def test_one_large_component_meets_the_others_only(spark):
    """Links between a large family and single texts that share its rare shingles are found under any head."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = [" ".join(w if k != j else f"x{n}" for k, w in enumerate(base)) for n, j in enumerate(rng.randrange(80) for _ in range(120))]
    rows += [" ".join(base[:58] + [f"q{n}-{k}" for k in range(n)]) for n in range(12, 30)]
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


def test_bands_find_links_at_the_threshold():
    """At similarity 0.75 the chance to share no band, and to be dropped by the estimate, is negligible."""
    assert (1 - 0.72**setsketch.ROWS) ** setsketch.BANDS < 1e-6
    rng = np.random.default_rng(3)
    low = []
    for _ in range(300):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 100))
        x, y = (setsketch.registers(np.concatenate([common, v])) for v in (a, b))
        assert (setsketch.band_keys(x[None]) == setsketch.band_keys(y[None])).any()
        low.append(setsketch.estimate(x[None], y[None], np.array([700.0]), np.array([700.0]))[0])
    assert min(low) > 0.75 - near_dedup.SLACK and 0.75 - near_dedup.SLACK < 0.75 - 5 * np.std(low)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (6000, 1000, 1000))
    x, y = (setsketch.registers(np.concatenate([common, v])) for v in (a, b))
    assert (setsketch.merge(x, y) == setsketch.registers(np.concatenate([common, a, b]))).all()
    j = setsketch.estimate(x[None], y[None], np.array([7000.0]), np.array([7000.0]))[0]
    assert j == pytest.approx(0.75, abs=0.12)


def test_shingles_of_long_and_short_texts():
    for text in ("", "a", "a b c d e", "a b c d e f", "A\x0bB\x0cc  d\ne", "x " * 100_000):
        assert len(shingle_set(text)) == len(shingles(text))
    assert (shingle_set("A b c d e") == shingle_set("a B\tc d e")).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98}


def test_components_of_long_chains(spark):
    """Ascending, descending, shuffled, with the two smallest at both ends; a hub of high number; settled in a logarithm of rounds."""
    rng = random.Random(8)
    n = 1000
    orders = [list(range(n)), list(range(n))[::-1], rng.sample(range(n), n), [0, *rng.sample(range(2, n), n - 2), 1]]
    edges = [(base * n + a, base * n + b) for base, order in enumerate(orders) for a, b in zip(order, order[1:], strict=False)]
    edges += [(10 * n, 9 * n + i) for i in range(300)]
    calls = []
    stash = components.stash
    components.stash = lambda df, name: calls.append(name) or stash(df, name)
    try:
        got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        components.stash = stash
    assert got == {**{base * n + i: base * n for base in range(4) for i in range(n)}, **{9 * n + i: 9 * n for i in range(300)}, 10 * n: 9 * n}
    assert calls.count("parents") <= 2 * 14


def test_versions_of_one_document(spark):
    """Each of 120 versions shares nine tenths with the next; the smallest ids are at the two ends."""
    words = [f"w{i}" for i in range(100 + 10 * 119)]
    order = [0, *range(2, 120), 1]
    docs = spark.createDataFrame([(i, " ".join(words[10 * k : 10 * k + 100])) for k, i in enumerate(order)], "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
