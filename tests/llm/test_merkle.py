"""Merkle manifest against a plain tree in lists; multiproofs are minimal and fetched once; odd rows; tampering."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geoquarry.llm import merkle as M
from geoquarry.llm.common import stash


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def proof_in(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 3
        out += [x for k, x in enumerate(level[first : first + 3], first) if k != at]
        at //= 3
    return out


def brute(rows):
    """doc_id, leaf, subroot, root, proof of every row (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    for place, s in enumerate(order):
        for at, x in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            yield x[3], x[2], trees[s][-1][0], top[-1][0], proof_in(trees[s], at) + proof_in(top, place)


def some_rows(n, rng):
    return [(i, None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{rng.randrange(9)}é"[: 2 + i % 2], None if i % 5 == 0 else "en", None if i % 11 == 0 else i, None if i % 13 == 0 else "a\nb" * (i % 4)) for i in range(n)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def manifest(spark, rows, levels):
    docs = spark.createDataFrame(rows, SCHEMA)
    return M.Manifest(stash(docs.select("doc_id", "source", M.digest([F.col(c) for c in M.FIELDS]).alias("leaf")), "t"), levels)


@pytest.mark.parametrize(("n", "levels"), [(700, 2), (700, 5), (1, 5), (3, 1), (4, 1)])
def test_equals_brute_force(spark, n, levels):
    rng = random.Random(n)
    rows = some_rows(n, rng)
    if n > 100:
        rows += [(5, "hot", "en", 1, "x"), (5, "hot", "en", 1, "x"), (5, "hot", "fr", 1, "y"), (None, "hot", None, None, None), (None, None, None, None, ""), (9, "", "en", 2, "\n"), (10, "one", "en", 2, "t" * 50_000)]
        rng.shuffle(rows)
    m = manifest(spark, rows, levels)
    proofs = m.proofs()
    got = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in proofs.collect())
    assert got == sorted((str(r[0]), leaf, sub, root, proof) for r, leaf, sub, root, proof in brute(rows))
    assert M.fold(proofs, "leaf").where("folded_root <> root").count() == 0
    # another leaf folds to another root
    assert M.fold(proofs.withColumn("other", F.sha2("leaf", 256)), "other").where("folded_root = root").count() == 0


def test_a_few_asked_leaves(spark):
    rows = some_rows(500, random.Random(2))
    m = manifest(spark, rows, 2)
    asked = m.leaves.where("doc_id % 7 = 0")
    want = {r[0]: proof for r, _, _, _, proof in brute(rows)}
    got = {r.doc_id: r.proof for r in m.proofs(asked).collect()}
    assert got == {i: p for i, p in want.items() if i % 7 == 0}
    assert m.proofs(asked.limit(0)).count() == 0


def test_coordinates_are_minimal():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 60)
        leaves = rng.sample(range(n), rng.randrange(1, min(n, 8) + 1))
        need = M.missing(n, leaves)
        assert len(set(need)) == len(need)
        every = levels_of([str(k) for k in range(n)])
        nodes = M.interiors(n, {k: str(k) for k in leaves}, {(level, at): every[level][at] for level, at in need})
        assert all(M.proof_of(n, k, nodes) == proof_in(every, k) for k in leaves)
        # no coordinate can be left out: none lies above an asked leaf, and the proofs use each
        covered = {(level, k // 3**level) for k in leaves for level in range(M.height(n) + 1)}
        used = {(level, s) for k in leaves for level in range(M.height(n)) for s in M.run_of(k // 3**level, M.count_at(n, level)) if s != k // 3**level}
        assert set(need) == used - covered
    assert M.missing(27, range(27)) == [] and len(M.missing(27, range(9))) == 2


def test_empty_table(spark):
    m = manifest(spark, [], 5)
    assert m.root is None and m.proofs().count() == 0


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*M.FIELDS).collect()]
    got = {r.doc_id: r for r in M.op12_octopus_manifest(spark, sf).collect()}
    seen = set()
    for r, leaf, sub, root, proof in brute(rows):
        own = got[r[0]]
        assert (own.leaf, own.subroot, own.root, own.proof_sha256) == (leaf, sub, root, h(*proof))
        tampered = zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "")
        assert own.verified == (not tampered) == (own.folded_root == root)
        seen.add(tampered)
    assert seen == {True, False} and len(got) == len(rows)
