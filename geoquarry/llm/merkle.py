"""Merkle manifest of a table with proofs for all rows by partition-wise multiproofs (octopus).

Every row is a leaf, the digest of its fields. The leaves of a source, in the order of doc_id, are the lowest level of a tree
whose every WIDTH consecutive nodes have one parent, up to the source's subroot; subroots, in the order of their sources, are
the leaves of one more tree, up to the root. A last run of fewer nodes, even one, has its own parent.

``grow`` builds a forest of such trees: the leaves are cut into blocks of WIDTH ** LEVELS neighbours, each block gives all
nodes above it up to its own root in one small task, and the block roots are the leaves of the next pass. No tree is in
one task, however many leaves it has.

``prove`` deals the asked leaves by the same blocks. A block first works out, from positions alone, the coordinates that the
proofs of all its leaves need and that the block cannot derive from them: the siblings along the borders of what it
knows, each once. Those few coordinates are fetched in one join for all blocks; then every block derives the interior nodes that
its proofs share from its leaves and the fetched nodes, and writes out each leaf's own proof. When all leaves of a block
are asked for, it fetches only the siblings on the path above its root. ``fold`` recomputes a root from a leaf and its proof.

Leaves with equal doc_id are in the order of their digests; repeated rows are equal leaves next to each other. Nulls come
first among doc_ids and sources, and each null field is ``-``. A tree of one leaf is that leaf itself, a table of one
source has its subroot as root, and an empty table has no root and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from geoquarry.llm.common import stash, table
from geoquarry.operators.ranks import ranked

WIDTH = 3
#: Levels of one block: it has at most WIDTH ** LEVELS leaves.
LEVELS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value with its length in bytes, or a mark for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(row: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, row)), 256)


def joined(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int, width: int = WIDTH) -> int:
    """Levels above the leaves of a tree of ``n``."""
    levels = 0
    while n > 1:
        n, levels = -(-n // width), levels + 1
    return levels


def count_at(n: int, level: int, width: int = WIDTH) -> int:
    """Nodes of a level of a tree of ``n`` leaves."""
    for _ in range(level):
        n = -(-n // width)
    return n


def run_of(at: int, nodes: int, width: int = WIDTH) -> range:
    """Positions of the nodes with the same parent as the node at ``at``."""
    first = at - at % width
    return range(first, min(first + width, nodes))


def missing(n: int, leaves: Iterable[int], width: int = WIDTH) -> list[tuple[int, int]]:
    """Coordinates (level, position) that proofs of ``leaves`` need and that cannot be derived from them and from each other."""
    known, out, nodes = set(leaves), [], n
    for level in range(height(n, width)):
        out += sorted({(level, s) for at in known for s in run_of(at, nodes, width)} - {(level, at) for at in known})
        known, nodes = {at // width for at in known}, -(-nodes // width)
    return out


def interiors(n: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str], width: int = WIDTH) -> dict[tuple[int, int], str]:
    """All nodes that ``leaves`` and the fetched ones tell, the path to the root included."""
    out, nodes = fetched | {(0, at): h for at, h in leaves.items()}, n
    known = set(leaves)
    for level in range(height(n, width)):
        parents = {at // width for at in known}
        for p in parents:
            out[level + 1, p] = joined(out[level, s] for s in run_of(p * width, nodes, width))
        known, nodes = parents, -(-nodes // width)
    return out


def proof_of(n: int, at: int, nodes: dict[tuple[int, int], str], width: int = WIDTH) -> list[str]:
    """Siblings of one leaf, level by level, left to right."""
    out, size = [], n
    for level in range(height(n, width)):
        out += [nodes[level, s] for s in run_of(at, size, width) if s != at]
        at, size = at // width, -(-size // width)
    return out


def fold_path(leaf: str, proof: Sequence[str], path: Sequence[tuple[int, int]], width: int = WIDTH) -> str:
    """The root that a leaf and its siblings give; ``path`` has (position, leaves) of each tree from below."""
    rest, h = iter(proof), leaf
    for at, nodes in path:
        while nodes > 1:
            h = joined(h if s == at else next(rest) for s in run_of(at, nodes, width))
            at, nodes = at // width, -(-nodes // width)
    return h


_NODES = "tree string, n long, level int, at long, hash string"


def grow(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """All nodes (tree, n, level, at, hash) of a forest; ``leaves``, a written table, has tree, n (its leaves), at and hash, tree may be null."""
    block = WIDTH**levels

    def climb(base: int) -> DataFrame:
        def run(rows: pa.Table) -> pa.Table:
            tree, n = rows["tree"][0].as_py(), rows["n"][0].as_py()
            known = dict(sorted(zip(rows["at"].to_pylist(), rows["hash"].to_pylist(), strict=True)))
            out = []
            for level in range(base + 1, min(base + levels, height(n)) + 1):
                below = count_at(n, level - 1)
                known = {p: joined(known[s] for s in run_of(p * WIDTH, below)) for p in dict.fromkeys(at // WIDTH for at in known)}
                out += [(level, p, h) for p, h in known.items()]
            k = len(out)
            return pa.table([pa.array([tree] * k, pa.string()), pa.array([n] * k, pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["tree", "n", "level", "at", "hash"])

        return lambda nodes: nodes.groupBy("tree", F.floor(F.col("at") / block).alias("block")).applyInArrow(run, _NODES)

    layers = [leaves.select("tree", F.col("n").cast("long").alias("n"), F.lit(0).alias("level"), F.col("at").cast("long").alias("at"), "hash")]
    top = height(layers[0].agg(F.max("n")).first()[0] or 0)
    for base in range(0, top, levels):
        # single leaves are their own roots; block roots of unfinished trees go on
        open_ = layers[-1].where((F.col("level") == base) & (F.col("n") > WIDTH**base))
        layers.append(stash(climb(base)(open_), "nodes"))
    return reduce(DataFrame.unionByName, layers)


def roots(nodes: DataFrame) -> DataFrame:
    """tree, n, root: the only node of the highest level of every tree."""
    return nodes.where("at = 0").groupBy("tree", "n").agg(F.max_by("hash", "level").alias("root"))


def prove(asked: DataFrame, nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``asked`` (tree, n, at, hash and others) with ``proof``: the siblings from the leaf to its tree's root, by one multiproof for each block."""
    block = WIDTH**levels
    own = asked.select("*", F.floor(F.col("at") / block).alias("__block"))

    def ask(rows: pa.Table) -> pa.Table:
        tree, n, b = (rows[c][0].as_py() for c in ("tree", "n", "__block"))
        need = missing(n, set(rows["at"].to_pylist()))
        k = len(need)
        return pa.table([pa.array([tree] * k, pa.string()), pa.array([b] * k, pa.int64()), pa.array([x[0] for x in need], pa.int32()), pa.array([x[1] for x in need], pa.int64())], ["tree", "block", "level", "at"])

    def expand(rows: pa.Table, met: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.append_column("proof", pa.array([], pa.list_(pa.string()))).drop_columns(["__block"])
        n, at = rows["n"][0].as_py(), rows["at"].to_pylist()
        fetched = dict(zip(zip(met["level"].to_pylist(), met["at"].to_pylist(), strict=True), met["hash"].to_pylist(), strict=True))
        known = interiors(n, dict(zip(at, rows["hash"].to_pylist(), strict=True)), fetched)
        proofs = pa.array([proof_of(n, a, known) for a in at], pa.list_(pa.string()))
        return rows.append_column("proof", proofs).drop_columns(["__block"])

    need = own.select("tree", "n", "at", "__block").groupBy("tree", "__block").applyInArrow(ask, "tree string, block long, level int, at long")
    held = nodes.select(F.col("tree").alias("__tree"), F.col("level").alias("__level"), F.col("at").alias("__at"), "hash")
    met = need.join(held, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("level") == F.col("__level")) & (F.col("at") == F.col("__at"))).select("tree", "block", "level", "at", "hash")
    schema = StructType([*asked.schema.fields, StructField("proof", ArrayType(StringType()))])
    return own.groupBy("tree", "__block").cogroup(met.groupBy("tree", "block")).applyInArrow(expand, schema)


class Manifest:
    """The leaves with their places, all nodes, and the tree over the sources."""

    def __init__(self, leaves: DataFrame, levels: int = LEVELS) -> None:
        """``leaves``, a written table, has doc_id, source and leaf, and columns that are kept."""
        self.levels = levels
        sizes = leaves.groupBy(F.col("source").alias("__s")).agg(F.count("*").alias("n"))
        placed = ranked(leaves, [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()], ["source"], "at").withColumnsRenamed({"source": "tree", "leaf": "hash"})
        #: tree (source), n (its leaves), at, hash and the kept columns
        self.leaves = stash(placed.join(sizes, F.col("tree").eqNullSafe(F.col("__s"))).drop("__s"), "leaves")
        self.nodes = grow(self.leaves, levels)
        subroots = stash(ranked(roots(self.nodes).withColumnsRenamed({"tree": "source", "root": "subroot"}), [F.col("source").asc_nulls_first()], (), "place"), "subroots")
        sources = subroots.count()
        upper = subroots.select(F.lit(None).cast("string").alias("tree"), F.lit(sources).cast("long").alias("n"), F.col("place").alias("at"), F.col("subroot").alias("hash"), "source")
        upper = stash(upper, "upper")
        self.upper_nodes = grow(upper, levels)
        first = roots(self.upper_nodes).first()
        self.root = first["root"] if first else None
        proofs = prove(upper, self.upper_nodes, levels)
        #: source, place, sources, subroot, upper_proof: one row for each source
        self.sources = stash(proofs.select("source", F.col("at").alias("place"), F.col("n").alias("sources"), F.col("hash").alias("subroot"), F.col("proof").alias("upper_proof")), "sources")

    def proofs(self, asked: DataFrame | None = None) -> DataFrame:
        """The asked leaves (rows of ``leaves``; all if none are given) with subroot, root, path and proof up to the root."""
        lower = prove(self.leaves if asked is None else asked, self.nodes, self.levels)
        out = lower.join(self.sources, F.col("tree").eqNullSafe(F.col("source")))
        path = F.array(F.struct(F.col("at").alias("at"), F.col("n").alias("nodes")), F.struct(F.col("place").alias("at"), F.col("sources").alias("nodes")))
        kept = [c for c in lower.columns if c not in ("tree", "n", "at", "hash", "proof")]
        return out.select("source", F.col("hash").alias("leaf"), "subroot", F.lit(self.root).cast("string").alias("root"), path.alias("path"), F.concat("proof", "upper_proof").alias("proof"), *kept)


def fold(rows: DataFrame, leaf: str, name: str = "folded_root") -> DataFrame:
    """``rows`` (path, proof) with the root that the leaf in column ``leaf`` gives with the proof's siblings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(batch.column(leaf).to_pylist(), batch.column("proof").to_pylist(), batch.column("path").to_pylist(), strict=True)
            folded = [fold_path(h, proof, [(p["at"], p["nodes"]) for p in path]) for h, proof, path in parts]
            yield batch.append_column(name, pa.array(folded, pa.string()))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))


def op12_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    leaf = digest([F.col(c) for c in FIELDS])
    tampered = digest([*(F.col(c) for c in FIELDS[:-1]), F.translate("text", "\n", "")])
    odd = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    # a text without line feed is as it was
    leaves = docs.select("doc_id", "source", leaf.alias("leaf"), F.when(odd & F.contains("text", F.lit("\n")), tampered).alias("tampered"))
    manifest = Manifest(stash(leaves, "documents-leaves"))
    rows = fold(manifest.proofs().withColumn("shown", F.coalesce("tampered", "leaf")), "shown")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(c: str, value: str | None = None) -> str:
    text = f"({value or c})::VARCHAR"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _levels_sql(name: str, source: str) -> str:
    """Recursive levels of trees: tree, level, pos, h, n (nodes of the level)."""
    return (
        f"{name} AS (SELECT tree, 0 AS level, pos, h, n FROM {source} UNION ALL "
        f"SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3)"
    )


def oracle() -> str:
    """SQL of the query: trees, proofs and folds by recursion over levels."""
    own = " || ".join(_field_sql(c) for c in FIELDS)
    other = " || ".join(_field_sql(c, "replace(text, chr(10), '')" if c == "text" else None) for c in FIELDS)
    crc = "WITH RECURSIVE c0 AS (SELECT i::BIGINT AS i FROM range(256) t(i)), tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM c0)"
    of = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda s: coalesce(ascii(s), 0)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"
    return (
        f"{crc}, d AS (SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({own}) AS leaf, CASE WHEN {of} % 2 = 0 THEN sha256({other}) ELSE sha256({own}) END AS shown FROM documents, tab), "
        "p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS id FROM d), "
        "l0 AS (SELECT tree, pos, leaf AS h, n FROM p), "
        f"{_levels_sql('low', 'l0')}, "
        "u0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n, tree AS source FROM low WHERE n = 1), "
        f"{_levels_sql('up', 'u0')}, "
        # one chain of levels from the leaf to the root: the tree of the source first
        "chain AS (SELECT id, low.level, p.pos // (3 ** low.level)::BIGINT AS pos, p.tree, false AS upper FROM p JOIN low ON low.tree = p.tree AND low.pos = p.pos // (3 ** low.level)::BIGINT WHERE low.n > 1 "
        "UNION ALL SELECT id, up.level, u0.pos // (3 ** up.level)::BIGINT, '', true FROM p JOIN u0 ON u0.source = p.tree JOIN up ON up.pos = u0.pos // (3 ** up.level)::BIGINT WHERE up.n > 1), "
        "nodes AS (SELECT *, false AS upper FROM low UNION ALL SELECT *, true FROM up), "
        "runs AS (SELECT c.id, c.upper, c.level, string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos < c.pos) AS before, string_agg(x.h, '' ORDER BY x.pos) FILTER (x.pos > c.pos) AS after, row_number() OVER (PARTITION BY c.id ORDER BY c.upper, c.level) AS step "
        "FROM chain c JOIN nodes x ON x.tree = c.tree AND x.upper = c.upper AND x.level = c.level AND x.pos // 3 = c.pos // 3 GROUP BY c.id, c.upper, c.level, c.pos), "
        "folds AS (SELECT id, 0 AS step, shown AS h FROM p UNION ALL SELECT f.id, f.step + 1, sha256(coalesce(before, '') || h || coalesce(after, '')) FROM folds f JOIN runs r ON r.id = f.id AND r.step = f.step + 1), "
        "ends AS (SELECT id, arg_max(h, step) AS folded_root FROM folds GROUP BY 1), proofs AS (SELECT id, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY step)) AS proof FROM runs GROUP BY 1), "
        "top AS (SELECT h AS root FROM up WHERE n = 1) "
        "SELECT doc_id, leaf, u0.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM p JOIN u0 ON u0.source = p.tree JOIN ends USING (id) LEFT JOIN proofs USING (id), top"
    )


ORACLE = oracle()
