"""Secrets found by one deterministic automaton over all rules.

Every rule's regular expression, its last repeat at its least, goes into one unanchored automaton (subset
construction, minimisation, transition arrays); a single pass over a text's bytes tells which rules end a match anywhere in it. Only for those rules, the
reversed automaton marks every offset where a match begins and the anchored one gives the longest match from the
leftmost of them, so spans are leftmost and do not overlap within a kind. Matches that are too short are dropped.

Offsets are code points, end exclusive. Null texts count as empty. Rows may repeat, ids may be null and extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.llm.automata import Dfa, compile_rules, parse, reverse, shortest
from geoquarry.llm.common import table


@dataclass(frozen=True)
class Rule:
    """``least`` bytes are needed of the match, or of what follows ``prefix`` where one is given."""

    kind: str
    pattern: str
    least: int
    fold: bool = False
    prefix: str = ""


_KEY = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: Fixed rules. The first three are the base; hex holds its least length itself, as its runs are everywhere.
RULES = (
    Rule("assign", _KEY + r"[A-Za-z0-9+/_.=-]+", 12, True, _KEY),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    Rule("url", r"://[A-Za-z0-9._%-]+:[^\x20\x09-\x0D/@]+@", 8),
)
BASE = 3


class Scanner:
    """All automata of a set of rules."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        trees = [parse(r.pattern, r.fold) for r in rules]
        self.all = compile_rules([shortest(t) for t in trees], anchored=False)
        self.begins = [compile_rules([reverse(t)], anchored=False) for t in trees]
        self.whole = [compile_rules([t], anchored=True) for t in trees]
        self.prefix: list[Dfa | None] = [compile_rules([parse(r.prefix, r.fold)], anchored=True) if r.prefix else None for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start, then rule."""
        out = []
        for k in self.all.ends(data):
            starts = sorted(len(data) - e for e in self.begins[k].all_ends(data[::-1]))
            at = 0
            while (i := bisect_left(starts, at)) < len(starts):
                start = starts[i]
                end = self.whole[k].longest(data, start)
                value = self.prefix[k].longest(data, start) if self.prefix[k] else start
                if end - value >= self.rules[k].least:
                    out.append((start, k, end))
                at = end
        return sorted(out)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def find(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    data = (text or "").encode("utf-8", "surrogatepass")
    spans = scanner(rules).spans(data)
    if len(data) != len(text or ""):
        points, at, count = {}, 0, 0
        for p in sorted({p for s, _, e in spans for p in (s, e)}):
            count += len(data[at:p].decode("utf-8", "surrogatepass"))
            points[p], at = count, p
        spans = [(points[s], k, points[e]) for s, k, e in spans]
    return [(rules[k].kind, s, e) for s, k, e in spans]


def _scan(rules: tuple[Rule, ...]) -> Callable:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(x.as_py(), rules)] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (kind, start, end) of every row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(rules), "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in RULES[:BASE])))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *(count(r.kind) for r in RULES[:BASE]), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The base digest of a list of spans."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in {r.kind for r in RULES[:BASE]}).encode()).hexdigest()
