"""Piece encoding with exact N-best segmentation, and lossless decoding.

The pieces and scores come from a public SentencePiece vocabulary (its path is a parameter; nothing is trained).
A text gets one leading space and is cut before each run of spaces, around line feeds, and between a letter and a sign that follows a letter in no
piece; no piece spans such a cut, so
the lattice of a text is a chain of small lattices. In each, a forward Viterbi pass gives the best score to every
position; these are exact heuristics for a backward A-star search, which yields segmentations from best to worst.
The N best of a whole text differ from its best only in the N - 1 units with the smallest gap between their first
and second segmentation, so A-star runs on those alone and the lists are merged exactly.

Characters without a piece, and a literal U+2581, become the byte pieces of their UTF-8, so decoding gives back
every text. Null and empty texts have no pieces, score 0 and one (empty) segmentation. Equal scores prefer the
longer last piece. Rows may repeat; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.llm.common import small_batches, table, worker_cache

N_BEST = 4
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Units that one generation of the cache may hold, and the longest that is cached.
CACHE_UNITS, CACHE_LENGTH = 400_000, 48
_NONE = object()


class Vocabulary:
    """Pieces, scores and byte pieces read from a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = range(model.vocab_size())
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in size if model.is_byte(i)}
        plain = [i for i in size if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i).replace("▁", " "): (model.get_score(i), i) for i in plain}
        self.longest = max(map(len, self.pieces))
        #: every beginning of a piece, with (score, ids) where it is a piece itself
        self.beginnings = dict.fromkeys(p[:k] for p in self.pieces for k in range(1, len(p)))
        self.beginnings |= {p: (s, (i,)) for p, (s, i) in self.pieces.items()}
        self.byte_score = min(s for s, _ in self.pieces.values() if s > -1e8) - 10
        signs = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
        loose = "".join(re.escape(c) for c in signs if not any(re.search(f"[{_LETTER}]{re.escape(c)}", p) for p in self.pieces))
        word = f"[{_LETTER}]++(?:{f'(?=[{loose}])|' if loose else ''}[^ \n▁]*+)"
        self.units = re.compile(f" +(?:{word}|[^ \n▁]*+)|{word}|\n|▁|[^ \n▁]++").findall
        self.text = {i: p.encode() for p, (_, i) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}

    def edges(self, unit: str, end: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of the pieces of ``unit`` that end at ``end``, longest first."""
        for start in range(max(0, end - self.longest), end):
            if (found := self.pieces.get(unit[start:end])) is not None:
                yield start, found[0], (found[1],)
        if unit[end - 1] not in self.pieces:
            raw = unit[end - 1].encode()
            yield end - 1, self.byte_score * len(raw), tuple(self.bytes[b] for b in raw)


class _Young(dict):
    """unit -> (ids, score, gap, ids as bytes, decoded bytes); units that it lacks come from the older generation or are segmented."""

    def __init__(self, solve: Callable, old: dict) -> None:
        self.solve, self.old = solve, old

    def __missing__(self, unit: str) -> tuple[tuple[int, ...], float, float, bytes, bytes]:
        found = self.old.get(unit) or self.solve(unit)
        if len(unit) <= CACHE_LENGTH:
            self[unit] = found
        return found


class Segmenter:
    def __init__(self, vocabulary: Vocabulary, cache_units: int = CACHE_UNITS) -> None:
        self.v, self.cache_units = vocabulary, cache_units
        self.young = _Young(self.solve, {})

    def forward(self, unit: str) -> tuple[list[float], list[float], list[tuple[int, tuple[int, ...]]]]:
        """Best and second-best score of every position, and the last edge of the best."""
        n, low = len(unit), -np.inf
        first, second, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        first[0] = 0.0
        get, pieces = self.v.beginnings.get, self.v.pieces
        for start in range(n):
            a, b = first[start], second[start]
            if a == low:
                continue
            end = start
            while end < n:
                end += 1
                found = get(unit[start:end], _NONE)
                if found is _NONE:
                    break
                if found is not None:
                    s = a + found[0]
                    if s > first[end]:
                        second[end], first[end], back[end] = first[end], s, (start, found[1])
                    elif s > second[end]:
                        second[end] = s
                    if b > low and (s := b + found[0]) > second[end]:
                        second[end] = s
            if unit[start] not in pieces:
                for _, score, ids in self.v.edges(unit[start], 1):
                    end = start + 1
                    if (s := a + score) > first[end]:
                        second[end], first[end], back[end] = first[end], s, (start, ids)
                    elif s > second[end]:
                        second[end] = s
                    if (s := b + score) > second[end]:
                        second[end] = s
        return first, second, back

    def solve(self, unit: str) -> tuple[tuple[int, ...], float, float, bytes, bytes]:
        """ids, score, the gap to the second-best segmentation (infinite if there is none), ids as bytes, decoded bytes."""
        if unit == "▁":
            raw = unit.encode()
            ids, score, gap = tuple(self.v.bytes[b] for b in raw), self.v.byte_score * len(raw), np.inf
        else:
            first, second, back = self.forward(unit)
            at, parts = len(unit), []
            while at:
                at, own = back[at]
                parts.append(own)
            ids, score, gap = tuple(i for own in reversed(parts) for i in own), first[-1], first[-1] - second[-1]
        return ids, score, gap, struct.pack(f"<{len(ids)}I", *ids), b"".join(map(self.v.text.__getitem__, ids))

    def best(self, text: str) -> tuple[list[str], list[tuple[tuple[int, ...], float, float, bytes, bytes]]]:
        """The units of a text and their best segmentations."""
        if len(self.young) >= self.cache_units:
            self.young = _Young(self.solve, dict(self.young))
        units = self.v.units(" " + text)
        return units, list(map(self.young.__getitem__, units))

    def n_best(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a unit by backward A-star, best first."""
        if unit == "▁":
            ids, score = self.solve(unit)[:2]
            return [(score, ids)]
        first, _, _ = self.forward(unit)
        order, out = count(), []
        heap = [(-first[-1], len(unit), 0, 0.0, None)]  # bound, position, order, score behind it, ids behind it
        while heap and len(out) < n:
            _, at, _, behind, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((behind, tuple(ids)))
                continue
            for start, score, own in self.v.edges(unit, at):
                if first[start] > -np.inf:
                    heapq.heappush(heap, (-(first[start] + score + behind), start, next(order), score + behind, (own, path)))
        return out

    def encode(self, text: str | None, n: int = 1) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text as (score, ids), best first."""
        if not text:
            return [(0.0, [])]
        units, found = self.best(text)
        ids = [i for f in found for i in f[0]]
        total = sum(f[1] for f in found)
        merged: list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]] = [(0.0, ())]
        if n > 1:
            for k in heapq.nsmallest(n - 1, range(len(units)), key=lambda k: found[k][2]):
                if found[k][2] < np.inf:
                    own = self.n_best(units[k], n)
                    merged = sorted(((d + s - own[0][0], change + ((k, alt),) if j else change) for d, change in merged for j, (s, alt) in enumerate(own)), key=lambda x: -x[0])[:n]
        out = [(total, ids)]
        for delta, change in merged[1:]:
            swapped = dict(change)
            out.append((total + delta, [i for k, f in enumerate(found) for i in swapped.get(k, f[0])]))
        return out

    def scores(self, text: str | None, n: int) -> tuple[bytes, list[float], list[int], str]:
        """Ids of the best segmentation as little-endian bytes, scores and checksums of the ids of the n best, and what the ids decode to."""
        if not text:
            return b"", [0.0], [0], ""
        units, found = self.best(text)
        _, scores, gaps, ids, texts = zip(*found, strict=True)
        total, best = sum(scores), b"".join(ids)
        merged: list[tuple[float, tuple[tuple[int, tuple[int, ...]], ...]]] = [(0.0, ())]
        for k in heapq.nsmallest(n - 1, range(len(units)), key=gaps.__getitem__):
            if gaps[k] < np.inf:
                own = self.n_best(units[k], n)
                merged = sorted(((d + s - own[0][0], change + ((k, alt),) if j else change) for d, change in merged for j, (s, alt) in enumerate(own)), key=lambda x: -x[0])[:n]
        crcs = [zlib.crc32(best)]
        for _, change in merged[1:]:
            parts = list(ids)
            for k, alt in change:
                parts[k] = struct.pack(f"<{len(alt)}I", *alt)
            crcs.append(zlib.crc32(b"".join(parts)))
        return best, [total + d for d, _ in merged], crcs, b"".join(texts).decode("utf-8")[1:]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.text.__getitem__, ids)).decode("utf-8")[1:]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encoder(path: str, n: int, with_ids: bool, cache_units: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the worker's cache of units serves all tasks that it runs
        own = worker_cache(("pieces", path, cache_units), lambda: Segmenter(Vocabulary(path), cache_units))
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                pieces, crcs, scores, exact, ids_of = [], [], [], [], []
                for x in part.column("text"):
                    text = x.as_py()
                    ids, best, checks, back = own.scores(text, n)
                    pieces.append(len(ids) // 4)
                    crcs.append(checks)
                    scores.append(best)
                    exact.append(back == (text or ""))
                    if with_ids:
                        ids_of.append(np.frombuffer(ids, "<i4"))
                columns = [part.column("doc_id"), pa.array(pieces, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64())), pa.array(exact, pa.bool_())]
                names = ["doc_id", "n_pieces", "crcs", "scores", "round_trip"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids_of, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, path: str, n: int = N_BEST, with_ids: bool = True, cache_units: int = CACHE_UNITS) -> DataFrame:
    """doc_id, n_pieces, crcs (of the little-endian 32-bit ids of the n best, best first), scores (of the n best), round_trip, ids (of the best)."""
    schema = "doc_id long, n_pieces long, crcs array<long>, scores array<double>, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(path, n, with_ids, cache_units), schema)


def _decoder(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache(("pieces", path, CACHE_UNITS), lambda: Segmenter(Vocabulary(path)))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(x.as_py() or []) for x in batch.column("ids")], pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), "doc_id long, text string")


def op5_sentencepiece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), default_path(), with_ids=False)
    margin = F.when(F.size("scores") > 1, F.get("scores", 0) - F.get("scores", 1))
    n_best = F.array_join(F.zip_with("scores", "crcs", lambda s, c: F.concat_ws(":", s.cast("string"), c.cast("string"))), ",")
    return out.select("doc_id", "n_pieces", F.get("crcs", 0).alias("ids_crc32"), F.get("scores", 0).alias("score"), margin.alias("margin"), n_best.alias("n_best"), "round_trip")


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of piece ids for every document; a smaller cache, as executors also hold what earlier stages left."""
    small_batches(spark)
    return encode(docs, default_path(), n=2, cache_units=CACHE_UNITS // 16).select("doc_id", "n_pieces", F.get("crcs", 0).alias("ids_crc32"), F.get("scores", 0).alias("score"), "round_trip", "ids")
