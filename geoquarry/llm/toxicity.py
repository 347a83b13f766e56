"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, searched through a block-max inverted index.

Fitting uses a bounded, documented sample of the labelled rows (``examples`` of each class, by hash order, from
the training fold only): they become the indexed examples, and all their terms are the vocabulary, without any
selection. Inverse document frequencies are counted over all documents. A term's weight is its TF-IDF times the
evidence its z score in the sample gives about the class, (1 + z^2) / (1 + z^2 + HALF_Z^2): rare terms weigh less,
none weighs nothing.

Scoring turns every whole text into its vector. Short posting lists are added up as they are; long ones (terms that
many examples hold) are kept in blocks of BLOCK examples with the largest weight of each block. A block's bound is
its best sum over short lists plus the text's weights times the block's maxima: the blocks that promise most are
scored first, and blocks whose bound is under the k-th best cosine are never scored, so the result equals a full scan.
Votes are weighted by distance and shrunk towards the base rate. A logistic curve, fitted on every example's vote
without itself, weighted to the classes' shares among all labelled training rows, turns the vote into a probability.
The examples that voted most are returned as evidence.

Defined results: null and empty texts, and texts that share no term with any example, get the smoothed rate of toxic
rows among examples without any term; without usable labels every score is 0. Terms that no example holds take no
part in a text's length. Ties in cosine go to the example with the smaller place in the index. Repeated rows are
scored alike; labels of one doc_id count as their largest, and its texts as the smallest; extra columns are ignored;
a null doc_id is kept with held_out false.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.llm.common import release_worker_cache, small_batches, stash, table, unstash

#: Labelled rows of each class that fitting may use.
EXAMPLES = 2000
#: The z score (difference of the classes' shares in the sample) at which a term counts about half.
HALF_Z = 5.0
#: Lengths in bytes of the word beginnings that count as terms.
PREFIXES = (4, 5, 6)
K = 25
#: Texts scored at once, examples in a block, and the share of the examples from which a posting list is long.
BATCH, BLOCK, LONG_SHARE = 128, 32, 0.1
#: What 32-bit sums of a text's weights may be wrong by, with room to spare.
MARGIN = 1e-4
#: Pseudo-votes of the base rate, and what keeps weights finite at distance 0.
SHRINK, EPS = 1.0, 0.1
#: Words whose places a worker keeps: in the query, and in the pipeline, whose executors also hold what other stages need.
WORDS, STAGE_WORDS = 250_000, 20_000
#: Examples that are returned as evidence.
EVIDENCE = 5

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def terms(text: str | None) -> set[bytes]:
    """The distinct terms of a text: its words, and the beginnings of longer words (marked by a star)."""
    own = set(words(text))
    return own | {w[:k] + b"*" for w in own for k in PREFIXES if len(w) > k}


_NOWHERE = np.zeros(0, np.int32)


class _Places(dict):
    """word -> places of its terms; keeps so many words that are terms themselves."""

    def __init__(self, own: Vocabulary) -> None:
        super().__init__()
        self.place, self.most = own.get, own.keep
        #: from the longest on: length, and the places of a word beginning with those of its own beginnings
        self.stems: list[tuple[int, Callable[[bytes], np.ndarray | None]]] = []
        for k in sorted(PREFIXES):
            stems = {t[:-1]: np.append(self.begun(t[:-1]), np.int32(i)) for t, i in own.items() if len(t) == k + 1 and t.endswith(b"*")}
            self.stems.insert(0, (k, stems.get))

    def begun(self, w: bytes) -> np.ndarray:
        n = len(w)
        for k, stems in self.stems:
            if n > k and (found := stems(w[:k])) is not None:
                return found
        return _NOWHERE

    def __missing__(self, w: bytes) -> np.ndarray:
        out, i = self.begun(w), self.place(w)
        if i is not None:
            out = np.append(out, np.int32(i))
            if len(self) < self.most:
                self[w] = out
        return out


class Vocabulary(dict):
    """term -> place; counts the terms of a text without building those it does not hold."""

    def __init__(self, terms: list[bytes], keep: int = WORDS) -> None:
        super().__init__((t, i) for i, t in enumerate(terms))
        self.keep = keep

    @cached_property
    def of_word(self) -> _Places:
        return _Places(self)

    @cached_property
    def _last(self) -> np.ndarray:
        return np.zeros(len(self), int)

    def _once(self, place: np.ndarray) -> np.ndarray:
        """The distinct places; afterwards ``_last`` holds where each of them stands among these."""
        self._last[place] = np.arange(len(place))
        out = place[self._last[place] == np.arange(len(place))]
        self._last[out] = np.arange(len(out))
        return out

    def held(self, text: str | None) -> np.ndarray:
        """Places of the terms that a text holds."""
        return self._once(np.concatenate([_NOWHERE, *map(self.of_word.__getitem__, set(words(text)))]))

    def places(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms that a text holds, and how often it holds each."""
        own = Counter(words(text))
        found = list(map(self.of_word.__getitem__, own))
        times = np.repeat(np.fromiter(own.values(), float, len(own)), np.fromiter(map(len, found), int, len(own)))
        every = np.concatenate([_NOWHERE, *found])
        place = self._once(every)
        return place, np.bincount(self._last[every], times, len(place))

    def count(self, text: str | None) -> dict[int, int]:
        place, n = self.places(text)
        return dict(zip(place.tolist(), n.astype(int).tolist(), strict=True))

    def __reduce__(self):
        return Vocabulary, (list(self), self.keep)


class Postings:
    """Weights (32-bit) of terms in examples: short lists as they are, long ones in blocks with their maxima.

    Blocks are chosen by 32-bit sums with a margin for their error; the cosines of what may be among the nearest are
    then taken in 64 bits.
    """

    def __init__(self, term: np.ndarray, example: np.ndarray, weight: np.ndarray, shape: tuple[int, int], block: int = BLOCK) -> None:
        self.terms, self.examples = shape
        self.block, self.blocks = block, -(-shape[1] // block)
        weight = weight.astype(np.float32)
        held = np.bincount(term, minlength=shape[0])
        long = np.flatnonzero(held > max(LONG_SHARE * shape[1], 1))
        self.row = np.full(shape[0], -1, np.int32)
        self.row[long] = np.arange(len(long))
        own = self.row[term] >= 0
        self.long = np.zeros((self.blocks, len(long), block), np.float32)
        self.long[example[own] // block, self.row[term[own]], example[own] % block] = weight[own]
        self.most = self.long.max(axis=2, initial=0.0).T
        order = np.lexsort((example[~own], term[~own]))
        self.example, self.weight = example[~own][order].astype(np.int32), weight[~own][order]
        self.start = np.concatenate([[0], np.cumsum(np.where(self.row >= 0, 0, held))])

    def _short(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sums of w over the short lists of the terms t, by example."""
        begin, n = self.start[t], self.start[t + 1] - self.start[t]
        at = np.repeat(begin + n - np.cumsum(n), n)
        at += np.arange(len(at))
        w = np.repeat(w, n)
        w *= self.weight.take(at, mode="clip")
        return np.bincount(self.example.take(at, mode="clip"), w, self.blocks * self.block)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Places and cosines of the k nearest examples with a positive cosine, for each vector; and the blocks scored."""
        n, size = len(vectors), self.block
        if not self.examples:
            return [(np.zeros(0, int), np.zeros(0))] * n, 0
        weights, short = np.zeros((n, self.most.shape[0])), np.zeros((n, self.blocks * size))
        for v, (t, w) in enumerate(vectors):
            row = self.row[t]
            weights[v, row[row >= 0]] = w[row >= 0]
            short[v] = self._short(t[row < 0], w[row < 0])
        light, sums = weights.astype(np.float32), short.astype(np.float32).reshape(n, self.blocks, size)
        bound = sums.max(axis=2) + light @ self.most
        done = np.zeros((n, self.blocks), bool)

        def score(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                own = np.flatnonzero(wanted[:, b])
                sums[own, b] += light[own] @ self.long[b]
            done[wanted] = True

        first = min(self.blocks, -(-k // size) + 1)
        lead = np.zeros_like(done)
        np.put_along_axis(lead, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        score(lead)
        # the k-th best so far: what a further block has to reach
        seen = np.where(done[:, :, None], sums, 0.0).reshape(n, -1)
        bar = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] > k else np.zeros(n)
        score((bound >= bar[:, None] - MARGIN) & ~done)
        out = []
        for v in range(n):
            own = np.flatnonzero(done[v])
            s = sums[v, own].ravel()
            least = np.partition(s, -k)[-k] - MARGIN if len(s) > k else 0.0
            i = np.flatnonzero((s >= least) & (s > 0))
            b, e = own[i // size], i % size
            place, rows = b * size + e, np.flatnonzero(weights[v])
            exact = np.round(short[v, place] + weights[v, rows] @ self.long[b[None], rows[:, None], e[None]], 12)
            best = np.lexsort((place, -exact))[:k]
            out.append((place[best], exact[best]))
        return out, int(done.sum())

    def full(self) -> np.ndarray:
        """All weights, terms by examples."""
        out = np.zeros((self.terms, self.examples))
        out[np.repeat(np.arange(self.terms), np.diff(self.start)), self.example] = self.weight
        long = np.flatnonzero(self.row >= 0)
        out[long] = self.long.transpose(1, 0, 2).reshape(self.most.shape[0], -1)[self.row[long], : self.examples]
        return out


def calibrate(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of labels over the votes' log-odds; the identity where they tell nothing."""
    if not len(labels) or labels.min() == labels.max():
        return 1.0, 0.0
    x = np.column_stack([_log_odds(votes), np.ones(len(votes))])
    w, weight = np.array([1.0, 0.0]), weight / weight.mean()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (labels - p)) - np.array([w[0] - 1, w[1]])
        w = w + np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2), grad)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def _log_odds(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Index:
    """Labelled examples, their postings, and the curve from votes to probabilities."""

    vocabulary: Vocabulary
    idf: np.ndarray
    postings: Postings
    labels: np.ndarray
    ids: np.ndarray
    silent_rate: float  # among examples without any term
    base_rate: float
    curve: tuple[float, float] = (1.0, 0.0)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return _vector(*self.vocabulary.places(text), self.idf)

    def _vote(self, i: np.ndarray, s: np.ndarray) -> float:
        if not len(i):
            return self.silent_rate
        vote = 1 / (1 - np.minimum(s, 1) + EPS)
        return float(((vote * self.labels[i]).sum() + SHRINK * self.base_rate) / (vote.sum() + SHRINK))

    def votes_without_themselves(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The vote on each example, given by its place, when it is not among the examples."""
        out = []
        for at in range(0, len(vectors), BATCH):
            for k, (i, s) in enumerate(self.postings.nearest(vectors[at : at + BATCH], K + 1)[0]):
                keep = np.flatnonzero(i != at + k)[:K]
                out.append(self._vote(i[keep], s[keep]))
        return np.array(out)

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """Probability and evidence (doc_ids of the nearest examples) of each text."""
        found = []
        for at in range(0, len(texts), BATCH):
            found += self.postings.nearest([self.vector(x) for x in texts[at : at + BATCH]], K)[0]
        slope, offset = self.curve
        if not len(self.labels) and not self.base_rate:
            return [(0.0, [])] * len(texts)
        return [(float(1 / (1 + np.exp(-(slope * _log_odds(self._vote(i, s)) + offset)))), self.ids[i[:EVIDENCE]].tolist()) for i, s in found]

    def score(self, text: str | None) -> tuple[float, list[int]]:
        return self.scores([text])[0]


def _vector(t: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights at length 1; the last term stands in every text that has another."""
    if not len(t):
        return np.zeros(0, int), np.zeros(0)
    t, n = np.append(t, len(idf) - 1), np.append(n, 1)
    w = (1 + np.log(n)) * idf[t]
    return t, w / np.sqrt((w * w).sum())


def build_index(examples: Iterable[tuple[int, int, dict[int, int]]], vocabulary: list[bytes] | Vocabulary, idf: np.ndarray, known: tuple[int, int] | None = None) -> Index:
    """examples: (doc_id, label, term counts); idf: weights of the vocabulary and of the term that every text has.

    ``known`` are the numbers of clean and toxic rows that the examples stand for; their own numbers where it is None.
    """
    placed = sorted(((x[0], x[1], *_vector(np.array(sorted(x[2]), int), np.array([x[2][i] for i in sorted(x[2])], int), idf)) for x in examples), key=lambda x: x[:2])
    own, silent = [x for x in placed if len(x[2])], [x for x in placed if not len(x[2])]
    # examples of one class and the same heaviest terms stand in the same blocks, so that block maxima are close to their weights
    own.sort(key=lambda x: (x[1], x[2][np.argsort(-x[3], kind="stable")[:3]].tolist(), x[0]))
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    postings = Postings(join([x[2] for x in own], int), join([np.full(len(x[2]), k) for k, x in enumerate(own)], int), join([x[3] for x in own], float), (len(idf), len(own)))
    rate = lambda rows, by, n: (sum(x[1] for x in rows) + by * n) / (len(rows) + n)
    base = rate(placed, 0.0, 1)
    words_of = vocabulary if isinstance(vocabulary, Vocabulary) else Vocabulary(vocabulary)
    index = Index(words_of, idf, postings, np.array([x[1] for x in own], int), np.array([x[0] for x in own], int), rate(silent, base, 1), base)
    shown = np.bincount([x[1] for x in placed], minlength=2)
    share = np.array(known or shown) / np.maximum(shown, 1)
    index.curve = calibrate(index.votes_without_themselves([x[2:4] for x in own]), index.labels, share[index.labels])
    return index


def _shared[T](spark: SparkSession, value: T) -> Broadcast[T]:
    """A broadcast of what fitting has learnt, whose size the number of examples bounds; workers drop it with the stage that reads it."""
    return spark.sparkContext.broadcast(value)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            own = sorted(terms(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([toxic.as_py()] * len(own), pa.int64())], ["term", "toxic"])


def _vectors(shared: Broadcast[Vocabulary]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            counts = [vocabulary.count(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic"), pa.array([sorted(c) for c in counts], pa.list_(pa.int64())), pa.array([[c[i] for i in sorted(c)] for c in counts], pa.list_(pa.int64()))], ["doc_id", "toxic", "terms", "counts"])

    return run


def _frequencies(shared: Broadcast[Vocabulary]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker_cache()
        vocabulary, rows = shared.value, 0
        found = np.zeros(len(vocabulary), int)
        for batch in batches:
            for x in batch.column("text"):
                rows += 1
                found[vocabulary.held(x.as_py())] += 1
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int64()), pa.array(np.append(found[held], rows), pa.int64())], ["term", "df"])

    return run


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, keep: int = WORDS) -> Index:
    """Learn from at most ``examples`` training rows of each class; document frequencies cover all of ``docs``."""
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    order = [F.md5(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string"))), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(examples).unionByName(known.where("toxic = 0").orderBy(*order).limit(examples))
    # at most 2 * examples ids: a size that the parameter bounds
    sample = stash(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "examples")
    known = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    n1, n0 = (sample.where(f"toxic = {y}").count() for y in (1, 0))
    by_term = sample.mapInArrow(_term_rows, "term binary, toxic long").groupBy("term").agg(F.sum("toxic").alias("d1"), F.sum(1 - F.col("toxic")).alias("d0"))
    p1, p0 = (F.col("d1") + 0.5) / (n1 + 1), (F.col("d0") + 0.5) / (n0 + 1)
    pooled = (F.col("d1") + F.col("d0") + 1.0) / (n1 + n0 + 2)
    z = F.abs(p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / (n1 + 1) + 1 / (n0 + 1)) + 1e-12)
    known_terms = by_term.select("term", z.alias("z")).toArrow().sort_by("term")
    vocabulary, z2 = Vocabulary(known_terms["term"].to_pylist(), keep), 1 + np.square(known_terms["z"].to_numpy())
    place = _shared(docs.sparkSession, vocabulary)
    df, rows = np.zeros(len(vocabulary)), 0
    if vocabulary:
        found = docs.select("text").mapInArrow(_frequencies(place), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        t, n = found["term"].to_numpy(), found["df"].to_numpy()
        df[t[t >= 0]], rows = n[t >= 0], int(n[t < 0].sum())
    idf = (np.log((rows + 1) / (df + 1)) + 1) * z2 / (z2 + HALF_Z**2)
    idf = np.append(idf, np.median(idf) if len(idf) else 1.0)
    rows = sample.mapInArrow(_vectors(place), "doc_id long, toxic long, terms array<long>, counts array<long>").toArrow().to_batches()
    index = build_index(((r["doc_id"].as_py(), r["toxic"].as_py(), dict(zip(r["terms"].as_py(), r["counts"].as_py(), strict=True))) for b in rows for r in b.to_struct_array()), vocabulary, idf, (known.get(0, 0), known.get(1, 0)))
    unstash(sample)
    place.destroy()
    return index


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are scored at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH):
            yield batch.slice(i, BATCH)


def _scores(shared: Broadcast[Index]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in _parts(batches):
            found = index.scores(batch.column("text").to_pylist())
            keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], [*names, "score", "evidence"])

    return run


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (doc_ids of the nearest examples) for every row of ``docs``."""
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    scored = flat.mapInArrow(_scores(_shared(docs.sparkSession, index)), "doc_id long, held_out boolean, score double, evidence array<long>")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op3_toxicity_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def _clean(shared: Broadcast[Index]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in _parts(batches):
            keep = pa.array([s < 0.5 for s, _ in index.scores(batch.column("text").to_pylist())], pa.bool_())
            yield batch.filter(keep)

    return run


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the operator predicts toxic go; all others stay as they are."""
    small_batches(spark)
    index = fit(docs, table(spark, sf_dir, "labels"), keep=STAGE_WORDS)
    return docs.mapInArrow(_clean(_shared(spark, index)), docs.schema)
