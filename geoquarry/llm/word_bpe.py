"""Byte-pair encoding with word ends, by speculation and verification, and decoding.

The merges come from a public vocabulary file (its path is a parameter; nothing is trained). A text is cut into words
as the file's normalizer and pre-tokenizer say. For all words that a task has not met yet at once:

* speculate: one leftmost-longest pass of an Aho-Corasick automaton over the joined words proposes tokens;
* verify: a sequence of tokens is the exact encoding if and only if each token encodes to itself and no merge ever
  crosses the border of two adjacent tokens. ``Merges.apart`` tests all distinct adjacent pairs together in numpy: it
  takes the two tokens back in time, merge by merge, and looks up whether their inner ends would have been merged while
  both stood;
* merge: only words that fail are merged exactly: short ones together, one merge of each word at a time, long ones
  alone, from a heap of pairs.

Whether a border can be judged that way rests on merges that only build on earlier ones and make each token once; a
file for which this does not hold has all its words merged exactly.

Words of plain Latin text are cut by regular expressions here; others go through the library's own normalizer and
pre-tokenizer, run by run between white space, across which neither acts. Added tokens (``<|endoftext|>``) in a text
are those tokens, as in the library. Decoding joins the tokens' strings with spaces, as the library does for a file
without a decoder; ids that the file lacks are left out.

Null and empty texts have no ids and decode to the empty text. Words of any length are encoded whole. Rows may repeat; a
null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.llm.common import table, worker_cache

#: Runs and words that one generation of the caches may hold, and the longest that is cached.
CACHE_WORDS, CACHE_LENGTH = 300_000, 48
#: Rows and bytes of texts that are encoded together.
SLICE_ROWS, SLICE_BYTES = 500, 2_000_000
#: Bytes as the visible characters that byte-level models hold: printable ones stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: The last character of a word is told from the others by this distance, so that every unit is one character.
_LAST = 0x1000
_GAP = "\n"
_NEVER = np.int64(1 << 40)
#: Longest word whose exact merges are done together with those of others.
MERGED_TOGETHER = 64
#: Characters whose class, case and normal form every library agrees on.
_PLAIN = re.compile("[\t-\r -~À-įĲ-ɏ]*").fullmatch
_LETTER = "a-zà-öø-ɏ"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}ß]+|[0-9]|[^\t-\r {_LETTER}ß0-9]+").findall
#: Runs between white space; the separators of files are no white space to the tokenizer.
_RUNS = re.compile("[^\t-\r ]+").findall
_SEPARATORS = re.compile("[\x1c-\x1f]").search
#: The cuts of the file that the expressions above state; files with others go through the library.
_OWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Merges:
    """Tokens, merges and the arrays that tell which tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        self.suffix = suffix
        self.ids = {self._unit(t): i for t, i in vocab.items()}
        self.n = max(vocab.values(), default=-1) + 1
        #: units of each token
        self.wide = np.zeros(self.n, np.int64)
        self.wide[list(self.ids.values())] = [len(t) for t in self.ids]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        self.left = np.arange(self.n)
        self.right = np.arange(self.n)
        self.rank = np.full(self.n, -1, np.int64)
        self.regular = True
        for rank, merge in enumerate(merges):
            x, y = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            # parts are units or made by earlier merges, and nothing is made twice
            self.regular = bool(self.regular and self.rank[c] < 0 and all(self.wide[t] == 1 or self.rank[t] >= 0 for t in (a, b)))
            self.pairs[a, b] = (rank, c)
            self.left[c], self.right[c], self.rank[c] = a, b, rank
        self.made = np.array([self.pairs[tuple(vocab[x] for x in (m if isinstance(m, list) else m.split(" ")))][1] for m in merges], np.int64)
        self.keys = np.array(sorted(a * self.n + b for a, b in self.pairs), np.int64)
        self.ranks = np.array([self.pairs[divmod(int(k), self.n)][0] for k in self.keys], np.int64)
        units = np.zeros(self.n, bool)
        units[[i for t, i in self.ids.items() if len(t) == 1]] = True
        #: tokens that their own characters are merged to
        self.closed = units & (self.rank < 0)
        if self.regular:
            made = np.flatnonzero(self.rank >= 0)
            made = made[np.argsort(self.rank[made])]
            sound = self.apart(self.left[made], self.right[made], self.rank[made])
            for c, a, b, ok in zip(made.tolist(), self.left[made].tolist(), self.right[made].tolist(), sound.tolist(), strict=True):
                self.closed[c] = ok and self.closed[a] and self.closed[b]

    def _unit(self, token: str) -> str:
        """A token with one character for each unit."""
        return token if not self.suffix or not token.endswith(self.suffix) else self.spell(token.removesuffix(self.suffix))

    def spell(self, word: str) -> str:
        """A word with its last unit marked."""
        return word[:-1] + chr(ord(word[-1]) + _LAST) if self.suffix and word else word

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), _NEVER)
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of rank below ``until`` crosses the border between token ``a`` and token ``b``, for each pair.

        x and y are the inner ends at a moment; ``ends`` are the ranks at which they go into a larger token. Of
        equal ranks the leftmost merge comes first: x is gone before a crossing merge of that rank, y is not.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_ends = np.full(len(x), _NEVER) if until is None else until.astype(np.int64)
        y_ends = x_ends - 1 if until is not None else x_ends.copy()
        good, open_ = np.ones(len(x), bool), np.arange(len(x))
        while len(open_):
            r = self.merge_rank(x, y)
            crossed = (r < x_ends) & (r <= y_ends) & (r < _NEVER)
            good[open_[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & (np.maximum(rx, ry) >= 0)
            open_, x, y, x_ends, y_ends, rx, ry = (v[on] for v in (open_, x, y, x_ends, y_ends, rx, ry))
            back = rx > ry  # of two equal tokens the left one is made first
            x, x_ends = np.where(back, self.right[x], x), np.where(back, rx, x_ends)
            y, y_ends = np.where(back, y, self.left[y]), np.where(back, y_ends, ry)
        return good

    def exact(self, words: list[str]) -> list[bytes]:
        """Ids of spelled words, always by the merge of lowest rank, leftmost first, until none is left; units that the file lacks are dropped."""
        short = [k for k, w in enumerate(words) if len(w) <= MERGED_TOGETHER]
        out = dict(zip(short, self._together([words[k] for k in short]), strict=True))
        return [out[k] if k in out else self._alone(w) for k, w in enumerate(words)]

    def _together(self, words: list[str]) -> list[bytes]:
        """One merge of every word at a time, for short words."""
        done = [b""] * len(words)
        flat = [(self.ids.get(c, -1)) for w in words for c in w]
        ids, owner = np.array(flat, np.int64), np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids, owner = ids[ids >= 0], owner[ids >= 0]
        rank = np.full(len(ids), _NEVER)
        if len(ids):
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.merge_rank(ids[:-1], ids[1:]), _NEVER)
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, first)
            over = best == _NEVER
            size = np.diff(np.append(first, len(ids)))
            if over.any():
                raw = ids.astype("<u4").tobytes()
                for k, a, n in zip(owner[first[over]].tolist(), first[over].tolist(), size[over].tolist(), strict=True):
                    done[k] = raw[4 * a : 4 * (a + n)]
            stay = np.repeat(~over, size)
            low = np.flatnonzero(stay & (rank == np.repeat(best, size)))
            low = low[np.concatenate([[True], owner[low[1:]] != owner[low[:-1]]])] if len(low) else low
            ids[low] = self.made[rank[low]]
            stay[low + 1] = False
            at = np.cumsum(stay) - 1
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            # only the pairs on both sides of a merge are new
            for k in (at[low], at[low] - 1):
                k = k[(k >= 0) & (k < len(ids))]
                last = np.minimum(k + 1, len(ids) - 1)
                rank[k] = np.where((last > k) & (owner[last] == owner[k]), self.merge_rank(ids[k], ids[last]), _NEVER)
        return done

    def _alone(self, word: str) -> bytes:
        """One word of any length, its pairs in a heap."""
        ids = [i for c in word if (i := self.ids.get(c)) is not None]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(hit[0], k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (hit := self.pairs.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = self.pairs[a, b][1], -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
                if hit := self.pairs.get((ids[k], ids[after[k]])):
                    heapq.heappush(heap, (hit[0], k, ids[k], ids[after[k]]))
            if before[k] >= 0 and (hit := self.pairs.get((ids[before[k]], ids[k]))):
                heapq.heappush(heap, (hit[0], before[k], ids[before[k]], ids[k]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()


class Encoder:
    """Encodes texts by words; ``speculated`` and ``merged`` count the distinct words that took each way."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import ahocorasick
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        model, added = own["model"], own.get("added_tokens", [])
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.automaton = ahocorasick.Automaton()
        for unit, i in self.merges.ids.items():
            if self.merges.closed[i]:
                self.automaton.add_word(unit, i)
        self.automaton.make_automaton()
        self.added = {t["content"]: t["id"] for t in added}
        self.by_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        cut = json.dumps(own.get("pre_tokenizer") or {})
        steps = [s.get("type") for s in (own.get("normalizer") or {}).get("normalizers", [])]
        self.latin = json.dumps(_OWN_SPLIT) in cut and '"use_regex": false' in cut and steps == ["NFC", "Replace", "Lowercase"]
        self.cache_words = cache_words
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.long: list[str] = []
        self.speculated = self.merged = 0

    def cut(self, run: str) -> list[str]:
        """The words of a run of characters, as visible bytes."""
        if self.latin and _PLAIN(run):
            words = _CUT(run.lower())
            return words if run.isascii() else [w.encode().decode("latin-1").translate(_VISIBLE) for w in words]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))]

    def solve(self, words: list[str]) -> dict[str, bytes]:
        """Ids (little-endian, 32 bits) of distinct words that are not empty."""
        m, spelled = self.merges, [self.merges.spell(w) for w in words]
        ok = np.zeros(len(words), bool)
        if m.regular and words:
            size = np.fromiter(map(len, spelled), np.int64, len(spelled))
            start = np.cumsum(size + 1) - size - 1
            found = np.array([x for hit in self.automaton.iter_long(_GAP.join(spelled)) for x in hit], np.int64).reshape(-1, 2)
            last, ids = found[:, 0], found[:, 1]
            owner = np.searchsorted(start, last, "right") - 1
            covered = np.bincount(owner, m.wide[ids], len(words)).astype(np.int64)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            pair, place = np.unique(ids[inside] * m.n + ids[inside + 1], return_inverse=True)
            ok = covered == size
            ok[owner[inside[~m.apart(pair // m.n, pair % m.n)[place]]]] = False
            bounds, raw = np.searchsorted(owner, np.arange(len(words) + 1)) * 4, ids.astype("<u4").tobytes()
        failed = np.flatnonzero(~ok).tolist()
        merged = dict(zip(failed, m.exact([spelled[k] for k in failed]), strict=True))
        self.speculated += len(words) - len(failed)
        self.merged += len(failed)
        return {w: merged[k] if k in merged else raw[bounds[k] : bounds[k + 1]] for k, w in enumerate(words)}

    def _learn(self, runs: list[str]) -> None:
        """Takes distinct runs into the cache, and their words."""
        cuts = [self.cut(r) for r in runs]
        words = self.words
        fresh = [w for w in set(chain.from_iterable(cuts)) if w not in words]
        words.update(self.solve(fresh))
        get = words.__getitem__
        self.runs.update({r: get(ws[0]) if len(ws) == 1 else b"".join(map(get, ws)) for r, ws in zip(runs, cuts, strict=True)})
        self.long += [w for w in chain(runs, fresh) if len(w) > CACHE_LENGTH]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, 32 bits each, little-endian."""
        if len(self.runs) > self.cache_words or len(self.words) > self.cache_words:
            self.runs, self.words = {}, {}
        parts = []
        for t in texts:
            if t and any(a in t for a in self.added):
                parts.append([r for p in self.by_added.split(t) for r in ([p] if p in self.added else _RUNS(p))])
            else:
                parts.append([] if not t else _RUNS(t) if _SEPARATORS(t) else t.split())
        # an added token that is not in the text as one stands there in no other way, so its string names it
        self.runs |= {t: np.array([i], "<u4").tobytes() for t, i in self.added.items()}
        self._learn([r for r in set(chain.from_iterable(parts)) if r not in self.runs])
        known = self.runs.__getitem__
        out = [b"".join(map(known, p)) for p in parts]
        for long in self.long:
            self.runs.pop(long, None)
            self.words.pop(long, None)
        self.long = []
        return out


class Decoder:
    """The tokens' strings by id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        known = own["model"]["vocab"] | {t["content"]: t["id"] for t in own.get("added_tokens", [])}
        self.tokens: list[str | None] = [None] * (max(known.values(), default=-1) + 1)
        for token, i in known.items():
            self.tokens[i] = token

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings with spaces between; special tokens stay."""
        tokens = self.tokens
        return " ".join([t for i in ids.tolist() if i < len(tokens) and (t := tokens[i]) is not None])


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and bytes of a column; a longer value is a part of its own."""
    size = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)), np.int64, batch.num_rows)
    begin, held = 0, 0
    for k, n in enumerate(size.tolist()):
        if k > begin and (k - begin >= SLICE_ROWS or held + n > SLICE_BYTES):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


def _encoder(path: str) -> Encoder:
    return worker_cache(("word-bpe", path), lambda: Encoder(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, 32 bits each, little-endian) of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(("word-bpe", path), lambda: Encoder(path))
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encoder.encode(part.column("text").to_pylist()), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text of every row of ``encoded`` (doc_id, ids); null ids are no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_cache(("word-bpe-tokens", path), lambda: Decoder(path))
        for batch in batches:
            for part in slices(batch, "ids"):
                texts = [decoder.decode(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else "" for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    done = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
