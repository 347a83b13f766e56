"""Token-id files with a minimal perfect hash index: constant-time access by document key over raw id payloads.

Documents are range-partitioned by doc_id, rows that repeat one further by the beginning and hash of their texts, so
no id fills a task; each partition is encoded and written as one file to the shared folder under a name that depends
on the partition alone (written aside, then moved; a file that already stands there is the same), so repeated tasks
are harmless.

File, little-endian: a header of 8-byte unsigned numbers (magic, bytes for each id, documents, ids, levels, slots'
words), the bits of each level's size, the bit words of the levels, then in slot order 32-bit fingerprints, 64-bit
offsets and 64-bit lengths, then in document order 64-bit keys, 32-bit ordinals and 8-bit null flags, then the raw
ids. A key is (doc_id, ordinal among equal doc_ids). Keys that collide on one level of the hash move to the next;
the rank of a key's bit is its slot, and the stored fingerprint rejects foreign keys. Ordinals count within a file.

Encoding looks words up in a cache: a byte-level tokenizer never joins two words that a single space separates, so
each word with its space is a closed unit. Texts where white space touches white space, or that hold an added token,
and all texts of tokenizers of another build, go to the tokenizer whole.

Every document ends with id 0, null and empty texts are that id alone. Null doc_ids come first; rows that repeat a
doc_id are in the order of their texts' first characters. Rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from geoquarry.llm.common import scratch_path, stash, table, worker_cache
from geoquarry.llm.shingles import mix

MAGIC = 0x31485045444955  # names the format and its version
END_ID = 0
SHARD_BYTES = 64 << 20
#: Words that one generation of the cache may hold, and the longest that is cached.
CACHE_WORDS, CACHE_LENGTH = 500_000, 48
#: Characters by which rows of one doc_id are spread over partitions before the hash of their text.
HEAD_CHARS = 16
#: White space next to a space: no word boundary there is certain.
_WIDE = r" \s|\s "
#: Texts without such characters hold no white space but spaces and line feeds.
_RARE = re.compile("[^\n -~À-ɏ]").search
#: Characters whose classes every regex engine agrees on; words with others are encoded whole.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_UNSURE = re.compile("[^\t\n\r -~À-ɏ]")
#: The byte-level cut of a text; words come first here, as no other branch can begin where they do.
_CUT = re.compile(f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+")
#: Bytes as the visible characters that byte-level models hold: printable ones stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPACE = chr(_VISIBLE[32])
#: What a file must encode alike both ways before its words are cached.
_PROBE = "It's a 2nd naïve Œuvre, isn't it? we'll x'yz 12a-b--c ...\nÜber\n\nŽ ß×÷ \"q\" (r) tab\tend a_b http://x.y/z?a=1&b=2 "


# -- minimal perfect hash --------------------------------------------------------------------------------------


def _key_hash(keys: np.ndarray, ordinals: np.ndarray, flags: np.ndarray) -> np.ndarray:
    k = keys.astype(np.int64).view(np.uint64)
    return mix(mix(k) + ordinals.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + flags.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _spot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(h + np.uint64((level + 1) * 0x632BE59BD9B4E019 & (2**64 - 1))) % np.uint64(size)


class PerfectHash:
    """Levels of bit arrays; the rank of the first set bit that a key meets is its slot."""

    def __init__(self, sizes: list[int], words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.bits = np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool) if len(words) else np.zeros(0, bool)
        self.ranks = np.concatenate([[0], np.cumsum(self.bits)])

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(h):
            if len(sizes) > 200:
                raise ValueError("keys repeat")
            size = max(64, -(-2 * len(h) // 64) * 64)
            spot = _spot(h, len(sizes), size)
            seen = np.bincount(spot.astype(np.int64), minlength=size)
            parts.append(seen == 1)
            h = h[seen[spot.astype(np.int64)] > 1]
            sizes.append(size)
        bits = np.concatenate(parts) if parts else np.zeros(0, bool)
        return cls(sizes, np.packbits(bits, bitorder="little").view(np.uint64))

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that no level holds."""
        out, base = np.full(len(h), -1, dtype=np.int64), 0
        left = np.arange(len(h))
        for level, size in enumerate(self.sizes):
            spot = base + _spot(h[left], level, size).astype(np.int64)
            hit = self.bits[spot]
            out[left[hit]] = self.ranks[spot[hit]]
            left, base = left[~hit], base + size
        return out


# -- the file ----------------------------------------------------------------------------------------------------


def pack(keys: np.ndarray, flags: np.ndarray, ids: list[np.ndarray], width: int) -> bytes:
    """One file: ``keys`` ascending (flags mark null keys), ``ids`` of each document with its end id."""
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (flags[1:] != flags[:-1])]) if len(keys) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, int)
    ordinals = (np.arange(len(keys)) - begin).astype(np.uint32)
    lengths = np.array([len(x) for x in ids], dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.uint64) if len(ids) else lengths
    h = _key_hash(keys, ordinals, flags)
    index = PerfectHash.build(h)
    slot = index.slots(h)
    prints, at, size = np.empty(len(h), np.uint32), np.empty(len(h), np.uint64), np.empty(len(h), np.uint64)
    prints[slot], at[slot], size[slot] = _fingerprint(h), offsets, lengths
    head = np.array([MAGIC, width, len(keys), int(lengths.sum()), len(index.sizes), len(index.words)], "<u8")
    parts = [head, np.array(index.sizes, "<u8"), index.words, prints, at, size, keys.astype("<i8"), ordinals, flags.astype(np.uint8)]
    return b"".join(x.tobytes() for x in parts) + b"".join(x.astype(f"<u{width}").tobytes() for x in ids)


class TokenFile:
    """Reads a file written by ``pack``."""

    def __init__(self, raw: bytes) -> None:
        magic, self.width, n, self.total, levels, words = (int(x) for x in np.frombuffer(raw, "<u8", 6))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = 48

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, count, at)
            at += out.nbytes
            return out

        sizes = [int(x) for x in take("<u8", levels)]
        self.index = PerfectHash(sizes, take("<u8", words))
        self.prints, self.at, self.size = take("<u4", n), take("<u8", n), take("<u8", n)
        self.keys, self.ordinals, self.flags = take("<i8", n), take("<u4", n), take("u1", n)
        self.ids = take(f"<u{self.width}", self.total)

    def find(self, keys: np.ndarray, ordinals: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and lengths in ids; length 0 where the key is not in the file."""
        h = _key_hash(keys, ordinals, flags)
        slot = self.index.slots(h)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == _fingerprint(h[known])
        safe = np.where(known, slot, 0)
        if not len(self.at):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        return np.where(known, self.at[safe], 0).astype(np.int64), np.where(known, self.size[safe], 0).astype(np.int64)

    def get(self, key: int, ordinal: int = 0) -> np.ndarray | None:
        """The ids of one document, or None."""
        start, n = self.find(np.array([key]), np.array([ordinal]), np.array([0]))
        return self.ids[start[0] : start[0] + n[0]] if n[0] else None


# -- encoding ------------------------------------------------------------------------------------------------------


class _Words(dict):
    """word -> ids as bytes, as it stands after a space; words that it lacks come from the older generation or are encoded."""

    def __init__(self, solve: Callable[[str], bytes], old: dict[str, bytes]) -> None:
        super().__init__()
        self.solve, self.old = solve, old

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word) or self.solve(" " + word)
        if len(word) <= CACHE_LENGTH:
            self[word] = found
        return found


class Encoder:
    """The tokenizer with a cache of words: byte-level pieces never cross a single space."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.kind = np.dtype(f"<u{self.width}")
        self.words = _Words(self.solve, {})
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        cut = own.get("pre_tokenizer") or {}
        self.added, self.wide = [t["content"] for t in own.get("added_tokens", [])], re.compile(_WIDE).search
        self.tokens = self.tokenizer.model.tokenize
        self.by_word = own.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        self.by_word = self.by_word and self.encode([_PROBE])[0][:-1].tolist() == self.tokenizer.encode(_PROBE, add_special_tokens=False).ids

    def unsure(self, text: str) -> bool:
        """Whether white space touches a space, or an added token may stand in the text."""
        if "  " in text or " \n" in text or "\n " in text or any(t in text for t in self.added):
            return True
        return _RARE(text) is not None and self.wide(text) is not None

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def solve(self, unit: str) -> bytes:
        """Ids of a word with the space before it: the library's model on each pre-token."""
        plain = unit.isascii() and unit.isprintable()
        if not plain and _UNSURE.search(unit):
            return self.whole(unit)
        ids = []
        for piece in _CUT.findall(unit):
            shown = piece.replace(" ", _SPACE) if plain else piece.encode().decode("latin-1").translate(_VISIBLE)
            ids += [t.id for t in self.tokens(shown)]
        return array(self.code, ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        if len(self.words) >= CACHE_WORDS:
            self.words = _Words(self.solve, dict(self.words))
        get, end, out = self.words.__getitem__, np.array([END_ID], self.kind).tobytes(), []
        for text in texts:
            if self.by_word and not self.unsure(text):
                first, *rest = text.split(" ")
                ids = self.whole(first) + b"".join(map(get, rest))
            else:
                ids = self.whole(text)
            out.append(np.frombuffer(ids + end, self.kind))
        return out


def _settle(fs: FileSystem, aside: str, target: str) -> None:
    """Give a written file its name; where a former attempt of the task has done so, the file is the same and stays."""
    try:
        if fs.get_file_info(target).type == FileType.NotFound:
            fs.move(aside, target)
            return
    except OSError:
        if fs.get_file_info(target).type == FileType.NotFound:
            raise
    fs.delete_file(aside)


def _writer(where: str, path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), worker_cache(("tokens", path), lambda: Encoder(path))
        keys, flags, ids = [], [], []
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                own = part.column("doc_id")
                flags.extend(own.is_null().to_pylist())
                keys.extend(own.fill_null(0).to_pylist())
                ids.extend(encoder.encode([x.as_py() or "" for x in part.column("text")]))
        if keys:
            raw = pack(np.array(keys, np.int64), 1 - np.array(flags, np.uint8), ids, encoder.width)
            fs, folder = FileSystem.from_uri(where)
            aside = f"{folder}/.{shard:06d}-{uuid.uuid4().hex}"
            with fs.open_output_stream(aside) as f:
                f.write(raw)
            _settle(fs, aside, f"{folder}/shard-{shard:06d}.ids")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64())], ["shard", "docs"])

    return run


def write(docs: DataFrame, where: str, path: str) -> int:
    """Write ``docs`` (doc_id, text) as token-id files in the folder ``where``; returns the number of files."""
    fs, folder = FileSystem.from_uri(where)
    fs.create_dir(folder, recursive=True)
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # rows of one doc_id, and copies of one text under it, may fall in several partitions
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, HEAD_CHARS).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(parts, "doc_id", "head", "hash", "row").sortWithinPartitions("doc_id", "head", "hash").select("doc_id", "text")
    return dealt.mapInArrow(_writer(where, path), "shard int, docs long").where("docs > 0").count()


def shard_number(path: str) -> int:
    """The number in a file's name, which has six digits or more."""
    return int(re.search(r"shard-([0-9]+)\.ids$", path)[1])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            f = TokenFile(content.as_buffer())
            start, n = f.find(f.keys, f.ordinals, f.flags)
            crc = [zlib.crc32(f.ids[a : a + k].astype("<u4").tobytes()) for a, k in zip(start, n, strict=True)]
            shard = shard_number(path.as_py())
            keys = pa.array(f.keys, mask=f.flags == 0)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(n), pa.int32()), keys, pa.array(start), pa.array(n), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, where: str) -> DataFrame:
    """shard, doc_id, at (offset in the shard), n_tokens, ids_crc32 of every document in the files, by index lookup."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.ids").load(where).select("path", "content")
    return files.mapInArrow(_read, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = scratch_path(spark, "token-files")
    if not write(table(spark, sf_dir, "documents"), where, default_path()):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = stash(read(spark, where), "token-rows")
    # one row for each file
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
