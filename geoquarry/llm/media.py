"""Media columns: AVI motion-JPEG files, their frames, and the shots in them.

``store`` writes a payload as the luma of an AVI file: 192 bytes make one frame of 16 x 12 blocks, each byte the
value of one 8 x 8 block. The frames are baseline JPEG with a DC quantiser of 8, so a block that is flat at v has
the quantised coefficient v - 128 and decodes to v exactly: the storage is lossless. ``decode`` parses the RIFF
chunks and the idx1 index, entropy-decodes the intra frames and inverts the transform. Shots end where the
difference of neighbouring frames' histograms exceeds what the differences before it lead to expect; ``clips``
gives them as timed rows.

Files of others are read as well: any frame size, grey or colour (the luma counts), restart intervals, "rec " lists,
index offsets from either base, or no index. Progressive and damaged frames are not decoded.

Null texts count as empty; an empty payload is one frame of blanks. Equal texts give equal files. Rows may repeat,
ids may be null, extra columns are ignored. Media that cannot be parsed gives no clips and null digests.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoquarry.llm.common import table

COLUMNS, ROWS, FRAME_MS = 16, 12, 40
FRAME = COLUMNS * ROWS
WIDTH, HEIGHT = COLUMNS * 8, ROWS * 8
#: Payload bytes that are coded in one numpy step.
STEP_BYTES = 256 << 10
#: Histogram bins; differences that the adaptive threshold looks back on, its factor and its floor.
BINS, LOOK_BACK, FACTOR, FLOOR = 16, 8, 3.0, 0.1

# Huffman tables as (code lengths' counts, symbols): the baseline luma DC table, and an AC table of end-of-block only.
DC_TABLE = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
AC_TABLE = (bytes([1, *[0] * 15]), bytes([0]))


def _codes(table: tuple[bytes, bytes]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out.append((table[1][k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_HEAD = b"".join(
    [
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHB3B", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + DC_TABLE[0] + DC_TABLE[1]),
        _segment(0xC4, b"\x10" + AC_TABLE[0] + AC_TABLE[1]),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ]
)


def _dc_words() -> tuple[np.ndarray, np.ndarray]:
    """Left-aligned 32-bit code words and lengths, end-of-block included, of the differences -255..255."""
    diff = np.arange(-255, 256)
    size = np.where(diff == 0, 0, np.floor(np.log2(np.maximum(np.abs(diff), 1))).astype(int) + 1)
    code = {s: (c, n) for s, c, n in _codes(DC_TABLE)}
    base, bits = np.array([code[s][0] for s in size]), np.array([code[s][1] for s in size])
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    (_, eob, eob_bits), *_ = _codes(AC_TABLE)
    length = bits + size + eob_bits
    return ((((base << size) | extra) << eob_bits | eob).astype(np.uint64) << (32 - length).astype(np.uint64)).astype(np.uint32), length


_WORDS, _LENGTHS = _dc_words()
_WIDEST = int(_LENGTHS.max())


def encode_frames(blocks: np.ndarray) -> list[bytes]:
    """JPEG files of frames of flat blocks; ``blocks`` is (frames, FRAME) uint8."""
    level = blocks.astype(np.int32) - 128
    k = np.diff(level, axis=1, prepend=0) + 255
    words, lengths = _WORDS[k], _LENGTHS[k]
    pad = (-lengths.sum(axis=1)) % 8  # ones up to the next byte
    words = np.column_stack([words, np.full(len(k), 0xFF000000, np.uint32)])
    lengths = np.column_stack([lengths, pad])
    place = np.arange(_WIDEST)
    bits = ((words[:, :, None] >> (31 - place).astype(np.uint32)) & 1).astype(np.uint8)
    raw = np.packbits(bits[place < lengths[:, :, None]]).tobytes()
    ends = np.cumsum(lengths.sum(axis=1) // 8).tolist()
    return [_HEAD + raw[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip([0, *ends], ends, strict=False)]


def avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, frame_ms: int = FRAME_MS) -> bytes:
    """An AVI file of motion-JPEG frames with an idx1 index."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", frame_ms * 1000, 0, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, frame_ms * 1000, 1_000_000, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    sizes = np.array([len(f) for f in frames], dtype=np.uint32)
    offsets = 4 + np.concatenate([[0], np.cumsum(8 + sizes + (sizes & 1))[:-1]]) if frames else sizes
    index = np.column_stack([np.full(len(sizes), int.from_bytes(b"00dc", "little")), np.full(len(sizes), 0x10), offsets, sizes]).astype("<u4")
    body = b"AVI " + head + chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", f) for f in frames)) + chunk(b"idx1", index.tobytes())
    return chunk(b"RIFF", body)


_VIDEO = re.compile(rb"[0-9][0-9]d[bc]", re.S)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin of the body, size) of the chunks in a list."""
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def _walk(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Video chunks of a movi list in order, those in its "rec " lists included, however deep."""
    lists = [(_chunks(data, at, end), end)]
    while lists:
        chunks, end = lists[-1]
        for name, begin, size in chunks:
            if name == b"LIST" and data[begin : begin + 4] == b"rec ":
                inner = min(begin + size, end)
                lists.append((_chunks(data, begin + 4, inner), inner))
                break
            if _VIDEO.fullmatch(name):
                yield name, begin, size
        else:
            lists.pop()


def parse_avi(data: bytes) -> tuple[list[bytes], int]:
    """The first video stream's frames, as the index names them, and milliseconds for each.

    Index offsets count from the movi list or from the file; without an index the list itself is walked.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, frame_ms = None, b"", FRAME_MS
    for name, begin, size in _chunks(data, 12, len(data)):
        kind = data[begin : begin + 4]
        if name == b"LIST" and kind == b"hdrl":
            frame_ms = int.from_bytes(data[begin + 12 : begin + 16], "little") // 1000
        elif name == b"LIST" and kind == b"movi":
            movi, last = begin, min(begin + size, len(data))
        elif name == b"idx1":
            index = data[begin : begin + size]
    if movi is None:
        raise ValueError("no movi list")
    rows = np.frombuffer(index[: len(index) // 16 * 16], "<u4").reshape(-1, 4)
    own = [(n.to_bytes(4, "little"), o, k) for n, _, o, k in rows.tolist()]
    own = [x for x in own if _VIDEO.fullmatch(x[0])]
    if own:
        name, offset, _ = own[0]
        base = movi if data[movi + offset : movi + offset + 4] == name else 0
        found = [(n, base + o + 8, k) for n, o, k in own]
    else:
        found = list(_walk(data, movi + 4, last))
    if any(data[at - 8 : at - 4] != n or at + k > len(data) for n, at, k in found):
        raise ValueError("the index does not fit the file")
    return [data[at : at + k] for n, at, k in found if n == found[0][0]], frame_ms


# -- decoding ------------------------------------------------------------------------------------------------------


class _Tables:
    """What the header of a baseline JPEG says: size, components, quantiser, Huffman lookups by 16 bits, restart interval."""

    def __init__(self, head: bytes) -> None:
        at, quant, tables, parts, self.restart = 2, {}, {}, [], 0
        while at + 4 <= len(head):
            marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
            body = head[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("8-bit quantisers are expected")
                    quant[body[0] & 15] = np.frombuffer(body[1:65], np.uint8).astype(np.int32)
                    body = body[65:]
            elif marker in (0xC0, 0xC1):
                _, self.height, self.width, count = struct.unpack(">BHHB", body[:6])
                parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("a baseline frame is expected")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                coded = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            at += 2 + size
        if not parts or len(coded) != len(parts) or not self.width or not self.height:
            raise ValueError("one scan of all components is expected")
        lookups = {k: self._lookup(t) for k, t in tables.items()}
        #: of each component: samples across and down in a unit, DC lookup, AC lookup
        self.parts = [(h, v, lookups[coded[i] >> 4], lookups[0x10 | coded[i] & 15]) for i, h, v, _ in parts]
        if len(parts) == 1:
            self.parts = [(1, 1, *self.parts[0][2:])]
        self.dc, self.ac, self.q = self.parts[0][2], self.parts[0][3], quant[parts[0][3]]
        if (self.parts[0][0], self.parts[0][1]) != (max(x[0] for x in self.parts), max(x[1] for x in self.parts)) or not all(h and v for h, v, _, _ in self.parts):
            raise ValueError("the first component is expected in full")
        self.blocks = -(-self.width // 8) * -(-self.height // 8)

    @staticmethod
    def _lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and code length by the next 16 bits; length 0 where no code begins so."""
        symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        for s, code, n in _codes(table):
            low = code << (16 - n)
            symbol[low : low + (1 << (16 - n))], length[low : low + (1 << (16 - n))] = s, n
        return symbol, length


_tables: dict[bytes, _Tables] = {}
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def _split(frame: bytes) -> tuple[_Tables, list[bytes]]:
    """The tables of a JPEG file and the runs of its scan between restart markers, without stuffing."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    head = frame[:at]
    if head not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[head] = _Tables(head)
    scan = frame[at : frame.rindex(b"\xff\xd9")]
    runs = _RESTART.split(scan) if _tables[head].restart else [scan]
    return _tables[head], [r.replace(b"\xff\x00", b"\xff") for r in runs]


def _values(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed values from their 16 following bits and sizes."""
    raw = (bits >> (16 - size)).astype(np.int32)
    return np.where(size == 0, 0, np.where(raw >> np.maximum(size - 1, 0) == 0, raw - (1 << size) + 1, raw))


def _flat(tables: _Tables, scans: list[bytes]) -> np.ndarray | None:
    """Block values (frames, blocks) if every block of every frame is flat, else None; all frames in step."""
    sizes = np.array([len(s) for s in scans])
    raw = np.frombuffer(b"".join(scans) + b"\xff\xff\xff", np.uint8).astype(np.uint32)
    wide = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    window = ((wide[:, None] >> np.arange(8, 0, -1).astype(np.uint32)) & 0xFFFF).ravel()
    (dc, dc_bits), (ac, ac_bits) = tables.dc, tables.ac
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) * 8
    last = len(window) - 1
    pred, out = np.zeros(len(scans), np.int32), np.empty((len(scans), tables.blocks), np.int32)
    for k in range(tables.blocks):
        w = window[at]
        size, used = dc[w].astype(np.int64), dc_bits[w].astype(np.int64)
        value = window[np.minimum(at + used, last)]
        at = np.minimum(at + used + size, last)
        end = window[at]
        if ac[end].any() or not (ac_bits[end].all() and used.all()):
            return None
        pred = pred + _values(value, size)
        out[:, k] = pred
        at = np.minimum(at + ac_bits[end], last)
    level = out * int(tables.q[0])
    return np.clip(np.floor(level / 8 + 0.5) + 128, 0, 255).astype(np.uint8)


_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_COS = np.array([[(np.sqrt(0.5) if u == 0 else 1) * np.cos((2 * x + 1) * u * np.pi / 16) / 2 for u in range(8)] for x in range(8)])


def decode_frame(frame: bytes) -> np.ndarray:
    """Samples (height, width) of any baseline JPEG; of a colour frame, its first component (the luma)."""
    t, runs = _split(frame)
    wide, high = t.parts[0][0], t.parts[0][1]
    across, down = -(-t.width // (8 * wide)), -(-t.height // (8 * high))
    # a block takes two bits at least
    if across * down * wide * high > 4 * sum(map(len, runs)):
        raise ValueError("the frame is larger than its scan")
    image, unit = np.empty((down * high * 8, across * wide * 8)), 0
    for run in runs:
        scan, at, pred = run + b"\xff" * 8, 0, [0] * len(t.parts)

        def look(n: int) -> int:
            i = at >> 3
            if i > len(run) + 2:
                raise ValueError("the scan ends early")
            return int.from_bytes(scan[i : i + 5], "big") >> 40 - (at & 7) - n & (1 << n) - 1

        def signed(n: int) -> int:
            v = look(n) if n else 0
            return v if not n or v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(t.restart or across * down, across * down - unit)):
            for p, (h, v, dc, ac) in enumerate(t.parts):
                for y, x in product(range(v), range(h)):
                    own = np.zeros(64)
                    w = look(16)
                    size, k = int(dc[0][w]), 1
                    if not dc[1][w] or size > 15:
                        raise ValueError("no such code")
                    at += int(dc[1][w])
                    pred[p] += signed(size)
                    at += size
                    own[0] = pred[p]
                    while k < 64:
                        w = look(16)
                        symbol = int(ac[0][w])
                        if not ac[1][w]:
                            raise ValueError("no such code")
                        at += int(ac[1][w])
                        skip, size = symbol >> 4, symbol & 15
                        if not size and skip != 15:
                            break
                        k += skip
                        if size:
                            own[k] = signed(size)
                            at += size
                        k += 1
                    if p:
                        continue
                    grid = np.zeros(64)
                    grid[_ZIGZAG] = own * t.q
                    top, left = ((unit // across) * high + y) * 8, ((unit % across) * wide + x) * 8
                    image[top : top + 8, left : left + 8] = _COS @ grid.reshape(8, 8) @ _COS.T
            unit += 1
    if unit != across * down:
        raise ValueError("the scan ends early")
    return np.clip(np.floor(image + 0.5) + 128, 0, 255).astype(np.uint8)[: t.height, : t.width]


def decode_blocks(frames: list[bytes]) -> np.ndarray:
    """(frames, blocks) values, one for each 8 x 8 block; frames are of one size, and those of one header are decoded in step."""
    split = [_split(f) for f in frames]
    sizes = {(t.width, t.height) for t, _ in split}
    if len(sizes) > 1:
        raise ValueError("frames of one size are expected")
    out = np.empty((len(frames), split[0][0].blocks if split else FRAME), np.uint8)
    for t in {id(t): t for t, _ in split}.values():
        own = [k for k, (x, _) in enumerate(split) if x is t]
        flat = _flat(t, [split[k][1][0] for k in own]) if len(t.parts) == 1 and not t.restart else None
        out[own] = flat if flat is not None else [decode_frame(frames[k])[::8, ::8].ravel() for k in own]
    return out


# -- shots ---------------------------------------------------------------------------------------------------------


def shots(blocks: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frame after the last) of each shot."""
    n = len(blocks)
    if n < 2:
        return [(0, n)]
    level = (blocks >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(level.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * blocks.shape[1])
    # the median of the LOOK_BACK differences before each, so that an earlier cut does not hide the next one
    before = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.repeat(diff[:1], LOOK_BACK), diff[:-1]]), LOOK_BACK)
    cut = np.flatnonzero(diff > FACTOR * np.median(before, axis=1) + FLOOR) + 1
    edges = [0, *cut.tolist(), n]
    return list(zip(edges, edges[1:], strict=False))


def feature(blocks: np.ndarray, frame_ms: int) -> str:
    return f"frames={len(blocks)};shots=" + ",".join(f"{a * frame_ms}-{b * frame_ms}" for a, b in shots(blocks))


#: What broken files raise somewhere in parsing or decoding.
_DAMAGED = (ValueError, KeyError, IndexError, struct.error, OverflowError, UnboundLocalError, MemoryError, RecursionError)


# -- columns -------------------------------------------------------------------------------------------------------


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME), len(raw)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about STEP_BYTES."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > STEP_BYTES:
            yield start, k
            start, total = k, 0
        total += n
    if sizes:
        yield start, len(sizes)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")]
        for a, b in _groups(sizes):
            part = batch.slice(a, b - a)
            own = [payload(x.as_py()) for x in part.column("text")]
            frames = encode_frames(np.frombuffer(b"".join(p for p, _ in own), np.uint8).reshape(-1, FRAME))
            files, at = [], 0
            for p, _ in own:
                k = len(p) // FRAME
                files.append(avi(frames[at : at + k]))
                at += k
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for _, n in own], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (the AVI file that holds it) for every row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[np.ndarray | None], list[int]]]:
    """(first row, media, blocks, milliseconds a frame) for runs of rows."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("media")]
    for a, b in _groups(sizes):
        media, parsed = [x.as_py() for x in batch.column("media").slice(a, b - a)], []
        for m in media:
            try:
                parsed.append(parse_avi(m or b""))
            except _DAMAGED:
                parsed.append(None)
        out, at = [], 0
        try:
            blocks = decode_blocks([f for p in parsed if p for f in p[0]])
            for p in parsed:
                out.append(blocks[at : at + len(p[0])] if p else None)
                at += len(p[0]) if p else 0
        except _DAMAGED:  # some file is damaged or of another size: each by itself
            out = []
            for p in parsed:
                try:
                    out.append(decode_blocks(p[0]) if p else None)
                except _DAMAGED:
                    out.append(None)
        yield a, media, out, [p[1] if p else 0 for p in parsed]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, media, blocks, ms in _decoded(batch):
            raw = [b.tobytes() if b is not None else None for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(a, len(media)) for c in ("doc_id", "n_bytes")),
                    pa.array([len(r) if r is not None else None for r in raw], pa.int64()),
                    pa.array([hashlib.sha256(r).hexdigest() if r is not None else None for r in raw]),
                    pa.array([zlib.crc32(r[-16:]) if r is not None else None for r in raw], pa.int64()),
                    pa.array([len(m or b"") for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m or b"").hexdigest() for m in media]),
                    pa.array([feature(b, t) if b is not None else None for b, t in zip(blocks, ms, strict=True)]),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )


def digests(stored: DataFrame) -> DataFrame:
    """What reading ``media`` back gives: payload and media digests, and the shots as text."""
    return stored.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, media, blocks, ms in _decoded(batch):
            ids = batch.column("doc_id").slice(a, len(media)).to_pylist()
            rows = [(i, k, x * t, y * t) for i, b, t in zip(ids, blocks, ms, strict=True) if b is not None for k, (x, y) in enumerate(shots(b))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "clip", "start_ms", "end_ms"])


def clips(stored: DataFrame) -> DataFrame:
    """doc_id, clip, start_ms, end_ms: one row for each shot of each file."""
    return stored.select("doc_id", "media").mapInArrow(_clips, "doc_id long, clip long, start_ms long, end_ms long")


def op6_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(table(spark, sf_dir, "documents")))
