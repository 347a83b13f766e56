"""AVI motion-JPEG: exact round trips, general decoding, shots."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from geoquarry.llm import media


def test_frames_round_trip_in_both_decoders():
    rng = np.random.default_rng(1)
    blocks = np.concatenate([rng.integers(0, 256, (3, media.FRAME)), np.tile([0, 255], (2, media.FRAME // 2)), np.full((1, media.FRAME), 127)]).astype(np.uint8)
    frames = media.encode_frames(blocks)
    assert (media.decode_blocks(frames) == blocks).all()
    for f, b in zip(frames, blocks):
        image = media.decode_frame(f)
        assert image.shape == (media.HEIGHT, media.WIDTH)
        assert (image == b.reshape(media.ROWS, media.COLUMNS).repeat(8, 0).repeat(8, 1)).all()


def test_general_decoder_with_ac_coefficients():
    """A frame coded here by hand with one AC coefficient, against the transform written out."""
    ac = (bytes([0, 2, *[0] * 14]), bytes([0x00, 0x02]))  # end of block, and run 0 size 2
    head = media._HEAD.replace(media._segment(0xC4, b"\x10" + media.AC_TABLE[0] + media.AC_TABLE[1]), media._segment(0xC4, b"\x10" + ac[0] + ac[1]))
    head = head.replace(struct.pack(">HH", media.HEIGHT, media.WIDTH), struct.pack(">HH", 8, 8))
    bits = "011" + "10" + "01" + "11" + "00"  # DC size 2 value 2, AC size 2 value 3, end
    raw = int(bits.ljust(16, "1"), 2).to_bytes(2, "big")
    image = media.decode_frame(head + raw + b"\xff\xd9")
    x = np.arange(8)
    want = 2 * 8 / 8 + 3 * 8 * np.sqrt(0.5) * np.cos((2 * x + 1) * np.pi / 16) / 4
    assert (image == np.floor(want + 0.5).astype(int) + 128).all()


def test_index_and_damage():
    frames = media.encode_frames(np.arange(2 * media.FRAME, dtype=np.uint8).reshape(2, -1))
    data = media.avi(frames)
    assert media.parse_avi(data) == (frames, media.FRAME_MS)
    assert struct.unpack("<I", data[4:8])[0] == len(data) - 8


def test_shots():
    dark, light = np.full((6, media.FRAME), 10, np.uint8), np.full((5, media.FRAME), 200, np.uint8)
    assert media.shots(np.concatenate([dark, light, dark])) == [(0, 6), (6, 11), (11, 17)]
    assert media.shots(dark) == [(0, 6)] and media.shots(dark[:1]) == [(0, 1)]


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é" * 20_000, "x"), (4, "a" * 192, "x"), (4, "a" * 192, "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    stored = media.store(docs)
    got = media.digests(stored).collect()
    for (i, t, _), r in zip(rows, got):
        raw = (t or "").encode()
        full = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(full))
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-16:])
        assert r.feature.startswith(f"frames={len(full) // 192};")
    assert got[0][1:] == got[1][1:] and got[3] == got[4]
    clips = media.clips(stored.where("doc_id = 3")).orderBy("clip").collect()
    assert clips[0].start_ms == 0 and clips[-1].end_ms == 209 * media.FRAME_MS
    assert media.digests(media.store(docs.limit(0))).count() == 0
    bad = spark.createDataFrame([(1, 0, bytearray(b"RIFFxxxx")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r.payload_sha256 for r in media.digests(bad).collect()] == [None, None]
    assert media.clips(bad).count() == 0


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in media.op6_avi_motion_jpeg(spark, sf).collect():
        full, n = media.payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_sha256) == (n, hashlib.sha256(full).hexdigest())


def _colour_frame(luma, restart=0):
    """A 4:2:0 colour JPEG of flat blocks: ``luma`` is (rows, columns) of block values, both even; chroma is 128 + its place."""
    codes = {n: (c, k) for n, c, k in media._codes(media.DC_TABLE)}
    (_, eob, eob_bits), *_ = media._codes(media.AC_TABLE)
    rows, columns = luma.shape
    runs, bits, pred, done = [], "", [0, 0, 0], 0

    def put(part, value):
        nonlocal bits
        d, pred[part] = value - pred[part], value
        size = abs(d).bit_length()
        c, k = codes[size]
        bits += f"{c:0{k}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + f"{eob:0{eob_bits}b}"

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        runs.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
        bits, pred[:] = "", [0, 0, 0]

    for y in range(0, rows, 2):
        for x in range(0, columns, 2):
            for v in (luma[y, x], luma[y, x + 1], luma[y + 1, x], luma[y + 1, x + 1]):
                put(0, int(v) - 128)
            put(1, x)
            put(2, -y)
            done += 1
            if restart and done % restart == 0 and done * 4 < rows * columns:
                flush()
    flush()
    head = [b"\xff\xd8", media._segment(0xDB, b"\x00" + bytes([8] * 64)), media._segment(0xC0, struct.pack(">BHHB9B", 8, rows * 8, columns * 8, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))]
    head += [media._segment(0xC4, b"\x00" + media.DC_TABLE[0] + media.DC_TABLE[1]), media._segment(0xC4, b"\x10" + media.AC_TABLE[0] + media.AC_TABLE[1])]
    head += [media._segment(0xDD, struct.pack(">H", restart))] if restart else []
    scan = b"".join(r + (b"\xff" + bytes([0xD0 + k % 8]) if k + 1 < len(runs) else b"") for k, r in enumerate(runs))
    return b"".join(head) + media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_colour_and_restarts():
    luma = np.random.default_rng(2).integers(0, 256, (4, 6))
    for restart in (0, 1, 2, 4):
        assert (media.decode_frame(_colour_frame(luma, restart))[::8, ::8] == luma).all()


def test_other_layouts_of_files():
    frames = media.encode_frames(np.random.default_rng(3).integers(0, 256, (3, media.FRAME)).astype(np.uint8))
    data = media.avi(frames)
    movi = data.index(b"movi")
    index = data.index(b"idx1")
    assert media.parse_avi(data)[0] == frames
    assert media.parse_avi(data[:index])[0] == frames  # no index
    rows = np.frombuffer(data[index + 8 :], "<u4").reshape(-1, 4).copy()
    rows[:, 2] += movi
    assert media.parse_avi(data[: index + 8] + rows.tobytes())[0] == frames  # offsets from the file
    chunks = [b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in frames]
    rec = [b"LIST" + struct.pack("<I", len(c) + 4) + b"rec " + c for c in chunks]
    body = b"movi" + b"".join(rec)
    assert media.parse_avi(data[: movi - 8] + b"LIST" + struct.pack("<I", len(body)) + body)[0] == frames


def test_damaged_media_give_nulls(spark):
    frames = media.encode_frames(np.zeros((2, media.FRAME), np.uint8) + 7)
    good = media.avi(frames)
    progressive = frames[0].replace(b"\xff\xc0", b"\xff\xc2")
    short = frames[0].replace(b"\xff\xc0\x00\x0b", b"\xff\xc0\x00\x05")
    rng = random.Random(1)
    broken = [bytes(b if rng.random() > 0.02 else rng.randrange(256) for b in good) for _ in range(60)]
    files = [None, b"", good, media.avi([progressive]), media.avi([short]), media.avi([frames[0][:40]]), media.avi([b""]), good[:300], good[:-200], media.avi([_colour_frame(np.full((4, 6), 9))] * 3), *broken]
    rows = media.digests(spark.createDataFrame([(i, 1, m) for i, m in enumerate(files)], "doc_id long, n_bytes long, media binary")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(files) and got[2].payload_bytes == 2 * media.FRAME and got[9].feature == "frames=3;shots=0-120"
    assert all(got[i].payload_sha256 is None and got[i].feature is None for i in (0, 1, 3, 4, 5, 6, 7))
    assert media.clips(spark.createDataFrame([(2, good), (3, None), (4, files[3])], "doc_id long, media binary")).count() == 1


def test_files_that_ask_for_too_much():
    """Lists in lists, and frames that no scan could fill, are damage like any other."""
    frames = media.encode_frames(np.zeros((2, media.FRAME), np.uint8) + 7)
    data = media.avi(frames)
    movi = data.index(b"movi")
    body = b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in frames)
    for _ in range(3000):
        body = b"LIST" + struct.pack("<I", len(body) + 4) + b"rec " + body
    nested = data[: movi - 8] + b"LIST" + struct.pack("<I", len(body) + 4) + b"movi" + body
    assert media.parse_avi(nested)[0] == frames
    at = frames[0].index(b"\xff\xc0")
    huge = frames[0][: at + 5] + struct.pack(">HH", 60_000, 60_000) + frames[0][at + 9 :]
    with pytest.raises(ValueError):
        media.decode_frame(huge)
