"""N-best segmentation against all segmentations of short texts; exact round trips."""

import random
import zlib

import numpy as np
import pytest

from geoquarry.llm import pieces


@pytest.fixture(scope="module")
def segmenter():
    return pieces.Segmenter(pieces.Vocabulary(pieces.default_path()))


def every(v, text):
    """Scores of all segmentations."""
    ends = [[] for _ in range(len(text) + 1)]
    ends[0] = [0.0]
    for end in range(1, len(text) + 1):
        if text[end - 1] == "▁":
            ends[end] = [s + v.byte_score * 3 for s in ends[end - 1]]
            continue
        for start, score, _ in v.edges(text, end):
            if "▁" not in text[start:end]:
                ends[end] += [s + score for s in ends[start]]
    return sorted(ends[-1], reverse=True)


def test_n_best_equals_brute_force(segmenter):
    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice("the in\nonéß\U0001f600▁a") for _ in range(rng.randrange(1, 9)))
        want = every(segmenter.v, " " + text)[:5]
        got = segmenter.encode(text, 5)
        assert [s for s, _ in got] == pytest.approx(want)
        assert segmenter.scores(text, 5)[1] == pytest.approx(want)
        # checksums are of the segmentations themselves, best first
        assert segmenter.scores(text, 5)[2] == [zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in got]
        assert all(segmenter.decode(ids) == text for _, ids in got)
        assert len({tuple(ids) for _, ids in got}) == len(got)


def test_cache_generations_change_nothing(segmenter):
    text = " ".join(f"word{i} thing" for i in range(300))
    want = segmenter.encode(text, 3)
    assert pieces.Segmenter(segmenter.v, 7).encode(text, 3) == want


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 20_000, "x"), (4, " lead  and trail \n", "x"), (4, " lead  and trail \n", "x"), (None, "null id", "x"), (5, "▁ \t\r\n é", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.encode(docs, pieces.default_path()).cache()
    got = {r.doc_id: r for r in out.collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == 6
    assert got[1].n_pieces == got[2].n_pieces == 0 and got[1].scores == [0.0]
    texts = {r.doc_id: r.text for r in pieces.decode(out, pieces.default_path()).collect()}
    assert texts == {i: t or "" for i, t, _ in rows}
    assert pieces.encode(docs.limit(0), pieces.default_path()).count() == 0


def test_given_documents(spark):
    out = pieces.op5_sentencepiece_n_best(spark, "/root/testdata/sf0.001")
    assert out.where("not round_trip").count() == 0 and out.count() == 200
