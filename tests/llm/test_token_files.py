"""Token-id files: exact ids, index lookups, and order."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from geoquarry.llm import token_files as tf


def plain(texts):
    t = Tokenizer.from_file(tf.default_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_cached_words_give_the_same_ids():
    texts = ["", "it's we'll 'tis  two  spaces\n\n x\t", "é ü ß×÷ 12 3a4 ... <|endoftext|> a", " nb   \x1c\x85 \U0001f600 ١", "a" * 5000, " lead", "trail ", "'s't're '", "x\r\ny \r\n"]
    enc = tf.Encoder(tf.default_path())
    assert [x.tolist() for x in enc.encode(texts)] == plain(texts)
    assert [x.tolist() for x in enc.encode(texts)] == plain(texts)


def test_perfect_hash_is_minimal_and_rejects_foreign_keys():
    keys = np.arange(0, 30_000, 3, dtype=np.int64)
    ids = [np.array([k % 50_000, 0], np.uint16) for k in keys]
    f = tf.TokenFile(tf.pack(keys, np.ones(len(keys), np.uint8), ids, 2))
    h = tf._key_hash(keys, np.zeros(len(keys)), np.ones(len(keys), np.uint8))
    assert sorted(f.index.slots(h)) == list(range(len(keys)))
    start, n = f.find(f.keys, f.ordinals, f.flags)
    assert (n == 2).all() and (start == np.arange(len(keys)) * 2).all()
    _, other = f.find(keys + 1, np.zeros(len(keys)), np.ones(len(keys), np.uint8))
    assert (other > 0).sum() == 0


def test_rows(spark, tmp_path):
    rows = [(7, "seven", "x"), (3, None, "x"), (None, "none", "x"), (5, "five " * 3000, "x"), (5, "again", "x"), (5, "again", "x"), (-2, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tf.write(docs, f"file://{tmp_path}/t", tf.default_path())
    got = sorted(((r.shard, r.at, r.doc_id, r.n_tokens, r.ids_crc32) for r in tf.read(spark, f"file://{tmp_path}/t").collect()), key=lambda r: r[:2])
    want = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ids = plain([t for _, t in want])
    assert [(r[2], r[3], r[4]) for r in got] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(want, ids)]


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(map(tuple, tf.op10_token_id_files(spark, sf).collect()))
    start, want = 0, []
    for (i, _), x in zip(docs, plain([t for _, t in docs])):
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert got == want


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tf.op10_token_id_files(spark, str(tmp_path)).count() == 0


def test_wide_white_space_and_added_tokens_go_whole():
    enc = tf.Encoder(tf.default_path())
    assert enc.by_word
    for text in ("a  b", "a \nb", "a\n b", "a\xa0 b", "a \x1fb", "x <|endoftext|> y"):
        assert enc.unsure(text)
    assert not any(map(enc.unsure, ("a b", "a\nb", " a b ", "é ü\t1")))
    texts = [a + s + b for a in ("x", "1", ".", "", "é") for s in (" ", "  ", " \n", "\n ", "\t", "\xa0 ", " \x1f") for b in ("y.", "'s", "٣ z", "\U0001f600 k", "")]
    assert [x.tolist() for x in enc.encode(texts)] == plain(texts)


def test_a_file_of_another_build_is_encoded_whole(tmp_path):
    import json

    with open(tf.default_path(), encoding="utf-8") as f:
        own = json.load(f)
    own["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, own["pre_tokenizer"]]}
    (tmp_path / "t.json").write_text(json.dumps(own))
    enc, t = tf.Encoder(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not enc.by_word
    assert enc.encode(["a 123 b"])[0].tolist() == [*t.encode("a 123 b").ids, 0]


def test_one_id_is_spread_over_files(spark, tmp_path):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "concat('text ', id % 1500) as text")
    tf.write(docs, f"file://{tmp_path}/t", tf.default_path())
    rows = tf.read(spark, f"file://{tmp_path}/t").groupBy("shard").count().collect()
    assert sum(r["count"] for r in rows) == 3000 and len(rows) > 1 and max(r["count"] for r in rows) < 2000


def test_shard_numbers_of_any_width():
    assert [tf.shard_number(f"s3://a/shard-1/shard-{n:06d}.ids") for n in (0, 999_999, 1_000_000, 12_345_678)] == [0, 999_999, 1_000_000, 12_345_678]
