"""Speculative encoding against the library: given texts, odd characters, random words; the border test against merging."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from geoquarry.llm import word_bpe as W


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(W.default_path())


@pytest.fixture(scope="module")
def encoder():
    return W.Encoder(W.default_path())


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_odd_characters(encoder, library):
    decoder = W.Decoder(W.default_path())
    rng = random.Random(1)
    pool = "abcdeéÀßİıǅſσΣς'  \n\t\x1c\x85\xa0 12²٣़κ́é‍\U0001f600中文ñ.,!<|_\"`´’\x00\x7fͅŉ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) + rng.choice(["", "", "<|endoftext|>", "<|startoftext|>a", "'s", "<|endoftext|"]) for _ in range(4000)]
    texts += ["", None, "a" * 3000, "ha" * 2000, "<|endoftext|>" * 3, "x<|endoftext|>"]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids(raw) == want, repr(text)
        assert decoder.decode(np.frombuffer(raw, "<u4")) == library.decode(want, skip_special_tokens=False)


def test_random_words(encoder, library):
    rng = random.Random(2)
    tokens = [t.removesuffix("</w>") for t in sorted(library.get_vocab()) if t.removesuffix("</w>").isalpha() and t.isascii()]
    words = ["".join(rng.choice(tokens) for _ in range(rng.randrange(1, 4))) for _ in range(8000)]
    words += ["".join(rng.choice("aeinrstab") for _ in range(rng.randrange(1, 30))) for _ in range(4000)] + ["a" * k for k in range(1, 150)] + ["ha" * k for k in range(1, 150)]
    words = list(dict.fromkeys(w for w in words if w.isascii() and w.islower()))
    before = encoder.speculated, encoder.merged
    got = encoder.solve(words)
    assert all(ids(got[w]) == library.encode(w, add_special_tokens=False).ids for w in words)
    # both ways were taken
    assert encoder.speculated > before[0] and encoder.merged > before[1]
    alone = encoder.merges
    assert [alone._alone(alone.spell(w)) for w in words[:2000]] == alone.exact([alone.spell(w) for w in words[:2000]])


def test_border_test_is_merging_of_two_tokens():
    """On random small vocabularies, equal ranks and runs of one token included."""
    rng = random.Random(3)
    for _ in range(60):
        vocab = {c: k for k, c in enumerate("abc")}
        merges = []
        for _ in range(rng.randrange(1, 14)):
            x, y = rng.choice(list(vocab)), rng.choice(list(vocab))
            if x + y not in vocab:
                vocab[x + y] = len(vocab)
                merges.append([x, y])
        m = W.Merges(vocab, merges, "")
        assert m.regular
        names = {i: t for t, i in vocab.items()}
        exact = lambda w, m=m: ids(m._alone(w))
        assert all(bool(m.closed[i]) == (exact(t) == [i]) for t, i in vocab.items())
        closed = [i for i in names if m.closed[i]]
        pairs = [(a, b) for a in closed for b in closed]
        apart = m.apart(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        assert [bool(x) for x in apart] == [exact(names[a] + names[b]) == [a, b] for a, b in pairs]
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(50)]
        assert m.exact(words) == [m._alone(w) for w in words]


def test_an_irregular_file_is_merged_exactly():
    m = W.Merges({"a": 0, "b": 1, "aba": 2, "ab": 3}, [["ab", "a"], ["a", "b"]], "")
    assert not m.regular and [ids(x) for x in m.exact(["aba", "abab"])] == [[2], [2, 1]]


def test_caches_change_nothing(library):
    small = W.Encoder(W.default_path(), cache_words=5)
    texts = [f"word{i % 7} thing{'x' * (i % 60)} it's" for i in range(300)]
    assert [ids(x) for k in range(0, 300, 20) for x in small.encode(texts[k : k + 20])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows(spark, library):
    rows = [(1, None, 1), (2, "", 1), (3, "a" * 20_000, 1), (4, "Some  Thing\n", 1), (4, "Some  Thing\n", 1), (None, "null id", 1), (5, "x<|endoftext|> \x1c é", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    path = W.default_path()
    out = W.decode(W.encode(docs, path), path).collect()
    want = []
    for i, t, _ in rows:
        own = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, own, library.decode(own, skip_special_tokens=False)))
    assert sorted(((r.doc_id, ids(r.ids), r.text) for r in out), key=str) == sorted(want, key=str)
    assert W.decode(W.encode(docs.limit(0), path), path).count() == 0


def test_given_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in W.op13_speculative_bpe(spark, sf).collect()}
    for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        own = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest() and got[i].n_tokens == len(own)
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
