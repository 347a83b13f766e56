"""Fill-in-middle against a plain brute force; exact round trips; odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from geoquarry.llm import fill_in_middle as M


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def some_texts(n):
    rng = random.Random(6)
    odd = ["", None, "\n", "\n\n", "a", "a\n", "<P>", "x<S>\n", "<", "<M", "<P\n>", "é\nß\U0001f600\n中", "x" * 70_000 + "\n" + "y" * 70_000]
    return odd + ["".join(rng.choice(["a", "\n", "é", "<", "P>", "中 ", "<M>", " "]) for _ in range(rng.randrange(12))) for _ in range(n)]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (100, 100)])
def test_equals_brute_force(spark, rate, spm):
    rows = [(i, t, "x", "psm") for i, t in enumerate(some_texts(700))] + [(None, "null id\nb", "x", "x"), (3, "again\n", "x", "x"), (3, "again\n", "x", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, FORM string")
    done = M.restore(M.transform(docs, rate=rate, spm_rate=spm)).collect()
    want = sorted(((i, *brute(i, t, rate, spm), t or "") for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in done), key=str) == want
    assert M.restore(M.transform(docs.limit(0))).count() == 0


def test_parts_cover_a_batch(monkeypatch):
    texts = some_texts(200)
    for size in (1, 30, 1000):
        monkeypatch.setattr(M, "PART_BYTES", size)
        batch = pa.RecordBatch.from_arrays([pa.array([t * 1 if t else t for t in texts[:-1]] + ["z" * 5000])], ["text"]).slice(3)
        got = [bytes(raw[a:b]) for _, raw, at in M.parts(batch, "text") for a, b in zip(at, at[1:], strict=False)]
        assert got == [(t or "").encode() for t in batch.column("text").to_pylist()]


def test_an_output_that_was_tampered_with_is_refused():
    for out, form in ((b"<P>a<S>b", 1), (b"<P>a<S>b<M>c", 2), (b"<P><P><S><M>", 1)):
        with pytest.raises(ValueError):
            M.gather(np.frombuffer(out, np.uint8), np.array([0, len(out)]), np.array([form]))


def test_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in M.op11_fill_in_middle(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        *head, output = brute(i, t)
        assert (got[i].n, got[i].form, got[i].prefix_chars, got[i].middle_chars) == tuple(head)
        assert got[i].output_sha256 == hashlib.sha256(output.encode()).hexdigest() and got[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
