"""PII spans against a plain-Python brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

from geoquarry.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    d = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def letters(text):
    return re.findall(r"[^\W\d_]{3,}", text.lower())


def brute(texts):
    """text -> joined spans, with disclosing terms."""
    distinct = {t for t in texts if t is not None}
    near, joint, has = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in distinct:
        for w in set(letters(t)):
            has[w].add(t)
        for k, s, e, v in base(t):
            entity = f"{k}:{v.lower()}"
            near[entity].add(t)
            free = [m for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(a < m.end() and m.start() < z for _, a, z, _ in base(t))]
            for m in [*[m for m in free if m.end() <= s][-10:], *[m for m in free if m.start() >= e][:10]]:
                joint[entity, m.group().lower()].add(t)
    telling = defaultdict(set)
    for (entity, w), both in joint.items():
        n_e = len(near[entity])
        if 1 + math.log2(len(both) / (len(has[w]) + 1)) / max(math.log2(len(distinct) / n_e), 1e-9) >= 0.8:
            for t in near[entity]:
                telling[t].add(w)
    out = {}
    for t in distinct | {None}:
        spans = base(t)
        own = []
        if telling[t]:
            for m in re.finditer(r"(?<![^\W\d_])(?:" + "|".join(telling[t]) + r")(?![^\W\d_])", t or "", re.I):
                if not any(s < m.end() and m.start() < e for _, s, e, _ in spans):
                    own.append(("term", m.start(), m.end()))
        out[t] = ",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in [*spans, *own])
    return out


def check(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op7_information_theoretic_pii(spark, str(tmp_path)).collect()
    want = brute([t for _, t in rows])
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        spans = base(texts[r.doc_id])
        assert r.spans == want[texts[r.doc_id]], texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans).encode()).hexdigest()
    return got


def test_random_strings(spark, tmp_path):
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "a" * 30_000), (3, "1" * 30_000), (4, "+1" * 9000), (5, "1.2.3.4." * 500), (6, "a@b.c_x@c.d é+1 (555) 555-0000"), (7, "4111 1111 1111 1111"), (8, "4111-1111-1111-1112")]
    rows += [(9 + i, "".join(rng.choice("ab@.-+ ()0123456789é\U0001f600\n") for _ in range(rng.randrange(120)))) for i in range(400)]
    check(spark, rows, tmp_path)


def test_disclosing_terms(spark, tmp_path):
    rng = random.Random(7)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(40)) for i in range(300)]
    rows += [(300 + i, f"{text(15)} zanzibari Mayor writes from mayor@town.example.org today {text(15)} zanzibari") for i in range(8)]
    rows += [(400 + i, rows[300][1]) for i in range(20)]
    got = check(spark, rows, tmp_path)
    assert sum("term:" in r.spans for r in got) == 28


def test_an_entity_in_one_text_is_assessed(spark, tmp_path):
    """A word that stands nowhere else, next to an address that stands nowhere else, is told; a common one is not."""
    rng = random.Random(9)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(300)]
    rows.append((300, f"{rows[0][1]} zweifelhuber someone@town.example.org {rows[1][1]}"))
    (own,) = [r.spans for r in check(spark, rows, tmp_path) if r.doc_id == 300]
    at = rows[300][1].index("zweifelhuber")
    assert own.split(",")[1:] == [f"term:{at}:{at + 12}"]


def test_the_window_counts_terms(spark, tmp_path):
    """Ten terms on either side however far they reach, none beyond them."""
    far = " ".join(f"{'1' * 60} farword{c}" for c in "abcdefghijkl")
    rows = [(i, f"filler text number {i}") for i in range(200)] + [(200, f"{far} me@x.example.org {far.replace('far', 'post')}")]
    (own,) = [r for r in check(spark, rows, tmp_path) if r.doc_id == 200]
    assert own.spans.count("term:") == 20


def test_long_texts_full_of_spans(spark):
    text = " ".join(f"user{i}@site{i}.example.org or 10.0.0.{i % 256} wrote" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, "nothing " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.with_spans(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1]["__base"]] == [(k, s, e) for k, s, e, _ in base(text)]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == " ".join(["[EMAIL] or [IP] wrote"] * 3000) and clean[2] == "nothing " * 20_000


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "call +1 (555) 555-0000 or a@b.org now", "x", 1, 2, 3)], "doc_id long, text string, __email string, __spans int, __k1 int, k1 int")
    (row,) = pii.sanitise(docs).collect()
    assert tuple(row) == (1, "call [PHONE] or [EMAIL] now", "x", 1, 2, 3)


def test_given_documents(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = check(spark, rows, tmp_path)
    assert sum(r.n_email for r in got) > 0


def test_sanitise(spark):
    docs = spark.createDataFrame([(1, "call +1 (555) 555-0000 or a@b.org now", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, k1 string")
    got = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert got == {1: "call [PHONE] or [EMAIL] now", 2: None, 3: ""}
    assert pii.sanitise(docs.limit(0)).count() == 0
