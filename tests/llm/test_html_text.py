"""Min-cut extraction: cuts against brute force, and pages of several make-ups."""

import random
import re
from html import unescape
from itertools import product

import numpy as np
import pytest

from geoquarry.llm import html_text as H


def test_min_cut_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 7)
        s, t = ([rng.choice([0, 0, 1, 2, 5]) + rng.random() for _ in range(n)] for _ in range(2))
        edges = [(a, b, rng.random() * 3) for a in range(n) for b in range(a) if rng.random() < 0.6]

        def cost(side):
            return sum(t[v] if side[v] else s[v] for v in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])

        assert cost(H.min_cut(s, t, edges)) == pytest.approx(min(map(cost, product([False, True], repeat=n))))


PARAGRAPH = "This is a sentence of the story, and it goes on for a while; then it stops."
CASES = {
    "plain": (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>{PARAGRAPH}<p>a<br>b &lt;c&gt;</article><footer>&copy; me</footer>", f"T & U\n\n{PARAGRAPH}\n\na b <c>"),
    "classes": (f"<body class='has-sidebar'><div id=top-menu><li>One<li>Two</div><div class=content><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div class='sidebar-left'><p>{PARAGRAPH}</p></div><div class=cookieNotice>We use cookies.</div><section id=comments><p>{PARAGRAPH}</p></section></body>", f"{PARAGRAPH}\n\n{PARAGRAPH}"),
    "inside": (f"<main><p>{PARAGRAPH}</p><div class=ad>Buy now.</div><form><label>Mail</label><input></form><aside>{PARAGRAPH}</aside><p>End of it.</p></main>", f"{PARAGRAPH}\n\nEnd of it."),
    "script": ("<article><script>var t='</p><p>no';</script><p>x  \n y</p><!-- <p>no</p> --></article>", "x y"),
    "broken": ("<article><p title='a>b'>one</p><p>2 < 3<p>end <b>bold", "one\n\n2 < 3\n\nend bold"),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    for weights in (np.zeros(len(H.PRIOR)), H.PRIOR):
        assert H.extract(page, weights) == want


BY_NAME = {
    "register-entry": (f"<article class='register-entry'><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article>", f"{PARAGRAPH}\n\n{PARAGRAPH}"),
    "story-header": (f"<main><div class='story-header-image-wrap'><h1>A title</h1><p>{PARAGRAPH}</p></div></main>", f"A title\n\n{PARAGRAPH}"),
    "both-wrapped": (f"<div class='content-sidebar-wrap'><main class=content><p>{PARAGRAPH}</p><p>Short.</p></main><aside class=sidebar><p>{PARAGRAPH}</p></aside></div>", f"{PARAGRAPH}\n\nShort."),
    "no marks": (f"<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div><div><p>{PARAGRAPH}</p><p>Two years ago</p><p>{PARAGRAPH}</p></div></div><div><a href=3>Imprint</a> <a href=4>Help</a></div>", f"{PARAGRAPH}\n\nTwo years ago\n\n{PARAGRAPH}"),
    "comments": (f"<article><header class='article-header'><h1>A title</h1></header><p>{PARAGRAPH}</p><div class='comment-list'><article class=comment><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></article></div></article>", f"A title\n\n{PARAGRAPH}"),
    "related": (f"<main><p>{PARAGRAPH}</p><section class='related-stories'><article><p>{PARAGRAPH}</p></article></section><div class='share-buttons social'><a href=1>Post it</a></div></main>", PARAGRAPH),
}


def test_unmarked_pages_lose_to_the_cut_only_where_texts_mislead():
    """Given pages with all telling tags and names taken away: prose stays whole, menus and rights lines go."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    rows = [(y, H.features(b)) for x in pages[:100] for b in H.blocks(x)[0] if (y := H._marked(b)) is not None]
    weights = H.train(np.array([f for _, f in rows]), np.array([y for y, _ in rows]))
    right = total = 0
    for page in pages[100:]:
        want = H.extract(page, weights).split("\n\n")
        bare = re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page)
        got = H.extract(bare, weights).split("\n\n")
        right += len(set(got) & set(want))
        total += len(set(got) | set(want))
    assert right / total > 0.8


@pytest.mark.parametrize("name", BY_NAME)
def test_names_are_hints(name):
    page, want = BY_NAME[name]
    assert H.extract(page, H.PRIOR) == want


def test_the_cut_decides_doubtful_blocks():
    # the short line between the paragraphs is boilerplate by itself and content by its neighbours
    found, held = H.blocks(BY_NAME["no marks"][0])
    odds, _ = H.network(found, held, H.PRIOR)
    own = [b.text for b, o in zip(found, odds) if o > 0]
    assert "Two years ago" not in own
    assert "Two years ago" in [b.text for b, k in zip(found, H.content(found, held, H.PRIOR)) if k]


def test_content_equals_brute_force_over_whole_pages():
    rng = random.Random(3)
    kinds = ["<p>{}</p>", "<li><a href=x>{}</a></li>", "<div class='{}-box'><p>{}</p></div>", "<div>{}</div>", "<h2>{}</h2>"]
    flipped = 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            words = " ".join(rng.choice(["one", "two", "three.", "four,", "five"]) for _ in range(rng.choice([1, 3, 8, 30])))
            kind = rng.choice(kinds)
            parts.append(kind.format(rng.choice(["side", "header", "story", "menu"]), words) if kind.count("{}") == 2 else kind.format(words))
        found, held = H.blocks("<div>" + "".join(parts) + "</div>")
        odds, edges = H.network(found, held, H.PRIOR)

        def cost(side):
            return sum(max(-o, 0) if s else max(o, 0) for o, s in zip(odds, side)) + sum(c for a, b, c in edges if side[a] != side[b])

        least = min(cost(side) for side in product([False, True], repeat=len(odds)))
        kept = H.content(found, held, H.PRIOR)
        rest = len(odds) - len(found)
        assert min(cost([*kept, *side]) for side in product([False, True], repeat=rest)) == pytest.approx(least)
        flipped += kept != [o > 0 for o in odds[: len(found)]]
    assert flipped > 15


def test_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", CASES["plain"][0], "x"), (3, "u", CASES["plain"][0], "x"), (None, "u", "<article><p>" + "word " * 50_000, "x"), (4, "u", "<p>" * 3000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract_pages(pages, H.fit(pages)).collect()
    assert [(r.page_id, r.url) for r in got] == [(r[0], r[1]) for r in rows]
    assert [r.text for r in got[:4]] == ["", "", CASES["plain"][1], CASES["plain"][1]]
    assert len(got[4].text) == 249_999 and got[5].text == ""
    assert H.extract_pages(pages.limit(0), H.fit(pages.limit(0))).count() == 0


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in H.op2_html_min_cut(spark, sf).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p), r.page_id
        assert r.n_chars == len(r.text)
