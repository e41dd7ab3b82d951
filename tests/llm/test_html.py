"""Main text against the marked article, and on layouts that no labelled page has."""

import html
import re
import time

import numpy as np
import pytest

from corpuscat.llm.html import Forest, Model, extract_text, forest, labels, main_texts, parse, train
from corpuscat.llm.html_pages import LABELLED

SCHEMA = "page_id bigint, url string, html string, text string, n_chars string"
LONG = "Rain fell on the hills all day. The paths were soft, and few people came. "


@pytest.fixture(scope="module")
def model():
    return train(LABELLED)


def article(source):
    """The blocks between the article's tags, by pattern."""
    inner = source[source.find("<article>") + 9 : source.find("</article>")]
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = extract_text(pages, model).collect()
    assert len(got) == len(want) > 100
    for r in got:
        assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])


LAYOUTS = [
    (f"<body><header><p>Site name</p></header><main><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></main><aside><p>{LONG}</p></aside><footer><p>{LONG}</p></footer></body>", 3),
    (f'<div class="navbar"><a href="/">Home</a> <a href="/a">About</a></div><div class="article-body"><h2>Title</h2><p>{LONG}</p>'
     f'<div class="ad-slot"><p>Buy now. Only today.</p></div><p>{LONG}</p></div><div class="comments-area"><p>{LONG}</p></div>', 3),
    (f'<main><article><h1>Title</h1><p>{LONG}</p></article><section id="comments"><h2>2 comments</h2><p>{LONG}</p></section></main><form><p>{LONG}</p></form>', 2),
    (f'<div id="cookie-banner"><p>We use cookies. {LONG}</p></div><article><h1>Title</h1><p>{LONG * 20}</p><ul><li>First point here.</li></ul></article>', 3),
]


@pytest.mark.parametrize("source,blocks", LAYOUTS)
def test_other_layouts(model, source, blocks):
    text = main_texts(model, [source])[0].split("\n")
    assert len(text) == blocks and text[0] == "Title"
    assert not any(w in " ".join(text) for w in ("Buy", "cookies", "comments", "Home", "Site name"))


def test_held_out_labelled_pages():
    """Trained without a page, the model still finds most of its main text."""
    right = total = 0
    for k in range(0, len(LABELLED), 3):
        page = parse(LABELLED[k])
        p = train(LABELLED[:k] + LABELLED[k + 1 :], rounds=120).marginals(forest([page]))[0]
        said = [e for e, _, t in page.runs if t.strip()]
        right += sum((p[e] > 0.5) == (labels(page)[e] > 0.5) for e in said)
        total += len(said)
    assert right / total > 0.85


def test_messages_give_the_marginals_of_all_states():
    """Sum-product on small random trees against the sum over all labellings."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        parent = np.array([-1, *[rng.integers(0, k) for k in range(1, n)]])
        depth = [0] * n
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        levels = [np.array([k for k in range(n) if depth[k] == d]) for d in range(max(depth) + 1)]
        m = Model(rng.standard_normal(4), rng.standard_normal((3, 2, 2)))
        f = Forest(parent, levels, rng.standard_normal((n, 4)), rng.integers(0, 3, n), [0])
        states = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
        score = states @ (f.features @ m.own)
        for k in range(1, n):
            score = score + m.step[f.step[k], states[:, parent[k]], states[:, k]]
        weight = np.exp(score - score.max())
        weight /= weight.sum()
        p, pair = m.marginals(f)
        assert p == pytest.approx(weight @ states)
        for k in range(1, n):
            both = weight[(states[:, parent[k]] == 1) & (states[:, k] == 1)].sum()
            assert pair[k, 1, 1] == pytest.approx(both)


BARE = [
    (f"<html><body><p>{LONG}</p><p>{LONG * 3}</p></body></html>", 2),
    (f"<html><body><h1>Title</h1><p>{LONG}</p><p>{LONG * 3}</p><p>{LONG}</p></body></html>", 4),
    (f"<p>{LONG}</p><p>{LONG * 3}</p>", 2),
    (f'<body><img alt="x>y" title="broken><p>{LONG}</p><p>{LONG * 2}</p></body>', 2),
    (f'<body><article><h1>Title</h1><p>{LONG}</p><p>See <a title="x>the broken link</a> there. <b class="y">{LONG}</b></p></article></body>', 3),
    (f'<body><nav><a href="/">Home</a></nav><article><h1>Title</h1><p class="tags">{LONG * 2}</p><p>{LONG}</p></article></body>', 3),
]


@pytest.mark.parametrize("source,blocks", BARE)
def test_bare_and_broken_pages(model, source, blocks):
    text = main_texts(model, [source])[0]
    assert len(text.split("\n")) == blocks and "<" not in text and "class=" not in text and text.count("Rain fell") >= 2


def test_quoted_values_may_hold_markup():
    page = parse('<p data-x="a > b" title=\'c > "d"\' class = "e">text</p><a href="/x"/>more')
    assert [t.strip() for _, _, t in page.runs] == ["text", "more"] and page.names[1] == "e"


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a b="', "<a b='x>", '<a b="x>', "<b>", "<div>", "</p>", "<b></i>", "<!--", "<script>", "<p class='", "<td><tr>", "<i><p></b>"])
def test_time_grows_with_the_length(piece):
    """Hostile markup takes seconds, and eight times the length about eight times as long."""
    def seconds(size):
        source = "<div>" + "<i>" * 600 + piece * (size // len(piece)) + '"'
        start = time.process_time()
        parse(source)
        return time.process_time() - start

    small = max(seconds(60_000), 0.02)
    assert seconds(480_000) < 24 * small + 1


EDGE = [
    (1, "u", None, "t", "n"), (2, None, "", "t", "n"), (3, "u", "   ", "t", "n"), (4, "u", "<", "t", "n"), (5, "u", "<article><p>a &amp; b&nbsp;&#233;&lt;i&gt; \n\t c", "t", "n"),
    (6, "u", "<!-- <article><p>x</p>", "t", "n"), (7, "u", "</p></div><article><p>" + LONG * 5_000, "t", "n"), (7, "u", "<p", "t", "n"), (None, "u", f"<article><h1>T</h1><p>{LONG}", "t", "n"),
    (8, "u", "<div>" * 3_000 + "deep", "t", "n"), (9, "u", "<article><script>if (a < b) { x('</p>') }</script><p>Kept words here.</p></article>", "t", "n"),
]


def test_edges(spark, model):
    got = extract_text(spark.createDataFrame(EDGE, SCHEMA).repartition(3), model).collect()
    assert len(got) == len(EDGE)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[3] == by[6] == ""
    assert by[5] == "a & b é<i> c" and by[9] == "Kept words here."
    assert max((r["n_chars"] for r in got if r["page_id"] == 7)) == len((LONG * 5_000).strip())
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_text(spark.createDataFrame([], SCHEMA), model).count() == 0
