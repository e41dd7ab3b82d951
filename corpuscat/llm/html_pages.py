"""Labelled pages for training: small pages of common layouts, with main parts marked.

``data-main="1"`` marks main text with all below it, ``data-main="0"`` takes parts out
again. The marks are no features. Sentences are drawn by place from the lines below, so that
lengths vary and nothing can be learned from words.
"""

from __future__ import annotations

_LINES = (
    "The river rose slowly during the night, and by morning the lower fields were under water.",
    "Nobody had expected the council to vote on the plan before the end of the year.",
    "A second report, due in spring, will look at the cost of each of the three routes.",
    "She opened the door, looked down the street, and went back to her work!",
    "Most of the parts are printed; the rest can be bought in any good shop.",
    "Why did the bees leave? Growers gave three answers, and none of them was complete.",
    "It took two days to reach the village, where the old mill still stands.",
    "Prices fell again last month, though by less than in the summer.",
)
_SHORT = ("Home", "About us", "Contact", "World", "Sport", "Culture", "Archive", "Sign in", "Next", "Top")


def _text(start: int, n: int) -> str:
    return " ".join(_LINES[(start + k) % len(_LINES)] for k in range(n))


def _bare(start: int, n: int) -> str:
    """Text without a sentence end."""
    return "".join(c for c in _text(start, n) if c.isalpha() or c == " ")


def _links(start: int, n: int, item: str = "li") -> str:
    words = [_SHORT[(start + k) % len(_SHORT)] for k in range(n)]
    return "".join(f'<{item}><a href="/{w}">{w}</a></{item}>' if item else f'<a href="/{w}">{w}</a> ' for w in words)


def _paragraphs(start: int, n: int) -> str:
    sizes = (1, 2, 9, 3, 30, 1, 4)
    return "".join(f"<p>{_text(start + k, sizes[(start + k) % len(sizes)])}</p>" for k in range(n))


def _page(body: str, head: str = "") -> str:
    return f"<!DOCTYPE html><html><head><title>{_SHORT[len(body) % 10]}</title>{head}</head><body>{body}</body></html>"


LABELLED = [
    # News: header, menu, article, footer.
    _page(
        f'<header><h1><a href="/">The Daily</a></h1></header><nav><ul>{_links(0, 6)}</ul></nav><div class="ad">{_text(1, 1)}</div>'
        f'<article data-main="1"><h1>{_LINES[1]}</h1>{_paragraphs(0, 5)}</article><footer>&copy; The Daily. {_text(6, 1)}</footer>',
        "<style>p{margin:0}</style><script>var a=1;</script>",
    ),
    _page(
        f'<nav><ul>{_links(2, 5)}</ul></nav><div class="ad">{_text(4, 2)}</div><article data-main="1"><h1>{_LINES[3]}</h1>'
        f"<p><b>{_LINES[2]}<br><p>{_text(3, 3)}</p><p><b>{_LINES[5]}<br><p>{_text(5, 1)}</p><p>Yes.</p></article><footer>{_text(2, 1)}</footer>"
    ),
    _page(f'<nav><ul>{_links(4, 4)}</ul></nav><article data-main="1"><h1>{_SHORT[3]}</h1><p>{_LINES[0][:12]}</p></article><footer>{_text(3, 2)}</footer>'),
    # Blog with a sidebar, sharing and comments.
    _page(
        f'<div id="wrapper"><div class="masthead"><p>{_SHORT[2]}</p></div><div class="menu">{_links(1, 6, "")}</div>'
        f'<div class="post" data-main="1"><h2>{_LINES[4]}</h2>{_paragraphs(2, 4)}<blockquote><p>{_text(1, 2)}</p></blockquote>'
        f'<ul><li>{_LINES[0]}</li><li>{_LINES[3]}</li></ul></div><div class="share-buttons">{_links(3, 4, "")}</div>'
        f'<div class="sidebar"><h3>Archive</h3><p>{_text(2, 2)}</p><ul>{_links(0, 7)}</ul></div>'
        f'<div id="comments"><h3>Comments</h3><div class="comment"><p>{_text(5, 2)}</p></div><div class="comment"><p>{_text(7, 1)}</p></div>'
        f'<form><label>Your name</label><textarea>x</textarea><button>Send</button></form></div><div id="footer"><p>{_text(0, 1)}</p></div></div>'
    ),
    # Comments and related links inside the article.
    _page(
        f'<header class="site-header">{_links(5, 5, "")}</header><main><article data-main="1"><header><h1>{_LINES[6]}</h1></header>{_paragraphs(4, 6)}'
        f'<aside data-main="0"><p>{_text(3, 1)}</p><ul>{_links(2, 3)}</ul></aside><div class="related" data-main="0"><h4>More</h4>{_links(1, 4, "")}</div>'
        f'<section class="comments" data-main="0"><p>{_text(2, 3)}</p><p>{_text(6, 2)}</p></section>'
        f'<form data-main="0"><p>{_text(4, 1)}</p><input><button>Go</button></form></article></main><footer><p>{_text(7, 2)}</p></footer>'
    ),
    # A cookie notice, adverts between paragraphs, a newsletter form.
    _page(
        f'<div class="cookie-notice"><p>{_text(6, 2)}</p><button>Accept</button></div><nav>{_links(0, 8, "")}</nav><main data-main="1"><h1>{_LINES[7]}</h1>'
        f'{_paragraphs(1, 2)}<div class="advert" data-main="0"><p>{_text(0, 1)}</p></div>{_paragraphs(3, 3)}'
        f'<div class="newsletter" data-main="0"><p>{_text(5, 2)}</p><form><input></form></div>{_paragraphs(6, 2)}</main><aside><p>{_text(1, 3)}</p></aside>'
    ),
    # Plain pages without a frame.
    _page(f'<div data-main="1"><h1>{_LINES[2]}</h1>{_paragraphs(5, 3)}</div>'),
    _page(f'<div data-main="1">{_text(2, 4)}<br>{_text(1, 3)}</div><div class="footer">{_text(4, 1)}</div>'),
    f'<p data-main="1">{_text(0, 3)}<p data-main="1">{_text(4, 2)}',
    _page(f'<nav><ul>{_links(1, 5)}</ul></nav><article data-main="1"><h1>{_SHORT[6]} {_LINES[1][:30]}</h1><p>{_text(3, 40)}</p><p>{_LINES[4].upper()}</p><p>ok</p></article><footer>{_text(1, 9)}</footer>'),
    _page(f'<nav><ul>{_links(0, 6)}</ul></nav><div class="ad">{_text(5, 1)}</div><article data-main="1"><h1>{_LINES[5]}</h1><p><b>{_LINES[5]}<br><p></article><footer>{_text(2, 2)}</footer>'),
    _page(f'<nav><ul>{_links(3, 6)}</ul></nav><article data-main="1"><h1>{_SHORT[1]}</h1><p><b>{_SHORT[8]}<br><p></p></article><footer>{_text(6, 1)}</footer>'),
    _page(f'<nav><ul>{_links(5, 6)}</ul></nav><div class="ad">{_text(2, 1)}</div><article data-main="1"><h1>{_bare(1, 1)}</h1><p><b>{_bare(1, 1)}<br><p>{_bare(3, 90)}</p></article><footer>{_text(0, 1)}</footer>'),
    _page(f'<nav><ul>{_links(7, 6)}</ul></nav><article data-main="1"><h1>{"Word " * 12}</h1><p>{"Word " * 300}</p></article><footer>{_text(4, 1)}</footer>'),
    # Very many short paragraphs.
    _page(f'<nav><ul>{_links(6, 6)}</ul></nav><div class="ad">{_text(3, 1)}</div><article data-main="1"><h1>{_LINES[3]}</h1>{"<p>It was so.</p>" * 60}<p><b>Then<br><p>No.</p></article><footer>{_text(3, 1)}</footer>'),
    _page(f'<header>{_links(2, 6, "")}</header><div class="post" data-main="1"><h2>{_SHORT[4]}</h2>{"<p>Go on, then</p><p>Why?</p>" * 25}{_paragraphs(1, 2)}</div><div class="footer"><p>{_text(6, 1)}</p></div>'),
    _page(f'<nav><ul>{_links(8, 6)}</ul></nav><main data-main="1"><h1>{_SHORT[2]}</h1>{"".join(f"<p>{w}</p>" for w in _SHORT * 5)}</main><footer>{_text(1, 1)}</footer>'),
    # Tables of an old layout.
    _page(
        f'<table><tr><td class="nav">{_links(0, 6, "")}</td><td class="content" data-main="1"><h2>{_LINES[5]}</h2>{_paragraphs(0, 4)}</td></tr></table>'
        f'<div class="copyright"><p>{_text(3, 1)}</p></div>'
    ),
    # Sections, figures and a table within the main text.
    _page(
        f'<header><nav>{_links(2, 5, "")}</nav></header><main data-main="1"><section><h2>{_LINES[0]}</h2>{_paragraphs(2, 3)}</section>'
        f'<figure><img src="a"><figcaption>{_LINES[4]}</figcaption></figure><section><h2>{_LINES[1]}</h2>{_paragraphs(4, 3)}'
        f"<table><tr><th>Year</th><th>Count</th></tr><tr><td>1990</td><td>{_LINES[3]}</td></tr></table><pre>a = 1</pre>"
        f"<ol><li>{_LINES[6]}</li><li>Short</li></ol></section></main><footer><ul>{_links(1, 5)}</ul><p>{_text(5, 1)}</p></footer>"
    ),
    # Divisions only, told apart by names and link density.
    _page(
        f'<div class="topbar">{_links(6, 6, "")}</div><div class="entry-content" data-main="1"><h1>{_LINES[3]}</h1><div>{_text(0, 3)}</div>'
        f'<div>{_text(3, 2)} <a href="/x">{_SHORT[4]}</a> {_text(5, 1)}</div></div><div><ul>{_links(3, 8)}</ul></div>'
        f'<div class="popup"><p>{_text(2, 1)}</p></div><div class="footer-links">{_links(1, 6, "")}<p>{_text(7, 1)}</p></div>'
    ),
    # Menus and forms only: no main text.
    _page(f'<nav><ul>{_links(0, 9)}</ul></nav><form><label>Name</label><input><button>Sign in</button></form><footer><p>{_text(1, 1)}</p></footer>'),
    _page(f'<div class="sidebar"><p>{_text(0, 2)}</p><ul>{_links(3, 6)}</ul></div><aside class="banner"><p>{_text(4, 2)}</p></aside>'),
]

# Many more by rule: containers of main text, with parts before, within and after it.
_HOMES = (
    ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="article-body">', "</div>"), ('<div class="post-content">', "</div>"), ("<main><article>", "</article></main>"),
    ('<div id="content">', "</div>"), ("<section>", "</section>"), ('<div class="entry">', "</div>"), ('<section class="story">', "</section>"), ("<div>", "</div>"),
    ('<article class="hentry">', "</article>"), ('<div role="main">', "</div>"), ('<div itemprop="articleBody">', "</div>"),
)


def _before(k: int) -> str:
    return (
        f"<nav><ul>{_links(k, 6)}</ul></nav>", f'<div class="navbar">{_links(k, 5, "")}</div>', f"<header><p>{_SHORT[k % 10]}</p>{_links(k, 4, '')}</header>",
        f'<div id="cookie-banner"><p>{_text(k, 2)}</p></div>', f'<div class="ad-slot"><p>{_text(k, 1)}</p></div>', f'<ul class="breadcrumbs">{_links(k, 3)}</ul>',
        f'<div class="header">{_links(k, 5, "")}</div><div class="ad">{_text(k, 2)}</div>',
    )[k % 7]


def _within(k: int) -> str:
    return (
        "", f'<div class="ad-slot"><p>{_text(k, 1)}</p></div>', f'<aside><p>{_text(k, 2)}</p></aside>', "", f'<div class="share-bar">{_links(k, 4, "")}</div>',
        f'<div class="related-posts"><ul>{_links(k, 4)}</ul></div>', "", f"<form><p>{_text(k, 1)}</p><button>Go</button></form>", f'<div class="notice"><p>{_text(k, 1)}</p></div>',
    )[k % 9]


def _after(k: int) -> str:
    return (
        f"<footer><p>{_text(k, 2)}</p></footer>", f'<div class="comments-area"><h3>Comments</h3><p>{_text(k, 3)}</p><p>{_text(k + 1, 1)}</p></div>',
        f'<section id="comments"><h2>2 comments</h2><div><p>{_text(k, 2)}</p></div></section><footer>{_links(k, 5, "")}</footer>',
        f'<aside><h4>Popular</h4><p>{_text(k, 2)}</p><ul>{_links(k, 5)}</ul></aside>', f"<footer>{_text(k, 1)}</footer>",
        f'<div class="sidebar"><p>{_text(k, 3)}</p></div><div id="footer"><p>{_text(k, 1)}</p></div>',
        f'<form class="newsletter-signup"><p>{_text(k, 1)}</p><input></form><footer><p>{_text(k, 1)}</p></footer>',
        f'<ol class="comment-list"><li class="comment"><p>{_text(k, 2)}</p></li><li class="comment"><p>{_text(k, 1)}</p></li></ol>',
    )[k % 8]


def _by_rule(k: int) -> str:
    opened, closed = _HOMES[k % len(_HOMES)]
    head = (f"<h1>{_LINES[k % 8]}</h1>", f"<h2>{_SHORT[k % 10]}</h2>", f"<header><h1>{_LINES[k % 8]}</h1></header>", "")[k % 4]
    extra = ("", f"<ul><li>{_LINES[k % 8]}</li><li>{_SHORT[k % 10]} first</li></ul>", f"<blockquote><p>{_text(k, 2)}</p></blockquote>", f"<h3>{_SHORT[k % 10]}</h3>{_paragraphs(k, 1)}", f"<pre>x = {k}</pre>", f"<p>{_bare(k, 1)}</p><p>{_bare(k, 60)}</p>")[k % 6]
    aside = _within(k).replace(" class=", ' data-main="0" class=').replace("<aside>", '<aside data-main="0">').replace("<form>", '<form data-main="0">')
    body = f"{head}{_paragraphs(k, 1 + k % 4)}{aside}{extra}{_paragraphs(k + 3, k % 3)}"
    return _page(f'{_before(k)}{opened.replace(">", " data-main=1>", 1)}{body}{closed}{_after(k)}')


LABELLED += [_by_rule(k) for k in range(91)]

# Bare pages: paragraphs that stand in the body, with or without page parts around them.
_MAIN = "".join(f'<p data-main="1">{_text(k, n)}</p>' for k, n in enumerate((2, 1, 9, 4)))
_FEW = f'<p data-main="1">{_text(2, 1)}</p><p data-main="1">{_text(4, 3)}</p>'
LABELLED += [
    f"<html><body>{_MAIN}</body></html>",
    f"<html><body>{_FEW}</body></html>",
    f"<html><head><title>{_SHORT[4]}</title></head><body>{_FEW}</body></html>",
    _page(f'<h1 data-main="1">{_LINES[5]}</h1>{_MAIN}'),
    _page(f'<h1 data-main="1">{_LINES[2]}</h1>{_FEW}<ul data-main="1"><li>{_LINES[1]}</li><li>{_LINES[6]}</li></ul>{_FEW}'),
    _page(f"<nav><ul>{_links(3, 5)}</ul></nav>{_MAIN}<footer><p>{_text(1, 2)}</p></footer>"),
    _page(f'<div class="menu">{_links(0, 4, "")}</div><h2 data-main="1">{_SHORT[4]}</h2>{_FEW}<div class="footer">{_text(3, 1)}</div>'),
    _page(f'<header><p>{_text(6, 1)}</p></header>{_FEW}<div class="ad">{_text(1, 2)}</div>{_MAIN}<aside><p>{_text(5, 2)}</p></aside>'),
]

# Paragraphs of an article whose class says something that page parts are named for, too.
LABELLED += [
    _page(
        f'<nav><ul>{_links(k, 4)}</ul></nav><article data-main="1"><h1>{_LINES[k]}</h1><p>{_text(k, 2)}</p><p class="{name}">{_text(k + 1, 2 + k)}</p>'
        f"<p>{_text(k + 3, 9)}</p></article><footer>{_text(k, 1)}</footer>"
    )
    for k, name in enumerate(("tags", "notice", "legal", "share-text", "popular", "promo"))
]
