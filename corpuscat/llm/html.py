"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element is content or not. Its own features give a potential for it alone, and the kind
of step from its parent gives a potential for the two; sum-product messages up and down the
tree give the marginal of each element. The weights are trained from labelled pages by the
gradient of the likelihood, which needs the same marginals.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscat.llm.batches import slices
from corpuscat.llm.html_pages import LABELLED

SLICE_BYTES = 2 << 20

# Element names of HTML by role, and words that class and id names use.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg math xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSES_ITEM = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ITEM_HOME = set("ul ol menu dl table tbody thead tfoot select".split())
ROLES = [
    set("article main".split()), set("nav menu".split()), {"header"}, {"footer"}, set("aside dialog".split()),
    set("form fieldset button select label input option legend textarea".split()),
    set("head title script style noscript iframe template svg math".split()), {"html", "body"},
    set("div section center details".split()), {"p"}, set("h1 h2 h3 h4 h5 h6 hgroup".split()),
    set("ul ol dl".split()), set("li dt dd".split()), set("table tbody thead tfoot tr td th caption".split()),
    set("blockquote pre figure figcaption".split()), {"a"},
]
AGAINST = re.compile(
    r"(?:^|[\W_])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumb\w*|side ?bar|aside|widget\w*|footer|foot|masthead|"
    r"topbar|toolbar|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|search|share|sharing|"
    r"social|related|recommend\w*|popular|trending|tags?|pager|pagination|copyright|legal|disclaimer|skip|hidden|outbrain|taboola)(?:$|[\W_\d])", re.I
)
REPLIES = re.compile(r"comment|disqus|repl(?:y|ies)|respond|discussion|feedback", re.I)
FAVOUR = re.compile(r"(?:^|[\W_])(?:article\w*|content|post|entry|story|main|body|text|prose|hentry)(?:$|[\W_\d])", re.I)
OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"[>\"']")
DEEPEST = 512  # elements within each other; what is deeper stands side by side, as in browsers
NAME = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MARK = re.compile(r"\bdata-main\s*=\s*[\"']?([01])", re.I)
LENGTHS = (1, 25, 80, 250, 800)
FEATURES = len(ROLES) + 3 + len(LENGTHS) + 5
STEPS = 5  # kinds of step from a parent: inline, block, into something set apart, into what names itself main, from the page itself


@dataclass
class Page:
    """A parsed page: elements in page order, and runs of text with the element they are in."""

    tags: list[str]
    parent: list[int]
    names: list[str]
    marks: list[int]  # labels of a training page: 1 main, 0 not, -1 as its parent
    runs: list[tuple[int, int, str]]  # element, block number, text


def parse(source: str) -> Page:
    """Elements and text of a page as browsers would see it, roughly: what is left open is closed."""
    page = Page(["#root"], [-1], [""], [-1], [])
    stack, block, last = [0], 0, 0
    opened: Counter = Counter()  # elements of the stack by name
    pos, n = 0, len(source)

    def say(text: str) -> None:
        if text.strip():
            page.runs.append((stack[-1], block, entities.unescape(text)))

    while pos < n:
        m = OPEN.search(source, pos)
        if not m:
            say(source[pos:])
            break
        if m.start() > pos:
            say(source[pos : m.start()])
        if m[1] or m[2]:
            mark = "-->" if m[1] else ">"
            end = source.find(mark, m.end())
            pos = n if end < 0 else end + len(mark)
            continue
        stop = _tag_end(source, m.end())
        pos = min(stop + 1, n)
        tag, attributes = m[4].lower(), source[m.end() : stop]
        if tag in BLOCK or tag == "br" and stack[-1] == 0:
            block += 1
        if m[3]:
            for depth in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if page.tags[stack[depth]] == tag:
                    _cut(page.tags, stack, opened, depth)
                    break
                # An end tag of an inline element does not close a block.
                if tag not in BLOCK and page.tags[stack[depth]] in BLOCK:
                    break
            continue
        if tag in VOID:
            if tag == "br":
                page.runs.append((stack[-1], block, " "))
            continue
        if tag in BLOCK:
            _close(page.tags, stack, opened, tag)
        found = NAME.findall(attributes) if "=" in attributes else ()
        mark = MARK.search(attributes)
        page.tags.append(tag)
        page.parent.append(stack[-1])
        page.names.append(" ".join(a or b or c for a, b, c in found))
        page.marks.append(int(mark[1]) if mark else -1)
        last = len(page.tags) - 1
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(source, pos)
            stop = end.start() if end else n
            pos = end.end() if end else n
            continue
        if (not attributes.endswith("/") or tag in BLOCK) and len(stack) < DEEPEST:
            stack.append(last)
            opened[tag] += 1
    return page


def _cut(tags: list[str], stack: list[int], opened: Counter, depth: int) -> None:
    opened.subtract(tags[e] for e in stack[depth:])
    del stack[depth:]


def _tag_end(source: str, pos: int) -> int:
    """Where a tag ends whose attributes start at ``pos``: at a ``>`` outside quoted values, or with the page.

    A quote opens a value only behind ``=``. A value without an end, or whose end is not
    followed by a space, ``/`` or ``>``, was left open: the tag ends at the first ``>`` after its
    start. Each search goes forward, so a page takes time in proportion to its length.
    """
    while m := STOP.search(source, pos):
        if m[0] == ">":
            return m.start()
        pos = m.end()
        if source[max(m.start() - 8, 0) : m.start()].rstrip().endswith("="):
            end = source.find(m[0], pos)
            if end < 0 or not (source[end + 1 : end + 2] in "/>" or source[end + 1].isspace()):
                end = source.find(">", pos)
                return end if end >= 0 else len(source)
            pos = end + 1
    return len(source)


def _close(tags: list[str], stack: list[int], opened: Counter, tag: str) -> None:
    """Close what a block's start tag closes: an open paragraph, and items of its own kind."""
    closing = CLOSES_ITEM.get(tag, ())
    depth = len(stack)
    while depth > 1 and (opened["p"] or any(opened[t] for t in closing)):
        depth -= 1
        name = tags[stack[depth]]
        if name == "p" or name in closing:
            _cut(tags, stack, opened, depth)
            if not closing:
                return
        elif name in (ITEM_HOME if closing else BLOCK):
            return


@dataclass
class Forest:
    """Pages side by side: the tree and the features of all elements."""

    parent: np.ndarray
    levels: list[np.ndarray]
    features: np.ndarray
    step: np.ndarray
    first: list[int]


def forest(pages: list[Page]) -> Forest:
    first, tags, names = [], [], []
    parent: list[int] = []
    for p in pages:
        base = len(tags)
        first.append(base)
        tags += p.tags
        names += p.names
        parent += [base + x if x >= 0 else -1 for x in p.parent]
    n = len(tags)
    up = np.array(parent, np.int64)
    depth = np.zeros(n, np.int64)
    for i, x in enumerate(parent):
        if x >= 0:
            depth[i] = depth[x] + 1
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
    levels = [order[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]
    # Text within each element: characters, characters in links, sentence ends.
    own = np.zeros((n, 3))
    for base, p in zip(first, pages):
        for e, _, text in p.runs:
            own[base + e, 0] += len(text)
            own[base + e, 2] += text.count(". ") + text.count("! ") + text.count("? ") + (text.rstrip()[-1:] in ".!?")
    link = np.array([t == "a" for t in tags])
    block = np.array([t in BLOCK for t in tags])
    # Links count for all elements around them, length and sentences for the nearest block.
    near, total = own.copy(), own.copy()
    for level in levels[:0:-1]:
        total[level, 1] = np.where(link[level], total[level, 0], total[level, 1])
        np.add.at(total, up[level], total[level])
        inline = level[~block[level]]
        np.add.at(near, up[inline], near[inline])
    x = np.zeros((n, FEATURES))
    roles = _role_table()
    kind = np.array([roles.get(t, -1) for t in tags])
    x[np.flatnonzero(kind >= 0), kind[kind >= 0]] = 1
    judged = [_name_kind(s) for s in names]
    k = len(ROLES)
    x[:, k : k + 3] = judged
    k += 3
    for j, least in enumerate(LENGTHS):
        x[:, k + j] = near[:, 0] >= least
    k += len(LENGTHS)
    density = total[:, 1] / np.maximum(total[:, 0], 1)
    x[:, k] = density > 0.3
    x[:, k + 1] = density > 0.7
    x[:, k + 2] = near[:, 2] >= 1
    x[:, k + 3] = near[:, 2] >= 4
    x[:, k + 4] = 1
    apart = np.isin(kind, (1, 2, 3, 4, 5, 6)) | (x[:, len(ROLES)] > 0) | (x[:, len(ROLES) + 1] > 0)
    main = (kind == 0) | (x[:, len(ROLES) + 2] > 0)
    page_itself = np.isin(np.array(["#root", *tags])[up + 1], ("#root", "html", "body"))
    return Forest(up, levels, x, np.where(apart, 2, np.where(main, 3, np.where(page_itself, 4, np.where(block, 1, 0)))), first)


@functools.cache
def _role_table() -> dict[str, int]:
    return {t: i for i, names in enumerate(ROLES) for t in names}


@functools.lru_cache(maxsize=50_000)
def _name_kind(names: str) -> tuple[bool, bool, bool]:
    if not names:
        return (False, False, False)
    against, replies = bool(AGAINST.search(names)), bool(REPLIES.search(names))
    return (against, replies, bool(FAVOUR.search(names)) and not against and not replies)


@dataclass
class Model:
    """Weights of an element's features for being content, and a 2 x 2 log potential for each kind of step."""

    own: np.ndarray
    step: np.ndarray

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product: the probability of content of each element, and of each (parent, child) state."""
        n = len(f.parent)
        own = np.zeros((n, 2))
        own[:, 1] = f.features @ self.own
        potential = self.step[f.step]  # of each element with its parent: [element, parent, child]
        below, message = own.copy(), np.zeros((n, 2))
        for level in f.levels[:0:-1]:
            message[level] = np.logaddexp.reduce(potential[level] + below[level][:, None, :], axis=2)
            np.add.at(below, f.parent[level], message[level])
        above = np.zeros((n, 2))  # what the rest of the tree says to each element
        pair = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            up = f.parent[level]
            outside = above[up] + below[up] - message[level]
            joint = potential[level] + outside[:, :, None] + below[level][:, None, :]
            above[level] = np.logaddexp.reduce(potential[level] + outside[:, :, None], axis=1)
            joint -= np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None]
            pair[level] = np.exp(joint)
        belief = above + below
        return 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), pair


def labels(page: Page) -> np.ndarray:
    out = np.zeros(len(page.tags))
    for i in range(1, len(page.tags)):
        out[i] = page.marks[i] if page.marks[i] >= 0 else out[page.parent[i]]
    return out


def train(sources: list[str], rounds: int = 400, rate: float = 0.5, shrink: float = 0.0005) -> Model:
    """Weights of greatest likelihood on labelled pages, shrunk a little towards 0.

    Elements with ``data-main="1"`` are main text with all below them, down to one with
    ``data-main="0"``. Each round's gradient is what was seen less what the model expects.
    """
    pages = [parse(s) for s in sources]
    f = forest(pages)
    y = np.concatenate([labels(p) for p in pages])
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((STEPS, 2, 2))
    np.add.at(seen, (f.step[child], y[f.parent[child]].astype(int), y[child].astype(int)), 1)
    model = Model(np.zeros(FEATURES), np.zeros((STEPS, 2, 2)))
    scale = 1.0 / len(pages)
    moment = [np.zeros_like(model.own), np.zeros_like(model.step)]
    square = [np.zeros_like(model.own), np.zeros_like(model.step)]
    for r in range(1, rounds + 1):
        p, pair = model.marginals(f)
        expected = np.zeros((STEPS, 2, 2))
        np.add.at(expected, f.step[child], pair[child])
        gradients = [scale * (f.features.T @ (y - p)) - shrink * model.own, scale * (seen - expected) - shrink * model.step]
        for k, (weights, g) in enumerate(zip((model.own, model.step), gradients)):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            weights += rate * 0.2 * (moment[k] / (1 - 0.9**r)) / (np.sqrt(square[k] / (1 - 0.99**r)) + 1e-6)
    return model


@functools.cache
def _trained() -> Model:
    """The model of the package's labelled pages, trained once in a process."""
    return train(LABELLED)


def main_texts(model: Model, sources: list[str]) -> list[str]:
    """The main text of each page: blocks of its content elements, one a line."""
    pages = [parse(s) for s in sources]
    f = forest(pages)
    p = model.marginals(f)[0] > 0.5
    out = []
    for base, page in zip(f.first, pages):
        blocks: list[list[str]] = []
        at = None
        for element, block, text in page.runs:
            if p[base + element]:
                if block != at:
                    blocks.append([])
                    at = block
                blocks[-1].append(text)
        lines = (" ".join("".join(b).split()) for b in blocks)
        out.append("\n".join(line for line in lines if line))
    return out


def extract_text(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``id_col, url_col, text, n_chars``.

    The whole html is parsed; text of the elements whose marginal of being content is above
    a half stays. Character references are decoded, white space within a block is one
    space, and blocks are joined in page order by a line end. Null or empty html, and pages
    without main text, give an empty text of 0 characters. Broken markup is closed as
    browsers do. Repeated rows and null ids are rows like others; other columns are not
    read. Without ``model``, one is trained on the labelled pages of this package.
    """
    model = model or _trained()
    id_kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(start, end - start)
                texts = main_texts(model, [s or "" for s in part.column(2).to_pylist()])
                lengths = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), lengths], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    found = rows.mapInArrow(run, f"id {id_kind}, url {url_kind}, text string, n_chars bigint")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
