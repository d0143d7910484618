"""Main text of HTML pages from flat text blocks.

A page is cut into flat text blocks at block-level tags.  A block's features
are its word count and link density (the share of its visible characters that
are links), those of its two neighbours, and what encloses it: an article, a
boilerplate element such as an aside, footer, form or menu, a telling class or
id, comments.  A ``main`` element speaks for itself: what encloses it isn't
counted.  A decision tree, trained on a small labelled table of blocks by Gini
gain, keeps or drops each block; the kept ones, joined in page order by two line
ends, are the text.

Only one pass over the markup is made, in linear time, so long pages and
broken markup do no harm.  Defined results: a null page is empty and has an
empty text; so has a page without kept blocks; unclosed elements end with
the page, unclosed comments and scripts swallow the rest as in browsers;
repeated rows stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*>)")
_OPENS = re.compile(r"<[a-zA-Z!?/]")
_HINT_ATTR = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)

#: Elements that run inside a line; every other tag ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style template noscript iframe object svg math select option textarea button canvas audio video head title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
#: Parts of a class, id or role that tell of boilerplate; of reader comments; whole names that do.
HINTS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs complementary cookie cookies consent contentinfo copyright footer form login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted related search share sharing sidebar signup social sponsor sponsored subscribe tags teaser teasers toolbar topbar warning widget widgets".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
WHOLE = frozenset("hidden header site-header page-header top-header site-info legal bottom".split())
#: Names that begin so describe a layout, not a part of it.
_LAYOUT = ("has-", "with-", "without-", "no-", "is-", "js-")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SELF_CLOSING = {"p": "p", "li": "li", "td": "td", "th": "td", "tr": "tr", "dt": "dd", "dd": "dd", "option": "option"}


@dataclass
class Block:
    text: str
    words: int
    density: float
    article: bool
    boiler: bool
    hint: bool
    comment: bool
    heading: bool
    row: list[float] = field(default_factory=list)


def told(attrs: str) -> tuple[bool, bool]:
    """Whether the class, id or role tells of boilerplate, of comments."""
    hint = comment = False
    for v in _HINT_ATTR.finditer(attrs):
        for name in (v[1] or v[2] or v[3] or "").split():
            low = name.lower()
            if low in WHOLE:
                hint = True
            elif not low.startswith(_LAYOUT):
                parts = {p.lower() for p in _PARTS.findall(name)}
                hint |= not parts.isdisjoint(HINTS)
                comment |= not parts.isdisjoint(COMMENTS)
    return hint or _HIDDEN.search(attrs) is not None, comment


def blocks(html: str) -> list[Block]:
    """The flat text blocks of a page with words, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # (element, what it adds)
    open_at: dict[str, list[int]] = {}  # places in the stack of each element's open ones
    depth = {"article": 0, "boiler": 0, "hint": 0, "heading": 0, "skip": 0, "link": 0, "comment": 0, "main": 0}
    kinds = tuple(depth)
    piece: list[tuple[str, bool]] = []
    outside = {"boiler": 0, "hint": 0}  # what encloses main
    at, n = 0, len(html)

    def flush() -> None:
        if piece:
            text = " ".join("".join(t for t, _ in piece).split())
            if text:
                linked = sum(len("".join(t.split())) for t, link in piece if link)
                by_main = {k: depth[k] > (outside[k] if depth["main"] else 0) for k in outside}
                out.append(Block(text, text.count(" ") + 1, linked / len(text.replace(" ", "")), depth["article"] > 0, by_main["boiler"], by_main["hint"], depth["comment"] > 0, depth["heading"] > 0))
            piece.clear()

    def add(marks: int, by: int) -> None:
        for i, k in enumerate(kinds):
            if marks >> i & 1:
                depth[k] += by

    shut: int | None = None
    while at < n:
        lt = html.find("<", at)
        end = n if lt < 0 else lt
        if end > at and not depth["skip"]:
            piece.append((unescape(html[at:end]), depth["link"] > 0))
        if lt < 0:
            break
        m = _TAG.match(html, lt) if _OPENS.match(html, lt) else None
        if m is None:
            if shut is not None and 0 <= shut < lt or shut is None:
                shut = html.find(">", lt)  # each > is looked for once, however many < come before it
            gt = shut if _OPENS.match(html, lt) else -1
            if gt >= 0:  # a quote that never closes: the tag ends at the next >
                m = _TAG.match(re.sub("[\"']", " ", html[lt : gt + 1]))
            if m is None:  # a lone < is text, and all the rest if no > follows
                end = n if shut < 0 else lt + 1
                if not depth["skip"]:
                    piece.append((unescape(html[lt:end]), depth["link"] > 0))
                at = end
                continue
            at = gt + 1
        else:
            at = m.end()
        if m[1]:
            stop = html.find("-->", lt + 2)
            at = n if stop < 0 else stop + 3
            continue
        if not m[3]:
            continue
        name, attrs = m[3].lower(), m[4] or ""
        if name == "br":
            piece.append((" ", False))
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if m[2]:
            # Closes the nearest open element of the name, with what it holds; a stray end tag does nothing.
            if open_at.get(name):
                i = open_at[name][-1]
                for inner, marks in stack[i:]:
                    open_at[inner].pop()
                    add(marks, -1)
                del stack[i:]
            continue
        if name in _SELF_CLOSING and stack and _SELF_CLOSING.get(stack[-1][0]) == _SELF_CLOSING[name]:
            inner, marks = stack.pop()
            open_at[inner].pop()
            add(marks, -1)
        if name in RAW:
            close = re.compile(f"</{name}[\\s/>]", re.I).search(html, at)
            if close is None:
                break
            at = html.find(">", close.start()) + 1 or n
            continue
        hint, comment = told(attrs) if attrs else (False, False)
        inside, body = depth["article"] > 0, name in ("article", "main")
        if name == "main" and not depth["main"]:
            outside = {k: depth[k] for k in outside}
        marks = body | (name in BOILER or name == "header" and not inside) << 1 | (hint and not body) << 2
        marks |= (len(name) == 2 and name[0] == "h" and name[1] in "123456") << 3 | (name in SKIPPED) << 4 | (name == "a") << 5
        marks |= comment << 6 | (name == "main") << 7
        if name == "body" or name == "html":
            marks = 0
        if not attrs.endswith("/") or name not in ("svg", "math"):
            open_at.setdefault(name, []).append(len(stack))
            stack.append((name, marks))
            add(marks, 1)
    flush()
    for i, b in enumerate(out):
        near = [out[j] if 0 <= j < len(out) else None for j in (i - 1, i + 1)]
        b.row = [float(b.article), float(b.boiler), float(b.hint), float(b.comment), float(b.heading), float(b.words), b.density]
        for x in near:
            b.row += [float(x.words) if x else 0.0, x.density if x else 0.0]
    return out


#: Marks a main block in the labelled pages.
MAIN = "\ue000"
_TEXTS = (
    "Yes.",
    "A line of nine words stands here by itself.",
    "A longer paragraph of the article tells in many plain words what happened that day and why it mattered to those who lived there, and it goes on.",
)
_LINKS = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li><li><a href='/c'>Latest news of today</a></li></ul>"
#: Page shapes: T is a title, P paragraphs, L a list of links, X a text that is no part of the article.
SHAPES = (
    "<nav>L</nav><div class='ad'>X</div><article><h1>T</h1>P</article><footer>X</footer>",
    "<header><a href='/'>Site</a><p>X</p></header><nav>L</nav><main><h1>T</h1>P<ul><li>\ue000first item</li><li>\ue000second item of it</li></ul><blockquote>\ue000A quote by someone.</blockquote></main><aside><h3>Read next</h3><p>X</p></aside><footer><p>X</p>L</footer>",
    "<div id='menu'>L</div><div><h2>T</h2>P</div><div class='comments'><p>X</p><p>X</p></div><div class='sidebar'><p>X</p></div>",
    "<div class='cookie-notice'>X</div><article class='post tags-list'><header><h1>T</h1><p>\ue000By a writer</p></header>P<aside><p>X</p></aside><form><p>X</p></form><div class='share'><a href='/s'>Share</a> X</div><footer>X</footer><section class='comments'><article class='comment'><p>X</p></article></section></article>",
    "<table><tr><td><a href='/1'>Links</a></td><td><a href='/2'>More links</a></td></tr></table>P<p><a href='/3'>Next page</a> <a href='/4'>Last page</a></p>",
    "<nav>L</nav><article><h1>T</h1><p>\ue000Yes.</p><p>\ue000<a href='/q'>A paragraph that is a link only</a></p>P</article><div class='related'><article><h3>X</h3><p>X</p></article></div>",
    "<form id='all'><div class='topbar'>X</div><main><h1>T</h1>P</main><p>X</p></form>",
    "<div class='has-sidebar'><div class='content'><h1>T</h1>P</div><aside>X</aside></div><footer>X</footer>",
    "<h1>T</h1>P<hr>L<footer><p>X</p></footer>",
    "<div role='navigation'>L</div><section><h2>T</h2>P<h3>\ue000Part two</h3>P</section><div id='newsletter'><form><p>X</p></form></div><div class='site-info'>X</div>",
    "<dialog>X</dialog><article>P<figure><figcaption>\ue000A picture of it</figcaption></figure><nav>L</nav><div class='related-posts'><h3>X</h3>L</div></article><div id='disqus_thread'><p>X</p></div>",
    "<p><a href='/1'>Home</a> | <a href='/2'>News and more</a> | <a href='/3'>Contact</a></p><h1>T</h1>P<p>More: <a href='/1'>An older story of the year</a>, <a href='/2'>another one</a></p>",
    "<article><h1>T</h1>P<p>\ue000Read it in <a href='/r'>the report of the office</a> now.</p></article><p>&copy; <a href='/x'>Imprint of the site</a></p>",
    "<p>T</p><p>\ue000See <a href='/z'>this page</a> for more on the whole matter.</p>P<p><a href='/1'>One</a><a href='/2'>Two</a></p>",
)


def labelled_page(shape: str, title: int, lengths: Sequence[int], other: int) -> str:
    """A page of a shape, with texts of given lengths."""
    paragraphs = "".join(f"<p>{MAIN}{_TEXTS[i]}</p>" for i in lengths)
    fill = {"T": MAIN + _TEXTS[title], "P": paragraphs, "L": _LINKS, "X": _TEXTS[other]}
    return "<body>" + re.sub(r"(?<=[>\s])[TPLX](?=[<\s])|^[TPLX](?=<)|(?<=>)[TPLX]$", lambda m: fill[m[0]], shape) + "</body>"


#: The small labelled table: pages whose main blocks begin with ``MAIN``.
LABELLED = tuple(labelled_page(s, t, p, x) for s in SHAPES for t, p, x in ((1, (2, 0, 2), 2), (0, (0,), 1), (1, (1, 2), 0), (0, (2,), 2), (1, (0, 1), 2)))


def grow(rows: list[list[float]], labels: list[int], depth: int) -> tuple:
    """A decision tree by Gini gain: (label,) or (feature, threshold, low, high)."""
    ones = sum(labels)
    best = (0.0, 0, 0.0)
    gini = lambda a, b: 2.0 * a * b / (a + b) if a + b else 0.0
    whole = gini(ones, len(labels) - ones)
    if depth and whole:
        for f in range(len(rows[0])):
            order = sorted(zip((r[f] for r in rows), labels, strict=True))
            low1 = 0
            for i in range(1, len(order)):
                low1 += order[i - 1][1]
                if order[i - 1][0] < order[i][0]:
                    gain = whole - gini(low1, i - low1) - gini(ones - low1, len(order) - i - ones + low1)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, (order[i - 1][0] + order[i][0]) / 2)
    if not best[0]:
        return (int(2 * ones > len(labels)),)
    _, f, t = best
    low = [i for i, r in enumerate(rows) if r[f] <= t]
    high = [i for i, r in enumerate(rows) if r[f] > t]
    return (f, t, *(grow([rows[i] for i in part], [labels[i] for i in part], depth - 1) for part in (low, high)))


@lru_cache(maxsize=4)
def tree(labelled: Sequence[str] = LABELLED, depth: int = 8) -> tuple:
    rows, labels = [], []
    for html in labelled:
        for b, plain in zip(blocks(html), blocks(html.replace(MAIN, "")), strict=True):
            rows.append(plain.row)
            labels.append(int(b.text.startswith(MAIN)))
    return grow(rows, labels, depth)


def keeps(node: tuple, row: list[float]) -> bool:
    while len(node) > 1:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return bool(node[0])


def main_text(html: str, model: tuple | None = None) -> str:
    model = model or tree()
    return "\n\n".join(b.text for b in blocks(html) if keeps(model, b.row))


def extract(pages: DataFrame, labelled: Sequence[str] = LABELLED, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every page."""
    model = tree(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            texts = [main_text(h.decode("utf-8", "replace"), model) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(pages, html_col, "html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def digests(extracted: DataFrame) -> DataFrame:
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
