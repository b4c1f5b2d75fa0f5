"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is read as one sequence of tags and words. Words score positive and tags negative; the best contiguous region is
found in one linear scan. The weights are log-likelihood ratios counted on labelled pages, in which the region of the
article is known: how much likelier a word or a kind of tag is inside the region than outside. Inside the region, words
in elements that name themselves as something else (menus, asides, adverts, notices, forms, comments) score nothing and
are left out of the text. Their tags count against the region, but for those that stand inside the main part. What
stands between two paragraphs, headings or other blocks of text of one element belongs to what these belong to, so tags
there cost nothing: tables, lists and lists of links in an article. Where <article>, <main>, an element named as content
or else the innermost element around most of the words holds the page's heading and enough of its words, plain words
after it count against the region, as readers' comments and side columns do that have no known name. A name is
read from the first and last part of a class, id, role or label ("site-footer", "comments-area"), not from one that tells
of a state or of what else is on the page ("has-sidebar", "modal-open").

Defined results: null or empty html gives an empty text, as does a page without words outside such elements. Pages cut
off in the middle are read to their end; a page is read as a whole whatever its length, in time that grows with it. Repeated rows and ties: each row by itself; of equally good regions the first.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import to_python

#: A quote begins a value only right after "=", so title=it's is read as HTML reads it.
_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?)*+"""
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|canvas|annotation|annotation-xml|textarea|select)\b" + _ATTRS + r"(?:(?<=/)>|>.*?(?:</\1\s*>|\Z)|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s>/]*)(" + _ATTRS + r")>?",
    re.S | re.I,
)
CLASS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[a-z]+")
ROLE_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b""", re.I)
#: A name that begins or ends so tells what else is on the page or a state, not what the element is ("has-sidebar", "modal-open").
ABOUT = frozenset("has have with without no not is tag category format status type hide show hidden visible open opened closed active inactive enabled disabled on off".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace".split())
#: A choice of this operator, not fixed by anything: what an element's tag, class, id or role says that it is, in the
#: languages of the corpus. It decides what is left out of a region; where the region ends, scores decide.
BY_TAG = {
    "head": "head", "title": "head", "nav": "menu", "menu": "menu", "footer": "footer", "aside": "aside", "form": "form", "button": "form",
    "fieldset": "form", "dialog": "notice", "header": "header", "article": "main", "main": "main",
}
BY_NAME = {
    "menu": "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager tabs toolbar skip toc menue navegacion",
    "footer": "footer foot colophon contentinfo copyright legal imprint fusszeile impressum pied pie",
    "header": "masthead topbar siteheader header banner kopfzeile entete cabecera",
    "aside": "sidebar aside widget widgets related recommended recommendations trending popular complementary teaser teasers tags share sharing social seitenleiste barre barra relacionados",
    "ad": "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion outbrain taboola werbung anzeige publicite publicidad",
    "comments": "comment comments disqus respond reply replies reactions kommentar kommentare commentaire commentaires comentario comentarios",
    "notice": "cookie cookies consent gdpr notice notices alert alertdialog popup modal newsletter subscribe subscription paywall disclaimer overlay dialog hinweis avis aviso",
    "form": "form search login signup signin register contact suche recherche busqueda",
    "main": "article content story entry post main",
}
NAMED = {name: kind for kind, names in BY_NAME.items() for name in names.split()}
OTHER = frozenset(("head", "menu", "footer", "header", "aside", "ad", "comments", "notice", "form"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements of text; inside the main part, only a name as an advert or as comments leaves one out.
TEXTUAL = HEADINGS | INLINE | {"p", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption"}
#: Most wrappers within each other that are looked for.
WRAPPERS = 64


def named(token: str) -> Iterator[str]:
    """The kinds that a class, id, role or label names by its first and its last part."""
    parts = PARTS.findall(token)
    if len(parts) > 1 and (parts[0] in ABOUT or parts[-1] in ABOUT):
        return
    for i in (0, -1)[: len(parts)]:
        found = NAMED.get(parts[i], "")
        if found and (i == 0 or not parts[i].startswith("widget")):
            yield found


def kind_of(tag: str, attributes: str, inside: str) -> str:
    """What the words right below this element are; inside: what those around it are."""
    kind = BY_TAG.get(tag, "")
    if kind == "header" and inside == "main":
        kind = ""  # an article's own header holds its title
    if inside in OTHER:
        return inside
    if kind in OTHER or tag in ("body", "html"):
        return kind or inside
    for value in CLASS.findall(attributes) if "=" in attributes else ():
        for token in value.lower().strip("\"'").split():
            for found in named(token):
                if inside == "main" and tag in TEXTUAL and found not in ("ad", "comments"):
                    continue
                if found == "main" or (found == "header" and inside == "main"):
                    kind = kind or found
                elif kind != "main" or found not in ("header", "form"):
                    return found
    return kind or inside


@dataclass(slots=True)
class Element:
    tag: str
    attributes: str
    parent: Element | None
    n_words: int = 0
    n_linked: int = 0
    closed: bool = False
    heading: bool = False
    main: bool = False
    kind: str = ""
    host: Element | None = None  # the outermost excluded element around it, or itself


def _walk(html: str) -> list[tuple[re.Match | None, int, Element | None, Element | None]]:
    """Steps (tag or None for text, place, element around, element opened) of a page, their elements measured and closed."""
    steps: list[tuple[re.Match | None, int, Element | None, Element | None]] = []
    top: Element | None = None
    at = 0
    still_open: Counter[str] = Counter()

    def leave(upto: Element) -> Element | None:
        e = top
        while True:
            still_open[e.tag] -= 1
            if e.tag == "a":
                e.n_linked = e.n_words
            if e.parent:
                e.parent.n_words += e.n_words
                e.parent.n_linked += e.n_linked
                e.parent.heading |= e.heading
                e.parent.main |= e.main
            if e is upto:
                return e.parent
            e = e.parent

    for m in TAG.finditer(html):
        if m.start() > at:
            steps.append((None, at, top, None))
            if top:
                top.n_words += len(html[at : m.start()].split())
        at = m.end()
        tag = (m[3] or "").lower()
        opened = None
        if tag and m[2]:
            steps.append((m, m.start(), top, None))
            if still_open[tag] > 0:
                e = top
                while e.tag != tag:
                    e = e.parent
                e.closed = True
                top = leave(e)
            continue
        if tag:
            if tag == "body" and still_open["head"] > 0:
                e = top
                while e.tag != "head":
                    e = e.parent
                top = leave(e)
            elif tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and top and top.tag == tag:
                top.closed = True
                top = leave(top)
            opened = Element(tag, m[4], top, heading=tag == "h1", main=tag in ("article", "main"))
            steps.append((m, m.start(), top, opened))
            if tag not in VOID and not m[4].endswith("/"):
                top = opened
                still_open[tag] += 1
            continue
        steps.append((m, m.start(), top, None))
    if at < len(html):
        steps.append((None, at, top, None))
        if top:
            top.n_words += len(html[at:].split())
    while top:
        top = leave(top)
    return steps


def _set_kinds(elements: list[Element]) -> None:
    """The kind of every element, given in page order.

    An excluded element is a wrapper, and no reason to leave its words out, if it holds most of the page's words, little
    that isn't excluded stands outside it, it isn't a list of links, and it is of a kind that pages wrap themselves in, is
    never closed or holds a heading of the first order or an article. <main> and role=main end an inherited kind; so does <article> that holds
    most of the page's words or whose excluded element is never closed.
    """
    total = sum(e.n_words for e in elements if e.parent is None and e.tag != "head") - sum(e.n_words for e in elements if e.parent and e.tag == "head")
    wrappers: set[int] = set()
    for _ in range(WRAPPERS):
        outside, mains, suspects = total, [], []
        for e in elements:
            inside = e.parent.kind if e.parent else ""
            if inside in OTHER and inside != "head":
                host = e.parent.host
                if e.tag == "main" or ROLE_MAIN.search(e.attributes) or (e.tag == "article" and (not host.closed or 2 * e.n_words > total)):
                    inside = ""
                    outside += e.n_words
            e.kind = kind_of(e.tag, e.attributes, inside)
            e.host = e.parent.host if e.kind in OTHER and inside in OTHER else e
            if e.kind in OTHER and inside not in OTHER:
                if id(e) in wrappers:
                    e.kind = inside
                elif e.kind != "head":
                    outside -= e.n_words
                    if 2 * e.n_words > total and 5 * e.n_linked < 3 * e.n_words:
                        suspects.append(e)
            if e.kind not in OTHER and (e.tag in ("article", "main") or ROLE_MAIN.search(e.attributes)):
                mains.append(e)
        found = [e for e in suspects if not mains and 4 * outside < total and (e.kind not in ("menu", "footer", "comments") or not e.closed or e.heading or e.main)]
        if not found:
            return
        wrappers.add(id(found[0]))


def _kept(elements: list[Element]) -> tuple[dict[int, int], int]:
    """Words of each element, and of the page, without those of excluded elements."""
    lost: Counter[int] = Counter()
    total = 0
    out = {}
    for e in reversed(elements):  # elements within come after those around them
        own = e.n_words if e.kind in OTHER else lost[id(e)]
        out[id(e)] = e.n_words - own
        if e.parent:
            lost[id(e.parent)] += own
        else:
            total += e.n_words - own
    return out, total


def _text_block(e: Element) -> bool:
    """A paragraph or heading with words."""
    return bool(e.n_words) and (e.tag == "p" or e.tag in HEADINGS)


def _inner(elements: list[Element], mains: set[int]) -> set[int]:
    """Elements between two blocks of text of one plain element, and excluded ones inside the main part. Inside mains any
    child counts as such a block that has words and isn't mostly links."""
    last: dict[int, int] = {}

    def block(e: Element) -> bool:
        return e.kind not in OTHER and (_text_block(e) or bool(id(e.parent) in mains and e.n_words and e.tag not in INLINE and 5 * e.n_linked < 3 * e.n_words))

    for i, e in enumerate(elements):
        if e.parent and block(e):
            last[id(e.parent)] = i
    out, begun = set(), set()
    for i, e in enumerate(elements):
        inside = e.parent.kind if e.parent else ""
        if id(e.parent) in out:
            out.add(id(e))
        elif e.parent and inside not in OTHER and ((e.kind in OTHER and inside == "main") or (id(e.parent) in begun and last.get(id(e.parent), -1) >= i)):
            out.add(id(e))
        if e.parent and block(e):
            begun.add(id(e.parent))
    return out


def _signature(e: Element) -> tuple[str, str]:
    return e.tag, " ".join(CLASS.findall(e.attributes))


def _mains(elements: list[Element]) -> set[int]:
    """The main part with all within it, if there is one: <article>, <main> and role=main; else elements named as content; else
    the innermost container of most words. It has to hold half of the words that aren't excluded, or a quarter and the
    page's heading; the container has to hold the heading, and no sibling of its like may follow it."""
    kept, total = _kept(elements)

    def whole(found: list[Element]) -> set[int]:
        own, inner, held, heading = {id(e) for e in found}, set(), 0, False
        for e in elements:
            if e.parent and (id(e.parent) in own or id(e.parent) in inner):
                inner.add(id(e))
            if id(e) in own and id(e) not in inner:
                held += kept[id(e)]
                heading |= e.heading
        return own | inner if found and (2 * held >= total or heading and 4 * held >= total) else set()

    plain = [e for e in elements if e.kind not in OTHER and e.n_words]
    marked = [e for e in plain if e.tag in ("article", "main") or ROLE_MAIN.search(e.attributes)]
    named_main = [e for e in plain if e.kind == "main" and e.tag not in TEXTUAL and (not e.parent or e.parent.kind != "main")]
    if out := whole(marked) or whole([e for e in named_main if e.heading] or named_main):
        return out
    # Innermost first; a container that a sibling of its like follows is a part of what is around both.
    follows: set[tuple[int, tuple[str, str]]] = set()
    repeated = set()
    for e in reversed(elements):
        if e.parent and e.n_words and e.kind not in OTHER:
            mark = (id(e.parent), _signature(e))
            if mark in follows:
                repeated.add(id(e))
            follows.add(mark)
    around = [e for e in plain if e.heading and 2 * kept[id(e)] > total and e.tag in ("div", "section") and id(e) not in repeated]
    return whole(around[-1:])


def tag_group(tag: str, closing: str, inside: str) -> str:
    if inside in OTHER:
        return "other " + ("a" if tag == "a" else "tag")
    if tag in HEADINGS:
        return "heading"
    if tag in ("p", "br", "a", "li", "div", "section", "article", "main", "body"):
        return ("/" if closing and tag in ("article", "main", "body", "div", "section") else "") + tag
    return "inline" if tag in INLINE else "block"


def tokens(html: str) -> Iterator[tuple[str, str, str, int]]:
    """(group, raw text, break before it, place in html): group is that of a tag, or "word <kind>" for the text up to the next tag."""
    steps, gap = _walk(html), ""
    elements = [e for *_, e in steps if e]
    _set_kinds(elements)
    mains, begun = _mains(elements), False
    inner = _inner(elements, mains)
    for i, (m, at, around, opened) in enumerate(steps):
        kind = around.kind if around else ""
        if m is None:
            begun = begun or bool(around and id(around) in mains)
            if kind in ("", "main") and begun and not (around and id(around) in mains):
                kind = "after"  # what follows the article, but isn't in it
            yield f"word {kind}", html[at : steps[i + 1][1] if i + 1 < len(steps) else len(html)], gap, at
            gap = ""
            continue
        tag = (m[3] or "").lower()
        if not tag:
            gap = gap or ("" if m[0].startswith("<!") else " ")
            continue
        if tag not in INLINE:
            gap = " "
        if opened and opened.kind in OTHER:
            around, kind = opened, opened.kind
        yield "inner" if around and id(around) in inner else tag_group(tag, m[2], kind), "", "", at


def fit(pages: Iterable[tuple[str, int, int]], smooth: float = 2.0) -> dict[str, float]:
    """Weights from labelled pages (html, start and end of the article): log-likelihood ratios, words at least 0.3, tags from -1.5 to -0.2."""
    counts = {True: Counter(), False: Counter()}
    for html, start, end in pages:
        for group, raw, _, at in tokens(html):
            counts[start <= at < end][group] += len(raw.split()) if raw else 1
    groups = set(counts[True]) | set(counts[False])
    totals = {k: sum(c.values()) + smooth * len(groups) for k, c in counts.items()}
    out = {}
    for g in groups:
        ratio = math.log((counts[True][g] + smooth) / totals[True]) - math.log((counts[False][g] + smooth) / totals[False])
        if g == "word after":
            out[g] = max(-2.0, min(ratio, -0.3))
        elif g.startswith("word "):
            out[g] = 0.0 if g[5:] in OTHER else max(0.3, min(ratio, 2.0))
        else:
            out[g] = 0.0 if g == "inner" else min(-0.2, max(ratio, -1.5))
    return out


def labelled_pages(n: int = 300, seed: int = 7) -> list[tuple[str, int, int]]:
    """Made pages of several layouts with the place of their article, for fit()."""
    r = random.Random(seed)
    say = lambda lo, hi: " ".join("".join(r.choice(("ta", "re", "no", "li", "sun", "der", "mo")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi)))
    links = lambda k: "".join(f'<li><a href="/{i}">{say(1, 2)}</a></li>' for i in range(k))
    out = []
    for _ in range(n):
        top = r.choice((f"<nav><ul>{links(r.randint(3, 9))}</ul></nav>", f'<div id="menu"><ul>{links(5)}</ul></div>', f"<header><a href='/'>{say(1, 3)}</a></header><ul>{links(6)}</ul>"))
        top += r.choice(("", f'<div class="ad">{say(3, 20)}</div>', f'<div class="cookie-notice"><p>{say(8, 30)}</p><button>{say(1, 1)}</button></div>'))
        body = [f"<h1>{say(2, 9)}</h1>"]
        for _ in range(r.randint(1, 14)):
            body.append(r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}</b></p>", "<p>{}<br>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<table><tr><td>" + say(1, 3) + "</td><td>{}</td></tr></table>", '<p>{} <a href="#">' + say(1, 3) + "</a></p>")).format(say(5, 90)))
            if r.random() < 0.12:
                body.append(r.choice((f"<h2>{say(2, 6)}</h2>", f'<div class="ad">{say(3, 12)}</div>', f"<aside><p>{say(4, 20)}</p></aside>", "<script>x()</script>")))
        opened, closed = r.choice((("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<div>", "</div>"), ('<div id="story"><div>', "</div></div>")))
        after = r.choice(("", f'<div class="comments"><p>{say(5, 40)}</p><p>{say(5, 40)}</p></div>', f"<section><h3>{say(1, 3)}</h3><p>{say(5, 40)}</p></section>" if opened in ("<article>", "<main>") else "", f'<aside class="sidebar"><ul>{links(5)}</ul></aside>', f"<ul>{links(8)}</ul>", f'<form action="/s"><label>{say(1, 3)}</label><input></form>'))
        foot = r.choice((f"<footer>&copy; {say(3, 14)}</footer>", f'<div class="footer"><a href="/">{say(1, 2)}</a> {say(2, 8)}</div>', f"<div><a href='/'>{say(1, 2)}</a> <a href='/b'>{say(1, 2)}</a></div>"))
        start = f"<!DOCTYPE html><html><head><title>{say(2, 8)}</title><style>p{{}}</style></head><body>{top}{opened}"
        inner = "".join(body)
        out.append((f"{start}{inner}{closed}{after}{foot}</body></html>", len(start), len(start) + len(inner)))
    return out


@cache
def standard_weights() -> dict[str, float]:
    return fit(labelled_pages())


def best_region(gains: list[float]) -> tuple[int, int]:
    """Start and end of the first contiguous region of greatest sum, in one scan; (0, 0) if none is positive."""
    best, here, begun, region = 0.0, 0.0, 0, (0, 0)
    for i, gain in enumerate(gains):
        if here <= 0:
            here, begun = 0.0, i
        here += gain
        if here > best:
            best, region = here, (begun, i + 1)
    return region


def scored(html: str, weights: dict[str, float]) -> tuple[list[float], list[tuple[str, str, str]]]:
    """What each tag and text of a page gains, and its group, raw text (none for a tag) and break before it."""
    gains, found = [], []
    for group, raw, gap, _ in tokens(html):
        if raw:
            gains.append(len(raw.split()) * weights.get(group, -0.3 if group == "word after" else 0.3 if group[5:] not in OTHER else 0.0))
        else:
            gains.append(weights.get(group, 0.0 if group == "inner" else -1.0))
        found.append((group, raw, gap))
    return gains, found


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The article's text: blanks inside a block as one space, blocks in page order joined by one space."""
    gains, found = scored(html or "", weights)
    start, end = best_region(gains)
    parts = [gap if group[5:] in OTHER else gap + unescape(raw) for group, raw, gap in found[start:end] if raw]
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, html: str = "html", weights: dict[str, float] | None = None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text and n_chars (code points of text) for every page."""
    use = weights or standard_weights()
    rows = pages.select(*keep, F.col(html).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), use) for x in batch.column(len(keep))]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return to_python(rows, run, f"{kinds}, text string, n_chars long")
