"""A small DOM of a page: block elements, their features and their text blocks."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow "
                 "ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
# Without any text that a page shows; those but the head stand inside a run of text without ending it.
SILENT = frozenset("head script style noscript template textarea select option button svg iframe title annotation annotation-xml".split())
INLINE = MATH | SILENT - {"head"} | frozenset("a abbr acronym b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark object q s "
                                              "samp small span strike strong sub sup time tt u var wbr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote body details div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li "
                     "main menu nav ol p pre section table ul".split())
SIBLING_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
# Words of class, id and role attributes.
BOILER_WORDS = frozenset("ad ads advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
                         "footer form header login masthead menu menubar nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
                         "promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe "
                         "teaser toolbar widget widgets complementary contentinfo alert modal".split())
CONTENT_WORDS = frozenset("article articlebody body content entry hentry main maincontent post story text".split())
BOILER_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "dialog")
FEATURES = ["depth", "children", "log_text", "link_density", "text_per_tag", "stops_per_char", "own_share", "start", "page_share", "sibling_at", "siblings",
            "same_tag_siblings", "sibling_text", "parent_links", "is_boiler_tag", "is_content_tag", "is_paragraph", "is_heading", "is_list", "is_table",
            "boiler_word", "content_word", "above_boiler", "above_content", "is_page"]


class Page(HTMLParser):
    """Block elements in page order (parent, tag, attribute words) and runs of text with their element."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.tokens, self.runs = ["#page"], [-1], [frozenset()], []
        self._open = [("#page", 0, False)]  # name, number of the block element around what follows, is a link
        self._names = Counter(["#page"])  # of the open elements, so that a name that isn't open costs no search
        self._text: list[str] = []
        self._links = self._silent = self._anchors = 0
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self):
        text = " ".join("".join(self._text).split())
        if text:
            self.runs.append((self._open[-1][1], text, min(self._links, len(text))))
        self._text, self._links = [], 0

    def _pop_to(self, at: int):
        if self._open[-1][1] != self._open[at - 1][1]:
            self._flush()
        self._silent -= sum(n in SILENT for n, *_ in self._open[at:])
        self._anchors -= sum(link for *_, link in self._open[at:])
        for name, *_ in self._open[at:]:
            self._names[name] -= 1
            if not self._names[name]:
                del self._names[name]
        del self._open[at:]

    def _leave_head(self):
        if at := self._last({"head"}):
            self._pop_to(at)

    def _last(self, names, until=frozenset()):
        if not any(n in self._names for n in names):
            return 0
        for at in range(len(self._open) - 1, 0, -1):
            if self._open[at][0] in names:
                return at
            if self._open[at][0] in until:
                return 0
        return 0

    def handle_starttag(self, name, attrs):
        if name in VOID:
            if name == "hr":
                self._flush()
            elif name == "br":
                self._text.append(" ")
            return
        if name == "html" and len(self._open) > 1 or name == "head" and any(n not in ("#page", "html") for n, *_ in self._open):
            return  # again, or late: no element of its own
        if name == "body" or self._open[-1][0] == "head" and name not in IN_HEAD:
            self._leave_head()
        if name in CLOSES_P and (at := self._last({"p"}, SILENT | {"td", "th", "object"})):
            self._pop_to(at)
        if name in SIBLING_END and (at := self._last(SIBLING_END[name], SILENT | HOLDS[name])):
            self._pop_to(at)
        if name == "a" and (at := self._last({"a"}, self._blocks())):
            self._pop_to(at)
        block = self._open[-1][1]
        if name not in INLINE and not self._silent:
            self._flush()
            words = frozenset(w for k, v in attrs if k in ("class", "id", "role") and v for w in re.split(r"[^a-z0-9]+", v.lower()) if w)
            self.tag.append(name)
            self.parent.append(block)
            self.tokens.append(words)
            block = len(self.tag) - 1
        link = name == "a" and any(k == "href" for k, _ in attrs)
        self._silent += name in SILENT
        self._anchors += link
        self._open.append((name, block, link))
        self._names[name] += 1

    def _blocks(self):
        return {n for n in self._names if n not in INLINE}

    def handle_endtag(self, name):
        if at := self._last({name}, self._blocks() if name in INLINE - SILENT - {"object", "canvas"} else frozenset()):
            self._pop_to(at)

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)
        if name not in VOID:
            self.handle_endtag(name)

    def handle_data(self, data):
        if self._open[-1][0] == "head" and data.strip():
            self._leave_head()
        if not self._silent:
            self._text.append(data)
            if self._anchors:
                self._links += len(data.strip())


def marks(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """For each element: boilerplate or content by its tag or its attribute words."""
    boiler = np.array([t in BOILER_TAGS or bool(w & BOILER_WORDS) for t, w in zip(page.tag, page.tokens)])
    content = np.array([t in ("article", "main") or bool(w & CONTENT_WORDS) for t, w in zip(page.tag, page.tokens)])
    return boiler, content & ~boiler


def features(page: Page) -> np.ndarray:
    """One row of FEATURES for each block element."""
    n, parent = len(page.tag), np.array(page.parent)
    own, links, stops = (np.zeros(n) for _ in range(3))
    start, total = np.full(n, np.inf), 0
    for k, text, linked in page.runs:
        own[k] += len(text)
        links[k] += linked
        stops[k] += sum(map(text.count, ".,;:!?"))
        start[k] = min(start[k], total)
        total += len(text)
    text, link, stop, tags, children = own.copy(), links.copy(), stops.copy(), np.ones(n), np.zeros(n)
    for k in range(n - 1, 0, -1):  # children come after their parent
        p = parent[k]
        text[p] += text[k]
        link[p] += link[k]
        stop[p] += stop[k]
        tags[p] += tags[k]
        children[p] += 1
        start[p] = min(start[p], start[k])
    depth, at, same = np.zeros(n), np.zeros(n), np.zeros(n)
    boiler, content = marks(page)
    above_b, above_c = np.zeros(n, bool), np.zeros(n, bool)
    seen, kinds, beside = np.zeros(n), {}, np.zeros(n)
    for k in range(1, n):
        p = parent[k]
        depth[k], at[k] = depth[p] + 1, seen[p]
        seen[p] += 1
        kinds[p, page.tag[k]] = kinds.get((p, page.tag[k]), 0) + 1
        beside[p] += text[k]
        above_b[k], above_c[k] = above_b[p] or boiler[p], above_c[p] or content[p]
    for k in range(1, n):
        same[k] = kinds[parent[k], page.tag[k]] - 1
    up = np.maximum(parent, 0)
    density = link / np.maximum(text, 1)

    def is_in(*names):
        return [t in names for t in page.tag]
    cols = [depth, children, np.log1p(text), density, text / tags, stop / np.maximum(text, 1), own / np.maximum(text, 1),
            np.where(np.isinf(start), total, start) / max(total, 1), text / max(total, 1), at / np.maximum(children[up], 1), children[up], same,
            np.log1p((beside[up] - text) / np.maximum(children[up] - 1, 1)), density[up], is_in(*BOILER_TAGS), is_in("article", "main"),
            is_in("p", "blockquote", "pre"), is_in("h1", "h2", "h3", "h4", "h5", "h6"), is_in("ul", "ol", "li", "dl"), is_in("table", "tr", "td", "th"),
            np.array([bool(w & BOILER_WORDS) for w in page.tokens]), np.array([bool(w & CONTENT_WORDS) for w in page.tokens]), above_b, above_c,
            is_in("#page", "html", "body")]
    return np.column_stack([np.asarray(c, np.float32) for c in cols])
