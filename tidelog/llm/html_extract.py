"""Main-text extraction from HTML by tag-path ratios.

A page's text blocks are grouped by their root-to-leaf tag path (block-level tags with their first class). For each
path the text length and the punctuation per block are added up; both are smoothed over the neighbouring paths in
page order and fused into one score. Paths that reach a threshold (LAMBDA standard deviations, the best path always
does) select the content blocks. Elements that HTML itself or a role keeps apart from the text (navigation, forms, asides)
are out beforehand. Words of a class or id are no such thing: a path with one has its score cut to NAMED of it, so that a
banner or a comment falls below the threshold, and a page whose article is so named keeps it, as its best path.
Content sits together, so the page's content element is the deepest one that holds all selected blocks, or the article
or main element around it; its blocks, short ones too, are the result, but for those of a named element within it below
the threshold, and those that are mostly link text without a sentence.

White space, line breaks (br) too, becomes one space inside a block; blocks are joined by a newline in page order.
Character references are decoded. Unclosed and misnested tags follow the usual rules: a block-level tag closes an
open paragraph, an end tag closes what is open inside its element, and what a cut-off page leaves open ends with it. A
button, map, object or the like without its end tag ends with its parent, and the blocks after it are text.

Defined results: a null or empty page, or one without content, gives the empty text; a tag or comment that is cut
off at the end of a page is markup and is dropped; repeated rows give a row each; a null page_id passes through; an
empty table gives no rows; further columns are ignored. Whole pages are read, one row at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame

#: How many standard deviations of the path scores a content path reaches.
LAMBDA = 0.8
#: What is left of a path's score if an element on it is named like boilerplate.
NAMED = 0.02
#: A named element with this part of the page's text isn't taken for boilerplate by its name.
MOST = 0.75
#: Weights of a path's neighbours in page order, by distance.
SMOOTH = tuple(exp(-0.5 * (d / 0.6) ** 2) for d in range(3))

#: Fixed values of HTML: elements whose content is no markup and no text, elements whose content is no text of the page
#: (if they are closed; else only what is directly in them), void elements, blocks, and boilerplate elements.
RAW = {"script", "style", "iframe", "title", "textarea"}
EMBEDDED = {"noscript", "template", "svg", "math", "object", "select", "canvas", "audio", "video", "button", "datalist", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "frame", "keygen"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "th", "tr", "table", "tbody", "thead", "tfoot", "ul", "ol", "dl", "pre", "blockquote", "figcaption", "figure", "caption", "summary"}
AWAY = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar", "status"}
#: Words of class and id names that mark boilerplate.
MARKS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "banner", "sponsor", "sponsored", "promo", "promotion", "promoted", "sidebar", "sidebars", "menu", "menus", "nav", "navbar", "navigation", "topbar",
    "breadcrumb", "breadcrumbs", "footer", "foot", "masthead", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "alert", "newsletter",
    "subscribe", "subscription", "signup", "login", "signin", "register", "form", "search", "related", "recommended", "recommendations", "share", "sharing", "social", "popup", "modal", "overlay", "widget", "widgets", "pagination", "pager",
    "copyright", "legal", "disclaimer", "toolbar", "skip", "hidden", "outbrain", "taboola", "paywall", "tags", "toc",
}
JOINED = ("sidebar", "advert", "cookie", "newsletter", "comment-", "-comment", "breadcrumb", "navbar", "promo-", "sponsor")

# <!--> and <!---> are comments without text.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:-->|\Z))|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
PUNCTUATION = re.compile(r"[.,;:!?¿¡。，；：！？、…]")


class Element:
    """An open element. path numbers its root-to-leaf tag path; held is the nearest embedded element around it or it."""

    __slots__ = ("articles", "away", "gone", "held", "inside", "label", "named", "parent", "path", "resume", "tag", "text", "within")

    def __init__(self, tag: str, label: str, parent: Element | None, away: bool, path: int, named: bool = False):
        self.tag, self.label, self.parent, self.away, self.path, self.text, self.inside = tag, label, parent, away, path, 0, False
        #: Whether it is an article or main element or in one; the text of such elements in it, counted later.
        self.within: bool = tag in ("article", "main") or parent is not None and parent.within
        self.articles = 0
        #: Whether an embedded element around it, or it, was closed; known at the end of the page.
        self.gone = False
        #: The nearest element from it upwards that is named like boilerplate.
        self.named: Element | None = self if named else parent and parent.named
        self.held: Element | None = self if tag in EMBEDDED else parent and parent.held
        #: Of an embedded element: the block and link depth that go on after its end.
        self.resume: tuple[Block | None, int] | None = None


class Block:
    __slots__ = ("element", "linked", "parts")

    def __init__(self, element: Element):
        self.element, self.parts, self.linked = element, [], 0


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text.strip() else {}


def _is_away(tag: str, attributes: dict[str, str], parent: Element | None) -> bool:
    if tag in AWAY or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    if tag == "header" and (parent is None or not parent.within):
        return True
    if tag in ("html", "body", "main"):
        return False
    return "display:none" in attributes.get("style", "").replace(" ", "").lower()


def _is_named(tag: str, attributes: dict[str, str]) -> bool:
    """Whether class or id words mark the element as boilerplate."""
    if tag in ("html", "body", "main"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if not names.strip():
        return False
    words = {w.lower() for w in WORDS.findall(names)}
    if tag == "article":
        words &= {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo"}
    return bool(words & MARKS) or (tag != "article" and any(j in names.lower() for j in JOINED))


def blocks_of(html: str) -> tuple[list[Block], list[Element]]:
    """The page's text blocks and elements in order; an element's path is that of its block-level ancestors.

    The places of open elements are kept by tag, so an end tag finds its element, or that there is none, at once.
    """
    root = Element("", "", None, False, 0)
    elements, paths = [root], {}
    stack: list[Element] = [root]
    places: dict[str, list[int]] = {}
    blocks: list[Block] = []
    current: Block | None = None
    links = 0
    at, end = 0, len(html)

    def opened(tag: str, label: str, away: bool, named: bool = False) -> None:
        up = stack[-1]
        stack.append(Element(tag, label, up, away, paths.setdefault((up.path, label), len(paths) + 1), named))
        elements.append(stack[-1])
        places.setdefault(tag, []).append(len(stack) - 1)

    def shut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def add(text: str) -> None:
        nonlocal current
        if not text:
            return
        if current is None or current.element is not stack[-1]:
            if text.isspace():
                return
            current = Block(stack[-1])
            blocks.append(current)
        text = unescape(text)
        current.parts.append(text)
        if links:
            current.linked += len(text.strip())

    while at < end:
        mark = html.find("<", at)
        if mark < 0:
            add(html[at:])
            break
        found = TOKEN.match(html, mark)
        if not found:
            rest = html[mark : mark + 2]
            add(html[at:mark])
            if rest in ("<", "</") and mark + len(rest) == end:
                break
            add("<")
            at = mark + 1
            continue
        add(html[at:mark])
        at = found.end()
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in VOID:
            if tag == "br" and current is not None:
                current.parts.append(" ")
            elif tag == "hr":
                current = None
            continue
        if tag in RAW:
            if not closing and not found[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else end
            continue
        if tag in EMBEDDED:
            if not closing:
                if not found[3].rstrip().endswith("/"):
                    opened(tag, tag, False)
                    stack[-1].resume, current, links = (current, links), None, 0
                continue
            k = last(tag)
            if k and k > last("body", "html", "article", "main"):
                stack[k].away = True
                current, links = stack[k].resume
                shut(k)
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in BLOCK and tag != "head":
            continue
        current = None
        if closing:
            k = last(tag)
            if k and (tag not in ("p", "li", "b") or k > last("table", "body", "html", "article", "main")):
                shut(k)
            links = 0
            continue
        if stack[-1].tag == "p":
            shut(len(stack) - 1)
        same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}.get(tag, ())
        while stack[-1].tag in same:
            shut(len(stack) - 1)
        if tag in ("html", "body") and places.get(tag):
            continue
        if tag == "body" and places.get("head"):
            shut(places["head"][0])
        attributes = _attributes(found[3])
        kind = (attributes.get("class", "").split() or [""])[0]
        opened(tag, f"{tag}.{kind}" if kind else tag, tag == "head" or stack[-1].away or _is_away(tag, attributes, stack[-1]), _is_named(tag, attributes))
        links = 0
    for element in elements:  # those around an element come before it
        held = element.held
        element.gone = held is not None and (held.away or held.parent.gone)
    return blocks, elements


def _is_dropped(element: Element) -> bool:
    """Whether an element is boilerplate, an embedded one or inside of such; an unclosed one has only its own text."""
    return element.tag in EMBEDDED or element.away or element.gone


def path_scores(rows: list[tuple[int, int, int, bool]]) -> dict[int, float]:
    """The smoothed, fused score of each path from (path, characters, punctuation, named) of the blocks in page order."""
    sums: dict[int, list[int]] = {}
    named = set()
    for path, chars, marks, by_name in rows:
        if by_name:
            named.add(path)
        total = sums.setdefault(path, [0, 0, 0])
        total[0] += 1
        total[1] += chars
        total[2] += marks
    order = list(sums)
    raw = [[sums[p][k] / sums[p][0] for p in order] for k in (1, 2)]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            near = [(SMOOTH[abs(d)], values[i + d]) for d in range(-2, 3) if 0 <= i + d < len(values)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    text, marks = smooth(raw[0]), smooth(raw[1])
    return {p: text[i] * (1 + marks[i]) * (sums[p][1] > 0) * (NAMED if p in named else 1) for i, p in enumerate(order)}


def _clear_names(elements: list[Element], rows: list[tuple]) -> None:
    """A name says nothing of an element with MOST of the page's text, unless an article or main element is beside it."""
    for _, element, text, _ in rows:
        element.text += len(text)
    for element in reversed(elements[1:]):
        element.articles += element.text if element.tag in ("article", "main") else 0
        element.parent.text += element.text
        element.parent.articles += element.articles
    total, whole = elements[0].text, elements[0].articles
    for element in elements[1:]:
        own = element.named is element
        if own and element.text >= MOST * total:
            own = element.articles < whole
        element.named = element if own else element.parent.named
    for element in elements:
        element.text = 0


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks, elements = blocks_of(html)
    rows = []
    for block in blocks:
        text = " ".join("".join(block.parts).split())
        if text and not _is_dropped(block.element):
            rows.append((block, block.element, text, len(PUNCTUATION.findall(text))))
    if not rows:
        return ""
    _clear_names(elements, rows)
    scores = path_scores([(e.path, len(text), marks, e.named is not None) for _, e, text, marks in rows])
    values = list(scores.values())
    mean = sum(values) / len(values)
    limit = min(LAMBDA * (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5, max(values))
    total = 0
    for _, element, text, _ in rows:
        if scores[element.path] >= limit:
            element.text += len(text)
            total += len(text)
    for element in reversed(elements[1:]):
        element.parent.text += element.text
    # Going down from the root, elements come before those inside them.
    content = elements[0]
    for element in elements[1:]:
        if element.parent is content and element.tag not in TEXTUAL and element.text == total:
            content = element
    around = content
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    content = around or content
    for element in elements:
        element.inside = element is content or (element.parent is not None and element.parent.inside)

    def kept(block: Block, element: Element, text: str, marks: int) -> bool:
        if not element.inside or (block.linked >= 0.7 * len(text) and not marks):
            return False
        within = element.named is not None and element.named is not content and element.named.inside
        return scores[element.path] >= limit or not within

    return "\n".join(text for block, element, text, marks in rows if kept(block, element, text, marks))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
