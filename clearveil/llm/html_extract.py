"""Main text of web pages by tag-path ratios.

Text blocks are grouped by their path of structural tags from the root.  Each path gets the amount of
text it holds and the punctuation in it, per node, less what is linked or marked by its class as not
of the article.  The two series are smoothed over the order in which paths first occur and among
paths with one parent, fused as a product, and thresholded: a block is kept if its path's score is
high enough, and for no other reason.

Elements that are never article text by their tag, role or attribute (menus, page headers and
footers, sidebars, forms, scripts, what is not shown ...) have no path at all.  Class names are weaker:
they count as whole names, and an element so marked that holds most of the page's text and its
article or title is a wrapper.

Pages are read in one pass over their bytes, by the rules of browsers where markup is broken; the
work grows with the length of the page, whatever it holds.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var label".split())
SKIPPED = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea button form nav footer aside menu dialog fieldset xmp noembed noframes".split())
#: Their content is no markup up to the end tag of the same name.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of class names and ids of what is not the article; a name is one, ends in one ("cookie-notice"),
#: or begins with one and says what it holds ("comment-list").
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toc footer masthead topbar toolbar share sharing related recommended comment comments commentlist disqus replies copyright disclaimer hidden".split()
)
STATES = frozenset("has with no without is not show shows open closed".split())
HOLDERS = frozenset("area bar block body box container content form inner item items link links list section text thread wrap wrapper".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first ends an open one of the same line, as far out as the second.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "option": (("option",), ("select",)),
}
P_WITHIN = ("button", "td", "th", "li", "div", "article", "section", "body", "blockquote")
PUNCTUATION = re.compile(r"[,.;:!?。，、；：！？…]")
#: Share of the best score from which a path is content.
THRESHOLD = 0.1
#: What a path takes over of the best score among paths with its parent.
KIN = 0.5
#: Share of the page's text from which an element is its wrapper, whatever its class.
WRAPPER = 0.5

_NEXT = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\t\n\f\r />]*))")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""[\t\n\f\r /]*(?:(>)|([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >"'][^\t\n\f\r >]*)|(?=[>])|(?P<open>["'])))?)""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.I) for t in RAW}
_STYLE = re.compile(r"display\s*:\s*none", re.I)


class Block(NamedTuple):
    path: int  # number of its path
    text: str
    linked: int  # characters inside links
    mark: int  # innermost element around it that its class marks, -1 if none


class Page(NamedTuple):
    blocks: list[Block]
    paths: list[tuple[int, str]]  # parent's number and tag
    marks: list[int]  # of each marked element the next one around it
    cores: list[int]  # innermost marked element around each article, main or h1, -1 if none


def _tokens(html: str):
    """(kind, tag, attributes or text): "text", "start", "end".  A tag or comment that never ends takes the rest with it."""
    at, n = 0, len(html)
    while at < n:
        m = _NEXT.search(html, at)
        if m is None:
            yield "text", "", html[at:]
            return
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        if m[1]:
            if html.startswith((">", "->"), m.end()):  # an empty comment
                at = html.index(">", m.end()) + 1
                continue
            end = _COMMENT_END.search(html, m.end())
            if end is None:
                return
            at = end.end()
        elif m[2]:
            at = html.find(">", m.end()) + 1
            if not at:
                return
        else:
            tag, attributes, at = m[4].lower(), [], m.end()
            while True:
                a = _ATTRIBUTE.match(html, at)
                if a is None or a["open"]:
                    # a quote that never ends, or the end of the page inside a tag
                    return
                at = a.end()
                if a[1]:
                    break
                attributes.append((a[2].lower(), next((v for v in a.groups()[2:5] if v is not None), None)))
            yield ("end" if m[3] else "start"), tag, attributes
            if tag in RAW and not m[3]:
                end = _RAW_END[tag].search(html, at)
                if end is None:
                    return
                at = end.start()


def _marked(name: str) -> bool:
    parts = [p for p in re.split(r"[-_]+", name.lower()) if p]
    if not parts or parts[0] in STATES:
        return False
    return parts[-1] in MARKS or (parts[0] in MARKS and all(p in HOLDERS for p in parts[1:]))


class _Open:
    __slots__ = ("tag", "skips", "path", "mark", "live")

    def __init__(self, tag: str, skips: bool, path: int, mark: int) -> None:
        self.tag, self.skips, self.path, self.mark, self.live = tag, skips, path, mark, True


class _Reader:
    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # of open elements in the stack, by tag
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.numbers: dict[tuple[int, str], int] = {}
        self.marks: list[int] = []
        self.cores: list[int] = []
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.skipping = self.linked = 0
        self.link = False

    def end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                top = self.stack[-1] if self.stack else None
                self.blocks.append(Block(top.path if top else 0, text, self.linked, top.mark if top else -1))
            self.text, self.linked = [], 0

    def push(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        above, mark, path = self.stack[-1] if self.stack else None, -1, 0
        if above:
            mark, path = above.mark, above.path
        skips = self.skips(tag, attributes)
        if not skips and tag not in ("html", "body", "main", "article") and any(_marked(v) for k, x in attributes if k in ("class", "id") and x for v in unescape(x).split()):
            self.marks.append(mark)
            mark = len(self.marks) - 1
        if tag in ("article", "main", "h1") and not (skips or self.skipping):
            self.cores.append(mark)
        if tag not in INLINE:
            path = self.numbers.setdefault((path, tag), len(self.paths))
            if path == len(self.paths):
                self.paths.append((above.path if above else 0, tag))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Open(tag, skips, path, mark))
        self.skipping += skips

    def shut(self, e: _Open) -> None:
        """The element ends; it may stay in the stack below elements that it does not hold."""
        if e.live:
            e.live = False
            self.skipping -= e.skips
            self.places[e.tag].pop()

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.shut(self.stack.pop())

    def place(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        at = self.place(tag)
        if at >= 0 and all(self.place(t) <= at or t == tag for t in within):
            self.end_block()
            self.pop_to(at)

    def start(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            if tag == "a":
                self.link = True
            elif any(k in ("class", "id", "role", "hidden", "aria-hidden", "style") for k, _ in attributes):
                self.push(tag, attributes)
            return
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.end_block()
            return
        self.end_block()
        if tag in CLOSES_P:
            self.close("p", P_WITHIN)
        if tag in HEADINGS and self.stack and self.stack[-1].tag in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        same, within = ENDS.get(tag, ((), ()))
        for t in same:
            self.close(t, within)
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        elif tag == "br":
            self.text.append(" ")
        elif tag in INLINE:
            at = self.place(tag)
            # no further out than the enclosing block
            if at >= 0 and all(e.tag in INLINE for e in self.stack[max(at, len(self.stack) - 64) :]):
                self.shut(self.stack[at])
                while self.stack and not self.stack[-1].live:
                    self.stack.pop()
        elif tag not in VOID:
            self.end_block()
            if tag in ("article", "body", "html") or self.place(tag) >= 0:
                self.link = False
            self.close(tag)

    def skips(self, tag: str, attributes: list[tuple[str, str | None]]) -> bool:
        if tag in SKIPPED:
            return True
        if tag == "header" and self.place("article") < 0 and self.place("main") < 0:
            return True
        if tag in ("html", "body", "main", "article"):
            return False
        for name, value in attributes:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "role" and value and value.strip().lower() in ROLES:
                return True
            if name == "style" and value and _STYLE.search(value):
                return True
        return False

    def data(self, text: str) -> None:
        if not self.skipping:
            text = unescape(text)
            self.text.append(text)
            if self.link:
                self.linked += len(text.strip())


def read(html: str) -> Page:
    r = _Reader()
    for kind, tag, value in _tokens(html):
        if kind == "text":
            r.data(value)
        elif kind == "start":
            r.start(tag, value)
        else:
            r.end(tag)
    r.end_block()
    return Page(r.blocks, r.paths, r.marks, r.cores)


def wrappers(page: Page) -> set[int]:
    """Marked elements that hold most of the page's text and its article, main element or first
    heading, or, where a page has none of these, three blocks or more."""
    held, blocks, cores = ([0] * len(page.marks) for _ in range(3))
    for b in page.blocks:
        if b.mark >= 0:
            held[b.mark] += len(b.text)
            blocks[b.mark] += 1
    for c in page.cores:
        if c >= 0:
            cores[c] += 1
    for i in range(len(held) - 1, -1, -1):  # an element comes after those around it
        if (above := page.marks[i]) >= 0:
            held[above] += held[i]
            blocks[above] += blocks[i]
            cores[above] += cores[i]
    least = WRAPPER * sum(len(b.text) for b in page.blocks)
    return {i for i, n in enumerate(held) if n >= least and (cores[i] or (not page.cores and blocks[i] >= 3))}


def outside(page: Page) -> list[bool]:
    """Of each block whether a marked element, wrappers aside, holds it."""
    wraps, marked = wrappers(page), [False] * len(page.marks)
    for i, above in enumerate(page.marks):
        marked[i] = i not in wraps or (above >= 0 and marked[above])
    return [b.mark >= 0 and marked[b.mark] for b in page.blocks]


def smoothed(x: np.ndarray) -> np.ndarray:
    """A third of each neighbour's value joins a value's own."""
    if len(x) < 2:
        return x
    side = np.zeros(len(x))
    side[1:] += x[:-1]
    side[:-1] += x[1:]
    return (x + side / 3) / (1 + 2 / 3)


def path_scores(page: Page, marked: list[bool]) -> dict[tuple[int, bool], float]:
    """Fused text and punctuation ratio of each path, apart for what lies in marked elements.

    A path whose text is mostly linked or marked scores nothing; others take KIN of the best score of
    paths that stand beside them or beside what is around them, so headings, lists and tables go with
    the paragraphs of their article.
    """
    paths: dict[tuple[int, bool], list[float]] = {}
    for b, m in zip(page.blocks, marked, strict=True):
        own = paths.setdefault((b.path, m), [0.0, 0.0, 0.0, 0.0])
        own[0] += len(b.text)
        own[1] += min(b.linked, len(b.text))
        own[2] += len(PUNCTUATION.findall(b.text))
        own[3] += 1
    if not paths:
        return {}
    rows = np.array(list(paths.values()))
    free = ~np.array([m for _, m in paths]) & (rows[:, 1] * 2 <= rows[:, 0])
    amount = np.where(free, rows[:, 0] - rows[:, 1], 0)
    text, marks = smoothed(amount / rows[:, 3]), smoothed(np.where(free, rows[:, 2], 0) / rows[:, 3])
    # amount enters too: one long path outweighs many short ones of a single node
    fused = np.where(free, text * (1 + marks) * np.log1p(amount), 0.0)
    kin = [0.0] * len(page.paths)
    for (path, _), s in zip(paths, fused.tolist(), strict=True):
        above = max(page.paths[path][0], 0)
        kin[above] = max(kin[above], s)
    for i in range(1, len(kin)):  # a path comes after its parent
        kin[i] = max(kin[i], kin[page.paths[i][0]])
    return {k: max(s, KIN * kin[max(page.paths[k[0]][0], 0)]) if ok else 0.0 for k, s, ok in zip(paths, fused.tolist(), free.tolist(), strict=True)}


def main_text(html: str, threshold: float = THRESHOLD) -> str:
    page = read(html)
    marked = outside(page)
    scores = path_scores(page, marked)
    best = max(scores.values(), default=0.0)
    return "\n".join(b.text for b, m in zip(page.blocks, marked, strict=True) if best and scores[b.path, m] >= threshold * best)


def extracted(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) for every row.

    Null and empty pages, and pages without content, give an empty text.  Broken markup is read as
    far as it goes: a tag, comment or script that never ends takes the rest of the page with it.  Rows
    do not influence each other; repeated rows and null ids stay; other columns are not read.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [main_text(x) if x else "" for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col(page_id).cast("long"), F.col(url), F.col(html)).mapInArrow(run, "page_id long, url string, text string, n_chars long")
