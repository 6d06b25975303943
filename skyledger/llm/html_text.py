"""Main text of web pages by tag-path ratios (operator 2).

A page is cut into blocks: runs of text between block-level tags.  Each block hangs on a tag path,
its open elements from the root down (with class and id words, without inline formatting).  Over
all blocks of a path the text outside links and the punctuation are summed: their means a block are
the path's text ratio and punctuation ratio.  They are fused into one value, the value is smoothed
with those of the paths beside it (same parent, same grandparent, weighed by text) and, where its text is
not linked, with the highest of its article, or of the paths beside the list, table or quote it is in, and
multiplied by a prior: none for paths through menus, footers, forms and the like, more for those through an article.
An element that only its class, id or role words mark as such keeps its prior if it holds most of the
unlinked text of article and main elements, or most of the page's and no such element stands beside it
(for words of comments and related pages: the latter, and only if it has an article).
Paths whose value reaches a fixed part of the page's highest are content; their blocks are the text.

Defined results: a null or empty page, or one without text, gives the empty string.  Markup may be
broken: stray ``<`` is text, unclosed elements end with their parent (``p`` and list items with the
next one), unclosed comments and scripts run to the end.  Pages are read whole, one at a time.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Part of the highest path value that a content path reaches.
THRESHOLD = 0.1
#: Weights of the paths with the same parent and grandparent against a path's own.
SIBLINGS, COUSINS = 0.6, 0.15
#: Weight of the highest ratio of the article, or beside the list, table or quote, that a path is in.
#: Above THRESHOLD * (1 + SIBLINGS + COUSINS + itself), so no unlinked text of the article with the highest path falls below.
AROUND = 0.5
#: Times the value of paths through an article or main element.
ARTICLE_PRIOR = 3.0

# fixed values: elements by what they do in a page
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                    "strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
_BOILERPLATE = frozenset("head nav footer aside form button select option dialog menu noscript template svg math canvas object "
                         "script style textarea title iframe".split())
_ARTICLE = frozenset(["article", "main"])
_BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar "
                               "navigation breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar cookie cookies "
                               "consent notice gdpr popup modal overlay newsletter subscribe signup login search comment comments "
                               "commentlist disqus respond reply replies discussion share sharing social related recommended teaser "
                               "widget pagination pager copyright legal disclaimer skip hidden".split())
_TEXT_FLOW = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote figure figcaption details summary "
                       "pre p h1 h2 h3 h4 h5 h6".split())
# of those, the words of text that is not the page's own, however much of it there is
_FOREIGN_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion related recommended teaser".split())
_HIDDEN = "(hidden)"        # stands for the attribute
_CLOSED_BY_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                     "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article section div main body aside nav header footer form blockquote td th".split())

# A mark that another "<" (outside quotes) follows before its ">" is text: no attempt reads beyond that "<".
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"""
                    r"""|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…»«“”\"()。，、；：！？]")
_WORDS = re.compile(r"[a-z0-9]+")


class _Path:
    """One tag path: its prior and the sums over its blocks."""

    __slots__ = ("parent", "tag", "children", "prior", "blocks", "chars", "length", "marks", "in_article", "article", "around",
                 "hard", "marked", "own")

    def __init__(self, parent: "_Path | None", tag: str, words: frozenset[str]):
        self.parent, self.tag, self.children = parent, tag, {}
        self.in_article = parent is not None and parent.in_article or tag in _ARTICLE
        self.blocks = self.chars = self.length = self.marks = 0
        self.article = self if tag in _ARTICLE else parent and parent.article       # the nearest
        # the element that holds the outermost list, table or quote
        self.around = self if parent is None or tag not in _TEXT_FLOW else parent.around
        self.prior = ARTICLE_PRIOR if self.in_article else 1.0      # until set_priors
        exempt = tag in ("html", "body", "article", "main")
        self.hard = (parent is not None and parent.hard or tag in _BOILERPLATE or tag == "header" and not self.in_article
                     or not exempt and _HIDDEN in words)
        self.marked = "" if exempt else "foreign" if words & _FOREIGN_WORDS else "class" if words & _BOILERPLATE_WORDS else ""
        self.own = not words & _FOREIGN_WORDS       # what an article element must be to count as the page's own

    def child(self, tag: str, words: frozenset[str]) -> "_Path":
        if (tag, words) not in self.children:
            self.children[tag, words] = _Path(self, tag, words)
        return self.children[tag, words]


def _attribute_words(attributes: str) -> frozenset[str]:
    words: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name = name.lower()
        if name == "hidden":
            words.add(_HIDDEN)
        elif name == "aria-hidden":
            words.update([_HIDDEN] if "true" in value.lower() else [])
        elif name in ("class", "id", "role"):
            words.update(_WORDS.findall(value.lower()))
    return frozenset(words)


def blocks_of(page: str) -> list[tuple[_Path, str]]:
    """The page's blocks in order, each with its path; the paths hold the sums."""
    root = _Path(None, "", frozenset())
    open_tags: list[tuple[str, _Path]] = [("", root)]
    out: list[tuple[_Path, str]] = []
    parts: list[str] = []
    linked, in_link = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path = open_tags[-1][1]
                path.blocks += 1
                path.chars += max(len(text) - linked, 0)
                path.length += len(text)
                path.marks += len(_PUNCTUATION.findall(text))
                out.append((path, text))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text)

    at, last = 0, max(page.rfind(x) for x in (">", "<!--", "<![CDATA["))       # no mark begins beyond
    while at <= last and (m := _TOKEN.search(page, at)):
        add(page[at:m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:                                    # an end tag
            if tag in _INLINE:
                in_link -= tag == "a" and in_link > 0
            elif any(t == tag for t, _ in open_tags):
                flush()
                while open_tags.pop()[0] != tag:
                    pass
                in_link = 0
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in _RAW:
            flush()
            end = re.compile(rf"</{tag}\b[^<>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag in _INLINE:
            in_link += tag == "a"
        else:
            flush()
            if tag in _VOID or m[3].endswith("/") and tag not in _SCOPES and tag != "p":
                continue
            closes = _CLOSED_BY_ITSELF.get(tag, {"p"} if tag in _SCOPES or tag in ("h1", "h2", "h3", "h4", "h5", "h6", "pre", "figure") else set())
            for k in range(len(open_tags) - 1, 0, -1):
                if open_tags[k][0] in closes:
                    del open_tags[k:]
                    break
                if open_tags[k][0] in _SCOPES:
                    break
            in_link = 0
            open_tags.append((tag, open_tags[-1][1].child(tag, _attribute_words(m[3]))))
    add(page[at:])
    flush()
    return out


def set_priors(root: _Path) -> None:
    """Priors of 0 for the paths through boilerplate."""
    order = [root]
    for p in order:
        order.extend(p.children.values())

    def sums(skip: set[int]) -> tuple[dict[int, int], dict[int, int]]:
        """Unlinked text, and that in article and main elements, by path with all below it."""
        text: dict[int, int] = {}
        within: dict[int, int] = {}
        for p in reversed(order):
            open_here = not p.hard and id(p) not in skip
            text[id(p)] = (p.chars + sum(text[id(c)] for c in p.children.values())) if open_here else 0
            inner = sum(within[id(c)] for c in p.children.values())
            within[id(p)] = (text[id(p)] if p.tag in _ARTICLE and p.own else inner) if open_here else 0
        return text, within

    def above(p: _Path | None) -> set[int]:
        out = set()
        while p is not None:
            out.add(id(p))
            p = p.parent
        return out

    marked = [p for p in order if p.marked and not p.hard]
    if marked:
        text, _ = sums(set())
        articles = [a for a in order if a.tag in _ARTICLE and a.own and text[id(a)]]
        foreign = {id(p) for p in marked if p.marked == "foreign"}
        # an article counts where no foreign element stands above it
        free = [(a, above(a)) for a in articles]

        def alone(p: _Path) -> bool:
            up = above(p)
            return all(id(p) in over or id(a) in up or over & foreign for a, over in free)

        for p in marked:
            if p.marked == "foreign" and 2 * text[id(p)] > text[id(root)] and any(id(p) in over for _, over in free) and alone(p):
                foreign.discard(id(p))
        text, within = sums(foreign)
        zero = foreign | {id(p) for p in marked if p.marked == "class" and not (
            2 * within[id(p)] > within[id(root)] or 2 * text[id(p)] > text[id(root)] and alone(p))}
    else:
        zero = set()
    for p in order:
        if p.hard or id(p) in zero or p.parent is not None and p.parent.prior == 0:
            p.prior = 0.0


def path_values(paths: list[_Path]) -> dict[int, float]:
    """The smoothed, fused ratio of each path, times its prior; by id()."""
    fused = {id(p): (p.chars / p.blocks) * (1.0 + p.marks / p.blocks) for p in paths}
    by_parent: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    by_grandparent: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for p in paths:
        for sums, over in ((by_parent, p.parent), (by_grandparent, p.parent.parent if p.parent else None)):
            s = sums[id(over)]
            s[0] += fused[id(p)] * p.chars * (p.prior > 0)
            s[1] += p.chars * (p.prior > 0)

    highest: dict[tuple[str, int], float] = defaultdict(float)
    for p in paths:
        if p.prior > 0:
            for at in {("article", id(p.article)), ("around", id(p.around))}:
                highest[at] = max(highest[at], fused[id(p)])

    def mean(s: list[float]) -> float:
        return s[0] / s[1] if s[1] else 0.0

    def around(p: _Path) -> float:
        if p.article is not None and (p.article.tag == "article" or not any_article):
            return highest["article", id(p.article)] * p.chars / p.length
        return highest["around", id(p.around)] * p.chars / p.length if p.parent is not p.around else 0.0

    any_article = any(p.article is not None and p.article.tag == "article" and p.prior > 0 for p in paths)
    return {id(p): p.prior * (fused[id(p)] + SIBLINGS * mean(by_parent[id(p.parent)])
                              + COUSINS * mean(by_grandparent[id(p.parent.parent if p.parent else None)]) + AROUND * around(p)) for p in paths}


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by line feeds."""
    blocks = blocks_of(page or "")
    if blocks:
        root = blocks[0][0]
        while root.parent is not None:
            root = root.parent
        set_priors(root)
    values = path_values(list({id(p): p for p, _ in blocks}.values()))
    least = THRESHOLD * max(values.values(), default=0.0)
    return "\n".join(text for path, text in blocks if values[id(path)] > 0 and values[id(path)] >= least)


@F.pandas_udf(T.StringType())
def _main_text(batch: pd.Series) -> pd.Series:
    return batch.map(main_text, na_action=None)


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``df`` with column ``text``: the main text of each whole page."""
    return df.withColumn(text, _main_text(F.col(html)))
