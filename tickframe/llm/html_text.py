"""Main text of web pages as a maximum-scoring contiguous region.

A page is a sequence of words and tags. Words score positive and tags negative; how much
is learned from labelled pages: the log-odds of a kind of word or tag inside and outside
the article. Words in links and in parts that say what they are (menu, footer, advert ...)
are kinds of their own, and so are those parts' tags and the tags of an element that says it is the
article. One linear scan finds the contiguous region with the largest sum. Its blocks are the text,
without the parts inside it that are no article, such as adverts.

Parts are told by what they are, never by their size. Comments, notices, adverts and the like stay out. An element
whose name or class speaks of the page's layout (a form around the page, layout-with-sidebar, menu-open) may be
a wrapper: where nothing unmarked is the article, a mark does not reach into an ``article``, ``main`` or
post inside it; and where no unmarked paragraph is left either, the wrapper around the paragraphs is no mark.

Rules: null or empty pages have no text. Character references are decoded, white space in
a block becomes one space, blocks are joined by a line end; ``br`` is white space. Unclosed
and stray tags are read as a browser would, roughly: a closing tag closes what is open
inside it, or nothing; svg, math, object, template and noscript end with their parent. A quote counts
only right after an equals sign; a tag whose quote never closes ends at its first ``>``. Text of
formulas and of objects counts, svg, template and noscript are not shown. Of regions with equal sums the
first and shortest is taken. Reading takes time in proportion to the page, however deep it is.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm.common import small_batches
from tickframe.llm.labelled_pages import PAGES, START, STOP

_PIECE = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML: elements without content, with raw text, without visible text, and inside a line.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe"}
UNSHOWN = {"svg", "template", "noscript", "annotation", "annotation-xml"}
#: Tags that end an svg or math element around them, but not from inside these parts of one.
BREAKOUT = {"article", "blockquote", "body", "center", "dd", "div", "dl", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "img",
            "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
FOREIGN_PARTS = {"foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "math", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr"}
#: Elements, and words in class, id and role, that say a part is not the article.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "head"}
HINTS = {"ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies",
         "consent", "notice", "alert", "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "breadcrumb",
         "breadcrumbs", "sidebar", "aside", "widget", "header", "masthead", "footer", "copyright", "comment", "comments",
         "disqus", "respond", "reply", "replies", "share", "social", "related", "recommended", "newsletter", "subscribe",
         "signup", "login", "search", "pagination", "pager", "toolbar", "disclaimer", "complementary", "contentinfo"}
#: Of these the ones that a class of a wrapper may name, as it tells how the page is laid out.
LAYOUT = {"nav", "navbar", "navigation", "menu", "sidebar", "aside", "header", "masthead", "footer", "toolbar", "search", "widget",
          "overlay", "banner", "complementary", "contentinfo", "breadcrumb", "breadcrumbs", "login"}
ARTICLE = {"article", "main", "post", "entry", "story", "body"}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
COMMENT = {"comment", "comments", "reply", "replies"}

#: What speaks against an element: nothing; a form or a class like menu-open or layout-with-sidebar; a class like
#: comments-open; a class like site-footer; its name; a class like comments or cookie-bar; it is not shown.
NOT, WRAPPER, FIRM_WRAPPER, LAYOUT_PART, NAMED, FIRM, NOT_SHOWN = range(7)


def _class_kind(tokens: list[str]) -> tuple[int, bool]:
    """What the words of class, id and role say, and whether one of them names the article."""
    kind, core = NOT, False
    for token in tokens:
        parts = [w.lower() for w in _PARTS.findall(token)]
        hints = HINTS & set(parts)
        of_article = ARTICLE & set(parts)
        core = core or bool(of_article and not hints)
        # An entry-header belongs to the article, post-comments do not; has-sidebar says nothing of itself.
        if not hints or of_article and parts[-1] not in HINTS - {"header"} and not COMMENT & hints or parts[0] in ("has", "with", "no"):
            continue
        # The last word says what a thing is: a site-footer is a footer, a layout-with-sidebar is a layout.
        itself = parts[-1] in HINTS and not (len(parts) > 1 and parts[-2] in ("has", "with", "no", "and"))
        if hints - LAYOUT:
            its = FIRM if itself or len(parts) < 2 or parts[1] not in ("open", "enabled", "free", "active", "on") else FIRM_WRAPPER
        else:
            its = LAYOUT_PART if itself else WRAPPER
        kind = max(kind, its)
    return kind, core


def _kind_of(name: str, attrs: str, inside_article: bool) -> tuple[int, bool]:
    """What speaks against an element, and whether it says it is the article."""
    core = name in ("article", "main")
    tokens = [t for _, value in _NAMED.findall(attrs) for t in value.strip("\"'").split()] if attrs else []
    if name in ASIDE and not (name == "header" and inside_article):
        by_class = _class_kind(tokens)[0] if name == "form" else NOT
        return (by_class if by_class == FIRM else WRAPPER) if name == "form" else NAMED, False
    if attrs and _HIDDEN.search(attrs) and name not in ("html", "body"):
        return NOT_SHOWN, core
    if core or name in ("html", "body", "header"):
        a_comment = name == "article" and any((w := _PARTS.findall(t.lower())) and w[0] in COMMENT and "open" not in w for t in tokens)
        return (FIRM, False) if a_comment else (NOT, core)
    return _class_kind(tokens)


class _Elements:
    """The elements of a page in the order of their start tags; 0 is the page."""

    def __init__(self) -> None:
        self.name, self.parent, self.kind, self.core, self.words = ["page"], [0], [NOT], [False], [0]

    def add(self, name: str, parent: int, kind: int, core: bool = False) -> int:
        self.name.append(name)
        self.parent.append(parent)
        self.kind.append(kind)
        self.core.append(core)
        self.words.append(0)  # plain words of its own
        return len(self.name) - 1

    def settle(self) -> tuple[list[bool], list[bool]]:
        """For each element whether it is in a part that is no article, and whether it is in an unmarked core.

        Wrappers lose their mark. Three passes over the elements.
        """
        n = len(self.name)
        marks = [0] * n  # bits of the kinds around and of each element
        holds = list(self.words)
        has_core = [False] * n
        for i in range(1, n):
            marks[i] = marks[self.parent[i]] | (1 << self.kind[i] if self.kind[i] else 0)
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            holds[up] += holds[i]
            has_core[up] = has_core[up] or has_core[i] or self.core[i] and holds[i] > 0
        cores = [i for i in range(1, n) if self.core[i] and holds[i] and not self.kind[i]]
        reset = {i for i in cores if self.name[i] == "main"}
        if not any(marks[i] == 0 or i in reset for i in cores):
            paragraphs = [marks[i] for i in range(1, n) if self.name[i] in PARAGRAPHS and holds[i]]
            alone = 0 not in paragraphs
            allowed = 1 << WRAPPER | 1 << LAYOUT_PART | (1 << FIRM_WRAPPER if alone else 0)
            named = allowed | 1 << NAMED
            reset |= {i for i in cores if not marks[i] & ~(named if self.name[i] == "article" else allowed)}
            if alone and not reset and 1 << WRAPPER in paragraphs:
                self.kind = [NOT if k == WRAPPER else k for k in self.kind]
            elif alone and not reset:
                weak = 1 << WRAPPER | 1 << FIRM_WRAPPER
                if any(not m & ~weak for m in paragraphs):
                    self.kind = [NOT if k in (WRAPPER, FIRM_WRAPPER) else k for k in self.kind]
        under, inside = [NOT] * n, [False] * n
        for i in range(1, n):
            outer = under[self.parent[i]]
            under[i] = max(self.kind[i], NOT if i in reset and outer != NOT_SHOWN else outer)
            # The innermost core counts: main around articles says no more than they do.
            inside[i] = under[i] == NOT and (inside[self.parent[i]] or self.core[i] and not has_core[i])
        return [k != NOT for k in under], inside


def pieces_of(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, text, mark)``: ``word:`` kinds with their text, ``tag:`` kinds, ``end`` of a block, ``mark`` comments.

    A text run is one piece. Kinds of words: plain, link, aside. Kinds of tags: aside, core, or the name.
    """
    elements = _Elements()
    found = list(_pieces(page, elements))
    no_article, in_core = elements.settle()
    for kind, text, mark, at, touched in found:
        if kind == "text":
            yield "word:aside" if no_article[at] else "word:link" if mark else "word:plain", text, ""
        elif kind == "tag":
            aside = any(elements.kind[i] != NOT for i in touched)
            core = touched and in_core[touched[0]]
            yield "tag:aside" if aside else "tag:core" if core else f"tag:{mark}", text, ""
        else:
            yield kind, text, mark


class _Open:
    """The open elements, with what must be known of them at every tag held up to date."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.count: dict[str, int] = {}
        #: For each open svg and math its height and how many of the parts inside it are open that hold ordinary text.
        self.foreign: list[list[int]] = []

    def has(self, *names: str) -> bool:
        return any(self.count.get(x) for x in names)

    def push(self, name: str, element: int) -> None:
        if name in ("svg", "math"):
            self.foreign.append([len(self.stack), 0])
        elif name in FOREIGN_PARTS and self.foreign:
            self.foreign[-1][1] += 1
        self.stack.append((name, element))
        self.count[name] = self.count.get(name, 0) + 1

    def pop(self) -> tuple[str, int]:
        name, element = self.stack.pop()
        self.count[name] -= 1
        if name in ("svg", "math"):
            self.foreign.pop()
        elif name in FOREIGN_PARTS and self.foreign:
            self.foreign[-1][1] -= 1
        return name, element

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def element(self) -> int:
        return self.stack[-1][1] if self.stack else 0


def _pieces(page: str, elements: _Elements) -> Iterator[tuple[str, str, str, int, list[int]]]:
    """Pieces with the element that text is in and the elements that a tag starts or ends; fills ``elements``."""
    open_ = _Open()
    stack = open_.stack
    at, n = 0, len(page)
    lower = page.lower() if len(page.lower()) == n else page
    last_close = {x: lower.rfind(f"</{x}") for x in UNSHOWN}
    #: Height of the stack below the outermost element that is not shown, and below the outermost formula.
    unshown = formula = math.inf
    while at < n:
        m = _PIECE.match(page, at)
        at = m.end()
        if m["text"] is not None:
            if unshown < math.inf:
                continue
            inner, text, linked = open_.element(), html.unescape(m["text"]), open_.has("a")
            if not linked:
                elements.words[inner] += len(text.split())
            yield "text", text, "a" if linked else "", inner, []
        elif m["name"]:
            name = m["name"].lower()
            if name in BREAKOUT and not m["close"] and open_.foreign and not open_.foreign[-1][1]:
                root = open_.foreign[-1][0]
                while len(stack) > root:
                    open_.pop()
                unshown, formula = (math.inf if h >= root else h for h in (unshown, formula))
            quiet = min(unshown, formula) < math.inf
            if m["close"]:
                touched = []
                if open_.has(name):
                    while stack[-1][0] != name:
                        touched.append(open_.pop()[1])
                    touched.append(open_.pop()[1])
                    touched.reverse()
                    quiet = quiet and len(stack) >= min(unshown, formula)  # not where a parent ends
                    unshown, formula = (math.inf if h >= len(stack) else h for h in (unshown, formula))
            elif name in RAW and open_.foreign and m["attrs"].endswith("/"):
                continue
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at, touched = end.end() if end else n, [elements.add(name, 0, NOT if name == "title" else NOT_SHOWN)]
            else:
                if name not in INLINE and open_.top() == "p":
                    open_.pop()
                if name in ("li", "dt", "dd", "tr", "td", "th", "option") and open_.top() == name:
                    open_.pop()
                touched = [elements.add(name, open_.element(), *_kind_of(name, m["attrs"], open_.has("article", "main")))]
                if name not in VOID and not m["attrs"].endswith("/"):
                    # What is never closed does not hide the rest of its parent.
                    if name in UNSHOWN and last_close[name] >= at:
                        unshown = min(unshown, len(stack))
                    if name == "math":
                        formula = min(formula, len(stack))
                    open_.push(name, touched[0])
                if name in UNSHOWN and not quiet:
                    touched = [*touched, elements.add(name, 0, NOT_SHOWN)]
            if quiet or name == "math":
                continue
            yield "tag", " " if name == "br" else "", name, 0, touched
            if name not in INLINE:
                yield "end", "", "", 0, []
        elif m["comment"] is not None:
            yield "mark", "", m["comment"], 0, []


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Score of each kind of word and tag, from the labelled pages."""
    inside: Counter = Counter()
    outside: Counter = Counter()
    for page in PAGES:
        into = outside
        for kind, text, mark in pieces_of(page):
            if kind == "mark":
                into = {START: inside, STOP: outside}.get(f"<!--{mark}-->", into)
            elif kind != "end":
                into[kind] += len(text.split()) if kind.startswith("word") else 1
    total_in, total_out, kinds = sum(inside.values()), sum(outside.values()), set(inside) | set(outside)
    odds = {k: math.log((inside[k] + 0.5) / (total_in + 0.5 * len(kinds)))
            - math.log((outside[k] + 0.5) / (total_out + 0.5 * len(kinds))) for k in kinds}
    # A word never costs anything and a tag never gains.
    return {k: max(v, 0.01) if k.startswith("word") else min(v, -0.01) for k, v in odds.items()}


#: A tag that no labelled page has.
UNSEEN = -0.3


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous range with the largest sum (empty if none is positive)."""
    best, best_start, best_end, run, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, best_start, best_end = run, start, i + 1
    return best_start, best_end


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    pieces = [(k, t) for k, t, _ in pieces_of(page or "") if k != "mark"]
    weight = weights()
    scores = [weight.get(k, 0.0) * len(t.split()) if k.startswith("word") else 0.0 if k == "end" else weight.get(k, UNSEEN)
              for k, t in pieces]
    start, end = best_region(scores)
    blocks: list[str] = [""]
    for kind, text in pieces[start:end]:
        if kind == "end":
            blocks.append("")
        elif kind != "word:aside":
            blocks[-1] += text
    return "\n".join(filter(None, (" ".join(b.split()) for b in blocks)))


def extract(pages: DataFrame, key: list[str] | None = None, page: str = "html") -> DataFrame:
    """``key`` columns with ``text`` and ``n_chars`` (code points) for each page."""
    kept = pages.select(*(key or ["page_id", "url"]), F.col(page).alias("_page"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "_page"):
            found = [main_text(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.string()),
                                              pa.array([len(t) for t in found], pa.int64())], names=schema.names)

    return kept.mapInArrow(read, schema)
