"""Main text of web pages by a maximum-scoring run of tokens.

A page becomes tokens in page order: words and tags.  Words score positive,
tags negative; how much comes from labelled pages (those whose markup names its
main element: ``article`` or ``main``), as log odds of a word's or tag's element
inside and outside of it.  Kadane's linear scan finds the contiguous region of
the best sum.  The label serves to fit alone: to the scan, those two are ``div``.

Parts that are never content carry no words, wherever they stand: elements that
say so by name (scripts, menus, forms), hidden ones, and those with a class, id
or role that labelled pages hold outside of the main element or that is known
for it (``HINTS``: notices, adverts, comments of readers).  A class that they
hold inside overrules that list, and a paragraph needs every word of one of its
classes to be known for it.

Defined cases: null or empty html gives an empty text; a page without any
content word too; unclosed or stray tags are tolerated, in time linear in the
page; no page is dropped; repeated rows give repeated results; extra columns are
ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never hold main text. Fixed values.
DROP = frozenset("script style noscript template head title nav header footer aside form button select option textarea iframe object embed svg canvas dialog menu".split())
#: Elements without an end tag. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text; all others end a block. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is raw text. Fixed values.
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template"))
#: Elements that a block element's start closes, and elements that close when their parent does. Fixed values.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Words of class, id or role that mark what isn't main text. Fixed values.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment comments disqus reply replies responses respond cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login search pagination pager tags toolbar skip copyright gdpr complementary contentinfo dialog form".split())
MAIN = frozenset(("article", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

#: Elements of text: their tags score least below 0, and a hint has to be all of a class to drop them.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre br hr li ul ol dl dt dd table tr td th tbody thead figure figcaption".split()) | INLINE
#: Elements that end at the next of their kind in the same list or table. Fixed values.
ITEMS = frozenset(("li", "dt", "dd", "tr", "td", "th", "option"))
LISTS = ("ul", "ol", "dl", "table", "select", "menu")


class Model(NamedTuple):
    """Scores by element of a word and of a tag, and the log odds of class words."""

    words: dict[str, float]
    tags: dict[str, float]
    classes: dict[str, float]


#: Scores of elements that labelled pages don't show.
WORD, LINK_WORD, TAG, TEXT_TAG, DROPPED = 1.0, -0.5, -1.0, -0.1, -0.1
#: Log odds from which a class counts as outside (below) or inside (above) of the main element.
OUTSIDE, INSIDE = -3.0, 0.0
#: Words or tags that labelled pages must show before their odds count.
SEEN = 50
DEFAULT_WEIGHTS = Model({}, {}, {})


class Token(NamedTuple):
    name: str  # the element: of a tag its own, of a run of text the nearest that isn't inline, or "a" in a link
    text: str | None  # None for tags
    block: int
    dropped: bool
    inside: bool | None  # of the main element; None for its own tags

    def size(self) -> int:
        return 1 if self.text is None else len(self.text.split())


class _Open(NamedTuple):
    name: str
    dropped: bool
    inside: bool
    block_at: int  # position of the nearest element up to this one that isn't inline
    classes: tuple[str, ...]
    words_before: tuple[int, int]  # outside and inside


def class_words(attrs: str) -> list[list[str]]:
    """The words of each class, id and role."""
    return [x for m in _ATTR.finditer(attrs) for value in m[2].strip("\"'").lower().split() if (x := [w for w in re.split(r"[^a-z]+", value) if w])]


def _is_dropped(name: str, attrs: str, values: list[list[str]], classes: dict[str, float]) -> bool:
    if name in DROP:
        return True
    if name in ("html", "body", "main", "article"):
        return False
    if attrs and _HIDDEN.search(attrs):
        return True
    known = lambda w: classes.get(w, OUTSIDE if w in HINTS else INSIDE) <= OUTSIDE
    for parts in values:
        if not {"has", "with", "no", "is", "not"} & set(parts) and (all if name in TEXT_TAGS else any)(known(w) for w in parts):
            return True
    return False


class Page:
    """One pass over a page: its tokens, and by class word how many words stand in its elements outside and inside of the main one."""

    def __init__(self, page: str, classes: dict[str, float]):
        self.tokens: list[Token] = []
        self.classes: dict[str, list[int]] = {}
        self.stack: list[_Open] = []
        self.open: dict[str, list[int]] = {}  # where elements of a name stand in the stack
        self.words, self.block, self.known = [0, 0], 0, classes
        self._read(page)
        self._pop(0)

    def _text(self, run: str) -> None:
        top = self.stack[-1] if self.stack else _Open("", False, False, -1, (), (0, 0))
        name = "a" if self.open.get("a") else self.stack[top.block_at].name if top.block_at >= 0 else ""
        self.tokens.append(Token(_plain(name), _html.unescape(run), self.block, top.dropped, top.inside))
        self.words[top.inside] += self.tokens[-1].size()

    def _pop(self, k: int) -> None:
        while len(self.stack) > k:
            e = self.stack.pop()
            self.open[e.name].pop()
            for w in e.classes:
                n = self.classes.setdefault(w, [0, 0])
                for i in (0, 1):
                    n[i] += self.words[i] - e.words_before[i]

    def _last(self, *names: str) -> int:
        """Where the innermost open element of the names stands, or -1."""
        return max((self.open[x][-1] for x in names if self.open.get(x)), default=-1)

    def _end(self, name: str) -> None:
        k = self._last(name)
        # an inline end tag doesn't reach over a block's start
        if k >= 0 and not (name in INLINE and self.stack[-1].block_at > k):
            self._pop(k)

    def _start(self, name: str, attrs: str) -> None:
        if name in CLOSES_P:
            k = self.stack[-1].block_at if self.stack else -1
            if k >= 0 and self.stack[k].name == "p":
                self._pop(k)
        elif name in ITEMS:
            k = self._last(name)
            if k > self._last(*LISTS):
                self._pop(k)
        elif name == "a" and self.open.get("a"):
            self._end("a")

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = _TOKEN.search(page, at)
            if not m:
                self._text(page[at:])
                return
            if at < m.start():
                self._text(page[at : m.start()])
            at = m.end() if m.end() > m.start() else m.start() + 1
            name, attrs = (m[2] or "").lower(), m[3] or ""
            if not name:
                continue
            outer = self.stack[-1] if self.stack else None
            was_inside = outer is not None and outer.inside
            if m[1]:
                dropped, inside = outer is not None and outer.dropped, was_inside  # as what it ends
                self._end(name)
            else:
                self._start(name, attrs)
                top = self.stack[-1] if self.stack else None
                values = class_words(attrs) if attrs else []
                dropped = (top is not None and top.dropped) or _is_dropped(name, attrs, values, self.known)
                inside = (top is not None and top.inside) or name in MAIN
                if name not in VOID and not attrs.endswith("/"):
                    k = len(self.stack)
                    self.stack.append(_Open(name, dropped, inside, k if name not in INLINE else top.block_at if top else -1, tuple({w for v in values for w in v}), (self.words[0], self.words[1])))
                    self.open.setdefault(name, []).append(k)
                    if name in RAW:
                        close = _CLOSE[name].search(page, at)
                        at = close.start() if close else end
            if name not in INLINE:
                self.block += 1
            self.tokens.append(Token(_plain(name), None, self.block, dropped, None if name in MAIN else inside))


_CLOSE = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}


def _plain(name: str) -> str:
    """The label is no feature."""
    return "div" if name in MAIN else name


def count(page: str | None) -> dict[tuple[str, str], list[int]]:
    """Of a labelled page, by (what, name): how often outside and inside of the main element."""
    read = Page(page or "", {})
    out: dict[tuple[str, str], list[int]] = {}
    if any(t.inside for t in read.tokens):
        for t in read.tokens:
            if not t.dropped and t.inside is not None:
                out.setdefault(("tag" if t.text is None else "word", t.name), [0, 0])[t.inside] += t.size()
        for w, n in read.classes.items():
            got = out.setdefault(("class", w), [0, 0])
            got[0] += n[0]
            got[1] += n[1]
        out["all", ""] = [read.words[0], read.words[1]]
    return out


def model(counts: dict[tuple[str, str], list[int]]) -> Model:
    """Log odds of what was seen often enough; words that carry text score at least a little above 0, tags below."""
    out = Model({}, {}, {})
    total = {what: [sum(n[i] for (x, _), n in counts.items() if x == what) for i in (0, 1)] for what in ("word", "tag", "all")}
    for (what, name), (outside, inside) in counts.items():
        if outside + inside >= SEEN and what != "all":
            n, m = total["all" if what == "class" else what]
            score = math.log((inside + 0.5) / (m + 1)) - math.log((outside + 0.5) / (n + 1))
            if what == "class":
                out.classes[name] = score
            elif what == "word":
                out.words[name] = min(score, -0.1) if name == "a" else max(0.5, min(score, 4.0))
            else:
                # a line break or emphasis never outweighs a word
                out.tags[name] = max(TEXT_TAG if name in TEXT_TAGS else -6.0, min(score, -0.05))
    return out


def learn(pages) -> Model:
    """The model of labelled pages."""
    counts: dict[tuple[str, str], list[int]] = {}
    for page in pages:
        for key, n in count(page).items():
            got = counts.setdefault(key, [0, 0])
            got[0] += n[0]
            got[1] += n[1]
    return model(counts)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Kadane's scan: the first shortest [a, b) of the greatest sum, empty if none is above 0."""
    best, a, b, run, start = 0.0, 0, 0, 0.0, 0
    for k, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, a, b = run, start, k + 1
    return a, b


def score(t: Token, w: Model) -> float:
    if t.text is None:
        return DROPPED if t.dropped else w.tags.get(t.name, TEXT_TAG if t.name in TEXT_TAGS else TAG)
    if t.dropped:
        return 0.2 * DROPPED * min(t.size(), 20)  # a region may span it
    return w.words.get(t.name, LINK_WORD if t.name == "a" else WORD) * t.size()


def extract(page: str | None, w: Model) -> str:
    if not page:
        return ""
    got = Page(page, w.classes).tokens
    a, b = best_region([score(t, w) for t in got])
    blocks: dict[int, list[str]] = {}
    for t in got[a:b]:
        if t.text is not None and not t.dropped:
            blocks.setdefault(t.block, []).append(t.text)
    return " ".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", fit_pages: int = 2000) -> Model:
    """The model of the labelled pages among the ``fit_pages`` of smallest id (a documented bound)."""
    labelled = pages.where(F.col(html_col).rlike("(?i)<(article|main)[\\s>]"))
    # only ids are ordered; the pages of the bounded number that is left are fetched by them
    ids = labelled.select(F.col(id_col).alias("page_id")).orderBy("page_id").limit(fit_pages).distinct()
    sample = labelled.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).join(F.broadcast(ids), "page_id", "left_semi")

    def counted(batches):
        counts: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for page in batch.column("html").to_pylist():
                for key, n in count(page).items():
                    got = counts.setdefault(key, [0, 0])
                    got[0] += n[0]
                    got[1] += n[1]
        rows = [(*key, *n) for key, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["what", "name", "outside", "inside"])

    rows = sample.mapInArrow(counted, "what string, name string, outside long, inside long").groupBy("what", "name").agg(F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    # names of elements and classes of a bounded number of pages
    return model({(r["what"], r["name"]): [r["outside"], r["inside"]] for r in rows.collect()})


def extract_pages(pages: DataFrame, w: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and its length in code points, for every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = [extract(page, w) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
