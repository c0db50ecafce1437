"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of tokens: words, which score positive, and tags, which
score negative.  The weight of each kind of tag is learnt from labelled pages as
the log ratio of how often it stands outside and inside the main content, so a
tag that hardly occurs in content costs much and a paragraph little.  One linear
scan finds the contiguous run with the largest sum.  Elements that are never text
(scripts, styles, forms and the like) and boilerplate nested in the run are left
out, character references are decoded, and blocks are joined by line feeds.

An element is boilerplate by its tag, by its role, or by its class or id: names
that labelled pages show outside of their content only are learnt, and
``BOILERPLATE_NAMES`` stand for what no labelled page may show.  Structure comes before
names: neither tag nor name makes an element boilerplate that holds all of the page's
``main`` and ``article`` elements, nor a form with ``WORDS_PER_CONTROL`` words or more
for each control.  A name never makes ``html``, ``body``, ``main`` or ``article``
boilerplate, nor an element that holds all of the page's words in elements of its own,
nor, where there is no ``main`` or ``article``, more than three quarters of them
(replies, and what consists of links, excepted).

A page whose markup names one ``article``, or else one ``main``, outside of boilerplate
is read by that: tags in it cost nothing, so that lists, tables and short blocks at its
ends stay, and words outside of it score nothing.  Where more than twice as many words
stand outside, the markup is not believed, and the learnt weights decide alone.

Labelled pages: pages whose markup names their content with one ``article`` or
``main`` element are labels for the weights.  The weights are fitted on at most
``SAMPLE_PAGES`` of them, of any length, chosen by hash, a documented bound.  They
are read on the executors; only how often each kind of tag stands inside and
outside, and how many pages each trial finds, reach the driver.  Pages without
such markup are read by the same weights.

Defined results: a null or empty html and a page without words give the empty
text; markup cut off at the end is read as far as it goes; an unknown character
reference stays as written; repeated rows give equal texts; an empty table gives
no rows; without labelled pages a fixed small cost for every tag is used.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled pages the weights are fitted on, at most.
SAMPLE_PAGES = 2000
#: What a word scores; words in elements that are boilerplate score nothing.
WORD = 1.0
#: Multiples of the log ratio that are tried; the one that finds the content of
#: most labelled pages is kept, of equal ones the least.
SCALES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
#: Cost of a tag when nothing is known.
PLAIN_COST = 1.0

#: Elements whose content is no text (fixed values of HTML).
RAW = frozenset({"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes"})
#: Elements without content (fixed values of HTML).
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Elements that run on within a block (fixed values of HTML).
INLINE = frozenset(
    {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
)
#: Elements that a list item, term or choice may leave open when its next sibling
#: begins (fixed values of HTML, with the inline ones).
LOOSE = INLINE | {"p", "div", "address"}
#: Elements whose end may be left out, and the open siblings that they end.
SIBLINGS = {"li": ("li",), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Parts of tables, the open ones that they end, and within what.
CELLS = {"td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table", "thead", "tbody", "tfoot"))}
#: Elements that are boilerplate wherever they stand.
BOILERPLATE = frozenset({"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "head"})
#: Roles that mark boilerplate (fixed values of the accessibility standard).
ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert", "toolbar"})
#: Class names and ids that mark boilerplate: by themselves, as the last part of a
#: name ("site-footer"), or before a part that names a container ("comment-list").
BOILERPLATE_NAMES = frozenset(
    {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "widget"}
)
CONTAINERS = frozenset({"area", "bar", "block", "body", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "link", "links", "list", "panel", "post", "posts", "reply", "section", "slot", "text", "thread", "unit", "wrap", "wrapper"})
#: Before the last part of a name these say how a page is laid out ("has-sidebar").
LAYOUT = frozenset({"has", "with", "no", "without", "is", "hide", "show", "full", "left", "right"})
#: Elements that no name makes boilerplate.
CONTENT = frozenset({"html", "body", "main", "article"})
#: What a reader fills in or presses (fixed values of HTML).
CONTROLS = frozenset({"input", "select", "textarea", "button"})
#: A form of so many words for each control is no form but what a page is written in.
WORDS_PER_CONTROL = 50
#: Names of what may well be longer than the article.
REPLIES = frozenset({"comment", "comments", "disqus"})
#: Elements that give a text its shape; where labelled pages don't show one outside of
#: boilerplate, it costs this.
SHAPE = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption"})
SHAPE_COST = 0.25
#: A learnt name stands on so many elements outside of labels, and on so many times
#: more than inside.
LEAST_MET, TIMES_OUTSIDE = 5, 8

_ATTRIBUTE = r"[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|(?=>)))?+"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*))", re.I)
_HIDDEN = re.compile(r"(?:^|[\s/\"'])type\s*=\s*[\"']?hidden", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


@dataclass(slots=True)
class Token:
    """A tag (``kind`` set) or a run of text between tags."""

    kind: str
    name: str
    end: bool
    text: str
    words: int
    #: The innermost open element, as its number in page order; -1 for none.
    inside: int
    boiler: bool = False
    #: Class names and ids of a tag that begins.
    names: tuple[str, ...] = ()
    #: Whether it is something to fill in or press.
    control: bool = False


@dataclass(slots=True)
class Element:
    within: int
    tag: str
    names: tuple[str, ...]
    roles: tuple[str, ...]
    words: int = 0
    own_words: int = 0
    #: Words in links, things to fill in, ``main`` and ``article`` elements, words in those.
    links: int = 0
    controls: int = 0
    contents: int = 0
    held: int = 0


def is_boilerplate_name(name: str) -> bool:
    parts = _PART.findall(name)
    if not parts:
        return False
    *before, last = parts
    if last in BOILERPLATE_NAMES:
        return not (before and before[-1] in LAYOUT)
    return last in CONTAINERS and any(p in BOILERPLATE_NAMES for p in before)


def tokens(html: str, learnt: frozenset[str] = frozenset()) -> list[Token]:
    """Tags and texts in page order.  ``kind`` of a tag is its name, with its
    class and id if it has any, and "/" before it if it closes."""
    out: list[Token] = []
    elements: list[Element] = []
    at, n = 0, len(html)
    open_: list[tuple[str, str, int]] = []
    # Where in open_ each name stands, and what is not inline, or not loose.
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    walls: list[int] = []

    def last(*names: str) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def inside() -> int:
        return open_[-1][2] if open_ else -1

    def end(k: int) -> None:
        """Close open_[k] and all in it; each element is closed once."""
        for o in open_[k:]:
            places[o[0]].pop()
        del open_[k:]
        for some in (blocks, walls):
            while some and some[-1] >= k:
                some.pop()

    def text(piece: str) -> None:
        if piece:
            out.append(Token("", "", False, piece, 0 if piece.isspace() else len(piece.split()), inside()))

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            k = last(name)
            kind, where = "/" + name, inside()
            if k >= 0:
                kind, where = "/" + open_[k][1], open_[k][2]
                end(k)
            out.append(Token(kind, name, True, "", 0, where))
            continue
        found = [(a.lower(), _CAMEL.sub("-", b or c or d).lower().split()) for a, b, c, d in _NAMED.findall(m[3])] if m[3] else []
        names = tuple(sorted({x for a, b in found if a != "role" for x in b}))
        kind = " ".join((name, *names))
        if name in RAW:
            stop = _RAW_END[name].search(html, at)
            out.append(Token(kind, name, False, "", 0, inside(), control=name == "textarea"))
            at = n if stop is None else stop.end()
            continue
        if name not in VOID:
            if name == "p":  # a paragraph ends an open one
                if blocks and open_[blocks[-1]][0] == "p":
                    end(blocks[-1])
            elif name in SIBLINGS:
                if walls and open_[walls[-1]][0] in SIBLINGS[name]:
                    end(walls[-1])
            elif name in CELLS and (k := last(*CELLS[name][0])) > last(*CELLS[name][1]):
                end(k)
            if name not in INLINE:
                blocks.append(len(open_))
            if name not in LOOSE:
                walls.append(len(open_))
            places.setdefault(name, []).append(len(open_))
            elements.append(Element(inside(), name, names, tuple(x for a, b in found if a == "role" for x in b)))
            open_.append((name, kind, len(elements) - 1))
        control = name in CONTROLS and not (name == "input" and _HIDDEN.search(m[3] or ""))
        out.append(Token(kind, name, False, "", 0, inside(), names=names, control=control))
    _mark(out, elements, learnt)
    return out


def _mark(found: list[Token], elements: list[Element], learnt: frozenset[str]) -> None:
    """Which tokens are in boilerplate.  An element stands after what holds it."""
    for t in found:
        if t.inside >= 0:
            elements[t.inside].controls += t.control
            elements[t.inside].words += t.words
            elements[t.inside].own_words += t.words
    for e in reversed(elements):
        if e.tag == "a":
            e.links = e.words
        if e.tag in ("main", "article"):
            e.contents += 1
            e.held = e.words
        if e.within >= 0:
            up = elements[e.within]
            up.words += e.words
            up.links += e.links
            up.controls += e.controls
            up.contents += e.contents
            up.held += e.held
    top = [e for e in elements if e.within < 0]
    contents, held = sum(e.contents for e in top), sum(e.held for e in top)

    def down(own) -> list[bool]:
        """What an element or one that holds it is."""
        out = [False] * len(elements)
        for i, e in enumerate(elements):
            out[i] = (e.within >= 0 and out[e.within]) or own(e)
        return out

    def count(*but: list[bool]) -> int:
        return sum(t.words for t in found if t.words and not any(t.inside >= 0 and b[t.inside] for b in but))

    # The page's articles count if what else the page has to say isn't far longer.
    there = contents and 2 * held >= count(down(lambda e: e.tag in BOILERPLATE), down(lambda e: e.tag in ("main", "article")))

    def wraps(e: Element) -> bool:
        return bool(there) and e.contents == contents or e.tag == "form" and e.words >= WORDS_PER_CONTROL * max(1, e.controls)

    tagged = down(lambda e: e.tag in BOILERPLATE and not wraps(e))
    whole = count(tagged)

    def named(e: Element) -> bool:
        if e.tag in CONTENT or wraps(e) or (e.words >= whole and not e.own_words):
            return False
        if any(r in ROLES for r in e.roles) or any(x in learnt for x in e.names):
            return True
        said = [x for x in e.names if is_boilerplate_name(x)]
        # A name doesn't make most of a page boilerplate, but for replies and menus.
        most = not contents and 4 * e.words > 3 * whole and 2 * e.links < e.words
        return any(not most or not REPLIES.isdisjoint(_PART.findall(x)) for x in said)

    boiler = [False] * len(elements)
    for i, e in enumerate(elements):
        boiler[i] = tagged[i] or (e.within >= 0 and boiler[e.within]) or named(e)
    for t in found:
        t.boiler = t.inside >= 0 and boiler[t.inside]


def label(found: list[Token]) -> tuple[int, int] | None:
    """Where the one article (or main) element outside of boilerplate lies: first and
    last token in it."""
    for name in ("article", "main"):
        begins = [i for i, t in enumerate(found) if t.name == name and not t.end and not t.boiler]
        if len(begins) == 1:
            own = found[begins[0]].inside
            ends = [i for i, t in enumerate(found) if t.end and t.name == name and t.inside == own]
            return begins[0] + 1, (ends[0] if ends else len(found)) - 1
    return None


def marked(found: list[Token]) -> tuple[int, int] | None:
    """The label, unless far more is said outside of it."""
    span = label(found)
    if span is None:
        return None
    inside = sum(t.words for t in found[span[0] : span[1] + 1] if not t.boiler)
    outside = sum(t.words for t in found if not t.boiler) - inside
    return span if inside and 2 * inside >= outside else None


def _kind(t: Token) -> str:
    """Tags inside boilerplate are kinds of their own: a list in a menu says
    nothing about lists."""
    return "~" + t.kind if t.boiler else t.kind


@dataclass
class Weights:
    """What each kind of tag costs; kinds not met cost what their bare name does,
    ``plain`` at most."""

    cost: dict[str, float] = field(default_factory=dict)
    plain: float = PLAIN_COST
    #: Class names and ids that are boilerplate, as labelled pages show.
    names: frozenset[str] = frozenset()

    def of(self, t: Token) -> float:
        if not t.kind:
            return 0.0 if t.boiler else WORD * t.words
        got = self.cost.get(_kind(t))
        if got is None:
            # What is left out anyway tells nothing about the text around it.
            skipped = t.boiler or t.name in RAW
            plain = min(self.plain, SHAPE_COST) if self.cost and t.name in SHAPE else self.plain
            got = 0.0 if skipped else min(plain, self.cost.get(("/" if t.end else "") + t.name, plain))
        return -got


def best_run(found: list[Token], weights: Weights, within: tuple[int, int] | None = None) -> tuple[int, int]:
    """First and last token of the contiguous run with the largest sum, the
    earliest of equal ones; (0, -1) if no run is positive.  Where a page marks its
    content (``within``), tags in there cost nothing and words elsewhere score nothing."""
    best, span, total, begin = 0.0, (0, -1), 0.0, 0
    for i, t in enumerate(found):
        if total <= 0:
            total, begin = 0.0, i
        score = weights.of(t)
        total += score if within is None else max(score, 0.0) if within[0] <= i <= within[1] else min(score, 0.0)
        if total > best:
            best, span = total, (begin, i)
    return span


def _spread(found: list[Token], span: tuple[int, int]) -> tuple[int, int]:
    """The run's words alone: without tags at its ends."""
    a, b = span
    while a <= b and (found[a].boiler or not found[a].words):
        a += 1
    while b >= a and (found[b].boiler or not found[b].words):
        b -= 1
    return a, b


def _known(pages: Iterable[str], learnt: frozenset[str] = frozenset()) -> Iterator[tuple[list[Token], tuple[int, int]]]:
    """The labelled ones among ``pages``, with their labels."""
    return ((t, s) for p in pages if (s := label(t := tokens(p, learnt))) is not None and s[0] <= s[1])


def _count(pages: Iterable[str]) -> tuple[Counter, Counter]:
    """How often each kind of tag, and "." and each class name or id, stands inside
    and outside the labels."""
    inside, outside = Counter(), Counter()
    for found, (a, b) in _known(pages):
        for i, t in enumerate(found):
            if t.kind:
                where = inside if a <= i <= b else outside
                where[_kind(t)] += 1
                where.update(f".{x}" for x in t.names if t.name not in CONTENT)
    return inside, outside


def _trials(inside: Counter, outside: Counter) -> list[Weights]:
    """Weights for each of ``SCALES``."""
    names = frozenset(k[1:] for k, n in outside.items() if k[0] == "." and n >= max(LEAST_MET, TIMES_OUTSIDE * inside[k]))
    ratio = {k: math.log((outside[k] + 1) / (inside[k] + 1)) for k in [*inside, *outside] if k[0] != "."}
    return [Weights({k: 0.05 + scale * max(0.0, r) for k, r in ratio.items()}, PLAIN_COST, names) for scale in SCALES]


def _right(pages: Iterable[str], trials: list[Weights]) -> list[int]:
    """Of how many labelled pages each trial finds the content."""
    right = [0] * len(trials)
    for f, s in _known(pages, trials[0].names):
        want = _spread(f, s)
        for i, w in enumerate(trials):
            right[i] += _spread(f, best_run(f, w)) == want
    return right


def _best(trials: list[Weights], right: list[int]) -> Weights:
    return trials[max(range(len(trials)), key=lambda i: (right[i], -i))]


def fit(pages: Iterable[str]) -> Weights:
    """Weights from the labelled ones among ``pages``."""
    pages = list(pages)
    inside, outside = _count(pages)
    if not outside and not inside:
        return Weights()
    trials = _trials(inside, outside)
    return _best(trials, _right(pages, trials))


def main_text(html: str | None, weights: Weights) -> str:
    """Blocks of the best run, joined by line feeds."""
    found = tokens(html or "", weights.names)
    a, b = best_run(found, weights, marked(found))
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run and (text := " ".join(_html.unescape("".join(run)).split())):
            blocks.append(text)
        run.clear()

    for t in found[a : b + 1]:
        if t.kind:
            if t.name not in INLINE:
                close()
            elif t.name == "br":
                run.append(" ")
        elif not t.boiler:
            run.append(t.text)
    close()
    return "\n".join(blocks)


def learn(df: DataFrame, html: str = "html") -> Weights:
    """Weights from at most ``SAMPLE_PAGES`` pages, chosen by a hash so that the
    choice depends on nothing but the pages."""
    common.ship(df.sparkSession)
    named = df.select(F.col(html).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    chosen = common.sampled(named, SAMPLE_PAGES, "html")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
        return (h.as_py() for b in batches for h in b.column(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = _count(pages(batches))
        kinds = list(inside | outside)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside[k] for k in kinds], pa.int64()), pa.array([outside[k] for k in kinds], pa.int64())], ["kind", "inside", "outside"])

    counted = chosen.mapInArrow(common.task(count), "kind string, inside long, outside long")
    rows = counted.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    if not rows:
        return Weights()
    trials = _trials(Counter({r["kind"]: r["inside"] for r in rows}), Counter({r["kind"]: r["outside"] for r in rows}))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(trials)), pa.int32()), pa.array(_right(pages(batches), trials), pa.int64())], ["trial", "right"])

    scored = chosen.mapInArrow(common.task(score), "trial int, right long")
    right = {r["trial"]: r["n"] for r in scored.groupBy("trial").agg(F.sum("right").alias("n")).collect()}
    return _best(trials, [right[i] for i in range(len(trials))])


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: Weights | None = None) -> DataFrame:
    """``keep`` and ``text`` of every row."""
    common.ship(df.sparkSession)
    w = weights or learn(df, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [main_text(h, w) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("text", T.StringType(), False)])
    return df.select(*(df[c] for c in keep), df[html]).mapInArrow(common.task(run), schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op9_html": op9_html}
ORACLES: dict[str, str] = {}
