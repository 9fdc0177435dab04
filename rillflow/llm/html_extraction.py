"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page (what stands between block-level tags). Parts that are no article by their element,
class, id or role are ruled out; but what classes, ids and roles say of a block that most of the page's text is in, as of a wrapper named
after the layout, does not count (``_Guard``). Weights, the characters outside links, are summed over sliding windows of ``WINDOW``
lines. Where the sum falls to nothing the text dives; a stretch between two dives is a passage if the sum surges in it, that is
reaches ``SURGE`` characters (1, if it does so nowhere on the page), and a passage goes from its first line with weight to its last.

Elements that mark an article weigh (``MARK_WEIGHT``). Each of them is a region with a mass, what its passages weigh. Where the
marked regions together weigh at least what the unmarked lines do, lines have weight only in regions marked like the heaviest one (links
too), and the text is what lies in their passages: a teaser with the same mark does not surge, and goes. Else the marks are no guide, and the
article is all from the page's first passage to the end of its last, links too, and the paragraphs before and after that stand beside one in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import pieces, small_batches

WINDOW, SURGE = 3, 80
#: What a character weighs by how surely its line is marked as article: not, by class or id, as main, as article.
MARK_WEIGHT = (1, 4, 6, 8)

#: Elements by what they do to the text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_TEXT = frozenset("head script style noscript template textarea title iframe svg canvas object audio video map datalist".split())
NO_ARTICLE = frozenset("nav footer aside button select menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = frozenset(
    "ad ads adbox advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion "
    "related respond share sharing sidebar sidebars signup skyscraper social sponsor sponsored subscribe toolbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ARTICLE_MARKS = frozenset("article articlebody post entry story".split())
#: Elements that are never ruled out by their class or id: too much hangs on them.
FRAMES = frozenset("html body main".split())
#: Class names with one of these words say what a layout has or lacks, not what the element is.
LAYOUT_WORDS = frozenset("with without no not has have hide hidden show is".split())
#: Marks of reader comments, which may well be longer than the article.
COMMENTS = frozenset("comment comments commentlist disqus respond".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'<>]|"[^"<]*"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Guard:
    """A block that its class, id or role (or being a form) rules out, unless too much of the page is in it."""

    __slots__ = ("up", "comments", "mass", "marked", "out")

    def __init__(self, up: _Guard | None, comments: bool):
        self.up, self.comments, self.mass, self.marked, self.out = up, comments, 0, 0, False


def _ruled(guards: list[_Guard], mass: int, marked: int) -> None:
    """Settle which guards rule out; ``mass`` and ``marked`` are the page's text outside links, and that in marked elements."""
    for g in reversed(guards):  # inner ones first: their text is also the outer ones'
        if g.up:
            g.up.mass += g.mass
            g.up.marked += g.marked
    for g in guards:
        outside = mass - g.mass
        g.out = bool(g.up and g.up.out) or 2 * outside >= mass or marked - g.marked >= SURGE or (g.comments and outside >= SURGE)


class _Element:
    __slots__ = ("tag", "out", "heading_only", "article", "link", "regions", "place", "beside", "guard", "block")

    def __init__(self, tag: str, out: bool, heading_only: bool, article: int, link: bool, regions: tuple, place: int, beside: int | None, guard: _Guard | None, block: int):
        self.tag, self.out, self.heading_only, self.article, self.link, self.regions, self.place, self.beside, self.guard, self.block = tag, out, heading_only, article, link, regions, place, beside, guard, block


def _marks(value: str, tag: str) -> set[str]:
    """The words of class names that tell what an element is."""
    out: set[str] = set()
    for name in value.split():
        words = _WORD.findall(name)
        if not LAYOUT_WORDS.intersection(words):
            out.update(words[:1] if tag == "article" else words)
            out.add(name)
    return out


def _open(tag: str, attributes: str, up: _Element, at: int, depth: int, guards: list[_Guard]) -> _Element:
    out, heading_only, article = up.out or tag in NO_TEXT or tag in NO_ARTICLE, up.heading_only, up.article
    marks: set[str] = set()
    guarded = tag == "form"
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                marks |= _marks(value, tag)
            elif name == "role":
                guarded = guarded or (value in ROLES and tag not in FRAMES)
                article = max(article, 2 if value in ("main", "article") else 0)
            elif name == "itemprop":
                article = max(article, 3 if value == "articlebody" else 0)
            elif tag not in FRAMES:
                out = out or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and bool(_HIDDEN.search(value)))
    if tag not in FRAMES and marks:
        guarded = guarded or bool(marks & MARKS)
        if "header" in marks and tag != "article":
            heading_only = True
        if tag not in INLINE and tag != "article" and not guarded and marks & ARTICLE_MARKS:
            article = max(article, 1)
    if tag == "header":
        heading_only = True
    if tag == "article" and not guarded:
        article = 3
    elif tag == "main":
        article = max(article, 2)
    guard = up.guard
    if guarded and tag in INLINE:
        out = True
    elif guarded and not out:
        guard = _Guard(guard, bool(marks & COMMENTS))
        guards.append(guard)
    regions = (*up.regions, (article, at)) if article > up.article else up.regions
    beside = up.place if tag == "p" else up.beside if tag in INLINE else None
    return _Element(tag, out, heading_only, article, up.link or tag == "a", regions, up.place if tag in INLINE else at, beside, guard, up.block if tag in INLINE else depth)


Line = tuple[str, int, tuple, "int | None"]


class _Lines:
    """Collects (text, weight, regions, beside) lines, each with its guard.

    regions: (mark, place on the page) of the marked elements around it; beside: the place of what holds its paragraph.
    """

    def __init__(self):
        self.lines: list[Line] = []
        self.guards: list[_Guard | None] = []
        self.parts: list[str] = []
        self.weight, self.regions, self.beside, self.guard = 0, (), None, None
        self.mass = self.marked = 0

    def add(self, raw: str, on: _Element, heading: bool) -> None:
        if on.out or (on.heading_only and not (heading and on.article)):
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if not on.link:
            self.weight += len(text.strip())
        self.regions = max(self.regions, on.regions, key=lambda r: r[-1][0] if r else 0)
        self.beside = on.beside if self.beside is None else self.beside
        self.guard = on.guard

    def end(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.weight, self.regions, self.beside))
                self.guards.append(self.guard)
                marked = self.weight if self.regions else 0
                self.mass, self.marked = self.mass + self.weight, self.marked + marked
                if self.guard:
                    self.guard.mass += self.weight
                    self.guard.marked += marked
            self.parts, self.weight, self.regions, self.beside, self.guard = [], 0, (), None, None


def lines_of(page: str) -> list[Line]:
    """The page's lines without those that markup rules out; in time proportional to the page."""
    out, root = _Lines(), _Element("", False, False, 0, False, (), -1, None, None, 0)
    stack, guards = [root], []
    opened: Counter = Counter()
    at, n = 0, len(page)
    closes = page.rfind(">")

    def heading() -> bool:
        return any(opened[h] for h in HEADINGS)

    def cut(place: int) -> None:
        for e in stack[place:]:
            opened[e.tag] -= 1
        del stack[place:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > closes:  # no tag can end any more
            out.add(page[at:], stack[-1], heading())
            break
        if lt > at:
            out.add(page[at:lt], stack[-1], heading())
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            out.add("<", stack[-1], heading())
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if tag not in INLINE:
            out.end()
        if closing:
            if opened[tag]:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag not in INLINE and tag not in VOID:
            block = stack[-1].block  # a block ends an open paragraph
            if stack[block].tag == "p" or (tag == "li" and stack[block].tag == "li"):
                cut(block)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = n if not end else end.start()
        if not attributes.rstrip().endswith("/") or tag in INLINE:
            stack.append(_open(tag, attributes, stack[-1], lt, len(stack), guards))
            opened[tag] += 1
    out.end()
    _ruled(guards, out.mass, out.marked)
    return [line for line, guard in zip(out.lines, out.guards, strict=True) if not (guard and guard.out)]


def passages(weights: list[int], surge: int) -> list[tuple[int, int]]:
    """(first, after last) line of each passage: a stretch between dives in which the windowed weights surge."""
    sums = [0, *accumulate(weights)]
    out, first, last, most = [], None, 0, 0
    for k, w in enumerate([*weights, *[0] * WINDOW]):
        if w:
            first, last = k if first is None else first, k + 1
            most = max(most, sums[last] - sums[max(first, last - WINDOW)])
        elif first is not None and k - last + 1 >= WINDOW:
            if most >= surge:
                out.append((first, last))
            first, most = None, 0
    return out


def chosen_mark(lines: list[Line]) -> int:
    """The mark of the heaviest marked region; 0 if the page has none or its unmarked lines weigh more than all of them."""
    own: dict[tuple, list[int]] = {}
    last: dict[tuple, int] = {}
    linked = not any(r and 2 * w >= len(t) for t, w, r, _ in lines)  # links count where nothing else is marked
    for k, (t, w, r, _) in enumerate(lines):
        region = r[-1] if r else (0, 0)
        weights = own.setdefault(region, [])
        weights += [0] * min(WINDOW, k - last.get(region, k - 1) - 1)  # the lines of others between: as many as end a passage
        weights.append(MARK_WEIGHT[region[0]] * (len(t) if r and linked else w if 2 * w >= len(t) else 0))
        last[region] = k
    for surge in (SURGE, 1):
        mass = {region: sum(sum(weights[a:b]) for a, b in passages(weights, surge)) for region, weights in own.items()}
        if any(mass.values()):
            break
    unmarked = mass.pop((0, 0), 0)
    if not mass or sum(mass.values()) < unmarked:
        return 0
    return max(mass, key=lambda region: (mass[region], region[0]))[0]


def line_weights(lines: list[Line]) -> tuple[list[int], bool]:
    """(weight of each line, whether marks guide)."""
    mark = chosen_mark(lines)
    if mark:
        return [len(t) if any(m == mark for m, _ in regions) else 0 for t, _, regions, _ in lines], True
    return [w if 2 * w >= len(t) else 0 for t, w, *_ in lines], False


def main_text(page: str | None) -> str:
    """The article of a page as one line; empty if there is none."""
    lines = lines_of(page) if page else []
    weights, marked = line_weights(lines)
    found = passages(weights, SURGE) or passages(weights, 1)
    if not found:
        return ""
    if marked:
        return " ".join(lines[k][0] for a, b in found for k in range(a, b) if weights[k])
    first, last = found[0][0], found[-1][1]
    beside = {lines[k][3] for k in range(first, last) if weights[k]} - {None}
    more = [k for k, line in enumerate(lines) if weights[k] and line[3] in beside]
    first, last = min([first, *more]), max([last - 1, *more]) + 1
    return " ".join(t for t, *_ in lines[first:last])


class HtmlExtraction:
    """Extracts main texts.

    ``extract`` gives a row per page row: id, further columns named in ``keep``, ``text`` (empty for a null or
    empty page or one without an article; an input column of that name is not carried) and ``n_chars``, its code
    points. Broken markup never fails: unclosed elements end with the element around them, and an unclosed comment
    or script runs to the end. Pages are read whole, in time proportional to their length. Of equally heavy regions, that
    with the stronger mark and then the first counts. Repeated rows are alike; other columns are ignored; an empty
    table gives no rows.
    """

    def extract(self, pages: DataFrame, id_: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:

        small_batches(pages.sparkSession)

        def run(batches):
            for batch in pieces(batches):
                texts = [main_text(p) for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])

        rows = pages.select(F.col(page).cast("string").alias("__page"), id_, *keep)
        schema = T.StructType([*rows.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
        return rows.mapInArrow(run, schema)
