"""Main-text extraction from HTML by line-block distribution.

Markup is stripped into lines, one for each block-level piece of the page; what markup itself names as boilerplate (menus,
forms, footers, hidden elements, telling classes) leaves blank lines behind. A line's size is the length of its text outside
links less that inside; a short line that is no sentence has size 0, as the words of menus and notices have. The
distribution of a page is the sum of sizes over sliding windows of ``window`` lines. A surge point is where it rises to
``rise`` times its mean over the lines with text, a dive point where it falls below; the text between them is a region, and
regions between which only a few lines stand are one. The region with most text is the article; regions at least ``share``
as high with at least ``share`` of its text belong to it. The heading above a region's first line goes with it.

Where the page marks an article or main element, the distribution is taken within the marked elements: the element with
most text is the article, others belong to it by the same share, and what lies in them is kept, short lines too, but for
runs of lines that are nothing but links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table

#: Comments, raw-text elements with their content, declarations, then tags; each may be cut off by the end of the page.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|textarea|iframe|math)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
_SPACE = re.compile(r"\s+")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: What a sentence ends in, with quotes or brackets behind it.
_SENTENCE_END = re.compile(r"""[.!?:;\u2026\u3002\uff01\uff1f]["'\u201d\u2019\u00bb)\]]*$""")
_PART = re.compile(r"[^a-z]+")

#: Elements that never hold article text.
DROPPED_TAGS = frozenset("head nav footer aside form button select option dialog menu datalist label input object audio video canvas title".split())
#: Dropped outside an article only: within one they hold its title.
OUTER_TAGS = frozenset(["header", "hgroup"])
#: Class, id and role names that mark boilerplate, alone or with one another or with NEUTRAL_PARTS ("site-nav", not "no-sidebar").
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer comment comments commentlist respond reply replies disqus share sharing "
    "social related recommended recommendations newsletter subscribe signup popup modal overlay login search pagination pager skip toolbar "
    "complementary contentinfo alert alertdialog disclaimer widget outbrain taboola".split()
)
OUTER_NAMES = frozenset(["header", "masthead"])
NEUTRAL_PARTS = frozenset(
    "site page global primary secondary main top bottom left right inner outer list item items box block section area wrap wrapper container slot unit "
    "bar button buttons link links post posts article articles form icons panel text".split()
)
#: What an id says within an article; other ids there are anchors of its sections.
INNER_IDS = frozenset("ad ads adv advert adverts advertisement comment comments commentlist respond disqus newsletter subscribe outbrain taboola".split())
#: Within an article, ids of these are anchors always.
ANCHORS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that end the line they stand in.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li "
    "main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A line of fewer characters has no part in the distribution unless it is a sentence.
SHORT = 40
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN_TAGS = frozenset(["article", "main"])
#: An open element of the first kind is closed by a start tag of the second.
_CLOSED_BY = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}


def _names(value: str, names: frozenset[str]) -> bool:
    """Whether one of the names in a class, id or role marks boilerplate as a whole."""
    for name in value.split():
        parts = [x for x in _PART.split(name) if x]
        if not names.isdisjoint(parts) and all(x in names or x in NEUTRAL_PARTS for x in parts):
            return True
    return False


def _is_dropped(tag: str, attributes: str, in_main: bool) -> str:
    """Why an element is dropped: "tag", "hidden" or "name"; "" if it is not."""
    if tag in DROPPED_TAGS or (tag in OUTER_TAGS and not in_main):
        return "tag"
    if tag in ("body", "html", "article", "main") or not attributes:
        return ""
    why = ""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "hidden"
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "hidden"
        elif name == "id" and in_main:
            if tag not in ANCHORS and _names(value, INNER_IDS):
                why = "name"
        elif name in ("class", "id", "role"):
            if _names(value, DROPPED_NAMES) or (not in_main and _names(value, OUTER_NAMES)):
                why = "name"
    return why


class Line(NamedTuple):
    """text: "" where boilerplate was; plain, linked: characters outside and inside links; where: number of the enclosing main
    element, or 0; heading: whether it is one."""

    text: str
    plain: int = 0
    linked: int = 0
    where: int = 0
    heading: bool = False

    @property
    def size(self) -> int:
        """Its part in the distribution."""
        return max(0, self.plain - self.linked) if len(self.text) >= SHORT or _SENTENCE_END.search(self.text) else 0

    @property
    def is_link(self) -> bool:
        return bool(self.text) and self.linked > 0 and self.plain == 0


def page_lines(page: str, window: int = 3, spared: frozenset[int] = frozenset()) -> list[Line]:
    """The lines of a page.

    If all main elements are within elements dropped by their names, or within a form, those around the first are kept;
    ``spared`` has their places in the page."""
    lines: list[Line] = []
    pieces: list[str] = []
    plain = linked = 0
    heading = False
    stack: list[tuple[str, bool, int]] = []  # tag, whether it starts a dropped element, its main element
    dropping = in_link = mains = 0
    where = 0
    around: list[tuple[int, str]] = []  # of open dropped elements: place in the page, why dropped
    to_spare: frozenset[int] = frozenset()

    def end_line() -> None:
        nonlocal plain, linked, heading
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                lines.append(Line(text, plain, linked, where, heading))
            pieces.clear()
        plain = linked = 0
        heading = False

    def close(depth: int) -> None:
        nonlocal dropping, in_link, where
        while len(stack) > depth:
            tag, starts, outer = stack.pop()
            if starts:
                around.pop()
                dropping -= 1
                if not dropping:
                    lines.extend([Line("")] * window)
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in MAIN_TAGS:
                where = outer

    def text_piece(text: str) -> None:
        nonlocal plain, linked
        if text and not dropping:
            pieces.append(text)
            size = len(text) - text.count(" ")
            if in_link:
                linked += size
            else:
                plain += size

    at = 0
    for m in _MARKUP.finditer(page):
        text_piece(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if tag in BLOCK_TAGS or tag in DROPPED_TAGS:
            end_line()
        elif tag == "br":
            text_piece(" ")
        if m[2] or m[5]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        attributes = m[4] if m[3] else m[7]
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        while stack and tag in _CLOSED_BY.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if tag in BLOCK_TAGS:  # a block inside <p><b> ends both, as browsers do
            for depth in range(len(stack) - 1, max(-1, len(stack) - 8), -1):
                if stack[depth][0] in BLOCK_TAGS:
                    if stack[depth][0] == "p":
                        close(depth)
                    break
        why = "" if m.start() in spared else _is_dropped(tag, attributes, bool(where))
        starts = bool(why)
        stack.append((tag, starts, where))
        if starts:
            around.append((m.start(), "name" if tag == "form" else why))
            dropping += 1
        if tag in MAIN_TAGS and dropping and not to_spare and all(x[1] == "name" for x in around):
            to_spare = frozenset(x[0] for x in around)
        if tag in HEADINGS:
            heading = True
        if tag == "a":
            in_link += 1
        if tag in MAIN_TAGS and not dropping:
            mains += 1
            where = where or mains
    text_piece(page[at:])
    end_line()
    if to_spare and not mains:
        return page_lines(page, window, spared | to_spare)
    return lines


def distribution(sizes: list[int], window: int = 3) -> list[int]:
    """The sum over the window that ends at each line."""
    sums, total = [], 0
    for i, n in enumerate(sizes):
        total += n - (sizes[i - window] if i >= window else 0)
        sums.append(total)
    return sums


def regions(lines: list[Line], window: int = 3, rise: float = 0.5) -> list[tuple[int, int]]:
    """(first line, end) of each stretch between a surge and a dive point; those at most ``window`` lines of text apart are one."""
    sizes = [x.size for x in lines]
    sums = distribution(sizes, window)
    some = [s for s in sums if s]
    if not some:
        return []
    least = rise * sum(some) / len(some)
    found: list[tuple[int, int]] = []
    start = None
    for i, s in enumerate([*sums, 0]):
        if s >= least and start is None:
            start = i
        elif s < least and start is not None:
            a = next(k for k in range(max(0, start - window + 1), len(lines)) if sizes[k])
            b = next(k for k in range(i - 1, -1, -1) if sizes[k]) + 1
            start = None
            if found and a - found[-1][1] <= window and all(x.text for x in lines[found[-1][1] : a]):
                a = found.pop()[0]
            found.append((a, b))
    return found


def _up_to_boilerplate(lines: list[Line], a: int, b: int, window: int) -> tuple[int, int]:
    """A region with the few lines, none of them a link, that part it from what markup names as boilerplate."""
    for k in range(b, min(b + window, len(lines) - 1) + 1):
        if k == len(lines) or lines[k].is_link:
            break
        if not lines[k].text:
            b = k
            break
    for k in range(a - 1, max(a - 1 - window, 0) - 1, -1):
        if lines[k].is_link:
            break
        if not lines[k].text:
            a = k + 1
            break
    return a, b


def _without_menus(lines: list[Line], window: int) -> list[str]:
    """The texts of lines, but for runs of at least ``window`` lines that are nothing but links."""
    out: list[str] = []
    run: list[str] = []
    for x in [*lines, Line("")]:
        if x.is_link:
            run.append(x.text)
            continue
        out += run if len(run) < window else []
        run = []
        if x.text:
            out.append(x.text)
    return out


def main_text(page: str | None, window: int = 3, share: float = 0.3, rise: float = 0.5) -> str:
    """The article's blocks in page order, joined by line breaks; "" for a null or empty page or one without text."""
    lines = page_lines(page or "", window)
    marked = sorted({x.where for x in lines if x.text and x.where})
    if marked:
        weight = {w: sum(max(0, x.plain - x.linked) for x in lines if x.where == w) for w in marked}
        most = max(weight.values())
        return "\n".join(_without_menus([x for x in lines if x.where and weight[x.where] >= share * most], window))
    found = regions(lines, window, rise)
    if not found:  # no sentence and no long line: what there is, menus left out
        return "\n".join(_without_menus(lines, window))
    sums = distribution([x.size for x in lines], window)
    weight = [sum(x.size for x in lines[a:b]) for a, b in found]
    height = [max(sums[a:b]) for a, b in found]
    best = max(range(len(found)), key=lambda i: (weight[i], -i))
    kept: list[Line] = []
    for i, (a, b) in enumerate(found):
        if i == best or (weight[i] >= share * weight[best] and height[i] >= share * height[best]):
            a, b = _up_to_boilerplate(lines, a, b, window)
            while a > 0 and lines[a - 1].heading and lines[a - 1].text:
                a -= 1
            kept += [*lines[a:b], Line("")]
    return "\n".join(_without_menus(kept, window))


def extract(pages: DataFrame, html_column: str = "html", window: int = 3) -> DataFrame:
    """pages plus text and n_chars (code points); existing columns of these names are replaced.

    Each page is a row by itself and read whole, so nothing depends on ties, repeated rows, the number of rows or the length of
    others; null html gives "".
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([main_text(page, window) for page in series], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = pages.drop("text", "n_chars").withColumn("text", F.pandas_udf(run, "string")(F.col(html_column)))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
