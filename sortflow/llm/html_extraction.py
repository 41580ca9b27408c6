"""Main text of web pages from parser events, by the text-to-tag ratio of lines.

The standard library's parser streams a page's events. Block elements end a
line; a line has its text and the number of tags in it. Menus, headers, footers,
side bars, notices, adverts, forms, comments and everything that is no text are
left out by element, role, and the words of class and id. A word counts if it is
the head noun of a class or id, and never for an element that holds most of the
page's text, nor for one that holds an article or main element if there is none
outside such elements; this is decided when the page is read. The ratio of text to
tags of the lines that remain is smoothed by a Gaussian; lines above a part of
its spread are content. The content lines vote for regions: articles and main
elements if the page has any, else the lowest container that all content lines
share and that holds other lines too; paragraphs, headings, lists, tables and their
parts are no containers. Every line of a chosen region is text, however short.

Defined results: null, empty and textless html give an empty text; unclosed
elements end with their parent; character references are decoded, unknown ones
kept as they stand; white space in a line, line-break elements included, becomes
one space; repeated rows give repeated results; an empty table gives no rows;
other columns pass through in the row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortflow.llm.rows import ROW, text_of, whole_row

SIGMA = 1.0
#: Content lines have at least this part of the standard deviation of the smoothed ratios.
SPREAD = 0.5

# Elements, roles and words of class and id, as used in HTML pages.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
DROPPED = set(
    "head title script style noscript template svg math iframe object embed canvas audio video map nav header footer aside "
    "form button select textarea input dialog menu".split()
)
DROPPED_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note".split()
)
DROPPED_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets notice notices cookie cookies consent gdpr "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments "
    "respond reply replies disqus related recommended recommendations pagination pager toolbar skip hidden".split()
)
#: Last words that add nothing to the noun before them, and first words that tell what an element has or lacks.
TAILS = set("container wrapper wrap box block area section slot unit list item items".split())
DESCRIBING = set("has have no not non with without hide show".split())
REGIONS = {"article", "main"}
#: Words that drop a whole article: others may describe the page around it.
DROPPED_REGION_WORDS = set("ad ads advert advertisement sponsored promo comment comments reply replies related teaser".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Block elements that are a piece of a text, never the region that holds it.
PIECES = HEADINGS | set(
    "p pre blockquote address hgroup ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th figure figcaption "
    "details summary fieldset legend optgroup option".split()
)


@dataclass
class Line:
    """A line of a page: text, tags in it, the containers around it, and the region it lies in."""

    text: str
    tags: int
    around: tuple[int, ...]
    region: int | None


@dataclass
class _Element:
    tag: str
    number: int
    dropped: bool
    region: int | None
    #: Elements around it, itself included, whose class or id names what is left out.
    marks: tuple[int, ...]


@dataclass
class _State:
    open: list[_Element] = field(default_factory=list)
    parts: list[tuple[str, tuple[int, ...]]] = field(default_factory=list)
    tags: int = 0
    count: int = 0


class LineParser(HTMLParser):
    """Collects the lines of one page from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.read: list[tuple[list[tuple[str, tuple[int, ...]]], Line]] = []
        self.regions: dict[int, tuple[int, ...]] = {}
        self.state = _State()

    def _end_line(self) -> None:
        state = self.state
        if any(not said.isspace() for said, _ in state.parts):
            top = state.open[-1] if state.open else None
            around = tuple(e.number for e in state.open if e.tag not in INLINE and e.tag not in PIECES)
            self.read.append((state.parts, Line("", state.tags, around, top.region if top else None)))
        state.parts = []
        state.tags = 0

    @staticmethod
    def _is_dropped(tag: str, attrs: dict[str, str]) -> bool:
        if tag in DROPPED or attrs.get("role", "").lower() in DROPPED_ROLES or "hidden" in attrs:
            return True
        return attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").lower().replace(" ", "")

    @staticmethod
    def _is_marked(tag: str, attrs: dict[str, str]) -> bool:
        if tag in {"html", "body", *HEADINGS}:
            return False
        wanted = DROPPED_REGION_WORDS if tag in REGIONS else DROPPED_WORDS
        for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
            words = [w for w in "".join(c if c.isalnum() else " " for c in token).split() if not w.isdigit()]
            while len(words) > 1 and words[-1] in TAILS:
                words.pop()
            if words and words[-1] in wanted and words[0] not in DESCRIBING:
                return True
        return False

    def _spared(self) -> set[int]:
        """Marked elements that stay: they hold most of the text of the page or their region, or the page's only articles."""
        held, within, total, inside = Counter(), {}, 0, Counter()
        for parts, line in self.read:
            for said, marks in parts:
                n = len("".join(said.split()))
                total += n
                held.update(dict.fromkeys(marks, n))
                if n and line.region is not None:
                    inside[line.region] += n
                    within |= {mark: line.region for mark in marks if mark > line.region}
        spared = {mark for mark, n in held.items() if 2 * n > (inside[within[mark]] if mark in within else total)}
        around = [self.regions[region] for region in inside]
        while around and not any(spared.issuperset(marks) for marks in around):
            spared |= {next(mark for mark in marks if mark not in spared) for marks in around}
        return spared

    def handle_starttag(self, tag: str, attrs: list) -> None:
        state = self.state
        if tag == "body":
            self._close("head")
        top = state.open[-1] if state.open else None
        if tag == "br":
            state.parts.append((" ", top.marks if top else ()))
        elif tag not in INLINE:
            self._end_line()
        state.tags += 1
        if tag in VOID:
            return
        if tag in {"p", "li", "td", "th", "tr", "dd", "dt", "option"} and top and top.tag == tag:
            self._close(tag)
            top = state.open[-1] if state.open else None
        state.count += 1
        said = {k: v or "" for k, v in attrs}
        dropped = bool(top and top.dropped) or self._is_dropped(tag, said)
        marked = not dropped and self._is_marked(tag, said)
        marks = (top.marks if top else ()) + ((state.count,) if marked else ())
        region = top.region if top else None
        if tag in REGIONS and region is None and not dropped and not marked:
            region = state.count
            self.regions[region] = marks
        state.open.append(_Element(tag, state.count, dropped, region, marks))

    def _close(self, tag: str) -> None:
        opened = self.state.open
        for i in range(len(opened) - 1, -1, -1):
            if opened[i].tag == tag:
                del opened[i:]
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_line()
        self.state.tags += 1
        self._close(tag)

    def handle_data(self, data: str) -> None:
        opened = self.state.open
        if not (opened and opened[-1].dropped):
            self.state.parts.append((data, opened[-1].marks if opened else ()))

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        spared = self._spared()
        lines = []
        for parts, line in self.read:
            text = " ".join("".join(said for said, marks in parts if spared.issuperset(marks)).split())
            if text:
                lines.append(replace(line, text=text))
        return lines


def smoothed_ratios(lines: list[Line], sigma: float = SIGMA) -> np.ndarray:
    """Characters per tag of every line, smoothed over its neighbours by a Gaussian."""
    ratios = np.array([len(line.text) / max(1, line.tags) for line in lines])
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _common_container(lines: list[Line], weight: np.ndarray) -> int | None:
    """The lowest container around all lines with weight that holds more than one line."""
    held = Counter(container for line in lines for container in line.around)
    shared = set.intersection(*[set(line.around) for line, w in zip(lines, weight) if w])
    return max((container for container in shared if held[container] > 1), default=None)


def main_text(html: str | None) -> str:
    """The lines of the page's content regions, in page order."""
    parser = LineParser()
    parser.feed(html or "")
    lines = parser.finish()
    if not lines:
        return ""
    ratios = smoothed_ratios(lines)
    content = ratios >= SPREAD * ratios.std()
    weight = np.where(content, [float(len(line.text)) for line in lines], 0.0)
    regions = {line.region for line in lines if line.region is not None}
    if regions:
        voted = {line.region for line, w in zip(lines, weight) if w and line.region is not None}
        chosen = [line for line in lines if line.region in (voted or regions)]
    else:
        inner = _common_container(lines, weight) if weight.any() else None
        chosen = [line for line in lines if inner is None or inner in line.around]
    return "\n".join(line.text for line in chosen)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(row, text, n_chars): every row of ``pages`` as a struct, and its main text."""
    chosen = pages.select(whole_row(pages.drop(html_col)), text_of(pages, html_col).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [ROW, "text", "n_chars"],
            )

    schema = chosen.select(ROW).schema.add("text", "string").add("n_chars", "long")
    return chosen.mapInArrow(extract, schema)
