"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from math import ceil, exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that end a line, elements without end tags, elements whose text never counts, elements that
# hold a page's frame, and words of class, id or role that mark such a frame.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title head svg math canvas object iframe select textarea button datalist".split())
FRAMES = frozenset("nav footer aside form dialog menu search".split())
FRAME_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie "
    "cookies copyright disqus footer masthead menu modal nav navbar navigation newsletter notice pager pagination popup "
    "promo promoted promotion related replies reply search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split()
)
REPLY_WORDS = frozenset("comment comments disqus replies reply".split())
AROUND = frozenset("has is no with without".split())  # "no-sidebar" says what the page is like, not what the holder is
MAIN = frozenset(("article", "main"))
ROOTS = MAIN | {"html", "body"}
HOLDERS = frozenset("article main section div td th body html nav header footer aside form dialog menu search figure "
                    "blockquote".split()) | SILENT
SIGMA = 1.0  # lines
PART = re.compile(r"[^a-z]+")
ROOM = 2 / 3  # of a page's text: a form or marked holder with so much is the page's own


def frame_marks(attrs: list) -> set[str]:
    """Frame words among the whole names of a class, id or role, or at either end of a name of several parts."""
    found: set[str] = set()
    for name in (n for k, v in attrs if k in ("class", "id", "role") and v for n in v.lower().split()):
        parts = [p for p in PART.split(name) if p]
        if parts and not AROUND & set(parts):
            found |= {parts[0], parts[-1]} & FRAME_WORDS
    return found


class Lines(HTMLParser):
    """Collects lines: text between block tags, the tags seen in it, its holder, and whether it is frame or silent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Text, tags, holder, frame, enclosing article or 0, and the frames around that might be the page itself.
        self.lines: list[tuple[str, int, int, bool, int, tuple[int, ...]]] = []
        self.open: list[tuple[str, int, bool, int, bool, tuple[int, ...]]] = [("", 0, False, 0, False, ())]
        self.parts: list[str] = []
        self.tags = 0
        self.count = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        tag, number, frame, article, silent, loose = self.open[-1]
        if text and not silent:
            self.lines.append((text, self.tags, number, frame, article, loose))
        self.parts, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS or tag in SILENT:
            self.end_line()
        self.tags += 1
        if tag in HOLDERS and tag not in VOID:
            _, _, frame, article, silent, loose = self.open[-1]
            marks = frame_marks(attrs)
            self.count += 1
            inside = article or (self.count if tag in MAIN else 0)
            if tag in ROOTS:  # whatever they are called, but for an article that is a comment
                frame = frame or (tag == "article" and bool(marks & REPLY_WORDS))
            elif (tag in FRAMES and tag != "form") or (tag == "header" and not inside) or marks & REPLY_WORDS:
                frame = True
            elif tag == "form" or marks:
                loose = (*loose, self.count)
            self.open.append((tag, self.count, frame, inside, silent or tag in SILENT, loose))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # HTML ignores the slash
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SILENT:
            self.end_line()
        self.tags += 1
        if tag in HOLDERS:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == tag:
                    del self.open[k:]
                    break

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def smoothed(values: list[float]) -> list[float]:
    """Gaussian smoothing over neighbouring lines; the weights at the ends are scaled to what is there."""
    reach = ceil(2 * SIGMA)
    kernel = [exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The border of two clusters: between their means, moved until it stays."""
    low, high = min(values), max(values)
    border = (low + high) / 2
    for _ in range(50):
        a = [v for v in values if v < border]
        b = [v for v in values if v >= border]
        if not a or not b:
            break
        moved = (sum(a) / len(a) + sum(b) / len(b)) / 2
        if moved == border:
            break
        border = moved
    return border


def main_text(html: str | None) -> str:
    """Main text of one page: lines of the regions that hold a content line, joined by single spaces.

    A line's ratio is its characters by its tags; frame lines (menus, footers, asides, forms, marked boxes) count 0. A
    form or a marked box with ``ROOM`` of the text outside other frames, and all that is in articles, is no frame. Smoothed ratios at or above the
    border of two clusters are content. A region is an article, unless some holder outside has over twice the text of
    all articles, else a line's holder; every line of a content region that is not frame is kept.
    """
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    size, told = defaultdict(int), defaultdict(int)  # characters, and those of articles, of the page (0) and of boxes
    for text, _, _, frame, article, loose in page.lines:
        for box in () if frame else (0, *loose):
            size[box] += len(text)
            told[box] += len(text) if article else 0
    own = {box for box in size if size[box] >= ROOM * size[0] and told[box] == told[0]}
    lines = [(t, tags, holder, frame or not own.issuperset(loose), article) for t, tags, holder, frame, article, loose in page.lines]
    if not any(not frame for _, _, _, frame, _ in lines):
        return ""
    outside: dict[int, int] = defaultdict(int)
    inside = 0
    for text, _, holder, frame, article in lines:
        if not frame:
            inside += len(text) if article else 0
            outside[0 if article else holder] += 0 if article else len(text)
    if inside and 2 * inside >= max(outside.values()):
        region = [article or -1 for *_, article in lines]
        out_of = {-1}
    else:
        region, out_of = [article or -holder for _, _, holder, _, article in lines], set()
    ratio = [0.0 if frame or r in out_of else len(t) / max(tags, 1) for (t, tags, _, frame, _), r in zip(lines, region)]
    even = smoothed(ratio)
    border = threshold(even)
    mass: dict[int, float] = defaultdict(float)
    for r, v, own in zip(region, even, ratio):
        if own > 0 and v >= border:
            mass[r] += v
    if not mass:  # only lines beside frame: the best line's region
        mass[max(zip(ratio, region))[1]] = 1.0
    return " ".join(t for (t, _, _, frame, _), r in zip(lines, region) if r in mass and not frame)


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Add the main text of an HTML column; other columns stay, but for one that is called ``name`` already.

    Null, empty and frame-only pages give an empty text; broken markup is read as far as it goes; repeated rows give
    equal texts; an empty table stays empty. Pages are read one at a time, whatever their length.
    """
    plain = pages.drop(name) if name != html else pages

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            text = pa.array([main_text(h) for h in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, name])

    return plain.mapInArrow(run, plain.withColumn(name, F.lit("")).schema)
