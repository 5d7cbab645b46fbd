"""Reading order of positioned text (TXO1-10): a page's items to its text, one task a page.

Pages are small and cutting them is recursive, so each page is a group of its own; the shuffle is by (document, page).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, groupby
from statistics import fmean
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
SAME_LINE, SAME_LINE_POINTS, SPACE, BAND = 0.5, 2, 1 / 3, 1.5
GUTTER, GUTTER_FROM, GUTTER_TO, GUTTER_OF_PAGE, GUTTER_WIDE = 0.02, 0.2, 0.8, 0.05, 0.03
SIDE_LINES, NARROW_SIDE_LINES, PEEL_LINES, PEEL_SHARE = 2, 4, 8, 0.4
OVERPRINT_POINTS, OVERPRINT_SHARE, HEADING_LETTERS, HEADING_TALLER = 2, 0.15, 3, 1.15
TRAILING_LINES, SWITCHES, SWITCH_SHARE, ALIGNED, TEXT_LINES, TEXT_CHARS = 2, 2, 0.1, 2, 4, 30
PAGE_WIDTH = 612

SCHEMA = "doc_id long, page int, text string, layout string"
HYPHEN_END, GOES_ON = regex.compile(r"\p{L}{3,}[-‐]$"), regex.compile(r"^\p{Ll}{3,}")

Span = tuple[float, float]


class Item(NamedTuple):
    seq: int
    str: str
    x: float
    y: float
    width: float
    height: float
    has_eol: bool

    @property
    def right(self) -> float:
        return self.x + self.width

    def shadows(self, other: Item) -> bool:
        return abs(self.x - other.x) < _shadow(self, other)


class Line:
    """Items on one baseline, the baseline being the first item's."""

    def __init__(self, first: Item):
        self.y, self.height, self.items = first.y, first.height, [first]

    def takes(self, item: Item) -> bool:
        return abs(item.y - self.y) <= _slack(item.height, self.height)

    def add(self, item: Item) -> None:
        self.items.append(item)
        self.height = max(self.height, item.height)

    def beside(self, other: Line) -> bool:
        return abs(self.y - other.y) <= _slack(self.height, other.height)

    @property
    def left(self) -> float:
        return min(i.x for i in self.items)

    @property
    def right(self) -> float:
        return max(i.right for i in self.items)

    @property
    def covered(self) -> list[Span]:
        return _union([], self.items)


class Gap(NamedTuple):
    start: float
    end: float
    lines: int


def _slack(*heights: float) -> float:
    return SAME_LINE * min((h for h in heights if h > 0), default=SAME_LINE_POINTS / SAME_LINE)


def _shadow(a: Item, b: Item) -> float:
    return max(OVERPRINT_POINTS, OVERPRINT_SHARE * max(a.height, b.height))


def nearest_rank(values: list[float], p: float) -> float:
    """AGG16: 0 for no values."""
    return sorted(values)[max(0, math.ceil(len(values) * p) - 1)] if values else 0


def _union(spans: list[Span], items: list[Item]) -> list[Span]:
    """AGG20."""
    out: list[Span] = []
    for a, b in sorted([*spans, *((i.x, i.right) for i in items)]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _lines(items: list[Item]) -> list[Line]:
    """TXO4."""
    out: list[Line] = []
    for item in sorted(items, key=lambda i: (-i.y, i.x)):
        if out and out[-1].takes(item):
            out[-1].add(item)
        else:
            out.append(Line(item))
    for line in out:
        line.items.sort(key=lambda i: i.x)
    return out


def without_overprint(items: list[Item]) -> list[Item]:
    """TXO2: of the same text at nearly the same place the first copy stays."""
    kept: dict[str, list[Item]] = {}
    out = []
    for item in items:
        same = kept.setdefault(item.str.strip(), [])
        if not any(item.shadows(o) and abs(item.y - o.y) < _shadow(item, o) for o in same):
            same.append(item)
            out.append(item)
    return out


class Columns:
    """TXO8: whether two sides are columns, read one after the other, or cells of rows."""

    def __init__(self, left: list[Item], right: list[Item], width: float, page: float):
        self.sides, self.width, self.page = (left, right), width, page
        self.lines = _lines(left), _lines(right)

    def switches(self) -> int:
        """WIN8: in stream order."""
        told = sorted([(i.seq, s) for s, side in enumerate(self.sides) for i in side])
        return sum(1 for _ in groupby(told, key=lambda t: t[1])) - 1

    def values_beside_labels(self) -> bool:
        spread = lambda vs: max(vs) - min(vs)

        def of(values: list[Line], labels: list[Line]) -> bool:
            enough = min(len(values), len(labels)) >= SIDE_LINES
            return enough and spread([v.right for v in values]) <= ALIGNED < spread([v.left for v in values]) and spread([x.left for x in labels]) <= ALIGNED

        return of(*self.lines) or of(*reversed(self.lines))

    def blocks(self) -> bool:
        """Two lists from one baseline on, with a heading each or one much the longer."""
        a, b = self.lines
        if not all(x.beside(y) for x, y in zip(a, b, strict=False)):
            return False
        return (_titled(a) and _titled(b)) or abs(len(a) - len(b)) >= TRAILING_LINES

    def prose(self) -> bool:
        a, b = sorted(self.lines, key=len)
        chars = lambda lines: nearest_rank([sum(len(i.str.strip()) for i in x.items) for x in lines], 0.5)
        if self.width < self.page * GUTTER_WIDE or len(a) < TEXT_LINES or min(chars(a), chars(b)) < TEXT_CHARS:
            return False
        return len(a) != len(b) or not all(any(x.beside(y) for y in b) for x in a)

    def hold(self, least: int) -> bool:
        n = [len(x) for x in self.lines]
        if min(n) < least:
            return False
        if self.switches() <= max(SWITCHES, math.ceil(sum(n) * SWITCH_SHARE)):
            return True
        return not self.values_beside_labels() and (self.blocks() or self.prose())


def _titled(lines: list[Line]) -> bool:
    """The first line is in capitals or taller than the rest."""
    text = " ".join(i.str for i in lines[0].items)
    if len(regex.findall(r"\p{L}", text)) >= HEADING_LETTERS and not regex.search(r"\p{Ll}", text):
        return True
    usual = nearest_rank([x.height for x in lines[1:] if x.height > 0], 0.5)
    return 0 < usual * HEADING_TALLER <= lines[0].height


class Page:
    def __init__(self, width: float):
        self.width, self.columns = width if width > 0 else PAGE_WIDTH, False

    def gaps(self, covered: list[Span]) -> list[Gap]:
        """TXO6: holes wide enough, and in the middle or wide for the page."""
        start, extent = covered[0][0], covered[-1][1] - covered[0][0]
        out = []
        for (_, a), (b, _) in zip(covered, covered[1:], strict=False):
            inside = start + extent * GUTTER_FROM <= (a + b) / 2 <= start + extent * GUTTER_TO
            if inside and b - a >= max(1, self.width * GUTTER):
                out.append(Gap(a, b, SIDE_LINES))
            elif b - a >= self.width * GUTTER_OF_PAGE:
                out.append(Gap(a, b, NARROW_SIDE_LINES))
        return out

    def split(self, items: list[Item]) -> tuple[list[Item], list[Item]] | None:
        """TXO5: the two sides of the widest gutter that parts columns."""
        if len(items) < 2 * SIDE_LINES:
            return None
        for gap in sorted(self.gaps(_union([], items)), key=lambda g: g.start - g.end):
            sides: tuple[list, list] = [], []
            for i in items:
                sides[i.right > gap.start].append(i)
            if Columns(*sides, gap.end - gap.start, self.width).hold(gap.lines):
                return sides
        return None

    def peels(self, lines: list[Line]) -> Iterator[tuple[int, int]]:
        """TXO7: how many lines to set aside above and below, fewest first; one end stays within a bound.

        Beyond that bound only a line that closed a gutter is worth its removal.
        """
        n, covered = len(lines), [x.covered for x in lines]
        bound = min(PEEL_LINES, math.floor(n * PEEL_SHARE))
        merged = lambda spans, more: _union([*spans, *more], [])
        found = []
        for near in range(bound + 1):
            # One end is fixed at `near`; the other goes from a single line left to none taken away.
            for rest, kept in enumerate(accumulate(covered[: n - near][::-1], merged), 1):
                found.append((n - near - rest, near, kept, covered[n - near - rest - 1] if n - near - rest else []))
            for rest, kept in enumerate(accumulate(covered[near:], merged), 1):
                if n - near - rest > bound:
                    found.append((near, n - near - rest, kept, covered[near + rest]))
        found.sort(key=lambda f: (f[0] + f[1], f[1]))
        for top, bottom, kept, last in found:
            if not top + bottom or n - top - bottom < SIDE_LINES:
                continue
            gaps = self.gaps(kept)
            if gaps and (max(top, bottom) <= bound or any(a < g.end and b > g.start for a, b in last for g in gaps)):
                yield top, bottom

    def blocks(self, items: list[Item]) -> Iterator[list[str]]:
        """TXO3: columns, columns between a header and a footer, bands, or one block."""
        if not items:
            return
        if sides := self.split(items):
            self.columns = True
            for side in sides:
                yield from self.blocks(side)
            return
        lines = _lines(items)
        flat = lambda part: [i for x in part for i in x.items]
        for top, bottom in self.peels(lines):
            if sides := self.split(flat(lines[top : len(lines) - bottom])):
                self.columns = True
                for part in (flat(lines[:top]), *sides, flat(lines[len(lines) - bottom :])):
                    yield from self.blocks(part)
                return
        bands = _bands(lines)
        if len(bands) > 1:
            for band in bands:
                yield from self.blocks(flat(band))
        else:
            yield [text for x in lines for text in _rendered(x)]


def _bands(lines: list[Line]) -> list[list[Line]]:
    """TXO9: parted where the step to the next baseline is unusually long."""
    steps = [a.y - b.y for a, b in zip(lines, lines[1:], strict=False)]
    usual = max(nearest_rank([x.height for x in lines if x.height > 0], 0.5), nearest_rank([s for s in steps if s > 0], 0.25) / 1.2)
    cuts = [k for k, s in enumerate(steps, 1) if usual > 0 and s > usual * BAND]
    return [lines[a:b] for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True)]


def _rendered(line: Line) -> list[str]:
    """TXO10: a gap of over a third of a character is a space; an end-of-line flag breaks."""
    items = [i for k, i in enumerate(line.items) if not (k and line.items[k - 1].str.strip() == i.str.strip() and i.shadows(line.items[k - 1]))]
    out, prev = "", None
    for item in items:
        if prev is not None:
            char = next((i.width / len(i.str) for i in (prev, item) if i.width > 0 and i.str), item.height * 0.5 or 1)
            out += "\n" if prev.has_eol else " " if item.x - prev.right > char * SPACE else ""
        out += item.str.replace("\n", " ")
        prev = item
    return [t for t in (" ".join(part.split()) for part in out.split("\n")) if t]


def _joined(texts: list[str]) -> str:
    """STR5 over the lines of a block."""
    out: list[str] = []
    for t in texts:
        if out and HYPHEN_END.search(out[-1]) and GOES_ON.match(t):
            out[-1] = out[-1][:-1] + t
        else:
            out.append(t)
    return "\n".join(out)


def ordered(items: list[Item], width: float) -> tuple[str, str]:
    """TXO1: (text, layout) of one page's items in stream order."""
    usable = without_overprint([i for i in items if i.str and i.str.strip() and all(math.isfinite(v) for v in i[2:6])])
    if not usable:
        return "", "unknown"
    page = Page(width)
    text = "\n\n".join(t for t in map(_joined, page.blocks(usable)) if t)
    return text.strip(), "multi-column" if page.columns else "single-column"


def reading_order(items: DataFrame) -> DataFrame:
    """(doc_id, page, seq, str, x, y, width, height, has_eol[, page_width]) to one row a page: text and layout.

    Items of equal seq keep no order of their own. A null position drops its item.
    """
    width = F.col("page_width") if "page_width" in items.columns else F.lit(float(PAGE_WIDTH))
    rows = items.select("doc_id", F.col("page").cast("int").alias("page"), "seq", "str", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")], F.coalesce("has_eol", F.lit(False)).alias("has_eol"), width.cast("double").alias("page_width"))

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("seq", kind="stable")
        own = [Item(*r) for r in df[list(Item._fields)].itertuples(index=False)]
        return pd.DataFrame([(*key, *ordered(own, float(df["page_width"].fillna(PAGE_WIDTH).max())))], columns=["doc_id", "page", "text", "layout"])

    return rows.groupBy("doc_id", "page").applyInPandas(run, SCHEMA)


def document_layouts(pages: DataFrame) -> DataFrame:
    """CLS16, SRC7: a document's pages put together; it has columns if one of its pages has."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n")
    return pages.groupBy("doc_id").agg(text.alias("text"), F.when(F.max(F.col("layout") == "multi-column"), "multi-column").otherwise("single-column").alias("layout"))


def mean_confidence(values: list[float]) -> float | None:
    """SRC38: clamped to 0 to 1."""
    return min(1.0, max(0.0, fmean(values))) if values else None
