"""Dates cut back to the precision that their source text shows."""

from __future__ import annotations

import calendar
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.dates import MONTHS, SEASON
from foliary.functions.text import _fold

#: Characters looked at on each side of a year.
REACH = 32
PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
PERIOD_WORDS = {"semestre", "cuatrimestre", "trimestre", "bimestre", "quarter", "semester"}
LINKS, MARKS, ORDINAL_ENDS = {"de", "del", "of"}, {"/", ".", "-"}, {"st", "nd", "rd", "th", "º", "°", "o"}


def _small(piece: str, most: int) -> bool:
    return piece.isdigit() and len(piece) <= 2 and 1 <= int(piece) <= most


def _day_ends(pieces: list[str]) -> bool:
    """Whether the pieces end in a day, with or without an ordinal ending."""
    return bool(pieces) and (_small(pieces[-1], 99) or len(pieces) > 1 and pieces[-1] in ORDINAL_ENDS and _small(pieces[-2], 99))


def _without(pieces: list[str], words: set[str]) -> list[str]:
    return pieces[:-1] if pieces and pieces[-1] in words else pieces


def shown_before(text: str) -> tuple[bool, bool]:
    """Whether the text that a year follows names its month, and its day."""
    pieces = PIECE.findall(text)
    mark = pieces[-1] if pieces and pieces[-1] in MARKS | {","} else ""
    head = pieces[:-1] if mark else pieces
    if mark in MARKS and head and head[-1].isdigit():
        day = len(head) > 2 and head[-2] in MARKS and _small(head[-1], 99) and _small(head[-3], 99)
        return _small(head[-1], 12), day
    word = _without(_without(head, LINKS), {"."})
    if word and word[-1] in MONTHS:
        return True, mark in ("", ",", ".") and _day_ends(_without(word[:-1], LINKS))
    if word and word[-1] in SEASON.keys() | PERIOD_WORDS:
        return True, False
    if len(word) > 1 and ("".join(word[-2:]) in {"q1", "q2", "q3", "q4"} or word[-2] in "1234" and word[-1] in ("t", "q")):
        return True, False
    if mark in ("", ",") and _day_ends(head):
        name = _without(head[: -2 if head[-1] in ORDINAL_ENDS else -1], {"."})
        if name and name[-1] in MONTHS:
            return True, True
    return False, False


def shown_after(text: str) -> tuple[bool, bool]:
    """Whether the text that follows a year names its month, and its day."""
    if text[:1].isalnum():
        return False, False
    pieces = PIECE.findall(text)
    if len(pieces) > 1 and pieces[0] in MARKS and pieces[1].isdigit():
        half = len(pieces) > 2 and pieces[1] in "1234" and pieces[2] in ("t", "q") and pieces[0] in "-/"
        day = len(pieces) > 3 and pieces[2] in MARKS and _small(pieces[1], 99) and _small(pieces[3], 99)
        return half or _small(pieces[1], 12), day
    rest = pieces[1:] if pieces[:1] in (["-"], ["/"]) else pieces
    pair = "".join(rest[:2])
    if re.fullmatch("q[1-4]|s[12]|[1-4][tq]", pair):
        return True, False
    name = pieces[1:] if pieces[:1] == [","] else pieces
    return bool(name) and name[0] in MONTHS, False


def reduced(iso: str | None, text: str | None) -> tuple[str, str] | None:
    """DAT11: (shorter date, part that went) where a first or last month or day stands in no mention of the year."""
    m = re.fullmatch(r"(\d{4})-(0[1-9]|1[0-2])(?:-(\d{2}))?", iso or "")
    if not m:
        return None
    year, month, day = m.groups()
    if day not in (None, "01") and int(day) != calendar.monthrange(max(int(year), 1), int(month))[1]:
        return None
    if day is None and month not in ("01", "12"):
        return None
    folded = _fold(text or "")
    spots = [x.span() for x in re.finditer(rf"(?<!\d){year}(?!\d)", folded)]
    seen = [f for a, b in spots for f in (shown_before(folded[max(0, a - REACH) : a]), shown_after(folded[b : b + REACH]))]
    if not seen or day and any(d for _, d in seen):
        return None
    if month in ("01", "12") and not any(k for k, _ in seen):
        return year, "month"
    return (f"{year}-{month}", "day") if day else None


def reduce_precision(iso: Column, text: Column) -> Column:
    """DAT11 as a struct; nulls where nothing changes. Null or empty texts change nothing."""

    @F.pandas_udf("value string, reason string")
    def run(dates: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reduced(d, t) or (None, None) for d, t in zip(dates, texts, strict=True)], columns=["value", "reason"])

    return run(iso, text)


def years(text: Column) -> Column:
    """DAT13: all numbers of four digits, as text."""
    return F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1)


def months_after(year: Column, month: Column, n: Column) -> Column:
    """DAT15: yyyy-MM."""
    return F.date_format(F.add_months(F.make_date(year, month, F.lit(1)), n), "yyyy-MM")
