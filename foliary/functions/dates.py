"""Human-written dates to ISO strings of the written precision, by tables of patterns. A reference date is a parameter."""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.lexicon import MONTH_WORDS, NUMBER_WORDS, ONGOING, ORDINALS, PERIODS, SEASONS, by_word

MONTHS, SEASON, NUMBER, ORDINAL, SPAN = (by_word(x) for x in (MONTH_WORDS, SEASONS, NUMBER_WORDS, ORDINALS, PERIODS))
ISO = re.compile(r"\d{4}(?:-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12]\d|3[01]))?)?")
SEASON_NOTE = "Season mapped to its Northern-hemisphere start month; the hemisphere is ambiguous"
YEAR = r"(?P<y>\d{4}|\d{2})"


def tidy(text: str) -> str:
    """CLN3."""
    text = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", text)).lower()
    text = re.sub(r"\.(?=\s|$)", "", re.sub("[‐-―−]", "-", text))
    return re.sub(r"\s+", " ", re.sub(r"[,;:()\[\]]", " ", text)).strip()


def year_of(raw: str) -> int:
    """DAT4."""
    n = int(raw)
    return n if len(raw) == 4 else n + (2000 if n <= 49 else 1900)


def iso(y: int, m: int | None = None, d: int | None = None) -> str | None:
    if not 1900 <= y <= 2100 or m is not None and not 1 <= m <= 12 or d is not None and not 1 <= d <= 31:
        return None
    return "-".join([f"{y}", *(f"{x:02d}" for x in (m, d) if x is not None)])


#: DAT3: (pattern, reading of its groups). The first pattern that fits and reads as a date gives it; those marked
#: final end the search even if they don't.
def _numeric(g: dict) -> str | None:
    return iso(int(g["y"]), *(int(g[k]) for k in ("m", "d") if g[k] is not None))


def _day_first(g: dict) -> str | None:
    y, a, b = year_of(g["y"]), int(g["a"]), int(g["b"])
    return iso(y, b, a) or iso(y, a, b)


def _named(g: dict) -> str | None:
    m = MONTHS.get(g["name"])
    return iso(year_of(g["y"]), m, int(g["d"]) if g.get("d") else None) if m else None


CORE: list[tuple[str, Callable[[dict], str | None], bool]] = [
    (r"(?P<y>\d{4})(?:[-/.](?P<m>\d{1,2}))?(?:[-/.](?P<d>\d{1,2}))?", _numeric, True),
    (rf"(?P<m>\d{{1,2}})[-/.]{YEAR}", lambda g: iso(year_of(g["y"]), int(g["m"])), True),
    (rf"(?P<a>\d{{1,2}})[-/.](?P<b>\d{{1,2}})[-/.]{YEAR}", _day_first, True),
    (rf"(?P<name>[a-z]+) (?:del? )?{YEAR}", _named, False),
    (r"(?P<y>\d{4}) (?P<name>[a-z]+)", _named, False),
    (rf"(?P<d>\d{{1,2}}) (?:de )?(?P<name>[a-z]+) (?:del? )?{YEAR}", _named, False),
    (r"(?P<name>[a-z]+) (?P<d>\d{1,2}) (?P<y>\d{4})", _named, False),
    (r"(?P<iso>\d{4}-\d{2}-\d{2})t.*", lambda g: g["iso"] if ISO.fullmatch(g["iso"]) else None, False),
]
OF = r"(?:del? |of )?"
#: DAT7.
PERIOD = [
    rf"(?P<unit>[qsht])(?P<n>\d)[ /-]{OF}{YEAR}",
    rf"(?P<n>\d)(?P<unit>[qsht])[ /-]{OF}{YEAR}",
    r"(?P<y>\d{4})[ /-]?(?P<unit>[qsht])(?P<n>\d)",
    r"(?P<y>\d{4})[ /-]?(?P<n>\d)(?P<unit>[qsht])",
    rf"(?P<n>[a-z]+|\d) (?P<unit>[a-z]{{2,}}) {OF}{YEAR}",
    rf"(?P<unit>[a-z]{{2,}}) (?P<n>\d) {OF}{YEAR}",
]


def core(text: str) -> str | None:
    for pattern, read, final in CORE:
        if m := re.fullmatch(pattern, text):
            if (out := read(m.groupdict())) or final:
                return out
    return None


def relative(text: str, ref: dt.date) -> str | None:
    """DAT5: years give a year, months a month."""
    m = re.fullmatch(r"(?:desde |since |from )?(?:hace|ha) (\S+) (\S+)", text) or re.fullmatch(r"(?:desde |since |from )?(\S+) (\S+) (?:ago|atras)", text)
    if not m:
        return None
    n = int(m[1]) if re.fullmatch(r"[0-9]{1,3}", m[1]) else NUMBER.get(m[1])
    if n is None:
        return None
    if re.fullmatch("anos?|anios?|years?|yrs?", m[2]):
        return iso(ref.year - n)
    if re.fullmatch("mes|meses|months?|mos?", m[2]):
        y, k = divmod(ref.year * 12 + ref.month - 1 - n, 12)
        return iso(y, k + 1)
    return None


def season(text: str) -> str | None:
    """DAT6."""
    m = re.fullmatch(rf"(?P<name>[a-z]+)(?: del?| of)? {YEAR}", text) or re.fullmatch(r"(?P<y>\d{4}) (?P<name>[a-z]+)", text)
    return iso(year_of(m["y"]), SEASON[m["name"]]) if m and m["name"] in SEASON else None


def period(text: str) -> str | None:
    text = re.sub(r"\s*([°ºª])", r"\1", text)
    text = re.sub(r"(\d)\.?(?:er|ero|era|do|da|ro|ra|to|ta|vo|va|mo|ma|no|na|st|nd|rd|th|o|a|°|º|ª)(?= |$)", r"\1", text)
    for pattern in PERIOD:
        if m := re.fullmatch(pattern, text):
            n = int(m["n"]) if m["n"].isdigit() else ORDINAL.get(m["n"])
            span = SPAN.get(m["unit"])
            if n is None or span is None:
                continue
            first = (n - 1) * span + 1
            return iso(year_of(m["y"]), first) if n >= 1 and first <= 12 else None
    return None


def loose_year(text: str) -> str | None:
    """DAT8."""
    m = re.fullmatch(r"(?:ano |year |desde |from |since |en |in )?(\d{4})(?: (.*))?", text)
    rest = (m[2] or "") if m else ""
    return iso(int(m[1])) if m and len(text) <= 24 and not re.search(r"\d", rest) and rest[:1] not in ("-", "/") else None


def resolve(text: str, ref: dt.date, loose: bool) -> tuple[str | None, bool, str | None] | None:
    """DAT2: (value, current, note), or None."""
    if text in ONGOING or re.sub("^(?:hasta|until|to) ", "", text) in ONGOING:
        return None, True, None
    if v := relative(text, ref):
        return v, False, f"Relative date resolved against {ref.isoformat()}"
    if v := season(text):
        return v, False, SEASON_NOTE
    v = period(text) or core(text) or (loose_year(text) if loose else None)
    return (v, False, None) if v else None


def _end(text: str, start: str, ref: dt.date) -> tuple[str | None, bool] | None:
    if re.fullmatch(r"\d{2}", text):
        century, yy = divmod(int(start[:4]), 100)
        v = iso(century * 100 + int(text)) if int(text) > yy else None
        return (v, False) if v else None
    r = resolve(text, ref, True)
    return r[:2] if r else None


def _pair(a: str, b: str, ref: dt.date) -> tuple | None:
    start = resolve(a.strip(), ref, True) if a.strip() and b.strip() else None
    end = _end(b.strip(), start[0], ref) if start and start[0] else None
    return (start[0], *end) if end else None


def range_of(text: str, ref: dt.date) -> tuple[str, str | None, bool] | None:
    """DAT9 on tidy text: the first split whose two sides are dates."""
    m = re.match("(desde|from|since|del?|entre|between) ", text)
    word, body = (m[1], text[m.end() :]) if m else ("", text)
    for now in sorted(ONGOING, key=len, reverse=True):
        if body == now or not body:
            return None
        if body.endswith((f" {now}", f"-{now}")):
            head = re.sub(r"(?:^|\s)(?:a|al|to|hasta|until|till|through|thru|ate)$|-$", "", body[: -len(now)].strip()).strip()
            r = resolve(head, ref, True) if head else None
            return (r[0], None, True) if r and r[0] else None
    for s in re.finditer(r" (a|al|hasta|to|until|till|through|thru|ate|y|and|e) ", body):
        if s[1] in ("y", "and", "e") and word not in ("entre", "between"):
            continue
        if r := _pair(body[: s.start()], body[s.end() :], ref):
            return r
    for s in re.finditer("-", body):
        if r := _pair(body[: s.start()], body[s.end() :], ref):
            return r
    if s := re.fullmatch(r"(\d{4})/(\d{4}|\d{2})", body):
        return _pair(s[1], s[2], ref)
    if word in ("desde", "from", "since"):
        r = resolve(body, ref, True)
        return (r[0], None, False) if r and r[0] else None
    return None


def normalize(text: str | None, ref: dt.date) -> dict:
    """DAT1."""
    out = {"value": None, "current": False, "unparsed": False, "note": None}
    raw = (text or "").strip()
    if ISO.fullmatch(raw):
        return out | ({"value": raw} if iso(int(raw[:4])) else {"unparsed": True})
    text = tidy(raw)
    if text in ("", "null", "n/a", "-"):
        return out
    if r := resolve(text, ref, False):
        return out | dict(zip(("value", "current", "note"), r, strict=True))
    span = range_of(text, ref)
    v = None if span and (span[1] or span[2]) else loose_year(text)
    return out | ({"value": v} if v else {"unparsed": True})


def split_range(text: str | None, ref: dt.date) -> dict | None:
    raw = (text or "").strip()
    clean = tidy(raw)
    if not clean or ISO.fullmatch(raw) or resolve(clean, ref, False):
        return None
    r = range_of(clean, ref)
    return dict(zip(("start", "end", "current"), r, strict=True)) if r else None


def latest(text: str | None, ref: dt.date) -> str | None:
    """DAT10: the latest of a list of two dates or more."""
    found = [v for p in re.split(r"[;,/|\n]| y | and | e ", text or "") if (v := normalize(p, ref)["value"])]
    return max(found) if len(found) >= 2 else None


#: Readings that a worker keeps from one batch to the next, for dates repeat, and the longest text it keeps one of.
REMEMBERED, REMEMBERED_CHARS = 100_000, 60


@lru_cache(REMEMBERED)
def _kept_date(text: str, ref: dt.date) -> tuple:
    return tuple(normalize(text, ref).values())


@lru_cache(REMEMBERED)
def _kept_range(text: str, ref: dt.date) -> tuple | None:
    out = split_range(text, ref)
    return out and tuple(out.values())


def _short(text: str | None) -> bool:
    return text is not None and len(text) <= REMEMBERED_CHARS


def read_date(text: str | None, ref: dt.date) -> tuple:
    return _kept_date(text, ref) if _short(text) else _kept_date.__wrapped__(text, ref)


def read_range(text: str | None, ref: dt.date) -> tuple | None:
    return _kept_range(text, ref) if _short(text) else _kept_range.__wrapped__(text, ref)


def normalize_date(col: Column, ref: dt.date) -> Column:
    @F.pandas_udf("value string, current boolean, unparsed boolean, note string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_date(t, ref) for t in texts], columns=["value", "current", "unparsed", "note"])

    return run(col)


def date_range(col: Column, ref: dt.date) -> Column:
    @F.pandas_udf("start string, end string, current boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_range(t, ref) or (None, None, None) for t in texts], columns=["start", "end", "current"])

    return run(col)


def latest_date(col: Column, ref: dt.date) -> Column:
    return F.pandas_udf(lambda texts: texts.map(lambda t: latest(t, ref)), "string")(col)


def strict_iso(col: Column) -> Column:
    """DAT17."""
    return col.rlike(f"^{ISO.pattern}$")


def last_day(col: Column) -> Column:
    """DAT12."""
    d = F.try_to_date(col, "yyyy-MM-dd")
    return F.coalesce(F.last_day(d) == d, F.lit(False))
