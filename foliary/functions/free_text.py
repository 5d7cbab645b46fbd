"""Free text of other systems as fields of records (STR6-9, DAT16), in column expressions. Null text is empty."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliary.functions.dates import date_range, normalize_date

# Fixed values that must equal the reference's for right results.
SKILL_BULLETS, LANGUAGE_BREAKS = "•●▪■◦‣∙·⦁○*", r"\n|[•●▪·]|[,;|]"
SKILL_LABEL, SKILL_CUTS, SKILL_CHARS = r"^[^:,;]{1,40}:\s*", r"[,;|]|\s/\s|\s[-–—]\s", 60
LANGUAGE = r"^\s*([^:(–—-]+?)\s*(?:[:–—-]\s*(.+?)|\((.+?)\))?\s*$"
END = "{end}"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def skills_of_text(text: Column) -> Column:
    """STR6: names between bullets, commas and the like, without a line's label; the first spelling of each stays."""
    lines = F.transform(F.split(_text(text), "\n"), lambda x: F.translate(F.regexp_replace(x, SKILL_LABEL, ""), SKILL_BULLETS, "," * len(SKILL_BULLETS)))
    names = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, SKILL_CUTS), lambda p: F.trim(F.regexp_replace(p, r"\.$", "")))))
    names = F.filter(names, lambda n: (n != "") & (F.length(n) <= SKILL_CHARS))
    keys = F.transform(names, F.lower)
    return F.filter(names, lambda n, i: F.array_position(keys, F.lower(n)) == i + 1)


def languages_of_text(text: Column) -> Column:
    """STR7: structs of language and fluency from "X: level", "X - level" and "X (level)"."""
    part = lambda x, k: F.trim(F.regexp_extract(x, LANGUAGE, k))
    level = lambda x: F.coalesce(F.nullif(part(x, 2), F.lit("")), F.nullif(part(x, 3), F.lit("")))
    told = F.transform(F.split(_text(text), LANGUAGE_BREAKS), lambda x: F.struct(part(x, 1).alias("language"), level(x).alias("fluency")))
    return F.filter(told, lambda x: ~x["language"].isin("", END))


def location_of_text(text: Column) -> Column:
    """STR9: the first of the comma's parts is the city; the second the region if there are more than two."""
    parts = F.filter(F.transform(F.split(_text(text), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.struct(F.get(parts, 0).alias("city"), F.when(F.size(parts) > 2, F.get(parts, 1)).alias("region"))


def marked_rows(text: Column) -> Column:
    """STR8: trimmed rows with text, and a row that marks the end."""
    rows = F.transform(F.split(_text(text), "\n"), lambda r: F.trim(F.regexp_replace(r, r"[\r\t]", "")))
    return F.array_join(F.concat(F.filter(rows, lambda r: r != ""), F.array(F.lit(END))), "\n")


def dates_of_text(text: Column, today: dt.date, alone: str = "start") -> Column:
    """DAT16: a struct of start and end; a date without a range goes to the side named."""
    span, one = date_range(text, today), normalize_date(text, today)["value"]
    ranged, none = span["start"].isNotNull(), F.lit(None).cast("string")
    start = F.when(ranged, span["start"]).otherwise(one if alone == "start" else none)
    return F.struct(start.alias("start"), F.when(ranged, F.when(~span["current"], span["end"])).otherwise(one if alone == "end" else none).alias("end"))
