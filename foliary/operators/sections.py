"""Sections of documents by their headings (WIN1, JOI3, JOI6), as native plans over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions.headings import LEAD, TAIL, is_boundary, looks_like_heading, names_languages, section_keys
from foliary.functions.text import fold


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("pos", "line"))


def headed_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CLS10: (key, section) for each section that a document heads, or labels inline. Nothing for null texts."""
    found = F.concat(section_keys(F.col("line")), F.when(names_languages(F.col("line")), F.array(F.lit("languages"))).otherwise(F.array().cast("array<string>")))
    return _lines(docs, key, text).select(key, F.explode(found).alias("section")).distinct()


def section_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", unknown: bool = False) -> DataFrame:
    """DM10: (key, section, heading, start, end), lines from 0; a span ends at the next heading or the last line.

    With unknown, lines that merely look like headings open spans "other". Only headings are dealt out, with the
    number of lines, so a document's whole lines never meet in one task.
    """
    rows = docs.select(key, F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("n_lines"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select(key, "n_lines", F.posexplode(F.split("_text", "\r?\n")).alias("start", "line"))
    line = F.col("line")
    short = F.length(F.trim(F.regexp_replace(fold(line), LEAD, ""))).between(1, 60)
    other = is_boundary(line) | (short & looks_like_heading(line)) if unknown else is_boundary(line)
    keys = section_keys(line)
    rows = rows.select(key, "n_lines", "start", "line", F.when(F.size(keys) > 0, F.get(keys, 0)).when(other, "other").alias("section")).where("section IS NOT NULL")
    end = F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("start")), F.col("n_lines"))
    heading = F.regexp_replace(F.regexp_replace(F.trim("line"), LEAD, ""), TAIL, "")
    return rows.select(key, "section", heading.alias("heading"), F.col("start").cast("long").alias("start"), end.cast("long").alias("end"))


def uncovered(docs: DataFrame, filled: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """JOI6, GRD15: headed sections without a row (key, section) in filled."""
    return headed_sections(docs, key, text).join(filled.select(key, "section"), [key, "section"], "left_anti")
