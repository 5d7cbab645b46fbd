"""What engines and other systems hand over, as tables that the rest of the library reads: words and blocks of OCR services,
pages to render, images for a model, records of rule-based parsers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from foliary.functions.dates import normalize, split_range
from foliary.functions.free_text import languages_of_text, location_of_text, skills_of_text
from foliary.operators.scoring import RECORD

# Fixed values that must equal the reference's for right results.
PHRASE_GAP, LEAST_GAP = 0.8, 1.0
NOMINAL_WIDTH, NOMINAL_HEIGHT = 1000, 1414
RENDER_SCALE, RENDER_PAGES = 2.0, 20
VISION_PAGES, VISION_BYTES, VISION_SIDE = 5, 15 * 1024 * 1024, 2000
VISION_MEDIA = ("image/png", "image/jpeg", "image/webp")

_unit = lambda percent: F.when(percent.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), percent / 100)))


def phrases(words: DataFrame) -> DataFrame:
    """SRC23: (doc_id, page, line, part, text, x, y, width, height, confidence) of words (doc_id, page, line, seq, text, x0,
    x1, top, bottom, confidence).

    A line's words are one phrase up to a gap of over 0.8 line heights; blank words are none. Confidences are percents to
    0 to 1, their mean null where no word has one. Words of equal seq keep no order of their own.
    """
    line = Window.partitionBy("doc_id", "page", "line").orderBy("seq")
    words = words.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    gap = F.col("x0") - F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    far = gap > F.greatest((F.col("bottom") - F.col("top")) * PHRASE_GAP, F.lit(LEAST_GAP))
    words = words.withColumn("far", F.coalesce(far, F.lit(False)).cast("long")).withColumn("part", F.sum("far").over(line))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w["text"]), " ")
    out = words.groupBy("doc_id", "page", "line", "part").agg(told.alias("text"), F.min("x0").alias("x"), F.max("x1").alias("x1"), F.min("top").alias("y"), F.max("bottom").alias("bottom"), F.avg(_unit(F.col("confidence"))).alias("confidence"))
    return out.select("doc_id", "page", "line", "part", "text", "x", "y", (F.col("x1") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height"), "confidence")


def line_items(blocks: DataFrame) -> DataFrame:
    """SRC25: (doc_id, page, seq, text, x, y, width, height, confidence) of the line blocks with text and a box, on a nominal page.

    Blocks have (doc_id, page, seq, kind, text, left, top, width, height, confidence), boxes as shares of the page.
    """
    rows = blocks.withColumn("text", F.trim("text")).where("kind = 'LINE' AND text <> '' AND left IS NOT NULL AND top IS NOT NULL")
    size = {"x": ("left", NOMINAL_WIDTH), "y": ("top", NOMINAL_HEIGHT), "w": ("width", NOMINAL_WIDTH), "h": ("height", NOMINAL_HEIGHT)}
    x, y, w, h = [(F.coalesce(F.col(c), F.lit(0.0)) * k).alias(n) for n, (c, k) in size.items()]
    return rows.select("doc_id", "page", "seq", "text", x, y, w.alias("width"), h.alias("height"), _unit(F.col("confidence")).alias("confidence"))


def layout_texts(blocks: DataFrame, depth: int = 8) -> DataFrame:
    """SRC25: (doc_id, page, text) of pages with layout blocks, which tell the reading order; others need line_items.

    Blocks have (doc_id, page, seq, id, kind, text, children). A block's path is its ancestors' places; a line stands at the
    least of its paths, once. Layout blocks inside others speak through those only. Lines of no layout block come last. An
    empty line between blocks, a line break between lines. Blocks nested over `depth` deep raise an error.
    """
    page = ["doc_id", "page"]
    layout = F.col("kind").startswith("LAYOUT_")
    edges = blocks.where(layout).select(*page, F.col("id").alias("parent"), F.posexplode("children").alias("k", "id"))
    targets = blocks.select(*page, "id", "kind", F.trim("text").alias("text")).where("id IS NOT NULL")
    links = edges.join(targets, [*page, "id"])
    inner = links.where(layout).select(*page, "id")
    paths = blocks.where(layout).join(inner, [*page, "id"], "left_anti").select(*page, "id", F.array(F.col("seq").cast("long")).alias("path"))
    found = None
    for level in range(depth + 1):
        below = links.join(paths.select(*page, F.col("id").alias("parent"), "path"), [*page, "parent"])
        below = below.select(*page, "id", "kind", "text", F.concat("path", F.array(F.col("k").cast("long"))).alias("path"))
        lines = below.where("kind = 'LINE'")
        found = lines if found is None else found.unionByName(lines)
        paths = below.where(layout).select(*page, "id", "path")
        if level >= 2 and not paths.head(1):
            break
    else:
        raise ValueError(f"layout blocks nested over {depth} deep")
    placed = found.groupBy(*page, "id").agg(F.min("path").alias("path"), F.first("text").alias("text"))
    lines = blocks.where("kind = 'LINE' AND trim(text) <> ''")
    with_layout = blocks.where(layout).select(*page).distinct()
    orphans = lines.join(placed, [*page, "id"], "left_anti").join(with_layout, page, "left_semi")
    rows = placed.where("text <> ''").select(*page, F.lit(0).alias("last"), F.col("path")[0].alias("root"), "path", "text")
    rows = rows.unionByName(orphans.select(*page, F.lit(1).alias("last"), F.lit(0).cast("long").alias("root"), F.array(F.col("seq").cast("long")).alias("path"), F.trim("text").alias("text")))
    told = lambda key, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, "text"))), lambda x: x["text"]), sep).alias("text")
    parts = rows.groupBy(*page, "last", "root").agg(told(["path"], "\n"))
    texts = parts.groupBy(*page).agg(told(["last", "root"], "\n\n"))
    return with_layout.join(texts, page, "left").withColumn("text", F.coalesce("text", F.lit("")))


def wanted_pages(total: Column, asked: Column, most: int = RENDER_PAGES) -> Column:
    """SRC18: a struct of the pages to render and whether some were left out; a null list asks for all.

    The limit is the feature: a renderer takes `most` pages of a document. Repeated pages and ones that don't exist are not asked.
    """
    every = F.when(total > 0, F.sequence(F.lit(1).cast("long"), total)).otherwise(F.array().cast("array<bigint>"))
    real = F.when(asked.isNull(), every).otherwise(F.array_distinct(F.filter(asked.cast("array<bigint>"), lambda p: (p >= 1) & (p <= total))))
    return F.struct(F.slice(real, 1, most).alias("pages"), (F.size(real) > most).alias("truncated"))


def render_scale(width: Column, height: Column, side: int | None = None, scale: float = RENDER_SCALE) -> Column:
    """SRC18: the scale of a page, less where its longest side would be over `side` pixels."""
    longest = F.greatest(width, height).cast("double")
    return F.lit(scale) if not side else F.when(longest * scale > side, F.lit(float(side)) / longest).otherwise(F.lit(scale))


def vision_input(images: DataFrame) -> DataFrame:
    """SRC26: images (media, bytes) with error: the code where a model can't take the image, else null."""
    known = F.coalesce(F.col("media").isin(*VISION_MEDIA), F.lit(False))
    return images.withColumn("error", F.when(~known | (F.col("bytes") > VISION_BYTES), F.lit("UNSUPPORTED_INPUT")))


def recognize(images: DataFrame, start: Callable[[str], Callable[[bytes], tuple[str, float | None]]]) -> DataFrame:
    """SRC23, SRC37: (doc_id, page, text, confidence, error) of images (doc_id, page, languages, content).

    start(languages) gives an engine, in the worker that uses it, when its first image comes. Each task's rows are ordered by
    languages, so it starts an engine once for each. An engine's failure is the row's error, OCR_FAILED and what it said;
    a lost executor's images are read anew.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, speaks = None, None
        for df in batches:
            out = []
            for r in df.itertuples(index=False):
                try:
                    if engine is None or speaks != r.languages:
                        engine, speaks = start(r.languages), r.languages
                    text, confidence = engine(bytes(r.content))
                    out.append((r.doc_id, r.page, text, confidence, None))
                except Exception as e:  # whatever an engine raises is the row's error
                    out.append((r.doc_id, r.page, None, None, f"OCR_FAILED: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "page", "text", "confidence", "error"])

    rows = images.select("doc_id", F.col("page").cast("long"), "languages", "content").sortWithinPartitions("languages")
    return rows.mapInPandas(run, f"doc_id {images.schema['doc_id'].dataType.simpleString()}, page long, text string, confidence double, error string")


def reader_items(items: DataFrame) -> DataFrame:
    """SRC35: a PDF reader's items (text, has_eol, ...) without a broken hyphen's extra signs, and without blank ones that end no line."""
    return items.withColumn("text", F.replace("text", F.lit("-­‐"), F.lit("-"))).where(F.col("has_eol") | (F.regexp_replace("text", r"\s", "") != ""))


def _record(**parts: Column) -> Column:
    """A struct of the type RECORD with these fields; the others are null."""
    kind = _parse_datatype_string(RECORD)
    none = lambda f: F.lit(None).cast(f.dataType)

    def filled(t: StructType, told: dict) -> Column:
        return F.struct(*[(filled(f.dataType, told[f.name]) if isinstance(told.get(f.name), dict) else told[f.name].cast(f.dataType) if f.name in told else none(f)).alias(f.name) for f in t.fields])

    return filled(kind, parts)


def _told(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _skills(names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(None).cast("array<string>").alias("keywords")))


def record_of_parts(parts: Column) -> Column:
    """UDX4: the record of a parser with flat fields: name, email, phone, and skills and languages as text."""
    basics = {k: _told(parts[k]) for k in ("name", "email", "phone")}
    return _record(basics=basics, skills=_skills(skills_of_text(parts["skills"])), languages=F.transform(languages_of_text(parts["languages"]), lambda x: F.struct(x["language"])))


def _dates(texts: Column, today: dt.date, alone: str) -> Column:
    """DAT16 over a list of texts, which functions of its elements can't read: a struct of start and end for each."""

    def read(text: str | None) -> dict:
        span = split_range(text, today)
        if span:
            return {"start": span["start"], "end": None if span["current"] else span["end"]}
        return {"start": None, "end": None, alone: normalize(text, today)["value"]}

    @F.pandas_udf("array<struct<start: string, end: string>>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: None if row is None else [read(t) for t in row])

    return run(texts)


def record_of_profile(profile: Column, today: dt.date) -> Column:
    """UDX4: the record of a parser with sections: name, email, phone, location; jobs (company, title, date); schools (school,
    degree, date); skills as a list of texts. An entry without both names is none; a lone date of a school is its end."""

    def entries(rows: Column, a: str, b: str, alone: str, *more: Column) -> Column:
        every = F.zip_with(rows, _dates(rows["date"], today, alone), lambda x, d: F.struct(_told(x[a]).alias("a"), _told(x[b]).alias("b"), *more, d["start"].alias("s"), d["end"].alias("e")))
        return F.filter(every, lambda x: x["a"].isNotNull() | x["b"].isNotNull())

    return _record(
        basics={**{k: _told(profile[k]) for k in ("name", "email", "phone")}, "location": {"city": location_of_text(profile["location"])["city"]}},
        work=entries(profile["jobs"], "company", "title", "start"),
        education=entries(profile["schools"], "school", "degree", "end", F.lit(None).cast("string").alias("area")),
        skills=_skills(skills_of_text(F.array_join(profile["skills"], "\n"))),
        languages=F.array().cast("array<struct<language: string>>"),
    )
