"""Pages of documents: which are scans, and text layers and recognized pages put together. All are tables by (doc_id, page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
MIN_TEXT_CHARS, MIN_PAGE_CHARS, SCAN_COVERAGE, LOW_CONFIDENCE = 20, 80, 0.25, 0.7
SAVE, RESTORE, TRANSFORM, FORM_BEGIN, FORM_END, IMAGES = 10, 11, 12, 74, 75, (83, 90)

BLANK = r"[\x09-\x0D\x20]+"


def image_coverage(ops: Column, area: Column) -> Column:
    """SRC8: the largest share of a page that one painted image takes, of (code, args) drawing operators in their order.

    An image fills the unit square under the current matrix, so its area is that matrix' determinant.
    """
    start = F.struct(F.array(*[F.lit(float(x)) for x in (1, 0, 0, 1, 0, 0)]).alias("m"), F.array().cast("array<array<double>>").alias("saved"), F.lit(0.0).alias("most"))

    def under(m: Column, n: Column) -> Column:
        x = lambda i, j, k: n[i] * m[j] + n[i + 1] * m[j + 2] + (m[k] if k is not None else F.lit(0.0))
        return F.array(x(0, 0, None), x(0, 1, None), x(2, 0, None), x(2, 1, None), x(4, 0, 4), x(4, 1, 5))

    def step(s: Column, op: Column) -> Column:
        code, six = op["code"], F.size(op["args"]) == 6
        back = code.isin(RESTORE, FORM_END) & (F.size(s["saved"]) > 0)
        saved = F.when(code.isin(SAVE, FORM_BEGIN), F.concat(s["saved"], F.array(s["m"]))).when(back, F.slice(s["saved"], 1, F.size(s["saved"]) - 1)).otherwise(s["saved"])
        m = F.when(back, F.element_at(s["saved"], F.when(back, F.lit(-1)).otherwise(F.lit(1)))).when(code.isin(TRANSFORM, FORM_BEGIN) & six, under(s["m"], op["args"])).otherwise(s["m"])
        share = F.least(F.lit(1.0), F.abs(s["m"][0] * s["m"][3] - s["m"][1] * s["m"][2]) / area)
        return F.struct(m.alias("m"), saved.alias("saved"), F.when(code.between(*IMAGES) & (area > 0), F.greatest(s["most"], share)).otherwise(s["most"]).alias("most"))

    # a saved matrix is only looked up where there is one
    return F.aggregate(ops, start, step, lambda s: s["most"])


def judged(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text, layout, coverage) with chars, needs_ocr and image_only (SRC9).

    A page needs recognition if it has no text, or little and a large image; a document is images only if all its pages
    do, or if the others have almost no text.
    """
    chars = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), BLANK, "")).cast("long")
    rows = pages.withColumn("chars", chars).withColumn("needs_ocr", (F.col("chars") == 0) | (F.col("chars") < MIN_PAGE_CHARS) & (F.coalesce("coverage", F.lit(0.0)) >= SCAN_COVERAGE))
    w = Window.partitionBy("doc_id")
    little = F.sum(F.when(F.col("needs_ocr"), 0).otherwise(F.col("chars"))).over(w) < MIN_TEXT_CHARS
    return rows.withColumn("image_only", F.min("needs_ocr").over(w) | little)


def _joined(text: Column, *order: str) -> Column:
    """Texts with a blank line between, in order; those that are null or empty are left out."""
    kept = F.collect_list(F.when(F.coalesce(text, F.lit("")) != "", F.struct(*order, text.alias("t"))))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: p["t"]), "\n\n")


def _numbers(which: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(which, F.col("page"))))


def layout_of(layout: Column) -> Column:
    """SRC11, an aggregate: several columns if a page has, else one if a page has, else unknown."""
    return F.when(F.max(layout == "multi-column"), "multi-column").when(F.max(layout == "single-column"), "single-column").otherwise("unknown")


def text_layer(pages: DataFrame) -> DataFrame:
    """SRC10: (doc_id, text, pages, layout, scanned, image_only) of judged pages; scanned ones are listed, not read."""
    read = ~F.col("needs_ocr")
    return pages.groupBy("doc_id").agg(_joined(F.when(read, F.col("text")), "page").alias("text"), F.count(F.lit(1)).alias("pages"), layout_of(F.when(read, F.col("layout"))).alias("layout"), _numbers(F.col("needs_ocr")).alias("scanned"), F.max("image_only").alias("image_only"))


def flipped(items: DataFrame) -> DataFrame:
    """SRC34: items with y from the top edge to items with y from the bottom, at their base."""
    return items.withColumn("y", F.col("page_height") - (F.col("y") + F.col("height"))).withColumn("has_eol", F.lit(False))


def line_blocks(blocks: DataFrame) -> DataFrame:
    """SRC38: (doc_id, page, lines, confidence) of the blocks that are lines with text; percents to 0 to 1, null where none is told."""
    rows = blocks.where("kind = 'LINE'").where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), BLANK, " ")) != "")
    return rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("lines"), F.when(F.count("confidence") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("confidence") / 100))).alias("confidence"))


def recognized(ocr: DataFrame) -> DataFrame:
    """SRC21: (doc_id, page, part, text, layout, confidence, low, empty) of what an OCR stage returned, cleaned."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"))
    rows = ocr.withColumn("text", F.regexp_replace(F.regexp_replace(text, rf"^{BLANK}", ""), rf"{BLANK}$", ""))
    return rows.withColumns({"low": F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(False)), "empty": F.col("text") == ""})


def recognized_documents(ocr: DataFrame) -> DataFrame:
    """SRC22: recognized pages put together, with the mean of the confidences that were told."""
    return ocr.groupBy("doc_id").agg(_joined(F.col("text"), "page", "part").alias("text"), F.count(F.lit(1)).alias("pages"), layout_of(F.col("layout")).alias("layout"), F.avg("confidence").alias("confidence"), _numbers(F.col("low")).alias("low"), _numbers(F.col("empty")).alias("empty"))


def merged(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """SRC12, JOI16: judged pages and recognized ones, by page number, to one row a document.

    A recognized page takes the place of the text layer's; one that needed recognition and got none is listed as
    skipped; the others keep their text.
    """
    parts = F.array_sort(F.collect_list(F.struct("part", "text", "confidence", "layout")))
    found = ocr.groupBy("doc_id", "page").agg(parts.alias("parts"))
    both = pages.select("doc_id", "page", "text", "layout", (F.col("image_only") | F.col("needs_ocr")).alias("wanted")).join(found, ["doc_id", "page"], "full")
    kept = F.array(F.struct(F.lit(0).cast("long").alias("part"), "text", F.lit(None).cast("double").alias("confidence"), "layout"))
    skipped = F.col("parts").isNull() & F.col("wanted")
    rows = both.select("doc_id", "page", skipped.alias("skipped"), F.col("parts").isNotNull().alias("read"), F.explode_outer(F.when(F.col("parts").isNotNull(), F.col("parts")).when(~F.col("wanted"), kept)).alias("p"))
    rows = rows.select("doc_id", "page", "skipped", "read", "p.*")
    return rows.groupBy("doc_id").agg(_joined(F.col("text"), "page", "part").alias("text"), layout_of(F.col("layout")).alias("layout"), F.avg("confidence").alias("confidence"), F.count_if("read").alias("ocr_pages"), _numbers(F.col("skipped")).alias("skipped"))
