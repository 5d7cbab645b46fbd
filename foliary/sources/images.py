"""What the first bytes of an image tell, the languages OCR engines want, and formats of data sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results: OCR engines' codes of languages, and file extensions.
OCR_CODES = {
    "es": "spa", "en": "eng", "pt": "por", "fr": "fra", "de": "deu", "it": "ita", "ca": "cat", "eu": "eus", "gl": "glg", "nl": "nld",
    "pl": "pol", "ro": "ron", "ru": "rus", "uk": "ukr", "tr": "tur", "sv": "swe", "da": "dan", "nb": "nor", "no": "nor", "fi": "fin",
    "cs": "ces", "sk": "slk", "hu": "hun", "el": "ell", "he": "heb", "ar": "ara", "ja": "jpn", "ko": "kor", "zh": "chi_sim",
}
IMAGE_EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/webp": "webp", "image/tiff": "tiff"}
DOCUMENT_EXTENSIONS = {"pdf": "pdf", "docx": "docx", "text": "txt"}


def _big(content: Column, at: int, n: int) -> Column:
    """n bytes from the place at, the highest first, as a number."""
    return F.conv(F.hex(F.substring(content, at + 1, n)), 16, 10).cast("long")


def _little(content: Column, at: int, n: int) -> Column:
    return sum((F.shiftleft(_big(content, at + i, 1), 8 * i) for i in range(1, n)), _big(content, at, 1))


def _has(content: Column, at: int, text: str) -> Column:
    return F.substring(content, at + 1, len(text)) == F.lit(text.encode())


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header; none after a scan has begun."""
    at, end = 2, len(data) - 9
    while at < end:
        kind = data[at + 1]
        if data[at] != 0xFF or kind == 0xFF:  # between segments, and padding
            at += 1
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # markers without a length
            at += 2
        elif kind in (0xD9, 0xDA):
            return None
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4])
    return None


def image_size(content: Column) -> Column:
    """SRC19: struct of width and height in pixels of a PNG, JPEG or WebP; null for others, cut ones and sizes of 0."""
    size = lambda w, h: F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
    n, bits = F.length(content), _little(content, 21, 4)
    png = (n >= 24) & F.startswith(F.hex(F.substring(content, 1, 3)), F.lit("89504E")) & _has(content, 12, "IHDR")
    webp = (n >= 30) & _has(content, 0, "RIFF") & _has(content, 8, "WEBP")
    walked = F.pandas_udf(lambda images: pd.DataFrame([jpeg_size(bytes(x)) or (None, None) for x in images], columns=["width", "height"], dtype="Int64"), "width long, height long")
    jpeg = (n >= 4) & (F.hex(F.substring(content, 1, 2)) == "FFD8")
    got = (
        F.when(png, size(_big(content, 16, 4), _big(content, 20, 4)))
        .when(webp & _has(content, 12, "VP8 "), size(_little(content, 26, 2).bitwiseAND(F.lit(0x3FFF)), _little(content, 28, 2).bitwiseAND(F.lit(0x3FFF))))
        .when(webp & _has(content, 12, "VP8L"), size(bits.bitwiseAND(F.lit(0x3FFF)) + 1, F.shiftright(bits, 14).bitwiseAND(F.lit(0x3FFF)) + 1))
        .when(webp & _has(content, 12, "VP8X"), size(_little(content, 24, 3) + 1, _little(content, 27, 3) + 1))
        .when(jpeg, walked(F.when(jpeg, content).otherwise(F.lit(b""))))
    )
    return F.when((got["width"] > 0) & (got["height"] > 0), got)


def ocr_languages(codes: Column) -> Column:
    """SRC24: language hints as an engine's list ("spa+eng"), each once; null if none is left or a two-letter one is unknown."""
    low = F.filter(F.transform(codes, lambda c: F.lower(F.trim(c))), lambda c: F.split(c, "[-_]")[0] != "")
    book = F.create_map(*[F.lit(x) for pair in OCR_CODES.items() for x in pair])
    named = F.transform(low, lambda c: F.when(F.length(F.split(c, "[-_]")[0]) == 2, F.try_element_at(book, F.split(c, "[-_]")[0])).otherwise(F.split(c, "-")[0]))
    return F.when((F.size(low) > 0) & F.forall(named, lambda c: c.isNotNull()), F.array_join(F.array_distinct(named), "+"))


def dataset_format(kind: Column, mime: Column) -> Column:
    """SRC36: struct of format and extension for a detected kind; null if it isn't one of data sets."""
    plain = F.create_map(*[F.lit(x) for pair in DOCUMENT_EXTENSIONS.items() for x in pair])
    images = F.create_map(*[F.lit(x) for pair in IMAGE_EXTENSIONS.items() for x in pair])
    ext = F.when(kind == "image", F.try_element_at(images, F.coalesce(mime, F.lit("")))).otherwise(F.try_element_at(plain, F.coalesce(kind, F.lit(""))))
    return F.when(ext.isNotNull(), F.struct(kind.alias("format"), ext.alias("ext")))
