"""Format detection and readers. PDF, OCR and model stages are callables that a caller passes in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.lexicon import ENTITIES
from foliary.functions.text import series_udf
from foliary.sources.docx import docx_text

_magic = lambda c, h: F.startswith(F.hex(F.substring(c, 1, len(h) // 2)), F.lit(h))


def looks_like_text(content: Column) -> Column:
    """SRC2: strict UTF-8 without NUL in the first 8 KiB."""
    head = F.substring(content, 1, 8192)
    return F.call_function("is_valid_utf8", head.cast("string")) & (F.position(F.lit(b"\x00"), head) == 0)


def detect_format(content: Column, name: Column) -> Column:
    """SRC1: magic bytes decide, the name only between kinds that share them."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    texty = ext.isin("txt", "md", "text", "markdown")
    pdf = F.position(F.lit(b"%PDF-"), F.substring(content, 1, 1024)) > 0
    image = _magic(content, "89504E47") | _magic(content, "FFD8FF") | _magic(content, "49492A00") | _magic(content, "4D4D002A") | (_magic(content, "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"))
    zip_ = _magic(content, "504B0304")
    docx = (F.position(F.lit(b"word/"), content) > 0) | (ext == "docx")
    return (
        F.when(pdf & ~(texty & looks_like_text(content)), "pdf").when(_magic(content, "FFFE") | _magic(content, "FEFF"), "text")
        .when(zip_ & docx, "docx").when(zip_, "zip").when(_magic(content, "D0CF11E0A1B11AE1"), "legacy-doc").when(image, "image")
        .when(looks_like_text(content) & (F.length(content) > 0), "text").otherwise("unknown")
    )


def mime(content: Column) -> Column:
    """SRC5."""
    return F.when(_magic(content, "89504E47"), "image/png").when(_magic(content, "FFD8FF"), "image/jpeg").when(_magic(content, "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "image/webp").when(_magic(content, "49492A00") | _magic(content, "4D4D002A"), "image/tiff")


def decode_text(content: Column) -> Column:
    """SRC4: by byte order mark, which goes."""
    body = lambda k: F.substring(content, k, 2**31 - 1)
    return F.when(_magic(content, "FFFE"), F.decode(body(3), "UTF-16LE")).when(_magic(content, "FEFF"), F.decode(body(3), "UTF-16BE")).when(_magic(content, "EFBBBF"), body(4).cast("string")).otherwise(content.cast("string"))


def decode_entities(text: str) -> str:
    """HTM5: six names and numbers; surrogates and numbers out of range give U+FFFD; other names stay."""

    def one(m: re.Match) -> str:
        if m[2]:
            n = int(m[2][1:], 16) if m[2][0] in "xX" else int(m[2])
            return "�" if 0xD800 <= n <= 0xDFFF or n > 0x10FFFF or n == 0 else chr(n)
        return ENTITIES.get(m[1], m[0])

    return re.sub(r"&(?:([A-Za-z]\w*)|#([xX][0-9a-fA-F]+|\d+));", one, text)


class _Blocks(HTMLParser):
    """HTM1-4: paragraphs, list items and tables as blocks of text; scripts and styles are skipped.

    The parser reads a name after & as an entity even without a semicolon and doesn't tell which, so it gets every & as
    &amp;, and entities are decoded in the text between two tags as it was written.
    """

    BLOCK = frozenset("p div section article header footer nav main aside h1 h2 h3 h4 h5 h6 ul ol body html title blockquote pre".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.blocks: list[str] = []
        self.now: list[str] = []
        self.run: list[str] = []
        self.skip = 0
        self.rows: list[list[str]] | None = None
        self.item = False

    def end_run(self, *_: object) -> None:
        if self.run:
            self.now.append(decode_entities("".join(self.run).replace("&amp;", "&")))
            self.run = []

    def close_block(self) -> None:
        self.end_run()
        text = "\n".join(x for x in (re.sub(r"[ \t\r\f\v\n]+", " ", y).strip() for y in "".join(self.now).split("\0")) if x)
        self.now = []
        if text and self.rows is not None:
            self.rows[-1][-1] += ("\n" if self.rows[-1][-1] else "") + text
        elif text:
            self.blocks.append("- " + text.replace("\n", "\n  ") if self.item else text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.end_run()
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag == "br":
            self.now.append("\0")
        elif tag == "table" and self.rows is None:
            self.close_block()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
        elif tag == "li" or tag in self.BLOCK:
            self.close_block()
            self.item = tag == "li" or self.item and tag not in ("ul", "ol")

    def handle_endtag(self, tag: str) -> None:
        self.end_run()
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.rows and self.rows[-1]:
            self.close_block()
        elif tag == "table" and self.rows is not None:
            rows, self.rows = [r for r in self.rows if any(r)], None
            grid = all(len(c) <= 80 and "\n" not in c for r in rows for c in r)
            self.blocks += [" | ".join(r) for r in rows] if grid else [c for r in rows for c in r if c]
        elif tag == "li" or tag in self.BLOCK:
            self.close_block()
            self.item = False

    def handle_data(self, data: str) -> None:
        if not self.skip and not (self.rows is not None and not (self.rows and self.rows[-1])):
            self.run.append(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    handle_comment = handle_decl = handle_pi = unknown_decl = end_run


def html_blocks(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Blocks()
    p.feed(html.replace("&", "&amp;"))
    p.close()
    p.close_block()
    return "\n".join(p.blocks)


html_text, entity_text = series_udf(html_blocks), series_udf(decode_entities)

def read_documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None, glob: str = "*") -> DataFrame:
    """SRC6, SRC30: files to (path, format, text, error). Readers for pdf and image formats are passed in."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    files = files.withColumn("format", detect_format(F.col("content"), F.col("path")))
    return extract(files, readers)


def extract(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    readers = {"docx": docx_text} | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, kind, content in zip(b["path"], b["format"], b["content"], strict=True):
                text, error = None, None
                if kind not in readers:
                    error = {"pdf": "NO_TEXT_LAYER", "image": "OCR_REQUIRED"}.get(kind, "UNSUPPORTED_FORMAT")
                else:
                    try:
                        text = readers[kind](bytes(content))
                    except Exception as e:  # one bad file must not fail the job
                        error = f"UNREADABLE: {type(e).__name__}"
                out.append((path, kind, text, error))
            yield pd.DataFrame(out, columns=["path", "format", "text", "error"])

    schema = "path string, format string, text string, error string"
    plain = files.where("format = 'text'").select("path", "format", decode_text(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    return plain.unionByName(files.where("format <> 'text'").select("path", "format", "content").mapInPandas(run, schema))
