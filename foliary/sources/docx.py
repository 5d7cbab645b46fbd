"""Text of a DOCX file: paragraphs, tables and text boxes of its main part, read from its XML tree."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.etree.ElementTree import Element

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ALTERNATIVES = "{http://schemas.openxmlformats.org/markup-compatibility/2006}AlternateContent"
BOX = f"{W}txbxContent"
#: A cell of a grid has at most so many characters; cells of longer ones are read one after another.
GRID_CELL = 80
MOST_BYTES = 256 << 20


def main_part(content: bytes, most: int = MOST_BYTES) -> Element:
    """SRC13-14: the tree of the part that the package's relationships name; a part of over `most` bytes is an error."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        rels = ElementTree.fromstring(z.read("_rels/.rels")) if "_rels/.rels" in z.namelist() else ()
        named = [r.get("Target", "").lstrip("/") for r in rels if r.get("Type", "").endswith("/officeDocument")]
        info = z.getinfo(named[0] if named else "word/document.xml")
        if info.file_size > most:
            raise ValueError("too large")
        return ElementTree.fromstring(z.read(info))


def _outside(node: Element, *stops: str) -> Iterator[Element]:
    """The node's descendants in order, without what lies below the tags in stops."""
    for child in node:
        yield child
        if child.tag not in stops:
            yield from _outside(child, *stops)


def _lines(paragraph: Element) -> list[str]:
    told = {f"{W}tab": " ", f"{W}br": "\n", f"{W}cr": "\n"}
    text = "".join((e.text or "") if e.tag == f"{W}t" else told.get(e.tag, "") for e in _outside(paragraph, BOX, ALTERNATIVES))
    return [x for x in (re.sub(r"\s+", " ", line).strip() for line in text.split("\n")) if x]


def _blocks(node: Element) -> Iterator[str]:
    """SRC15: paragraphs and tables in order; a list item has a dash and goes on under its text."""
    for child in node:
        if child.tag == f"{W}p":
            if lines := _lines(child):
                yield "- " + "\n  ".join(lines) if child.find(f"{W}pPr/{W}numPr") is not None else "\n".join(lines)
        elif child.tag == f"{W}tbl":
            yield from _table(child)
        elif child.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}ins"):
            yield from _blocks(child)


def _table(table: Element) -> Iterator[str]:
    rows = [[list(_blocks(cell)) for cell in row.findall(f"{W}tc")] for row in table.findall(f"{W}tr")]
    grid = all(len(cell) <= 1 and all(len(x) <= GRID_CELL and "\n" not in x for x in cell) for row in rows for cell in row)
    if grid:
        yield from (" | ".join("".join(cell) for cell in row) for row in rows if any(row))
    else:
        yield from (block for row in rows for cell in row for block in cell)


def _boxes(node: Element) -> Iterator[list[str]]:
    """SRC16: the lines of each text box; one that repeats another of its own alternatives is left out."""
    for child in _outside(node, BOX, ALTERNATIVES):
        if child.tag == BOX:
            yield [x for p in child.iter(f"{W}p") for x in _lines(p)]
        elif child.tag == ALTERNATIVES:
            own = [[x for p in box.iter(f"{W}p") for x in _lines(p)] for box in child.iter(BOX)]
            yield from (b for i, b in enumerate(own) if b not in own[:i])


def docx_text(content: bytes, most: int = MOST_BYTES) -> str:
    """The body's blocks a line each, then a blank line and the text boxes' lines that the body doesn't have (JOI12)."""
    root = main_part(content, most)
    body = "\n".join(x for child in root for x in _blocks(child))
    seen = {line.strip().removeprefix("- ") for line in body.split("\n")}
    more = [x for box in _boxes(root) for x in box if x.removeprefix("- ") not in seen]
    return "\n\n".join(x for x in (body, "\n".join(more)) if x)
