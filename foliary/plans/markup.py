"""Queries over pages and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.plans.registry import Book
from foliary.sources import formats as S

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


#: The pages' markup is plain: no tables, no blocks inside list items, four named entities, of which two are decoded.
HTML_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(html, '<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->|<![^>]*>', '', 'gs') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<li(?: [^>]*)?>', chr(1) || chr(2), 'g'), '<br[^>]*>', chr(3), 'g'), '</?(?:p|div|section|article|header|footer|nav|main|aside|h[1-6]|ul|ol|li|body|html|title|blockquote|pre)(?: [^>]*)?>', chr(1), 'g'), '</?[A-Za-z][^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, generate_subscripts(string_split(h, chr(1)), 1) AS k, unnest(string_split(h, chr(1))) AS block FROM b),
d AS (SELECT page_id, k, starts_with(block, chr(2)) AS item, list_filter(list_transform(string_split(replace(replace(replace(block, chr(2), ''), '&quot;', '"'), '&amp;', '&'), chr(3)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v\n]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM c)
SELECT p.page_id, coalesce(string_agg(CASE WHEN item THEN '- ' || array_to_string(lines, chr(10) || '  ') ELSE array_to_string(lines, chr(10)) END, chr(10) ORDER BY k) FILTER (len(lines) > 0), '') AS text FROM pages p LEFT JOIN d USING (page_id) GROUP BY ALL"""


@book.query("pages", sql=HTML_SQL)
def html_text(pages):
    return pages.select("page_id", F.coalesce(S.html_text("html"), F.lit("")).alias("text"))


@book.query("pages", sql="SELECT page_id, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS n_paragraphs, len(regexp_extract_all(html, '<li[ >]'))::BIGINT AS n_items, len(regexp_extract_all(html, '&[a-z]+;'))::BIGINT AS n_entities FROM pages")
def html_stats(pages):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return pages.select("page_id", n("<p[ >]").alias("n_paragraphs"), n("<li[ >]").alias("n_items"), n("&[a-z]+;").alias("n_entities"))


@book.query("pages", sql="SELECT page_id, CASE WHEN octet_length(encode(html)) > 8192 AND hex(array_slice(encode(html), 8193, 8193)) BETWEEN '80' AND 'BF' THEN 'unknown' ELSE 'text' END AS format, regexp_matches(lower(ltrim(substr(html, 1, 512))), '^(<!doctype html|<html)') AS is_html FROM pages")
def format_sniff(pages):
    content = F.col("html").cast("binary")
    return pages.select("page_id", S.detect_format(content, F.lit("page.html")).alias("format"), F.lower(F.ltrim(F.substring("html", 1, 512))).rlike("^(<!doctype html|<html)").alias("is_html"))


book.cases("entity_decode", "a string, r string", [("&amp;&lt;&gt;", "&<>"), ("&copy; x", "&copy; x"), ("&#65;&#x42;", "AB"), ("&#xD800;", "�"), ("&", "&"), (None, None)], S.entity_text)
book.cases("format_magic", "a string, b string, r string", [("255044462D312E37", "a.pdf", "pdf"), ("255044462D", "a.txt", "text"), ("FFFE4100", None, "text"), ("504B0304776F72642F", None, "docx"), ("504B030400", "x.zip", "zip"), ("D0CF11E0A1B11AE1", "x.doc", "legacy-doc"), ("89504E470D0A", None, "image"), ("00010203", None, "unknown"), ("6162", None, "text")], lambda a, b: S.detect_format(F.unhex(a), b))
book.cases("html_blocks", "a string, r string", [("<p>a<br>b</p><ul><li>x<li>y</ul>", "a\nb\n- x\n- y"), ("<table><tr><td>1</td><td>2</td></tr></table>", "1 | 2"), ("<script>z</script>t &amp; u", "t & u"), ("", "")], S.html_text)
