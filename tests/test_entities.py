"""Entities in HTML: only those with a semicolon are decoded, all other text stays as it is written."""

import duckdb
import pytest

from foliary import catalog
from foliary.sources.formats import html_blocks


@pytest.mark.parametrize(("html", "text"), [
    ("<title>the&amp;&amp;&amp</title><p>x</p>", "the&&&amp\nx"), ("<p>a &quo</p>", "a &quo"), ("<p>R&D rocks</p>", "R&D rocks"), ("<p>AT&T</p>", "AT&T"), ("a &", "a &"), ("a &am", "a &am"),
    ("<p>&#65 &#x42 &#67;</p>", "&#65 &#x42 C"), ("&amp;amp; &amp;#65; &copy; &#; &;", "&amp; &#65; &copy; &#; &;"), ("<p>&am<b>p;</b> &lt;b&gt;</p>", "&amp; <b>"), ("x<!-- & -->&amp<!-- -->;y", "x&amp;y"),
    ('<a href="?a=1&amp;b=2&c">l&gt</a>', "l&gt"), ('t <a href="x&y', 't <a href="x&y'), ("<script>a && b</script>&nbsp;&apos;", "'"),
])
def test_entities(html, text):
    assert html_blocks(html) == text


def test_pages_against_sql(spark, tmp_path):
    pages = ["<html><title>Das&amp;&amp; der&am</title><body><p>token = &quo</p></body></html>", "<ul><li>a&amp<br>b &copy; &amp;quot;</li></ul>", "<p>R&D &#65</p>", "", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in catalog.queries()["html_text"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == set(duck.sql(catalog.oracle_sql()["html_text"]).fetchall())
