"""Queries over what engines and other systems hand over, made from the tables by expressions, with SQL of the same meaning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from foliary.operators import adapters as A
from foliary.plans.registry import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

TODAY = dt.date(2026, 1, 15)


@book.query("orders", sql=r"""WITH RECURSIVE w AS (SELECT o_custkey AS line, o_orderkey AS seq, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'w' || o_orderkey END AS text, o_orderkey // 20 + o_orderkey % 7 AS x0, o_orderkey // 20 + o_orderkey % 7 + 1 + o_orderkey % 11 AS x1, CASE WHEN o_orderkey % 11 > 4 THEN o_orderkey % 150 - 20 END AS c FROM orders),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY line ORDER BY seq) AS k FROM w WHERE text <> ''),
r AS (SELECT line, k, text, x0, x1, c, 0 AS part, x1 AS phrase_end FROM n WHERE k = 1
  UNION ALL SELECT n.line, n.k, n.text, n.x0, n.x1, n.c, r.part + CASE WHEN n.x0 - r.phrase_end > 8 THEN 1 ELSE 0 END, CASE WHEN n.x0 - r.phrase_end > 8 THEN n.x1 ELSE greatest(r.phrase_end, n.x1) END FROM r JOIN n ON n.line = r.line AND n.k = r.k + 1)
SELECT line, part::BIGINT AS part, string_agg(text, ' ' ORDER BY k) AS text, min(x0)::DOUBLE AS x, (max(x1) - min(x0))::DOUBLE AS width, 10.0::DOUBLE AS height, round(avg(CASE WHEN c IS NOT NULL THEN greatest(0, least(1, c / 100.0)) END)::DOUBLE, 9) AS confidence FROM r GROUP BY line, part""")  # fmt: skip
def ocr_phrases(orders):
    """A customer's orders as the words of a line, some of them over each other, some blank."""
    key = F.col("o_orderkey")
    x0 = (F.floor(key / 20) + key % 7).cast("double")
    words = orders.select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("o_custkey").alias("line"), key.alias("seq"), F.when(key % 9 == 0, " \t").otherwise(F.concat(F.lit("w"), key)).alias("text"), x0.alias("x0"), (x0 + 1 + key % 11).alias("x1"), F.lit(30.0).alias("top"), F.lit(40.0).alias("bottom"), F.when(key % 11 > 4, (key % 150 - 20).cast("double")).alias("confidence"))
    return A.phrases(words).select("line", "part", "text", "x", "width", "height", F.round("confidence", 9).alias("confidence"))


@book.query("orders", sql="SELECT o_orderkey AS seq, o_orderpriority AS text, (o_custkey % 100) / 100.0::DOUBLE * 1000 AS x, (o_orderkey % 50) / 50.0::DOUBLE * 1414 AS y, (o_custkey % 3)::DOUBLE * 1000 AS width, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1414 END::DOUBLE AS height, CASE WHEN o_orderkey % 5 > 0 THEN least(1, (o_custkey % 130) / 100.0::DOUBLE) END AS confidence FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 8 <> 3")
def ocr_line_items(orders):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    blocks = orders.select(cust.alias("doc_id"), F.lit(1).alias("page"), key.alias("seq"), F.when(F.col("o_orderstatus") == "P", "WORD").otherwise("LINE").alias("kind"), F.concat(F.lit(" "), "o_orderpriority").alias("text"), F.when(key % 8 != 3, (cust % 100) / 100.0).alias("left"), ((key % 50) / 50.0).alias("top"), (cust % 3).cast("double").alias("width"), F.when(key % 4 != 0, F.lit(1.0)).alias("height"), F.when(key % 5 > 0, (cust % 130).cast("double")).alias("confidence"))
    return A.line_items(blocks).select("seq", "text", "x", "y", "width", "height", "confidence")


@book.query("orders", sql="""WITH l AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderkey % 4 AS m, o_orderpriority || ' ' || o_orderkey AS text FROM orders WHERE o_custkey % 5 > 0 AND o_orderkey % 13 > 0),
p AS (SELECT doc_id, CASE m WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS part, string_agg(text, chr(10) ORDER BY m DESC, CASE WHEN m = 0 THEN -k ELSE k END) AS text FROM l GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(p.text, chr(10) || chr(10) ORDER BY part), '') AS text FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders WHERE o_custkey % 5 > 0) d LEFT JOIN p USING (doc_id) GROUP BY ALL""")  # fmt: skip
def ocr_layout_texts(orders):
    """A customer's orders as lines: in a text inside a list, in the list itself, in the list and a text, and in no block."""
    page, key = [F.col("o_custkey").alias("doc_id"), F.lit(1).alias("page")], F.col("o_orderkey")
    name = F.concat(F.lit("L"), key)
    none = F.array().cast("array<string>")
    lines = orders.select(*page, (key + 10).alias("seq"), name.alias("id"), F.lit("LINE").alias("kind"), F.when(key % 13 > 0, F.concat_ws(" ", "o_orderpriority", key)).otherwise(" ").alias("text"), none.alias("children"))
    rows = orders.where("o_custkey % 5 > 0").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    ids = lambda keep, turn=lambda x: x: F.transform(turn(F.filter("keys", keep)), lambda k: F.concat(F.lit("L"), k))
    block = lambda seq, i, kind, children: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(i).alias("id"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("text"), children.alias("children"))
    made = F.array(
        block(0, "B", "LAYOUT_TEXT", ids(lambda k: k % 4 == 1)),
        block(1, "A", "LAYOUT_LIST", F.concat(F.array(F.lit("B")), ids(lambda k: k % 4 == 0, F.reverse))),
        block(2, "C", "LAYOUT_TEXT", ids(lambda k: k % 2 == 0)),
    )
    blocks = rows.select(*page, F.explode(made).alias("x")).select("doc_id", "page", "x.*")
    return A.layout_texts(lines.unionByName(blocks)).select("doc_id", "text")


@book.query("orders", sql="""WITH o AS (SELECT o_orderkey, o_custkey % 30 AS total, o_orderkey % 31 AS k, (o_custkey % 7) * 200 AS w, (o_orderkey % 5) * 300 + 100 AS h FROM orders),
p AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN range(1, total + 1) ELSE list_filter([k, CASE WHEN k <> 5 THEN 5 END], lambda x: x BETWEEN 1 AND total) END AS pages FROM o)
SELECT o_orderkey, array_to_string(pages[1:20], ',') AS pages, len(pages) > 20 AS truncated, round(CASE WHEN greatest(w, h) * 2 > 2000 THEN 2000.0 / greatest(w, h) ELSE 2.0 END::DOUBLE, 9) AS scale FROM p""")  # fmt: skip
def pages_to_render(orders):
    key, total = F.col("o_orderkey"), F.col("o_custkey") % 30
    asked = F.when(key % 3 != 0, F.array(key % 31, F.lit(5).cast("long"), F.lit(5).cast("long"), F.lit(0).cast("long")))
    got = A.wanted_pages(total, asked)
    return orders.select("o_orderkey", F.array_join(got["pages"].cast("array<string>"), ",").alias("pages"), got["truncated"].alias("truncated"), F.round(A.render_scale((F.col("o_custkey") % 7) * 200, (key % 5) * 300 + 100, A.VISION_SIDE), 9).alias("scale"))


@book.query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 2 OR floor(o_totalprice * 50) > 15728640 THEN 'UNSUPPORTED_INPUT' END AS error FROM orders")
def images_for_a_model(orders):
    media = F.get(F.array(*[F.lit(m) for m in (*A.VISION_MEDIA, "image/tiff")]), (F.col("o_orderkey") % 5).cast("int"))
    return A.vision_input(orders.select("o_orderkey", media.alias("media"), F.floor(F.col("o_totalprice") * 50).alias("bytes"))).select("o_orderkey", "error")


def _toy_engine(languages):
    """Stands for an engine in the query below: reads a page's size, and fails on some sizes."""

    def read(content: bytes) -> tuple[str, float]:
        if len(content) % 7 == 0:
            raise ValueError(f"no {languages}")
        return f"{languages} {len(content)}", 0.5

    return read


@book.query("pages", sql="""SELECT page_id, CASE WHEN n % 7 > 0 THEN lang || ' ' || n END AS text, CASE WHEN n % 7 > 0 THEN 0.5::DOUBLE END AS confidence, CASE WHEN n % 7 = 0 THEN 'OCR_FAILED: no ' || lang END AS error
FROM (SELECT page_id, octet_length(encode(html)) AS n, CASE WHEN page_id % 2 = 0 THEN 'eng' ELSE 'spa+eng' END AS lang FROM pages)""")  # fmt: skip
def engine_pages(pages):
    images = pages.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), F.when(F.col("page_id") % 2 == 0, "eng").otherwise("spa+eng").alias("languages"), F.col("html").cast("binary").alias("content"))
    return A.recognize(images, _toy_engine).select(F.col("doc_id").alias("page_id"), "text", "confidence", "error")


@book.query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'well-' || o_custkey ELSE ' ' END AS text FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0")
def reader_items(orders):
    key = F.col("o_orderkey")
    return A.reader_items(orders.select("o_orderkey", F.when(key % 3 == 0, F.concat(F.lit("well-­‐"), "o_custkey")).otherwise(" ").alias("text"), (key % 2 == 0).alias("has_eol"))).select("o_orderkey", "text")


@book.query("customer", sql="""SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '@x.org' END AS email, c_mktsegment || '|Go|SQL' AS skills, 'Inglés|Francés' AS languages FROM customer""")
def records_of_flat_parsers(customer):
    key = F.col("c_custkey")
    parts = F.struct(
        F.concat(F.lit(" "), "c_name").alias("name"), F.when(key % 2 == 0, F.concat(F.lit("c"), key, F.lit("@x.org"))).otherwise(" ").alias("email"), F.lit(None).cast("string").alias("phone"),
        F.concat(F.lit("Todo: "), "c_mktsegment", F.lit(", Go; go\n• SQL.")).alias("skills"), F.lit("Inglés: avanzado\nFrancés (B1)\n{end}").alias("languages"),
    )
    r = customer.select("c_custkey", A.record_of_parts(parts).alias("r"))
    return r.select("c_custkey", "r.basics.name", "r.basics.email", F.array_join(F.col("r.skills.name"), "|").alias("skills"), F.array_join(F.col("r.languages.language"), "|").alias("languages"))


@book.query("orders", sql="""SELECT o_orderkey, 1::BIGINT AS jobs, 'Firm ' || o_custkey AS company, year(o_orderdate)::VARCHAR AS "from", CASE WHEN o_orderkey % 3 > 0 THEN (year(o_orderdate) + 2)::VARCHAR END AS "to", year(o_orderdate)::VARCHAR AS graduated, o_orderpriority || '|Go' AS skills, 'Rosario' AS city FROM orders""")
def records_of_profile_parsers(orders):
    year = F.year("o_orderdate")
    job = lambda c, t, d: F.struct(c.alias("company"), t.alias("title"), d.alias("date"))
    none = F.lit(" ")
    profile = F.struct(
        F.lit("Ana").alias("name"), none.alias("email"), none.alias("phone"), F.lit("Rosario, Santa Fe, Argentina").alias("location"),
        F.array(job(none, none, F.lit("2001")), job(F.concat(F.lit(" Firm "), "o_custkey"), none, F.when(F.col("o_orderkey") % 3 > 0, F.concat(year, F.lit(" – "), year + 2)).otherwise(year.cast("string")))).alias("jobs"),
        F.array(F.struct(F.lit("UBA").alias("school"), F.lit("").alias("degree"), year.cast("string").alias("date"))).alias("schools"),
        F.array(F.col("o_orderpriority"), F.lit("Go")).alias("skills"),
    )
    r = orders.select("o_orderkey", A.record_of_profile(profile, TODAY).alias("r"))
    work = F.col("r.work")
    return r.select("o_orderkey", F.size(work).cast("long").alias("jobs"), work[0]["name"].alias("company"), work[0]["startDate"].alias("from"), work[0]["endDate"].alias("to"), F.col("r.education")[0]["endDate"].alias("graduated"), F.array_join(F.col("r.skills.name"), "|").alias("skills"), F.col("r.basics.location.city").alias("city"))
