"""Queries over pages, images and inboxes that are made from the tables by expressions, with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import imports as I
from foliary.operators import pages as P
from foliary.plans.registry import Book
from foliary.sources import images as G

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

#: A document's lines as its pages: a third of them with a large image, a fifth in columns.
PAGES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::BIGINT AS page FROM documents),
p AS (SELECT *, CASE WHEN (doc_id + page) % 5 = 0 THEN 'multi-column' ELSE 'single-column' END AS layout, ((doc_id + page) % 3) / 4.0 AS coverage, length(regexp_replace(text, '[\x09-\x0D\x20]+', '', 'g'))::BIGINT AS chars FROM l),
j AS (SELECT *, chars = 0 OR (chars < 80 AND coverage >= 0.25) AS needs_ocr FROM p),
w AS (SELECT *, (bool_and(needs_ocr) OVER (PARTITION BY doc_id)) OR (sum(CASE WHEN needs_ocr THEN 0 ELSE chars END) OVER (PARTITION BY doc_id)) < 20 AS image_only FROM j),
o AS (SELECT doc_id, page, k AS part, trim(regexp_replace('Page ' || page || ' part ' || k || CASE WHEN (doc_id + page) % 7 = 0 THEN '' ELSE chr(13) || chr(10) || 'of ' || doc_id END, '\r\n?', chr(10), 'g')) AS text,
        CASE WHEN (doc_id + page) % 4 = 3 THEN NULL ELSE ((doc_id + page) % 10) / 10.0 END AS confidence, CASE WHEN page % 2 = 0 THEN 'multi-column' ELSE 'unknown' END AS layout
      FROM w, (VALUES (1::BIGINT), (2::BIGINT)) v(k) WHERE (doc_id * 7 + page) % 2 = 0 AND (needs_ocr OR image_only) AND (k = 1 OR page % 3 = 0))
"""


def _layout(column: str, where: str = "true") -> str:
    return f"CASE WHEN bool_or({where} AND {column} = 'multi-column') THEN 'multi-column' WHEN bool_or({where} AND {column} = 'single-column') THEN 'single-column' ELSE 'unknown' END"


def _pages(docs):
    rows = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("page", "text"))
    rows = rows.withColumn("page", F.col("page").cast("long") + 1)
    at = F.col("doc_id") + F.col("page")
    return P.judged(rows.withColumns({"layout": F.when(at % 5 == 0, "multi-column").otherwise("single-column"), "coverage": (at % 3) / 4.0}))


def _recognized(pages):
    at = F.col("doc_id") + F.col("page")
    rows = pages.where((F.col("doc_id") * 7 + F.col("page")) % 2 == 0).where("needs_ocr OR image_only")
    rows = rows.select("doc_id", "page", F.explode(F.when(F.col("page") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("part")).withColumn("part", F.col("part").cast("long"))
    text = F.concat(F.lit("Page "), F.col("page"), F.lit(" part "), F.col("part"), F.when(at % 7 == 0, "").otherwise(F.concat(F.lit("\r\nof "), F.col("doc_id"))))
    return P.recognized(rows.select("doc_id", "page", "part", text.alias("text"), F.when(at % 4 != 3, (at % 10) / 10.0).alias("confidence"), F.when(F.col("page") % 2 == 0, "multi-column").otherwise("unknown").alias("layout")))


def _listed(rows, *columns):
    return rows.withColumns({c: F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",") for c in columns})


@book.query("documents", sql=PAGES_SQL + f"SELECT doc_id, coalesce(string_agg(CASE WHEN NOT needs_ocr AND text <> '' THEN text END, chr(10) || chr(10) ORDER BY page), '') AS text, count(*)::BIGINT AS pages, {_layout('layout', 'NOT needs_ocr')} AS layout, coalesce(string_agg(CASE WHEN needs_ocr THEN page::VARCHAR END, ',' ORDER BY page), '') AS scanned, bool_or(image_only) AS image_only FROM w GROUP BY doc_id")
def text_layer_documents(docs):
    return _listed(P.text_layer(_pages(docs)), "scanned")


@book.query("documents", sql=PAGES_SQL + f"SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page, part), '') AS text, count(*)::BIGINT AS pages, {_layout('layout')} AS layout, round(avg(confidence), 9) AS confidence, coalesce(string_agg(CASE WHEN confidence < 0.7 THEN page::VARCHAR END, ',' ORDER BY page), '') AS low, '' AS empty FROM o GROUP BY doc_id")
def recognized_documents(docs):
    rows = P.recognized_documents(_recognized(_pages(docs)))
    return _listed(rows, "low", "empty").withColumn("confidence", F.round("confidence", 9))


@book.query("documents", sql=PAGES_SQL + f""", f AS (SELECT coalesce(w.doc_id, o.doc_id) AS doc_id, coalesce(w.page, o.page) AS page, o.part, o.part IS NOT NULL AS read, o.part IS NULL AND (w.needs_ocr OR w.image_only) AS skipped,
  CASE WHEN o.part IS NOT NULL THEN o.text WHEN NOT (w.needs_ocr OR w.image_only) THEN w.text END AS text, CASE WHEN o.part IS NOT NULL THEN o.layout WHEN NOT (w.needs_ocr OR w.image_only) THEN w.layout END AS layout, o.confidence FROM w FULL JOIN o ON w.doc_id = o.doc_id AND w.page = o.page)
SELECT doc_id, coalesce(string_agg(CASE WHEN text <> '' THEN text END, chr(10) || chr(10) ORDER BY page, part), '') AS text, {_layout('layout')} AS layout, round(avg(confidence), 9) AS confidence, count(*) FILTER (read)::BIGINT AS ocr_pages, coalesce(string_agg(CASE WHEN skipped THEN page::VARCHAR END, ',' ORDER BY page), '') AS skipped FROM f GROUP BY doc_id""")
def mixed_pdf_merge(docs):
    pages = _pages(docs)
    return _listed(P.merged(pages, _recognized(pages)), "skipped").withColumn("confidence", F.round("confidence", 9))


@book.query("lineitem", sql="SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS seq, l_quantity AS x, 792.0 - (l_extendedprice + l_discount * 100) AS y, false AS has_eol FROM lineitem")
def ocr_items_flipped(items):
    rows = items.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), (F.col("l_discount") * 100).alias("height"), F.lit(792.0).alias("page_height"))
    return P.flipped(rows).select("doc_id", "seq", "x", "y", "has_eol")


@book.query("lineitem", sql="SELECT l_orderkey AS doc_id, l_suppkey AS page, count(*)::BIGINT AS lines, CASE WHEN count(*) FILTER (l_linestatus = 'O') > 0 THEN round(greatest(0.0, least(1.0, avg(CASE WHEN l_linestatus = 'O' THEN l_quantity * 3 END) / 100)), 9) END AS confidence FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def ocr_line_blocks(items):
    rows = items.select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("page"), F.lit("LINE").alias("kind"), F.when(F.col("l_returnflag") == "N", " \t").otherwise(F.col("l_returnflag")).alias("text"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity") * 3).alias("confidence"))
    words = rows.withColumn("kind", F.lit("WORD"))
    return P.line_blocks(rows.unionByName(words)).withColumn("confidence", F.round("confidence", 9))


@book.query("orders", sql="SELECT o_orderkey, round(greatest(1 / 484704.0, least(1.0, (o_custkey % 600) * 700 / 484704.0), CASE WHEN o_orderkey % 2 = 0 THEN least(1.0, 4 * (o_custkey % 600) * 50 / 484704.0) ELSE 0 END), 9)::DOUBLE AS coverage FROM orders")
def page_image_coverage(orders):
    """A page with an image under two matrices, inside a saved state that is dropped, and every other one with a second in a form."""
    w = (F.col("o_custkey") % 600).cast("double")
    num = lambda *xs: F.array(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in xs])
    none = F.array().cast("array<double>")
    op = lambda code, args=none: F.struct(F.lit(code).alias("code"), args.alias("args"))
    first = [op(10), op(12, num(2, 0, 0, 2, 5, 5)), op(12, num(0, w / 2, -350, 0, 1, 1)), op(85), op(11)]
    second = [op(74, num(4, 0, 0, 1, 9, 9)), op(12, num(w, 0, 0, 50, 0, 0)), op(83), op(75)]
    ops = F.concat(F.array(*first), F.when(F.col("o_orderkey") % 2 == 0, F.array(*second)).otherwise(F.array(op(11))), F.array(op(12, num(1, 2)), op(90)))
    return orders.select("o_orderkey", F.round(P.image_coverage(ops, F.lit(612.0 * 792.0)), 9).alias("coverage"))


@book.query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_custkey % 16000 + 1 END AS width, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_orderkey % 9000 + 1 END AS height FROM orders")
def image_sizes(orders):
    """Headers of PNG, JPEG (plain, and with segments and padding before the frame) and the three kinds of WebP, and a size of 0."""
    w, h, kind = F.col("o_custkey") % 16000 + 1, F.col("o_orderkey") % 9000 + 1, F.col("o_orderkey") % 7
    hexed = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    little = lambda x, n: F.concat(*[hexed(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)), 1) for i in range(n)])
    said = lambda *xs: F.unhex(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs]))
    riff = b"RIFF".hex() + "00000000" + b"WEBP".hex()
    frame = lambda mark: F.concat(F.lit(f"FF{mark}001108"), hexed(h, 2), hexed(w, 2), F.lit("03" + "00" * 12))
    zero = F.lit(0).cast("long")
    png = lambda w: said("89504E470D0A1A0A0000000D", b"IHDR".hex(), hexed(w, 4), hexed(h, 4), "0806")
    image = (
        F.when(kind == 0, png(w))
        .when(kind == 1, said("FFD8", frame("C0")))
        .when(kind == 2, said("FFD8FFE00004ABCDFF01FFC40003EEFFFF", frame("C2")))
        .when(kind == 3, said(riff, b"VP8 ".hex(), "00" * 10, little(w, 2), little(h, 2), "00"))
        .when(kind == 4, said(riff, b"VP8L".hex(), "00" * 5, little(w - 1 + F.shiftleft(h - 1, 14), 4), "00" * 8))
        .when(kind == 5, said(riff, b"VP8X".hex(), "00" * 8, little(w - 1, 3), little(h - 1, 3)))
        .otherwise(png(zero))
    )
    return orders.select("o_orderkey", G.image_size(image).alias("s")).select("o_orderkey", "s.width", "s.height")


@book.query("documents", sql="SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR lang IS NULL THEN NULL ELSE CASE lang WHEN 'en' THEN 'eng' WHEN 'es' THEN 'spa' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' END || CASE WHEN lang = 'en' THEN '' ELSE '+eng' END || '+chi_sim' || CASE WHEN lang = 'es' THEN '' ELSE '+spa' END END AS languages FROM documents")
def ocr_language_lists(docs):
    codes = F.array(F.upper("lang"), F.lit(" en-US "), F.lit(""), F.lit("chi_sim"), F.concat(F.lit("spa-"), F.upper("lang")), F.when(F.col("doc_id") % 11 == 0, "qq").otherwise("en"))
    return docs.select("doc_id", G.ocr_languages(codes).alias("languages"))


@book.query("documents", sql="SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'text' WHEN 2 THEN 'image' WHEN 5 THEN 'docx' END AS format, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'jpg' WHEN 5 THEN 'docx' END AS ext FROM documents")
def dataset_formats(docs):
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "text", "image", "image", "zip", "docx")]), (F.col("doc_id") % 6 + 1).cast("int"))
    mime = F.when(F.col("doc_id") % 6 == 2, "image/jpeg").when(F.col("doc_id") % 12 == 3, "image/gif")
    return docs.select("doc_id", G.dataset_format(kinds, mime).alias("f")).select("doc_id", "f.format", "f.ext")


@book.query("pages", sql=r"""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'consent' WHEN 1 THEN 'linkedin' WHEN 2 THEN 'public-record' WHEN 3 THEN 'public-record' ELSE 'unknown' END AS source, CASE WHEN page_id % 6 = 2 THEN chr((97 + page_id % 26)::INT) || 'r' ELSE 'xx' END AS cc FROM pages""")
def inbox_names(pages):
    k = F.col("page_id")
    two = F.concat(F.char((97 + k % 26).cast("int")), F.lit("r"))
    name = F.when(k % 6 == 0, F.concat(F.lit("Consent-"), k)).when(k % 6 == 1, "linkedin-ar-1.pdf").when(k % 6 == 2, F.concat(F.lit("public-"), F.upper(two), F.lit("-7.pdf"))).when(k % 6 == 3, "public-argentina-7.pdf").when(k % 6 == 4, "other-ar.pdf").otherwise("consent.pdf")
    return pages.select("page_id", I.inbox_source(name).alias("s")).select("page_id", "s.source", "s.cc")


@book.query("conversations", sql="SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'mixed' WHEN turn % 3 = 1 THEN 'es' ELSE 'unknown' END AS language FROM conversations")
def manifest_languages(talks):
    """A turn's text under headings of both languages, of one, or with headings inside lines alone."""
    k = F.col("turn") % 3
    text = F.concat(F.when(k == 0, "Educación:\n").when(k == 1, "IDIOMAS\n").otherwise("my skills are\n"), F.coalesce("text", F.lit("")), F.when(k == 0, "\n  Technical Skills \nx").otherwise("\nexperience: none"))
    return talks.select("conv_id", "turn", I.manifest_language(text, F.when(k == 1, "es")).alias("language"))


@book.query("customer", sql=r"""SELECT c_custkey, '{"basics":{"name":"' || c_name || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"location":{"city":"' || c_mktsegment || '"}' ELSE '' END || '},"work":[{"name":"' || c_mktsegment || '","startDate":"2020"}],"skills":[{"name":"a"},{"name":"b"}]}' AS draft FROM customer""")
def draft_truths(customer):
    none = F.lit(None).cast("string")
    basics = F.struct(F.col("c_name").alias("name"), none.alias("email"), F.lit("x").alias("label"), F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("city"), none.alias("region"), F.lit("9").alias("postalCode")).alias("location"))
    work = F.array(F.struct(F.col("c_mktsegment").alias("name"), F.lit("2020").alias("startDate"), none.alias("endDate"), F.array(F.lit("did")).alias("highlights")))
    record = F.to_json(F.struct(basics.alias("basics"), work.alias("work"), F.array(F.struct(F.lit("a").alias("name"), F.lit("x").alias("level")), F.struct(F.lit("b").alias("name"), none.alias("level"))).alias("skills")), {"ignoreNullFields": "false"})
    return customer.select("c_custkey", I.draft_truth(record).alias("draft"))


@book.query("customer", "supplier", sql="SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def manifest_upsert(customer, supplier):
    drafts = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    once = I.upserted(customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), drafts)
    return I.upserted(once, drafts)


@book.query("documents", "benchmark", sql=r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), b AS (SELECT d.doc_id, i.item_id % 3 AS block, i.item_id AS pos, '- ' || i.text AS line FROM documents d JOIN benchmark i ON i.item_id % 20 = d.doc_id % 20),
k AS (SELECT DISTINCT doc_id, regexp_replace(trim(line), '^- ', '') AS key FROM l) SELECT doc_id, block, min(pos) AS pos, line FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = b.doc_id AND k.key = regexp_replace(trim(b.line), '^- ', '')) GROUP BY doc_id, block, line""")
def text_box_lines(docs, bench):
    """Benchmark items as text boxes that documents have twice; a box whose line the body has goes."""
    body = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    items = bench.select((F.col("item_id") % 20).alias("r"), (F.col("item_id") % 3).alias("block"), F.col("item_id").alias("pos"), F.concat(F.lit("- "), F.col("text")).alias("line"))
    boxes = docs.select("doc_id", (F.col("doc_id") % 20).alias("r")).join(items, "r").drop("r")
    return I.unseen_lines(I.box_lines(boxes.unionByName(boxes)), body).select("doc_id", "block", "pos", "line")
