"""Record rules over tables: records, texts and positioned items made of rows by expressions, whose outcome SQL can tell."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from foliary.operators import reading_order as O
from foliary.operators import scoring as S
from foliary.operators.grounding import ground
from foliary.operators.tidying import tidy
from foliary.plans.registry import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

TODAY = dt.date(2026, 1, 15)
NL = "chr(10)"


@book.query("customer", sql=f"""WITH c AS (SELECT c_custkey, c_custkey % 3 AS kind, 5 + c_custkey % 4 AS n FROM customer),
k AS (SELECT *, unnest(range(0, n)) AS k FROM c),
t AS (SELECT c_custkey, kind, string_agg('left line ' || k || ' of ' || c_custkey, {NL} ORDER BY k) AS lefts, string_agg('right line ' || k, {NL} ORDER BY k) AS rights, string_agg('Company number ' || k || ' ' || (2000 + c_custkey % 20 + k), {NL} ORDER BY k) AS cells, string_agg('Line ' || k || ' of one column', {NL} ORDER BY k) AS lines FROM k GROUP BY ALL)
SELECT c_custkey AS doc_id, CASE kind WHEN 0 THEN 'Header of the page that is long enough to span all of the page' || {NL} || {NL} || lefts || {NL} || {NL} || rights WHEN 1 THEN cells ELSE lines || {NL} || 'Comunicación efectiva' END AS text,
  CASE kind WHEN 0 THEN 'multi-column' ELSE 'single-column' END AS layout FROM t""")  # fmt: skip
def columns_and_tables(customer):
    """A page for each customer: two columns under a wide header, rows of a table, or one column with a hyphen at a line's end."""
    key, kind, k = F.col("c_custkey"), F.col("c_custkey") % 3, F.col("k")
    item = lambda seq, text, x, y: F.struct(seq.cast("int").alias("seq"), text.alias("str"), F.lit(float(x)).alias("x"), y.cast("double").alias("y"))
    row = 700 - 12 * k
    lines = customer.select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), 4 + key % 4)).alias("k"))
    two = F.array(item(1 + k, F.concat(F.lit("left line "), k, F.lit(" of "), key), 50, row), item(100 + k, F.concat(F.lit("right line "), k), 350, row))
    table = F.array(item(2 * k, F.concat(F.lit("Company number "), k), 50, row), item(2 * k + 1, (2000 + key % 20 + k).cast("string"), 400, row))
    one = F.array(item(k, F.concat(F.lit("Line "), k, F.lit(" of one column")), 50, row))
    items = lines.select("c_custkey", F.explode(F.when(kind == 0, two).when(kind == 1, table).otherwise(one)).alias("i"))
    last = 700 - 12 * (5 + key % 4)
    ends = F.when(kind == 0, F.array(item(F.lit(0), F.lit("Header of the page that is long enough to span all of the page"), 50, F.lit(750)))).when(kind == 2, F.array(item(F.lit(200), F.lit("Comunica-"), 50, last), item(F.lit(201), F.lit("ción efectiva"), 50, last - 12)))
    items = items.unionByName(customer.select("c_custkey", F.explode(ends).alias("i"))).select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("page"), "i.*")
    items = items.select("*", (5.0 * F.length("str")).alias("width"), F.lit(10.0).alias("height"), F.lit(False).alias("has_eol"))
    return O.reading_order(items).select("doc_id", "text", "layout")



@book.query("customer", sql="""WITH c AS (SELECT c_custkey AS k, c_custkey % 3 AS three, c_custkey % 4 AS four FROM customer),
v AS (SELECT k, 'basics.name' AS field, (three < 2)::BIGINT AS tp, (three = 2)::BIGINT AS fp, (three = 2)::BIGINT AS fn FROM c
  UNION ALL SELECT k, 'basics.email', (four < 2)::BIGINT, (four = 2)::BIGINT, (four >= 2)::BIGINT FROM c
  UNION ALL SELECT k, 'skills', CASE WHEN three = 0 THEN 2 ELSE 1 END, CASE WHEN three = 0 THEN 1 ELSE 2 END, CASE WHEN three = 0 THEN 1 ELSE 2 END FROM c
  UNION ALL SELECT k, 'languages', 1, (four = 3)::BIGINT, (four = 0)::BIGINT FROM c
  UNION ALL SELECT k, 'work.entries', 1 + (four > 0)::BIGINT, 0, (four = 0)::BIGINT FROM c
  UNION ALL SELECT k, 'work.dates', 1 + (three > 0)::BIGINT + CASE WHEN four > 0 THEN 2 ELSE 0 END, (three = 0)::BIGINT, (three = 0)::BIGINT + CASE WHEN four = 0 THEN 2 ELSE 0 END FROM c)
SELECT k AS doc_id, field, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM v""")  # fmt: skip
def scored_customers(customer):
    """Records of customers against copies with other spellings, wrong names, missing parts, an entry less, another end."""
    key, three, four = F.col("c_custkey"), F.col("c_custkey") % 3, F.col("c_custkey") % 4
    mail = F.concat(F.lit("c"), key, F.lit("@x.org"))
    entry = lambda n, p, s, e: F.struct(F.lit(n).alias("name"), F.lit(p).alias("position"), F.lit(s).alias("startDate"), e.alias("endDate"))
    skill = lambda *names: F.array(*[F.struct((n if not isinstance(n, str) else F.lit(n)).alias("name")) for n in names])
    tongue = lambda *names: F.array(*[F.struct(F.lit(n).alias("language")) for n in names])
    truth = F.struct(
        F.struct(F.concat(F.lit("María de la Paz "), "c_name").alias("name"), mail.alias("email")).alias("basics"),
        F.array(entry("Acme S.A.", "Cook", "2015", F.lit("2018")), entry("Zeta", "Chief engineer", "2019-03", F.lit("2021-04"))).alias("work"),
        skill("Go", "C++", F.col("c_mktsegment")).alias("skills"), F.when(four == 0, tongue("Inglés", "Francés")).otherwise(tongue("Inglés")).alias("languages"),
    )
    told = F.array(entry("ACME", "cook", "2015", F.when(three == 0, "2017").otherwise("2018")))
    guess = F.struct(
        F.struct(F.when(three == 2, "Juan Otro").otherwise(F.concat(F.lit("Maria Paz "), "c_name")).alias("name"), F.when(four < 2, F.upper(mail)).when(four == 2, "z@z.org").alias("email")).alias("basics"),
        F.when(four > 0, F.concat(F.array(entry("Zeta", "Chief Engineer", "2019-03", F.lit("2021-04"))), told)).otherwise(told).alias("work"),
        skill("go", F.when(three == 0, F.lower("c_mktsegment")).otherwise("Cobol"), F.lit("Java")).alias("skills"), F.when(four == 3, tongue("English", "German")).otherwise(tongue("English")).alias("languages"),
    )
    side = lambda c: customer.select(key.alias("doc_id"), F.from_json(F.to_json(c), S.RECORD).alias("record"))
    return S.score_records(side(truth), side(guess))


@book.query("customer", sql="""SELECT c_custkey, '{"basics":{"email":' || CASE WHEN c_custkey % 3 = 0 THEN '"c' || c_custkey || '@x.org"' ELSE 'null' END || ',"phone":"' || (11000000 + c_custkey) || '"},"languages":[{"fluency":"B2","language":"English"}],"skills":[{"name":"Go"},{"name":"' || c_mktsegment || '"}]}' AS record,
CASE WHEN c_custkey % 2 = 0 THEN 'work' ELSE '' END AS missing FROM customer""")  # fmt: skip
def grounded_customers(customer):
    """Records of customers with an address, a skill, a language and a level that the text doesn't have, and sections left out."""
    key = F.col("c_custkey")
    mail, phone = F.concat(F.lit("c"), key, F.lit("@x.org")), (11000000 + key).cast("string")
    head = F.when(key % 2 == 0, "\nExperiencia\nAcme").otherwise("")
    text = F.concat(F.lit("Ana Díaz\n"), mail, F.lit(" - "), phone, head, F.lit("\nHabilidades\nGo, "), "c_mktsegment", F.lit("\nIdiomas\nInglés: B2"))
    skills = F.array(*[F.struct(x.alias("name")) for x in (F.lit("Go"), F.col("c_mktsegment"), F.lit("Cobol"))])
    tongues = F.array(*[F.struct(F.lit(x).alias("language"), F.lit("A1").alias("fluency")) for x in ("English", "French")])
    record = F.struct(F.struct(F.when(key % 3 == 0, mail).otherwise("other@y.org").alias("email"), phone.alias("phone")).alias("basics"), skills.alias("skills"), tongues.alias("languages"))
    got = customer.select("c_custkey", ground(F.to_json(record), text).alias("g"))
    return got.select("c_custkey", "g.record", F.array_join("g.missing", ",").alias("missing"))


@book.query("orders", sql="""WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS ym, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, '{"basics":{"location":{"countryCode":"AR"}},"ext":{},"work":[{"endDate":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' WHEN o_orderkey % 3 = 1 THEN '"' || (y + 2) || '"' ELSE '"' || (y + 1) || '-11"' END || ',"name":"Firm ' || o_custkey || '","position":"Cook","startDate":"' || CASE WHEN o_orderkey % 3 = 1 THEN y::VARCHAR ELSE ym END || '"}]}' AS record FROM o""")  # fmt: skip
def normalized_orders(orders):
    """Records of orders with blanks, dates as they are written, an empty entry and the same entry twice."""
    key, y = F.col("o_orderkey"), F.year("o_orderdate")
    kind = key % 3
    start = F.when(kind == 0, F.date_format("o_orderdate", "MM/yyyy")).when(kind == 1, F.concat(y, F.lit(" - "), y + 2)).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    end = F.when(kind == 0, "Actualidad").when(kind == 2, F.concat(F.lit("noviembre de "), y + 1))
    entry = F.struct(F.concat(F.lit(" Firm "), "o_custkey").alias("name"), F.lit("Cook ").alias("position"), start.alias("startDate"), end.alias("endDate"))
    record = F.struct(F.struct(F.struct(F.lit("ar").alias("countryCode")).alias("location")).alias("basics"), F.array(entry, entry).alias("work"))
    return orders.select("o_orderkey", tidy(F.to_json(record, {"ignoreNullFields": "false"}), F.lit(None).cast("string"), TODAY)["record"].alias("record"))
