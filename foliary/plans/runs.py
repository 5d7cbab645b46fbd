"""Queries over runs, caches and written forms, made from the tables by expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.functions import written as W
from foliary.operators import runs as R
from foliary.plans.registry import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
STYLES = ("month-name", "mm-yyyy", "abbr-dot", "abbr-cap", "two-digit", "a-la-fecha", "year-range")
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@book.query("documents", sql="SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'draft-truth' WHEN doc_id % 3 = 0 THEN 'unsupported-format' END AS skipped FROM documents")
def run_skips(docs):
    kind = F.when(F.col("doc_id") % 3 == 0, "image").otherwise("pdf")
    return docs.select("doc_id", R.skip_reason(F.col("doc_id") % 4 == 0, kind, ("pdf", "text")).alias("skipped"))


@book.query("documents", "labels", sql="SELECT d.doc_id AS id FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY 1 LIMIT 100")
def run_subset(docs, labels):
    return R.subset(docs.select(F.col("doc_id").alias("id")), labels.where("quality = 1").select(F.col("doc_id").alias("id")), 100)


@book.query("customer", "orders", sql="WITH n AS (SELECT count(*) AS n FROM nation) SELECT o_orderpriority AS run, c_nationkey::BIGINT AS id, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT c_nationkey) = (SELECT count(DISTINCT c_nationkey) FROM customer)) GROUP BY 1, 2")
def covering_runs(customer, orders):
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("o_orderpriority").alias("run"), F.col("c_nationkey").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return R.covering(rows, customer.select(F.col("c_nationkey").cast("long").alias("id")))


@book.query("part", sql="""SELECT p_partkey, '{"name":"' || p_name || '","kind":"' || p_type || '","details":{"brand":"' || p_brand || '","model":"m' || p_size || '"},"version":"1","provenance":{"commit":"c","hash":"h' || p_partkey % 7 || '"}}' AS key FROM part""")
def prediction_keys(part):
    s = lambda c: F.col(c).cast("string")
    details = F.create_map(F.lit("model"), F.concat(F.lit("m"), s("p_size")), F.lit("hardware"), s("p_retailprice"), F.lit("hash"), F.lit("old"), F.lit("brand"), s("p_brand"), F.lit("notes"), F.lit("n"))
    provenance = F.create_map(F.lit("hash"), F.concat(F.lit("h"), (F.col("p_partkey") % 7).cast("string")), F.lit("commit"), F.lit("c"))
    return part.select("p_partkey", R.cache_key(F.col("p_name"), F.col("p_type"), details, F.lit("1"), provenance).alias("key"))


@book.query("customer", "supplier", sql="SELECT c_custkey AS id, 'old' AS key FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 'new' FROM supplier")
def prediction_cache(customer, supplier):
    return R.updated_cache(customer.select(F.col("c_custkey").alias("id"), F.lit("old").alias("key")), supplier.select(F.col("s_suppkey").alias("id"), F.lit("new").alias("key")))


@book.query("lineitem", sql="SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT AS tp, l_suppkey AS fp, l_linenumber::BIGINT AS fn FROM lineitem")
def counts_of_ratios(items):
    """Counts to ratios and back."""
    tp, fp, fn = F.col("l_quantity"), F.col("l_suppkey"), F.col("l_linenumber")
    return items.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *R.counts_of(tp / (tp + fp), tp / (tp + fn), tp + fn))


@book.query("events", sql="SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'in' ELSE 'in,out' END AS told FROM events")
def usage_told(events):
    n = lambda ok: F.when(ok, F.col("user_id"))
    usage = F.create_map(F.lit("in"), n(F.col("user_id") % 3 > 0), F.lit("out"), n(F.col("user_id") % 3 == 2), F.lit("cached"), F.lit(None).cast("long"))
    return events.select("event_id", F.array_join(F.map_keys(R.compact(usage)), ",").alias("told"))


@book.query("orders", sql="WITH o AS (SELECT o_custkey, o_orderdate, o_orderkey, strftime(o_orderdate, '%Y-%m') AS m FROM orders), f AS (SELECT o_custkey, m, min((strftime(o_orderdate, '%Y%m%d') || lpad(o_orderkey::VARCHAR, 12, '0'))) AS k FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM f) SELECT o_custkey, string_agg(m, ', ' ORDER BY i) FILTER (i <= 10) || CASE WHEN max(n) > 10 THEN ' and ' || (max(n) - 10) || ' more' ELSE '' END AS months FROM r GROUP BY o_custkey")
def short_lists(orders):
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.date_format("o_orderdate", "yyyyMMdd"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("m")))), lambda x: x["m"])
    return orders.groupBy("o_custkey").agg(names.alias("names")).select("o_custkey", R.name_list(F.col("names")).alias("months"))


@book.query("part", sql="""SELECT p_partkey, 'run "' || p_name || '" --brand ' || CASE WHEN p_brand LIKE '%#%' THEN '"' || p_brand || '"' ELSE p_brand END || ' --api-key <redacted> --api-key=<redacted> "a\\"b\\$c"' AS command FROM part""")
def command_lines(part):
    args = F.array(F.lit("run"), F.col("p_name"), F.lit("--brand"), F.col("p_brand"), F.lit("--api-key"), F.col("p_type"), F.concat(F.lit("--api-key="), F.col("p_type")), F.lit('a"b$c'))
    return part.select("p_partkey", R.command_line(args).alias("command"))


ORACLES["command_lines"] = ORACLES["command_lines"].replace("\\\\", "\\")


YM = "year(o_orderdate)::INT AS y1, month(o_orderdate)::INT AS m1, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE year(o_orderdate)::INT + (o_custkey % 20)::INT END AS y2, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_custkey % 12)::INT + 1 END AS m2"


def _month(y: str, m: str) -> str:
    full, short = _list(W.MONTHS), _list(W.SHORT_MONTHS)
    return f"CASE s WHEN 'month-name' THEN {full}[{m}] || ' ' || {y} WHEN 'mm-yyyy' THEN lpad({m}::VARCHAR, 2, '0') || '/' || {y} WHEN 'abbr-dot' THEN {short}[{m}] || '. ' || {y} ELSE upper({short}[{m}][1]) || {short}[{m}][2:] || ' ' || {y} END"


@book.query(
    "orders",
    sql=f"""WITH o AS (SELECT o_orderkey, {_list(STYLES)}[(o_orderkey % 7)::INT + 1] AS s, {YM} FROM orders)
SELECT o_orderkey, CASE WHEN s IN ('month-name', 'mm-yyyy', 'abbr-dot', 'abbr-cap') THEN ({_month('y1', 'm1')}) || CASE WHEN s = 'mm-yyyy' THEN ' - ' ELSE ' – ' END || CASE WHEN y2 IS NOT NULL THEN ({_month('y2', 'm2')}) WHEN s = 'abbr-cap' THEN 'Presente' WHEN s = 'mm-yyyy' THEN 'Actualidad' ELSE 'actualidad' END
WHEN s = 'a-la-fecha' THEN CASE WHEN y2 IS NULL THEN y1 || ' a la fecha' ELSE y1 || ' a ' || y2 END WHEN y2 IS NULL THEN y1 || ' – presente' WHEN s = 'two-digit' AND y1 // 100 = y2 // 100 AND y2 > y1 AND y2 % 100 > 12 THEN y1 || '-' || lpad((y2 % 100)::VARCHAR, 2, '0') ELSE y1 || ' – ' || y2 END AS written FROM o""",
)
def written_ranges(orders):
    style = F.element_at(F.array(*[F.lit(x) for x in STYLES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    some = F.col("o_orderkey") % 5 != 0
    y1, m1 = F.year("o_orderdate"), F.month("o_orderdate")
    return orders.select("o_orderkey", W.written_range(style, y1, m1, F.when(some, y1 + (F.col("o_custkey") % 20).cast("int")), F.when(some, (F.col("o_custkey") % 12).cast("int") + 1)).alias("written"))


@book.query(
    "events",
    sql="""WITH a AS (SELECT event_id, (event_id::HUGEINT * 1000003 + 3663131626) % 4294967296 AS a FROM events),
b AS (SELECT event_id, (xor(a, a // 32768) * (a | 1)) % 4294967296 AS t FROM a),
c AS (SELECT event_id, xor(t, (t + (xor(t, t // 128) * (t | 61)) % 4294967296) % 4294967296) AS t FROM b)
SELECT event_id, (floor(xor(t, t // 16384)::DOUBLE / 4294967296.0 * 100) + 1)::BIGINT AS drawn FROM c""",
)
def seeded_draws(events):
    return events.select("event_id", W.draw_int(F.pmod(F.col("event_id") * 1000003, F.lit(2**32)), 1, 100, nth=1).alias("drawn"))
