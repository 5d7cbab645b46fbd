"""Queries over scores, groups and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliary.operators import records as R
from foliary.plans.registry import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
PAIRED = "WITH p AS (SELECT d.source, d.lang, l.quality = 1 AS t, length(d.text) >= 500 AS g FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT {k} count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn FROM p {g}), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN CASE WHEN fn = 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE tp::DOUBLE / (tp + fp) END AS prec, CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE tp::DOUBLE / (tp + fn) END AS rec FROM c) SELECT {o} tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, prec, rec, CASE WHEN prec + rec = 0 THEN 0.0::DOUBLE ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM r"


def _paired(labels, docs):
    joined = labels.select("doc_id", (F.col("quality") == 1).alias("t")).join(docs.select("doc_id", "source", "lang", (F.length("text") >= 500).alias("g")), "doc_id")
    return joined, R.counted(F.col("t"), F.col("g"))


def _prf(counts):
    return counts.select("*", *R.prf(F.col("tp"), F.col("fp"), F.col("fn")))


@book.query("labels", "documents", sql=PAIRED.format(k="", g="", o=""))
def micro_prf(labels, docs):
    rows, counts = _paired(labels, docs)
    return _prf(rows.agg(*counts))


@book.query("labels", "documents", sql=PAIRED.format(k="source,", g="GROUP BY source", o="source,"))
def prf_by_source(labels, docs):
    rows, counts = _paired(labels, docs)
    return _prf(rows.groupBy("source").agg(*counts))


@book.query("labels", "documents", sql=PAIRED.format(k="source, lang, GROUPING(source, lang)::BIGINT AS level,", g="GROUP BY GROUPING SETS ((source), (lang), ())", o="source, lang, level,"))
def prf_grouping_sets(labels, docs):
    rows, counts = _paired(labels, docs)
    return _prf(rows.groupingSets([[F.col("source")], [F.col("lang")], []], F.col("source"), F.col("lang")).agg(F.grouping_id().cast("long").alias("level"), *counts))


@book.query("labels", "documents", sql="WITH p AS (SELECT d.lang, l.quality FROM labels l JOIN documents d USING (doc_id)) SELECT quality, count(*) FILTER (lang = 'de')::BIGINT AS de, count(*) FILTER (lang = 'en')::BIGINT AS en, count(*) FILTER (lang = 'es')::BIGINT AS es, count(*) FILTER (lang = 'fr')::BIGINT AS fr FROM p GROUP BY quality")
def metrics_pivot(labels, docs):
    rows = labels.join(docs.select("doc_id", "lang"), "doc_id")
    return rows.groupBy("quality").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count(F.lit(1))).na.fill(0)


@book.query("labels", sql="SELECT doc_id, 'quality' AS field, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def metrics_unpivot(labels):
    return labels.unpivot("doc_id", ["quality", "toxic"], "field", "value")


@book.query("documents", "benchmark", sql="WITH t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark), p AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents) SELECT count(*) FILTER (t.w IS NOT NULL AND p.w IS NOT NULL)::BIGINT AS tp, count(*) FILTER (t.w IS NULL)::BIGINT AS fp, count(*) FILTER (p.w IS NULL)::BIGINT AS fn FROM t FULL JOIN p ON t.w = p.w")
def set_prf(docs, bench):
    words = lambda d, a: d.select(F.explode(F.split("text", " ")).alias("w")).distinct().withColumn(a, F.lit(True))
    both = words(bench, "t").join(words(docs, "p"), "w", "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.agg(*R.counted(yes("t"), yes("p")))


@book.query("nation", "supplier", sql="SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def coverage_missing(nation, supplier):
    return nation.join(supplier.where("s_acctbal > 9000"), nation.n_nationkey == supplier.s_nationkey, "left_anti").select("n_name")


@book.query("documents", "labels", sql="SELECT d.doc_id, l.doc_id IS NOT NULL AS hit, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_cache_hits(docs, labels):
    cache = labels.select("doc_id", "quality", F.lit(True).alias("hit"))
    return docs.select("doc_id").join(cache, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@book.query("conversations", sql="WITH w AS (SELECT conv_id, role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS sw FROM conversations) SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (sw)::BIGINT AS switches FROM w GROUP BY 1")
def role_turn_windows(talks):
    from pyspark.sql import Window

    sw = F.col("role") != F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return talks.select("conv_id", sw.alias("sw")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if("sw").alias("switches"))


SIMILAR = "row_number() OVER (PARTITION BY o_custkey, o_orderpriority, date_trunc('month', o_orderdate) ORDER BY o_orderkey)"


@book.query("orders", sql=f"SELECT o_orderkey FROM (SELECT o_orderkey, {SIMILAR} AS k FROM orders) WHERE k = 1")
def dedupe_similar(orders):
    return R.first_by(orders, ["o_custkey", "o_orderpriority", F.trunc("o_orderdate", "month")], ["o_orderkey"]).select("o_orderkey")


@book.query("orders", sql="WITH s AS (SELECT o_custkey, o_orderpriority, year(o_orderdate) - lag(year(o_orderdate)) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS d FROM orders) SELECT o_custkey, o_orderpriority, count(*)::BIGINT AS n, min(d)::BIGINT AS step FROM s GROUP BY ALL HAVING count(*) >= 3 AND min(d) = max(d) AND min(d) <> 0")
def fixed_step_runs(orders):
    rows = orders.withColumn("y", F.year("o_orderdate"))
    out = R.constant_step(rows, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"], "y")
    return out.select("o_custkey", "o_orderpriority", "n", F.col("step").cast("long").alias("step"))


@book.query("lineitem", sql="SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 40")
def first_n_per_group(items):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return items.withColumn("k", F.row_number().over(w)).where("k <= 40").select("l_suppkey", "l_orderkey", "l_linenumber")


@book.query("customer", "orders", sql="SELECT c_name, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name ORDER BY total DESC, c_name LIMIT 10")
def topk_customers(customer, orders):
    sums = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    out = customer.join(sums, customer.c_custkey == sums.o_custkey).orderBy(F.desc("total"), "c_name").limit(10)
    return out.select("c_name", F.col("total").cast("double").alias("total"))


ORACLES["topk_customers"] = "SELECT c_name, total::DOUBLE AS total FROM (SELECT c_name, sum(o_totalprice::DECIMAL(18,2)) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name ORDER BY total DESC, c_name LIMIT 10)"


@book.query("supplier", sql=r"SELECT 'S' || lpad(((SELECT max(regexp_extract(s_name, '([0-9]+)$', 1)::BIGINT) FROM supplier) + row_number() OVER (ORDER BY s_suppkey))::VARCHAR, 9, '0') AS new_id, s_suppkey FROM supplier WHERE s_acctbal < 0")
def id_allocate(supplier):
    top = supplier.agg(F.max(F.regexp_extract("s_name", "([0-9]+)$", 1).cast("long")).alias("top"))
    rows = R.numbered(supplier.where("s_acctbal < 0").select("s_suppkey"), "s_suppkey")
    return rows.join(F.broadcast(top)).select(F.concat(F.lit("S"), F.lpad((F.col("top") + F.col("k")).cast("string"), 9, "0")).alias("new_id"), "s_suppkey")


@book.query("events", sql="SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def counts_by_key(events):
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@book.query("events", sql="SELECT event_id, json(props)::VARCHAR AS canonical FROM events")
def json_canonical(events):
    return events.select("event_id", R.canonical_json("props").alias("canonical"))


@book.query("events", sql="SELECT event_id, '{\"list\":[' || json(props) || ']}' AS repaired FROM events")
def json_repair(events):
    return events.select("event_id", R.repaired_json(F.expr("""concat('{"list":[', props, ',', left(props, length(props) - 2))""")).alias("repaired"))


book.cases("json_cut", "a string, r string", [('{"a":[1,2,{"b":3},{"c', '{"a":[1,2,{"b":3}]}'), ('{"a":1}', '{"a":1}'), ('{"a":"x', None), ("[1,2", None), ('{"a":1,"b":[', None), ('so: {"a":{"x":"]}"},"b":2', '{"a":{"x":"]}"}}'), ('{"a":[1}', None), ('{"a":[{}]} {"b"', '{"a":[{}]}')], R.repaired_json)
