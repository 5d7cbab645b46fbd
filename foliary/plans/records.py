"""Queries over record scores, date precision and intervals."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from foliary.functions import precision as P
from foliary.functions.text import entity_tokens
from foliary.operators import scoring as S
from foliary.operators.model import complete, context_warning, failure, head, input_fit, prompt
from foliary.plans.registry import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


@book.query("documents", sql="WITH y AS (SELECT unnest(regexp_extract_all(text, '[0-9]+')) AS year FROM documents) SELECT year, count(*) AS n FROM y WHERE length(year) = 4 GROUP BY year")
def claims_per_year(docs):
    return docs.select(F.explode(P.years(F.col("text"))).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@book.query("orders", sql="SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 50 AS INTEGER) - 25), '%Y-%m') AS moved FROM orders")
def month_shift(orders):
    d = F.col("o_orderdate")
    return orders.select("o_orderkey", P.months_after(F.year(d), F.month(d), (F.col("o_orderkey") % 50 - 25).cast("int")).alias("moved"))


@book.query("orders", sql="WITH r AS (SELECT o_custkey, o_orderdate AS s, o_orderdate + to_days(CAST(o_orderkey % 200 AS INTEGER)) AS e FROM orders), m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r), g AS (SELECT *, sum(CASE WHEN seen IS NULL OR s > seen THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT o_custkey, strftime(min(s), '%Y-%m-%d') AS \"start\", strftime(max(e), '%Y-%m-%d') AS \"end\" FROM g GROUP BY o_custkey, island")
def interval_union(orders):
    rows = orders.select("o_custkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.make_interval(days=(F.col("o_orderkey") % 200).cast("int"))).alias("e"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return S.merged_intervals(rows, "o_custkey", "s", "e").select("o_custkey", day("start"), day("end"))


@book.query("lineitem", sql="SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def nearest_rank(lineitem):
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY l_quantity)")
    return lineitem.groupBy("l_returnflag").agg(rank(0.5).alias("median"), rank(0.9).alias("p90"))


def _told(c):
    return F.concat_ws(",", *[c[k].cast("string") for k in ("tp", "fp", "fn")])


book.cases("date_precision", "iso string, text string, r string", [
    ("2020-01", "Acme, 2020 - 2022", "2020"), ("2020-01", "enero de 2020", None), ("2020-12-31", "en 2020", "2020"), ("2020-03-01", "marzo 2020", "2020-03"), ("2020-06-30", "06/2020", "2020-06"), ("2020-03-01", "1 de marzo de 2020", None),
    ("2020-03-01", "March 1st, 2020", None), ("2020-03", "2020", None), ("2020-01-15", "2020", None), ("2020-01", "2019", None), ("2020-01", "2020-01", None), ("2020-01", "Q1 2020", None), ("2020-01", "2019 - marzo 2020", None),
    ("2019-01", "2019 - marzo 2020", "2019"), ("2020-01-01", "01/01/2020", None), ("2020-02-29", "2020", "2020-02"), ("2020-01", "", None), ("2020-01", None, None), (None, "2020", None), ("2020-13", "2020", None),
], lambda iso, text: P.reduce_precision(iso, text)["value"])
book.cases("date_slot_counts", "ts string, te string, ps string, pe string, r string", [
    ("2019", "2021", "2019-03", "2021", "2,0,0"), ("2019", None, "2019", None, "2,0,0"), ("2019", None, None, None, "0,0,2"), ("2019", None, "2019", "2020", "1,1,1"), (None, "2020", "2020", None, "1,0,0"),
    (None, "2020", "2019", "2020", "1,1,0"), (None, None, "2019", "2020", "0,2,0"), ("2019-03", "2021", "2019", None, "0,1,2"), (None, None, None, None, "0,0,0"),
], lambda ts, te, ps, pe: _told(S.date_counts(ts, te, ps, pe)))
book.cases("date_slots", "ts string, te string, r bigint", [("2019", None, 2), (None, "2020", 1), (None, None, 0)], S.date_slots)
book.cases("scalar_counts", "t string, p string, r string", [("a", "a", "1,0,0"), ("a", "b", "0,1,1"), ("a", None, "0,0,1"), ("", "b", "0,1,0")], lambda t, p: _told(S.scalar_counts(t, p, t == p)))
book.cases("entry_likeness", "ta string, pa string, tb string, pb string, r double", [
    ("Acme", "ACME S.A.", "lead cook", "cook", 0.75), ("Acme", None, "lead cook", "Lead Cook", 1.0), ("Acme", None, "lead cook", "cook", 0.25), (None, None, "a b", None, 0.0), (None, None, "chef", "chef", 1.0), (None, None, None, None, 0.0),
], lambda ta, pa, tb, pb: S.entry_likeness([(entity_tokens(ta), entity_tokens(pa)), (entity_tokens(tb), entity_tokens(pb))]))
book.cases("input_budget", "explicit bigint, context bigint, output bigint, r bigint", [(100, 9000, 1000, 100), (None, 9000, 1000, 6000), (None, None, 1000, 24000), (None, 1000, 1000, 1), (0, None, 1000, 1)], S.input_budget)


def _stand_in():
    """A model that answers with the input's length and is cut beyond 2,000 characters."""
    return lambda text, max_output, penalty: (f'{{"n":{len(text)}}}', len(text) > 2000)


@book.query("documents", sql="WITH s AS (SELECT doc_id, least(coalesce(length(text), 0), 2310)::BIGINT AS n FROM documents), o AS (SELECT *, CASE WHEN n <= 2000 THEN 'ok' WHEN ceil(n / 3.3::DOUBLE) >= 630 THEN 'less_input' ELSE 'failed' END AS outcome FROM s) SELECT doc_id, outcome, CASE outcome WHEN 'less_input' THEN 1386 ELSE n END::BIGINT AS sent_chars, CASE outcome WHEN 'failed' THEN NULL WHEN 'less_input' THEN '{\"n\":1386}' ELSE '{\"n\":' || n || '}' END AS answer FROM o")
def model_stage(docs):
    return complete(docs, _stand_in, budget=700, fit=head)


def _reader():
    """A model that answers with the length and checksum of all that it read."""
    return lambda text, max_output, penalty: (f'{{"n":{len(text)},"crc":{zlib.crc32(text.encode())}}}', False)


@book.query("documents")
def model_stage_whole(docs):
    """The model stage at its own budget and fit: sections of little value go first. model_stage has a prefix cut, which its SQL can express."""
    return complete(docs, _reader)


LONG = "Ana\nExperiencia\nCook at Acme\nPublicaciones\n" + "p" * 40 + "\nOTROS CONGRESOS\n" + "q" * 60 + "\nIdiomas\nInglés"

book.cases("input_sections", "t string, b bigint, r string", [
    (LONG, 100, LONG.replace("\n", "/") + " - false"), (LONG, 40, "Ana/Experiencia/Cook at Acme/Publicaciones/" + "p" * 40 + "/Idiomas/Inglés - OTROS CONGRESOS false"),
    (LONG, 20, "Ana/Experiencia/Cook at Acme/Idiomas/Inglés - Publicaciones,OTROS CONGRESOS false"), (LONG, 8, "Ana/Experiencia - Publicaciones,OTROS CONGRESOS true"), ("x" * 50, 10, "x" * 33 + " - true"), ("", 1, " - false"), (None, 1, " - false"),
], lambda t, b: _fits(t, b))


def _fits(t, b):
    out = None
    for budget in (100, 40, 20, 8, 10, 1):
        fit = input_fit(t, budget)
        told = F.concat(F.translate(fit["text"], "\n", "/"), F.lit(" - "), F.array_join(fit["dropped"], ","), F.when(F.size(fit["dropped"]) > 0, " ").otherwise(""), fit["tail_cut"].cast("string"))
        out = F.when(b == budget, told) if out is None else out.when(b == budget, told)
    return out


book.cases("model_failures", "kind string, message string, status bigint, attempts bigint, cut boolean, r string", [
    ("api", "refused", None, 1, False, "PROVIDER_ERROR: the call failed: refused"), ("api", "limit", 429, 3, False, "PROVIDER_ERROR: the call failed (HTTP 429): limit (after 3 attempts)"), ("no_object", "x", None, 1, True, "NO_OBJECT_GENERATED: the answer was cut at the output limit"),
    ("no_object", "x", None, 1, False, "NO_OBJECT_GENERATED: no valid record: x"), ("unparsed", "x", None, 1, False, "NO_OBJECT_GENERATED: the answer is no record: x"), ("aborted", "x", None, 1, False, "PROVIDER_ERROR: the call was aborted"),
    (None, "boom", None, 1, False, "PROVIDER_ERROR: extraction failed: boom"),
], lambda k, m, s, a, c: F.concat_ws(": ", failure(k, m, s, a, c)["code"], failure(k, m, s, a, c)["message"]))
book.cases("context_warnings", "n bigint, c bigint, r string", [(90, 100, "90 of 100 tokens of the context are taken by the input; the answer may be cut"), (89, 100, None), (1, None, None)], context_warning)


@book.query("documents", sql="SELECT doc_id, length(coalesce(replace(text, '</document>', '< /document>'), ''))::BIGINT AS inside, true AS fenced FROM documents")
def prompts(docs):
    made = docs.select("doc_id", prompt(F.col("text"), F.col("lang"), "2026-01-15").alias("p"))
    body = F.regexp_extract("p", r"(?s)\n<document>\n(.*)\n</document>$", 1)
    return made.select("doc_id", F.length(body).cast("long").alias("inside"), (F.regexp_count("p", F.lit("</document>")) == 1).alias("fenced"))
