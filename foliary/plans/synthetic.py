"""Queries over made people: what is written must read back as what the record tells."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from foliary.functions.dates import date_range
from foliary.operators import synthetic as Y
from foliary.operators.grounding import ground
from foliary.operators.records import spread
from foliary.plans.registry import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles

TODAY = dt.date(2026, 1, 15)
_PLAN = " ".join(f"WHEN i < {sum(p[2] for p in Y.PLAN[: k + 1])} THEN '{layout} {kind}'" for k, (layout, kind, _, _) in enumerate(Y.PLAN))


@book.query("orders", sql=f"""WITH o AS (SELECT o_orderkey, o_orderkey % 60 AS i, {list(Y.COUNTRIES)}[(o_orderkey % 7)::INT + 1] AS country, (o_orderkey // 7 + 1)::VARCHAR AS n FROM orders)
SELECT o_orderkey, 'es-' || lower(country) || '-' || lpad(n, greatest(3, length(n))::INT, '0') AS id, country, CASE {_PLAN} END AS kind, CASE WHEN i IN (3, 32) THEN 'mixed' ELSE 'es' END AS language FROM o""")  # fmt: skip
def planned_entries(orders):
    plan = Y.planned(F.col("o_orderkey"))
    return orders.select("o_orderkey", plan["id"].alias("id"), plan["country"].alias("country"), F.concat_ws(" ", plan["layout"], plan["format"]).alias("kind"), plan["language"].alias("language"))


#: Patterns are literals, for Spark compiles any other for each row.
_DIGITS = {cc: f"^{p.replace('+', '[+]').replace('#', '[0-9]').replace('*', '[1-9]')}$" for cc, p in Y.PHONES.items()}


@book.query("customer", sql="SELECT c_custkey, true AS phone_fits, true AS email_fits, true AS title_fits, true AS dates_read_back, true AS later_first FROM customer")
def people_read_back(customer):
    """Dates are read out of the text again, not taken from the record."""
    rows = Y.people(spread(customer.select("c_custkey")), "c_custkey")
    lines = F.split("text", "\n")
    rows = rows.withColumns({"one": date_range(lines[4], TODAY), "two": date_range(lines[6], TODAY)})
    same = lambda r, w: r["start"].eqNullSafe(w["startDate"]) & r["end"].eqNullSafe(w["endDate"]) & (r["current"] == w["endDate"].isNull())
    work, basics = F.col("record.work"), F.col("record.basics")
    phone = F.coalesce(*[F.when(F.col("plan.country") == cc, basics["phone"].rlike(p)) for cc, p in _DIGITS.items()])
    return rows.select(
        "c_custkey", phone.alias("phone_fits"), basics["email"].rlike(r"^[a-z]+\.[a-z]+@example\.com$").alias("email_fits"),
        (F.size(F.filter(work, lambda w: w["position"].rlike("[{}/]"))) == 0).alias("title_fits"), (same(F.col("one"), work[0]) & same(F.col("two"), work[1])).alias("dates_read_back"), (work[0]["startDate"] > work[1]["endDate"]).alias("later_first"),
    )


@book.query("customer", sql="SELECT c_custkey, true AS kept, '' AS missing FROM customer")
def people_grounded(customer):
    """Grounding a record against the text that was made with it keeps its address, phone, skills and languages, and misses no section."""
    rows = Y.people(spread(customer.select("c_custkey")), "c_custkey")
    told = "basics struct<email: string, phone: string>, skills array<struct<name: string>>, languages array<struct<language: string, fluency: string>>"
    rows = rows.withColumn("g", ground(F.to_json("record", {"ignoreNullFields": "false"}), F.col("text")))
    part = lambda c: F.to_json(F.from_json(c, told))
    return rows.select("c_custkey", (part(F.to_json("record")) == part(F.col("g.record"))).alias("kept"), F.array_join("g.missing", ",").alias("missing"))
