"""Queries over dates: round trips from timestamps, and phrases with known readings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from foliary.functions import dates as D
from foliary.plans.registry import Book

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
REF = dt.date(2024, 6, 15)

EXPECTED = "CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 6 THEN strftime(o_orderdate, '%Y') ELSE strftime(date_trunc('quarter', o_orderdate), '%Y-%m') END"


def _styled():
    d = F.col("o_orderdate")
    year, month = F.date_format(d, "yyyy"), F.element_at(F.array(*[F.lit(w.split()[0]) for w in D.MONTH_WORDS]), F.month(d))
    styles = (F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "MM/yyyy"), F.date_format(d, "dd/MM/yyyy"), F.concat(month, F.lit(" de "), year), F.date_format(d, "MMM d, yyyy"), F.concat(F.date_format(d, "d"), F.lit(" de "), month, F.lit(" de "), year), year, F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), year))
    out = F.when(F.lit(False), "")
    for i, s in enumerate(styles):
        out = out.when(F.col("o_orderkey") % 8 == i, s)
    return out


@book.query("orders", sql=f"SELECT o_orderkey, {EXPECTED} AS value FROM orders")
def date_roundtrip(orders):
    return orders.select("o_orderkey", D.normalize_date(_styled(), REF)["value"].alias("value"))


@book.query("orders", sql="SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS \"start\", CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE strftime(o_orderdate + INTERVAL 14 MONTH, '%Y-%m') END AS \"end\", o_orderkey % 4 = 3 AS current FROM orders")
def date_ranges(orders):
    d = F.col("o_orderdate")
    a, b = F.date_format(d, "MM/yyyy"), F.date_format(F.add_months(d, 14), "MM/yyyy")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(a, F.lit(" - "), b)).when(F.col("o_orderkey") % 4 == 1, F.concat(a, F.lit(" a "), b)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("entre "), a, F.lit(" y "), b)).otherwise(F.concat(a, F.lit(" - actualidad")))
    return orders.select("o_orderkey", D.date_range(text, REF).alias("r")).select("o_orderkey", "r.*")


book.cases("date_phrases", "a string, r string", [("marzo de 2020", "2020-03"), ("15 de marzo de 2020", "2020-03-15"), ("March 15, 2020", "2020-03-15"), ("03/25/2020", "2020-03-25"), ("15-03-20", "2020-03-15"), ("03/21", "2021-03"), ("2020-03-15T00:00:00Z", "2020-03-15"), ("año 2019", "2019"), ("2019 (aprox.)", "2019"), ("Actualidad", None), ("verano 2020", "2020-06"), ("", None), (None, None), ("2019 - 2021", None), ("1899", None), ("13/2020", None), ("Sept. 2018", "2018-09"), ("2020 marzo", "2020-03")], lambda a: D.normalize_date(a, REF)["value"])
book.cases("date_flags", "a string, r string", [("actualidad", "true,false"), ("2020", "false,false"), ("whatever", "false,true"), ("2019-21", "false,true"), ("", "false,false")], lambda a: F.concat_ws(",", D.normalize_date(a, REF)["current"].cast("string"), D.normalize_date(a, REF)["unparsed"].cast("string")))
book.cases("date_relative", "a string, r string", [("hace 3 años", "2021"), ("hace 6 meses", "2023-12"), ("a year ago", "2023"), ("há dois anos", "2022"), ("2 anos atrás", "2022"), ("desde hace un mes", "2024-05"), ("hace mucho", None)], lambda a: D.normalize_date(a, REF)["value"])
book.cases("date_periods", "a string, r string", [("Q1 2021", "2021-01"), ("2021 Q3", "2021-07"), ("1T 2021", "2021-01"), ("2020-S2", "2020-07"), ("primer semestre 2020", "2020-01"), ("2° cuatrimestre 2020", "2020-05"), ("second half of 2020", "2020-07"), ("semestre 2 de 2020", "2020-07"), ("Q5 2020", None)], lambda a: D.normalize_date(a, REF)["value"])
book.cases("date_splits", "a string, r string", [("2019-21", "2019/2021/false"), ("2019–2021", "2019/2021/false"), ("2019/21", "2019/2021/false"), ("de 2019 a 2021", "2019/2021/false"), ("entre 2019 y 2021", "2019/2021/false"), ("mar 2019 - jun 2021", "2019-03/2021-06/false"), ("2019 - presente", "2019//true"), ("desde 2019", "2019//false"), ("2019-03", None), ("1998-99", "1998/1999/false"), ("2019", None)], lambda a: F.when(D.date_range(a, REF)["start"].isNotNull(), F.concat_ws("/", D.date_range(a, REF)["start"], F.coalesce(D.date_range(a, REF)["end"], F.lit("")), D.date_range(a, REF)["current"].cast("string"))))
book.cases("date_latest", "a string, r string", [("2019, 2021", "2021"), ("marzo 2020; 2020", "2020-03"), ("2020", None), ("", None)], lambda a: D.latest_date(a, REF))
book.cases("date_strict", "a string, r boolean", [("2020", True), ("2020-02-30", True), ("2020-13", False), ("20", False)], D.strict_iso)
book.cases("date_last_day", "a string, r boolean", [("2020-02-29", True), ("2021-02-28", True), ("2021-02-27", False), ("2021", False)], D.last_day)
