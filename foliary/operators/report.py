"""Reports of scored systems (SNK8-10): bounded tables, one row a system and field, as text and Markdown.

Scores come in as DataFrames of sums, so what reaches the driver is a few rows for each system, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.operators.scoring import COMMON_FIELDS, FIELDS


def percent(value: float | None, absent: str = "n/a") -> str:
    return absent if value is None else f"{100 * value:.1f}"


def markdown(header: list[str], rows: Iterable[list[str]], right: int = 1) -> str:
    """A table whose columns from `right` on are numbers."""
    marks = ["---" if k < right else "---:" for k in range(len(header))]
    return "\n".join(f"| {' | '.join(cells)} |" for cells in [header, marks, *rows])


def aligned(header: list[str], rows: list[list[str]]) -> str:
    """SNK10: columns as wide as their widest cell."""
    widths = [max(map(len, column)) for column in zip(header, *rows, strict=True)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip() for cells in [header, *rows])


def ranked(fields: DataFrame) -> DataFrame:
    """SRT1: (system, field, f1, ...) to systems by the mean F1 of the common fields, best first, then by name."""
    mean = F.avg(F.when(F.col("field").isin(*COMMON_FIELDS), F.col("f1")))
    return fields.groupBy("system").agg(F.coalesce(mean, F.lit(0.0)).alias("overall_f1")).orderBy(F.desc("overall_f1"), F.collate(F.col("system"), "UNICODE"))


def field_table(fields: DataFrame) -> DataFrame:
    """SET4: a row a system, a column a field."""
    return fields.groupBy("system").pivot("field", list(FIELDS)).agg(F.first("f1"))


def slice_table(slices: DataFrame) -> DataFrame:
    """SET4: (slice, system, f1) to a row a slice; systems become columns, so there must be few."""
    return slices.groupBy("slice").pivot("system").agg(F.first("f1")).orderBy("slice")


def render(fields: DataFrame) -> str:
    """SNK9: the ranking with all fields, as Markdown."""
    table = {r["system"]: r for r in field_table(fields).collect()}
    shown = [f for f in FIELDS if any(r[f] is not None for r in table.values())]
    rows = [[s, f"**{percent(f1)}**", *(percent(table[s][f]) for f in shown)] for s, f1 in ranked(fields).collect()]
    return markdown(["system", "overall", *shown], rows)


def summary(system: str, fields: DataFrame, statuses: DataFrame) -> str:
    """SNK8: a run in plain text. statuses: (doc_id, ok, skipped, error); the failures are listed, a hundred at most of them."""
    n = statuses.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"), F.count_if(~F.col("ok") & F.col("skipped").isNull()).alias("failed")).first()
    own = {r["field"]: r for r in fields.collect()}
    body = [[f, *(percent(own[f][k]) for k in ("prec", "rec", "f1")), str(own[f]["tp"] + own[f]["fn"])] for f in FIELDS if f in own]
    mean = [own[f]["f1"] for f in COMMON_FIELDS if f in own]
    body.append(["overall", "", "", percent(sum(mean) / len(mean) if mean else 0.0), ""])
    failed = statuses.where("NOT ok AND skipped IS NULL").orderBy("doc_id").limit(100).collect() if n["failed"] else []
    lines = [f"{system}: {n['all']} documents, {n['all'] - n['skipped']} attempted, {n['failed']} failed", "", aligned(["field", "P", "R", "F1", "support"], body)]
    return "\n".join([*lines, *(f"failed: {r['doc_id']}: {r['error']}" for r in failed)])
