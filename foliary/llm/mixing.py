"""Operator 1: mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm.scratch import bucket_of, keyed, materialize, packed, prefix_sums, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows of a hash range that one task sums, about.
RANGE_ROWS = 256
MAX_RANGES = 8192


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (source, source_size) rows, one row a source.

    Sources by code point, null last, weigh `weights` in turn and share the total. A target stops at `epochs` times
    its source's size; the excess is shared again by weight until none is above. In ascending order of cap to weight
    the capped sources come first, so one pass of running sums finds them; all tests are on whole numbers.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("_ratio", "_rank")
    ahead = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    scale = 1
    for x in weights:
        scale *= x
    out = sources.withColumn("_rank", F.row_number().over(by_name).cast("long"))
    out = out.withColumn("_w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    out = out.withColumn("_cap", F.col("source_size") * epochs).withColumn("_ratio", F.expr(f"_cap * {scale} div _w"))
    out = out.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0)))
    out = out.withColumn("_capped", F.col("_w") * F.col("_left") > F.col("_cap") * F.sum("_w").over(rest))
    free = F.when(~F.col("_capped"), F.col("_w"))
    out = out.withColumn("_free", F.sum(free).over(every))
    out = out.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(every), F.lit(0)))
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise((F.col("_left") * F.col("_w")).cast("double") / F.col("_free").cast("double"))
    return out.select("source", "source_size", F.col("_rank").alias("rank"), target.alias("target"))


def takes(docs: DataFrame, *, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, id, tie, size, source_size, target, full and part of each row: whole copies, and words of one more."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    id_, tie = keyed(docs)
    sized = materialize(docs.select("doc_id", "source", id_, tie, word_count(F.col("text")).alias("size"), key.alias("_key")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = materialize(sources, "sources")
    goals = source_targets(sources.drop("_rows"), weights, epochs)
    goals = goals.join(sources.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("source")
    goals = materialize(goals.withColumn("_ranges", F.least(F.lit(MAX_RANGES), F.ceil(F.col("_rows") / RANGE_ROWS)).cast("long")), "targets")
    rows = sized.join(small(goals, goals.count()), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    h31 = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 1)
    rows = rows.withColumn("_range", bucket_of(h31, F.col("_ranges")))
    rows = prefix_sums(rows, ["rank"], "_range", ["_key", "doc_id", "size", "tie"], "size", "_before")
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * epochs)
    full = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_budget", budget).withColumn("full", full)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_budget") - F.col("full") * F.col("source_size") - F.col("_before")))
    return rows.select("doc_id", "source", "id", "tie", "size", "source_size", "target", "full", part.cast("long").alias("part"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of documents.

    Rows of a source stand in the order of a hash of doc_id (size and text hash break ties); their sizes' prefix
    sums, taken range by range of the hash, say which fall within the source's budget. Whole epochs repeat every row;
    the last is cut at the exact word, so a row at the edge is taken in part. The budget is the target rounded to a
    word. A null text has size 0, a null source is a source, a null doc_id hashes as the empty string, and
    equal rows are taken one after another. No rows give no rows; other columns are ignored.
    """
    rows = takes(docs, **options)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).alias("taken"), "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """documents as the mix takes them: a row for each copy, the one at a budget's edge cut after its last word.

    A null text has no words and so is not taken; a null source is a source, a null doc_id hashes as the empty string;
    rows equal in doc_id and text are taken one after another. Columns of any other name, those of the helpers among
    them, keep their values. No rows give no rows.
    """
    none = F.array().cast("array<long>")
    copies = F.concat(F.array_repeat("size", F.col("full").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(none))
    rows = takes(docs.select("doc_id", "source", "text"), **options).select("id", "tie", "source", "size", copies.alias("copies"))
    rows = materialize(rows.where("size > 0"), "copies")
    out = packed(docs).withColumn("source", F.col("row.source"))
    if rows.groupBy("id", "tie", "source").count().where("count > 1").head(1):
        rows = rows.groupBy("id", "tie", "source", "size").agg(F.flatten(F.collect_list("copies")).alias("copies"))
        out = out.dropDuplicates(["id", "tie", "source"])
    rows = rows.withColumnRenamed("source", "of").where(F.size("copies") > 0)
    out = out.join(rows, ["id", "tie"]).where(F.col("source").eqNullSafe(F.col("of"))).select("row", "size", F.explode("copies").alias("n"))
    whole, text = F.col("n") >= F.col("size"), F.col("row.text")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    short = F.array_join(F.slice(words, 1, F.col("n").cast("int")), "")
    changed = F.col("row").withField("text", short)
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(short).cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(whole, F.col("row")).otherwise(changed).alias("row")).select("row.*")


#: The same rows as op1 in DuckDB's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w, (3 * source_size)::BIGINT AS cap FROM r),
c AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap * 10 // w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lft,
        (sum(w) OVER (ORDER BY cap * 10 // w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS wr FROM w),
f AS (SELECT *, w * lft > cap * wr AS capped FROM c),
g AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
        (((SELECT sum(source_size)::BIGINT FROM f) - (SELECT coalesce(sum(cap), 0)::BIGINT FROM f WHERE capped)) * w)::DOUBLE / (SELECT sum(w)::BIGINT FROM f WHERE NOT capped)::DOUBLE END AS target FROM f),
b AS (SELECT *, least(round(target)::BIGINT, 3 * source_size) AS budget FROM g),
p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget, d.source,
        CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS full_epochs,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (full_epochs * size + greatest(0, least(size, budget - full_epochs * source_size - before)))::BIGINT AS taken, source FROM p
"""
