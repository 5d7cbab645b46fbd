"""Operator 9: URL filters by a blocked Bloom filter and an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.scratch import BROADCAST_ROWS, materialize, small

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Hosts with such a label are known for spam; the query's list is their pages' canonical URLs.
SPAM = r"(^|[.-])(spam|casino)([.-]|$)"
#: Words of 64 bits in a block, bits set for an entry, and entries a block is meant for: under 1 % of misses pass.
BLOCK_WORDS, PROBES, PER_BLOCK = 4, 6, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first :// in lower case (A-Z alone), and the path up to ? or #. Both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s:.*?)://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    return F.concat(host, F.regexp_replace(path, "/+$", ""))


def spam_urls(pages: DataFrame) -> DataFrame:
    """(url): the canonical URLs (host and path without its last slashes) of pages on SPAM hosts, each once."""
    host, path = host_and_path(F.col("url"))
    return pages.select(host.alias("host"), path.alias("path")).where(F.col("host").rlike(SPAM)).select(canonical(F.col("host"), F.col("path")).alias("url")).distinct()


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(block, bits): a blocked Bloom filter of n keys, one row a block."""
    blocks = max(1, -(-n // PER_BLOCK))
    rows = keys.select(F.explode(probes(F.col("key"), blocks)).alias("p")).select("p.*")
    words = rows.groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))
    return words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("bits")), blocks


def probes(key: Column, blocks: int) -> Column:
    """The block of a key and the word and bit of each probe; all probes fall in one block."""
    block = F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))
    at = lambda i: F.pmod(F.xxhash64(key, i), F.lit(64 * BLOCK_WORDS))
    one = lambda i: F.struct(block.alias("block"), F.shiftright(at(i), 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at(i), F.lit(64)).cast("int")).alias("mask"))
    return F.transform(F.sequence(F.lit(1), F.lit(PROBES)), one)


def possible(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows whose key the Bloom filter of keys passes. The filter is broadcast within the bound, else joined."""
    blocks, count = bloom(keys, n)
    rows = rows.withColumn("_probes", probes(F.col("key"), count)).withColumn("_block", F.col("_probes")[0]["block"])
    rows = rows.join(small(blocks, count), F.col("_block") == F.col("block"))
    passes = F.forall("_probes", lambda p: F.coalesce(F.col("bits")[p["word"]].bitwiseAND(p["mask"]) != 0, F.lit(False)))
    return rows.where(passes).drop("_probes", "_block", "block", "bits")


def judge_pages(pages: DataFrame, rules: tuple = RULES, listed: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    Each distinct host and path asks for the listed keys it could match: its canonical URL among the listed ones, and
    every suffix of its host with every beginning of its path that has the length of some rule's. A blocked Bloom
    filter of the listed keys passes possible hits; an exact join removes the false ones. The longest rule wins, by
    host and path together and then by host; without a rule a listed URL is blocked and the rest allowed. A null URL
    or one without :// has an empty host and path and no rule. Equal rows get equal verdicts. No rows give no rows;
    other columns are ignored.
    """
    spark = pages.sparkSession
    listed = listed if listed is not None else spark.createDataFrame([], "url string")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    told = [(f"r\n{h}\n{p}", h, p, v, len(h) + len(p), len(h)) for h, p, v in rules]
    book = spark.createDataFrame(told, "key string, h string, p string, v string, size int, host_size int")
    book = book.unionByName(listed.distinct().select(F.concat(F.lit("u\n"), "url").alias("key"), F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("p"), F.lit("block").alias("v"), F.lit(-1).alias("size"), F.lit(-1).alias("host_size")))
    book = materialize(book, "listed")
    n = book.count()
    labels = F.split("host", r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*[F.lit(x) for x in sorted({len(p) for _, p, _ in rules})])
    heads = F.array_distinct(F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring("path", F.lit(1), k))) if rules else F.array().cast("array<string>")
    asked = F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda p: F.concat(F.lit("r\n"), t, F.lit("\n"), p))))
    asked = F.concat(asked, F.array(F.concat(F.lit("u\n"), canonical(F.col("host"), F.col("path")))))
    distinct = rows.select("host", "path").distinct()
    hits = possible(distinct.select("host", "path", F.explode(asked).alias("key")), book.select("key"), n)
    exact = hits.join(small(book, n), "key")
    best = exact.groupBy("host", "path").agg(F.max(F.struct("size", "host_size", "h", "p", "v")).alias("b"))
    out = rows.join(best, ["host", "path"], "left")
    rule = F.concat(F.col("b.h"), F.col("b.p"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("b.v", F.lit("allow")).alias("verdict"))


#: The same rows as op9 in DuckDB's SQL.
ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
l(u) AS (SELECT DISTINCT regexp_replace(host || path, '/+$', '') FROM x WHERE regexp_matches(host, '(^|[.-])(spam|casino)([.-]|$)')),
m AS (SELECT x.host, x.path, h || p AS rule, v, row_number() OVER (PARTITION BY x.host, x.path ORDER BY length(h || p) DESC, length(h) DESC) AS k
      FROM (SELECT DISTINCT host, path FROM x) x JOIN r ON (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p))
SELECT x.page_id, x.host, x.path, m.rule, coalesce(m.v, CASE WHEN regexp_replace(x.host || x.path, '/+$', '') IN (SELECT u FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM x LEFT JOIN m ON m.host = x.host AND m.path = x.path AND m.k = 1
"""
