"""Operator 4: sharding by a hierarchical weighted hash tree, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm.scratch import bucket_of, hash31, materialize, prefix_sums

REGION_RACKS, RACK_SHARDS = 3, 4
RANGE_ROWS, MAX_RANGES = 256, 8192


def tree(n: int) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight. Twelve shards fill a region of three racks; the next one opens a region."""
    out: dict = {}
    for i in range(n):
        out.setdefault(i // (REGION_RACKS * RACK_SHARDS), {}).setdefault(i // RACK_SHARDS, {})[i] = 1.0
    return out


def draw(key: Column, level: str, children: Column) -> Column:
    """The child with the least exponential draw of rate weight: it wins with odds in proportion to its weight."""
    unit = lambda c: (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), c["id"]), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.array_min(F.transform(children, lambda c: F.struct((-F.log(unit(c)) / c["w"]).alias("d"), c["id"].alias("id"))))["id"]


def _weigh(node) -> float:
    return sum(map(_weigh, node.values())) if isinstance(node, dict) else node


def _children(node: dict) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("id"), F.lit(float(_weigh(v))).alias("w")) for k, v in node.items() if _weigh(v) > 0])


def shard_of(key: Column, shards: dict[int, dict[int, dict[int, float]]]) -> Column:
    """Descend region, rack and shard. A draw depends on the key, the level, the child and its weight alone.

    So a changed weight moves keys only into or out of the subtrees on its path: between unchanged siblings nothing
    moves, and below an unchanged subtree no draw changes. A shard that opens a region takes keys into itself only.
    Inside a region that grows, keys it gains are dealt to all its shards.
    """
    inner = lambda table, at: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), _children(v))]), at)
    racks = {rack: leaves for region in shards.values() for rack, leaves in region.items()}
    region = draw(key, "region", _children(shards))
    rack = F.transform(F.array(region), lambda r: draw(key, "rack", inner(shards, r)))[0]
    return F.transform(F.array(rack), lambda r: draw(key, "shard", inner(racks, r)))[0]


def shard_documents(docs: DataFrame, n: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of documents, by the law `key`.

    doc_id and the shard count alone decide, so equal texts go together only if their ids do. grown_shard is the place
    with one shard more, which takes rows only into itself where it opens a region (24 to 25 does). Slots number a
    shard's rows in hash order from 0, range by range. A null doc_id is a key of its own; a null text has size 8 and
    the checksum of no bytes; equal rows share a shard and get slots of their own. No rows give no rows; other
    columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("_key"))
    rows = rows.withColumn("shard", shard_of(F.col("_key"), tree(n)).cast("int")).withColumn("grown_shard", shard_of(F.col("_key"), tree(n + 1)).cast("int"))
    rows = materialize(rows.withColumn("_h", hash31(F.col("_key"), F.lit("slot"))).withColumn("_one", F.lit(1).cast("long")), "sharded")
    ranges = max(1, min(MAX_RANGES, -(-rows.count() // (n * RANGE_ROWS))))
    rows = rows.withColumn("_range", bucket_of(F.col("_h"), F.lit(ranges).cast("long")))
    rows = prefix_sums(rows, ["shard"], "_range", ["_h", "_key", "size", "text_crc32"], "_one", "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard")
