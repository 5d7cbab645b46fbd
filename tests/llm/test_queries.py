"""The registered queries against their SQL, and results that SQL can't tell against brute force on the small tables."""

import math
import struct

import duckdb
import pandas as pd
import pytest
import xxhash

from foliary.llm import queries
from foliary.llm.sharding import tree

SF = "/root/testdata/sf0.001"


def rows(df):
    plain = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    num = lambda v: float(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted(repr(tuple(num(plain(v)) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_shards_by_draws(spark):
    """Every place descends the tree by the least exponential draw, with a hash library of its own."""

    def draw(key, level, children):
        def rank(child, weight):
            h = 42
            for part in (key.encode(), level.encode(), struct.pack("<i", child)):
                h = xxhash.xxh64(part, seed=h).intdigest()
            return -math.log(((h >> 11) + 0.5) / 2**53) / weight

        return min(children, key=lambda c: rank(c, children[c]))

    def place(key, shards):
        weigh = lambda node: sum(map(weigh, node.values())) if isinstance(node, dict) else node
        for level in ("region", "rack"):
            shards = shards[draw(key, level, {c: weigh(x) for c, x in shards.items()})]
        return draw(key, "shard", shards)

    got = queries.queries()["op4_hash_tree_shards"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all((r.shard, r.grown_shard) == (place(str(r.doc_id), tree(24)), place(str(r.doc_id), tree(25))) for r in got)
    assert {r.shard for r in got} == set(range(24))


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    scores = queries.queries()["op6_toxicity"](spark, sf).where("held_out").select("doc_id", "predicted")
    pairs = scores.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("toxic IS NOT NULL").collect()
    assert len(pairs) > 50
    assert sum(r.predicted == r.toxic for r in pairs) >= 0.97 * len(pairs)
