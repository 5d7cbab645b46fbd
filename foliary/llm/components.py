"""Connected components of a table of links, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b) links of longs; root is the least node of its component.

    Each round every node hooks to its least neighbour, two jumps shorten the hooks, and links between what is left
    are contracted. The rounds grow as the logarithm of the nodes; each is cut from its lineage in shared storage.
    """
    links = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    done = None
    while links.head(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p")).select(F.col("a").alias("node"), "p"), "hooks")
        for _ in range(2):
            up = hook.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p"))
        hook = materialize(hook, "hooks")
        if done is None:
            done = hook.withColumnRenamed("p", "root")
        else:
            done = done.join(hook.select(F.col("node").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        done = materialize(done, "roots")
        to = hook.withColumnRenamed("node", "a").withColumnRenamed("p", "u")
        fro = hook.withColumnRenamed("node", "b").withColumnRenamed("p", "v")
        links = materialize(links.join(to, "a").join(fro, "b").select(F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "links")
    return done if done is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
