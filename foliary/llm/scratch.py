"""Shared-storage cuts of lineage, and distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows of a table that may be broadcast; with the narrow rows used here that is a few MB.
BROADCAST_ROWS = 50_000
#: Stands for a null doc_id in keys.
NO_ID = -(2**63)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session may do without spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(scratch_root, "own", None) or tempfile.mkdtemp(prefix="foliary-")
        scratch_root.own = root
    return root


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs only running tasks."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/foliary/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    spark._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of finished queries now, not in half an hour
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote, once nothing lazy reads it any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hash31(*cols: Column) -> Column:
    """31 hash bits as a non-negative long."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 33)


def bucket_of(h31: Column, n: Column) -> Column:
    """Which of n equal ranges of the 31-bit hash; ascends with the hash."""
    return F.shiftright(h31 * n, 31)


def prefix_sums(df: DataFrame, groups: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Exclusive prefix sums of value in each group, in the order (bucket, *order).

    df should be materialized, since it is read twice. Buckets are ranges of the order, so no task sees a whole
    group: bucket totals are summed first, and each bucket is summed alone and shifted by what lies before it.
    """
    base = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(*groups, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(base, [*groups, bucket])
    return df.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base")


def keyed(docs: DataFrame) -> tuple[Column, Column]:
    """doc_id (null as a number of its own) and a hash of the text: rows with equal keys have equal texts."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tie")


def packed(docs: DataFrame) -> DataFrame:
    """(row, id, tie): the rows as structs beside their keys, so that no column of docs meets a helper's name."""
    id_, tie = keyed(docs)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_, tie)
