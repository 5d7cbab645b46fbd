"""The registered queries of the operators here, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm.chat import CONTROL_ROWS, chat_digests

    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(talks.unionByName(spark.createDataFrame(CONTROL_ROWS, "conv_id long, turn long, role string, text string")))


def op3_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm.fingerprints import edited_likeness

    return edited_likeness(_table(spark, sf_dir, "documents"))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm.repeats import repeat_digests

    return repeat_digests(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm.neardup import near_duplicate_classes

    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm.quality import judge_documents

    return judge_documents(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm.urls import RULES, judge_pages, spam_urls

    pages = _table(spark, sf_dir, "pages")
    return judge_pages(pages, RULES, spam_urls(pages))


def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliary.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    fs = (op1_mix_sources, op2_chat_prefix_tree, op3_syncmer_fingerprints, op4_hash_tree_shards, op5_repeated_bytes, op6_toxicity, op7_near_duplicates, op8_quality_outliers, op9_url_filter, op10_pack_documents)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    from foliary.llm.chat import ORACLE as CHAT
    from foliary.llm.mixing import ORACLE as MIX
    from foliary.llm.neardup import ORACLE as NEAR
    from foliary.llm.repeats import ORACLE as REPEATS
    from foliary.llm.urls import ORACLE as URLS

    return {"op1_mix_sources": MIX, "op2_chat_prefix_tree": CHAT, "op5_repeated_bytes": REPEATS, "op7_near_duplicates": NEAR, "op9_url_filter": URLS}
