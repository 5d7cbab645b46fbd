"""Runs of systems over a data set: what is loaded, skipped, kept and written."""

from __future__ import annotations

import os
import platform
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results: details of a run that don't change its predictions.
SHOWN_ONLY = ("hardware", "notes", "command", "node")
PREDICTION = ("id", "prediction", "error", "seconds", "warnings", "usage")


@dataclass(frozen=True)
class System:
    """UDX3: a system under test. predict gets the entries it supports and returns rows of PREDICTION; only id and
    prediction must be there (UDX13)."""

    name: str
    kind: str
    supports: tuple[str, ...]
    predict: Callable[[DataFrame], DataFrame]
    details: dict[str, str] = field(default_factory=dict)


def predictions(system: System, entries: DataFrame) -> DataFrame:
    """UDX13-14: a row of PREDICTION for each entry; columns a system doesn't tell, and entries it leaves out, are null."""
    kinds = {"prediction": "string", "error": "string", "seconds": "double", "warnings": "array<string>", "usage": "map<string,bigint>"}
    got = system.predict(entries.where(F.col("format").isin(*system.supports)))
    got = got.select("id", *[F.col(c) if c in got.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    return entries.select("id").join(got.withColumn("usage", compact(F.col("usage"))), "id", "left")


def load_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """SRC27: the manifest's entries, and the version."""
    version = spark.read.text(f"{folder}/VERSION", wholetext=True).first()
    return spark.read.json(f"{folder}/manifest.json", multiLine=True), version[0].strip() if version else ""


def load_truth(spark: SparkSession, folder: str) -> DataFrame:
    """SRC28: (id, record) of a folder with a JSON file for each id."""
    rows = spark.read.text(f"{folder}/*.json", wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("id"), F.col("value").alias("record"))


def covering(results: DataFrame, manifest: DataFrame) -> DataFrame:
    """SRC29: (run, id, ...) rows of the runs that have every entry of the manifest."""
    n = manifest.select("id").distinct().count()
    full = results.join(manifest.select("id").distinct(), "id", "left_semi").groupBy("run").agg(F.count_distinct("id").alias("n")).where(F.col("n") == n)
    return results.join(full.select("run"), "run", "left_semi")


def skip_reason(draft: Column, kind: Column, supports: tuple[str, ...], include_drafts: bool = False) -> Column:
    """PRJ10: why an entry is skipped rather than failed; null if it runs."""
    return F.when(draft & F.lit(not include_drafts), "draft-truth").when(~kind.isin(*supports), "unsupported-format")


def subset(entries: DataFrame, only: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """PRJ11: the entries asked for by id, then the first so many by id."""
    entries = entries if only is None else entries.join(only.select("id").distinct(), "id", "left_semi")
    return entries if limit is None else entries.orderBy("id").limit(limit)


def run_details(details: Column, provenance: Column) -> Column:
    """ARR9: the details that a prediction depends on, by key."""
    kept = F.map_filter(details, lambda k, _: ~k.isin(*SHOWN_ONLY) & ~F.map_contains_key(provenance, k))
    return F.map_from_entries(F.array_sort(F.map_entries(kept)))


def cache_key(name: Column, kind: Column, details: Column, version: Column, provenance: Column) -> Column:
    """STR14: canonical JSON of all that a cached prediction depends on."""
    return F.to_json(F.struct(name.alias("name"), kind.alias("kind"), run_details(details, provenance).alias("details"), version.alias("version"), F.map_from_entries(F.array_sort(F.map_entries(provenance))).alias("provenance")))


def updated_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """SNK4: (id, key, ...) records; a fresh one takes the place of its id's, whatever that one's key."""
    return cache.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def result_folder(folder: str, partial: bool) -> str:
    """SNK3: a run of a subset never takes the place of a full one."""
    return f"{folder.rstrip('/')}/partial" if partial else folder


def counts_of(precision: Column, recall: Column, support: Column) -> list[Column]:
    """AGG3: tp, fp and fn of ratios, rounded half up."""
    half_up = lambda x: F.floor(x + 0.5).cast("long")
    tp = half_up(recall * support)
    return [tp.alias("tp"), F.when(precision > 0, half_up(tp / precision - tp)).otherwise(0).cast("long").alias("fp"), (support - tp).cast("long").alias("fn")]


def compact(usage: Column) -> Column:
    """AGG23: what was told of the usage; null if nothing was."""
    told = F.map_filter(usage, lambda _, v: v.isNotNull())
    return F.when(F.size(told) > 0, told)


def name_list(names: Column, most: int = 10) -> Column:
    """STR16: each name once, the first so many and the number of the rest."""
    once = F.array_distinct(names)
    shown = F.array_join(F.slice(once, 1, most), ", ")
    return F.when(F.size(once) > most, F.concat(shown, F.lit(" and "), (F.size(once) - most).cast("string"), F.lit(" more"))).otherwise(shown)


def command_line(args: Column) -> Column:
    """STR15: arguments as a shell would need them; a key's value is never shown."""
    def word(a: Column, i: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.regexp_replace(a, r'(["\\$`])', r"\\$1"), F.lit('"'))
        hidden = (i > 0) & (F.get(args, i - 1) == "--api-key")
        return F.when(hidden, "<redacted>").when(F.startswith(a, F.lit("--api-key=")), "--api-key=<redacted>").when(a.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), a).otherwise(quoted)

    return F.array_join(F.transform(args, word), " ")


def hardware() -> str:
    """UDX15: the driver's processors and system, unless a caller names the cluster."""
    return f"{os.cpu_count()} x {platform.machine()}, {platform.system()}"


def provenance(spark: SparkSession) -> dict[str, str]:
    """UDX15: what a run's results may depend on beside its inputs."""
    return {"python": platform.python_version(), "spark": spark.version, "master": spark.conf.get("spark.master", ""), "partitions": spark.conf.get("spark.sql.shuffle.partitions", "")}
