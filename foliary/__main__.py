"""Command line (UDX10, UDX15): 0 for success, 1 for a failed run, 2 for wrong arguments."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary import catalog
from foliary.operators import imports, records, report, runs, scoring
from foliary.sources.formats import read_documents


def _positive(text: str) -> int:
    if not text.isdecimal() or int(text) < 1:
        raise argparse.ArgumentTypeError("must be a positive whole number")
    return int(text)


def _names(text: str) -> list[str]:
    return [x for x in map(str.strip, text.split(",")) if x]


def printed(rows: DataFrame, pretty: bool) -> None:
    """SNK1: rows as JSON, one after another as they come."""
    lines = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()
    if not pretty:
        for (line,) in lines:
            print(line)
        return
    texts = (json.dumps(json.loads(line), ensure_ascii=False, indent=2) for (line,) in lines)
    print("[", end="")
    for k, text in enumerate(texts):
        print(",\n" * (k > 0) + text, end="")
    print("]")


def scored(spark: SparkSession, args: argparse.Namespace) -> None:
    """Counts by entry and field in a folder of their own for a run of a subset; a summary and where it ran are printed."""
    truth = runs.load_truth(spark, args.truth)
    only = spark.createDataFrame([(x,) for x in args.only], "id string") if args.only else None
    chosen = runs.subset(truth, only, args.limit)
    record = lambda c: F.from_json(c, scoring.RECORD).alias("record")
    told = spark.read.parquet(args.predictions).join(chosen.select("id"), "id", "left_semi")
    counts = scoring.score_records(chosen.select(F.col("id").alias("doc_id"), record("record")), told.select(F.col("id").alias("doc_id"), record("prediction")))
    out = runs.result_folder(args.out, True) if args.only or args.limit else f"{args.out.rstrip('/')}/full"
    counts.write.mode("errorifexists").parquet(out)
    statuses = chosen.select("id").join(told.select("id", "prediction"), "id", "left")
    missed = F.when(F.col("prediction").isNull(), F.lit("no prediction"))
    statuses = statuses.select(F.col("id").alias("doc_id"), F.col("prediction").isNotNull().alias("ok"), F.lit(None).cast("string").alias("skipped"), missed.alias("error"))
    print(report.summary(args.name, scoring.overall(spark.read.parquet(out)), statuses))
    print(json.dumps(runs.provenance(spark) | {"hardware": args.hardware}, sort_keys=True))


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    """PRJ13, CLS5: (path, source, cc, format, language, text, error) of a folder's files."""
    files = records.language_scores(read_documents(spark, folder))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", imports.inbox_source(name).alias("s"), "format", imports.manifest_language(F.col("text"), F.col("detected")).alias("language"), "text", "error").select("path", "s.*", "format", "language", "text", "error")


def arguments(argv: Sequence[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="foliary", description="Documents to checked records, on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    read = commands.add_parser("read", help="read a folder's files as (path, format, text, error) into Parquet")
    read.add_argument("folder")
    read.add_argument("out")
    run = commands.add_parser("run", help="write the rows of a query over a folder of tables as Parquet")
    run.add_argument("query", choices=sorted(catalog.queries()), metavar="query")
    run.add_argument("tables")
    run.add_argument("out")
    show = commands.add_parser("show", help="print the rows of a query as JSON, one a line")
    show.add_argument("query", choices=sorted(catalog.queries()), metavar="query")
    show.add_argument("tables")
    show.add_argument("--pretty", action="store_true", help="indented, as one list")
    score = commands.add_parser("score", help="score predictions (id, prediction) against truth files, and write the counts by entry and field")
    score.add_argument("truth", help="folder of JSON files named by id")
    score.add_argument("predictions", help="Parquet of (id, prediction)")
    score.add_argument("out")
    score.add_argument("--name", default="system")
    score.add_argument("--only", type=_names, help="ids, with commas")
    score.add_argument("--limit", type=_positive, help="the first so many by id")
    score.add_argument("--hardware", default=runs.hardware())
    take = commands.add_parser("import", help="write a folder's files as drafts of a manifest's entries")
    take.add_argument("folder")
    take.add_argument("out")
    commands.add_parser("list", help="name the queries")
    return parser.parse_args(argv)


def main(argv: Sequence[str], spark: SparkSession | None = None) -> int:
    try:
        args = arguments(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if args.command == "show":
            printed(catalog.queries()[args.query](spark, args.tables), args.pretty)
        elif args.command == "score":
            scored(spark, args)
        else:
            made = {"read": lambda: read_documents(spark, args.folder), "import": lambda: drafts(spark, args.folder), "run": lambda: catalog.queries()[args.query](spark, args.tables)}
            made[args.command]().write.mode("errorifexists").parquet(args.out)
    except PySparkException as e:
        print(f"foliary: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
