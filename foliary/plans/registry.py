"""How plan modules register queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, *names: str, sql: str | None = None) -> Callable:
        """Register f(*tables) -> DataFrame over the named tables, under f's name."""

        def add(f: Callable) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(*[table(spark, sf_dir, n) for n in names])

            self.queries[f.__name__] = run
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add

    def cases(self, name: str, schema: str, rows: list[tuple], made: Callable, result: str = "result") -> None:
        """A query over fixed (input..., expected) rows whose oracle is the expected values."""
        cols = [c.split(" ")[0] for c in schema.split(", ")]

        def lit(v, kind: str) -> str:
            if v is None:
                return f"NULL::{kind}"
            return f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).lower()

        kinds = ["VARCHAR" if " string" in c else "BOOLEAN" if " boolean" in c else "DOUBLE" if " double" in c else "BIGINT" for c in schema.split(", ")]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], "id long, " + ", ".join(schema.split(", ")[:-1]))
            return df.select("id", made(*[df[c] for c in cols[:-1]]).alias(result))

        values = ", ".join(f"({i}, {lit(r[-1], kinds[-1])})" for i, r in enumerate(rows))
        self.queries[name] = run
        self.oracles[name] = f"SELECT id::BIGINT AS id, r::{kinds[-1]} AS {result} FROM (VALUES {values}) v(id, r)"
