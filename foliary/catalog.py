"""Registry of the queries over the driver's tables and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules in foliary.plans, each with QUERIES (name -> callable) and ORACLES (name -> DuckDB SQL).
MODULES: tuple[str, ...] = ("pages", "adapters", "made", "synthetic", "runs", "texts", "dates", "scores", "markup", "records", "phrases", "people")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        out |= import_module(f"foliary.plans.{m}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"foliary.plans.{m}").ORACLES
    return out
