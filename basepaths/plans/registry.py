"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basepaths.plans.inputs import rounded
from basepaths.sources.fixtures import PBP_LAYERS, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, tuple[str, str]] = {}
CTES: dict[str, str] = {}


def _pbp_sql() -> str:
    inner = "events"
    for depth, layer in enumerate(PBP_LAYERS):
        columns = ", ".join(f"{expr} as {name}" for name, expr in layer)
        inner = f"(select {'' if depth == 0 else '*, '}{columns} from {inner})"
    return f"select * from {inner}"


CTES["pbp"] = _pbp_sql()
CTES.update(VIEWS)


def cte(name: str, sql: str) -> None:
    """Register a shared intermediate of the SQL side."""
    CTES[name] = sql


def _needed(sql: str) -> list[str]:
    """Intermediates a text uses, each after those it uses itself."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"\w+", text))
        for name in CTES:
            if name in words and name not in ordered:
                visit(CTES[name])
                ordered.append(name)

    visit(sql)
    return ordered


def compose(sql: str, doubles: str = "") -> str:
    """Prefix the needed intermediates and round the named double columns."""
    parts = [f"{name} as materialized ({CTES[name]})" for name in _needed(sql)]
    prefix = "with " + ",\n".join(parts) + "\n" if parts else ""
    if doubles:
        replaced = ", ".join(f'round("{c}", 6) + 0.0 as "{c}"' for c in doubles.split())
        sql = f"select * replace ({replaced}) from (\n{sql}\n) final_rows"
    return prefix + sql


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; without ``sql`` only its rows are checked."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if sql is not None:
            SQL[name] = (sql, doubles)
        return function

    return register


def oracle_sql() -> dict[str, str]:
    return {name: compose(sql, doubles) for name, (sql, doubles) in SQL.items()}
