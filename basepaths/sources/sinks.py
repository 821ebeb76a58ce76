"""Writers for JSON documents, flat CSV files and nested site payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in key order with columns by name; the commit protocol makes it all or nothing."""
    df.select(*sorted(df.columns)).orderBy(*order).write.option("ignoreNullFields", "false").json(path)


def flatten_for_csv(df: DataFrame, style: str = "joined") -> DataFrame:
    """Nested columns as text: lists joined by a bar (``joined``) or everything as JSON (``json``)."""
    columns = []
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind not in ("array", "map", "struct"):
            columns.append(F.col(f"`{field.name}`"))
        elif kind == "array" and style == "joined" and field.dataType.elementType.typeName() == "string":
            columns.append(F.array_join(field.name, "|").alias(field.name))
        else:
            columns.append(F.to_json(field.name).alias(field.name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, style: str = "joined") -> None:
    flatten_for_csv(df, style).write.option("header", "true").csv(path)


def period_documents(teams: DataFrame, players: DataFrame) -> DataFrame:
    """One nested document per period and team: the team row with its players in order.

    A document holds one team's roster, the size of a page; periods are not gathered whole.
    """
    roster = players.groupBy("period", "team").agg(
        F.array_sort(F.collect_list(F.struct("player_key", *[c for c in players.columns if c not in ("period", "team", "player_key")]))).alias("players")
    )
    return teams.join(roster, ["period", "team"], "left")
