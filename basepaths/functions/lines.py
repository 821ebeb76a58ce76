"""Stat columns and slash lines shared by the value, exposure and scouting operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basepaths import schema as S


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def is_in(events) -> Column:
    return F.col("event_type").isin(*events)


def ratio(numerator, denominator) -> Column:
    """``numerator / denominator`` with NULL where the denominator is zero."""
    num = F.col(numerator) if isinstance(numerator, str) else numerator
    den = F.col(denominator) if isinstance(denominator, str) else denominator
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def ratio0(numerator, denominator) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def total_bases() -> Column:
    return (
        F.when(F.col("event_type") == "single", 1)
        .when(F.col("event_type") == "double", 2)
        .when(F.col("event_type") == "triple", 3)
        .when(F.col("event_type") == "home_run", 4)
        .otherwise(0)
    )


def woba_denominator() -> Column:
    return flag(~is_in(S.WOBA_DEN_EXCLUSIONS))


def obp_denominator() -> Column:
    return flag(~is_in(S.OBP_DEN_EXCLUSIONS))


def stat_fields() -> dict[str, Column]:
    """Per-plate-appearance numerators and denominators."""
    return {
        "AB_value": flag(~is_in(S.AB_EXCLUSIONS)),
        "H_value": flag(is_in(S.HITS)),
        "TB_value": total_bases(),
        "BB_value": flag(is_in(S.WALKS)),
        "HBP_value": flag(F.col("event_type") == "hit_by_pitch"),
        "SF_value": flag(F.col("event_type") == "sacrifice_fly"),
        "SO_value": flag(is_in(S.STRIKEOUTS)),
        "HR_value": flag(F.col("event_type") == "home_run"),
        "OBP_num_value": flag(is_in(S.OBP_EVENTS)),
        "OBP_den_value": obp_denominator(),
        "wOBA_den_value": woba_denominator(),
    }


LINE_SUMS = (
    "AB", "H", "TB", "BB", "HBP", "SF", "SO", "HR", "OBP_num", "OBP_den", "wOBA_num", "wOBA_den",
)


def game_sums(pas: DataFrame, *keys: str) -> DataFrame:
    """First level of the two-level aggregation: one row per group and game."""
    return pas.groupBy(*keys, "canonical_id").agg(
        F.count("*").alias("PA"),
        F.sum("run_value").alias("run_value"),
        *[F.sum(f"{name}_value").alias(name) for name in LINE_SUMS],
    )


def _half_width(num: str, den: str) -> Column:
    """1.96 standard errors of a ratio with games as clusters.

    The sum of squared influences, sum (n - r d)^2, is expanded into three sums so one pass
    over the per-game rows is enough.
    """
    r = ratio(f"_{num}", f"_{den}")
    squares = F.col(f"_nn_{num}") - 2 * r * F.col(f"_nd_{num}") + r * r * F.col(f"_dd_{num}")
    clusters = F.col("games").cast("double")
    variance = clusters / F.nullif(clusters - 1, F.lit(0.0)) * squares / (F.col(f"_{den}") * F.col(f"_{den}"))
    return F.when(F.col("games") >= 2, 1.96 * F.sqrt(F.greatest(F.lit(0.0), variance)))


def slash_line(per_game: DataFrame, *keys: str, intervals: bool = True) -> DataFrame:
    """Second level: totals, rates and game-clustered intervals per group."""
    pairs = (("wOBA_num", "wOBA_den"), ("run_value", "PA"))
    sums = [F.sum(name).cast("double").alias(f"_{name}") for name in (*LINE_SUMS, "run_value", "PA")]
    squares = [
        expression
        for num, den in pairs
        for expression in (
            F.sum(F.col(num) * F.col(num)).cast("double").alias(f"_nn_{num}"),
            F.sum(F.col(num) * F.col(den)).cast("double").alias(f"_nd_{num}"),
            F.sum(F.col(den) * F.col(den)).cast("double").alias(f"_dd_{num}"),
        )
    ]
    grouped = per_game.groupBy(*keys).agg(F.count("*").alias("games"), *sums, *(squares if intervals else []))
    whole = [F.col(f"_{name}").cast("bigint").alias(name) for name in ("PA", "AB", "H", "BB", "HBP", "SO", "HR")]
    woba, rv = ratio("_wOBA_num", "_wOBA_den"), ratio("_run_value", "_PA")
    columns = [
        *keys, "games", *whole,
        ratio("_H", "_AB").alias("AVG"),
        ratio("_OBP_num", "_OBP_den").alias("OBP"),
        ratio("_TB", "_AB").alias("SLG"),
        (ratio0("_OBP_num", "_OBP_den") + ratio0("_TB", "_AB")).alias("OPS"),
        ratio("_SO", "_PA").alias("K_pct"),
        ratio("_BB", "_PA").alias("BB_pct"),
        ratio("_HR", "_PA").alias("HR_pct"),
        woba.alias("wOBA"),
        rv.alias("RV_per_PA"),
    ]
    if intervals:
        for value, (num, den), label in ((woba, pairs[0], "wOBA"), (rv, pairs[1], "RV_per_PA")):
            columns += [
                (value - _half_width(num, den)).alias(f"{label}_95_low"),
                (value + _half_width(num, den)).alias(f"{label}_95_high"),
            ]
    return grouped.select(*columns)


def banded(column: str, *bands: tuple[Column, str]) -> Column:
    """First matching label of ``bands``; the last band is the rest."""
    *cases, (_, rest) = bands
    chained = reduce(lambda acc, c: acc.when(c[0], c[1]), cases[1:], F.when(cases[0][0], cases[0][1]))
    return chained.otherwise(F.lit(rest)).alias(column)


def capped(value: str, top: int) -> Column:
    """Ordinals as text with everything from ``top`` on collected as ``top+``."""
    return F.when(F.col(value) < top, F.col(value).cast("string")).otherwise(F.lit(f"{top}+"))
