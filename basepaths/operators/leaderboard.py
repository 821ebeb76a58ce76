"""Filterable boards over the combined player table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basepaths.functions.lines import ratio

# --- fixed values: columns of every board ---
GROUPS = {
    ("position", "war"): "position_war offensive_war defensive_war PA wOBA wRAA baserunning_component_runs range_runs arm_runs",
    ("position", "hitting"): "PA H HR BB SO wOBA wRAA batting_war position_war",
    ("position", "running"): "PA advancement_opportunities baserunning_component_runs sb_cs_runs double_play_avoidance_runs baserunning_war",
    ("position", "fielding"): (
        "PA range_runs arm_runs defense_runs defense_war catcher_steal_attempts catcher_caught_stealing catcher_cs_rate catcher_throwing_runs"
    ),
    ("pitching", "war"): "IP pitcher_war pitching_war pitcher_defense_war pitching_runs_above_average RA7 ERA FIP ERA_minus_FIP",
    ("pitching", "pitching"): (
        "IP ERA RA7 FIP ERA_minus_FIP opponent_expected_RA7 ra7_pitching_runs_above_average pitching_runs_above_average pitching_war FIP_BF"
    ),
    ("pitching", "defense"): "IP pitcher_range_runs pitcher_arm_runs pitcher_defense_runs pitcher_defense_war pitcher_war",
}


def leaderboard(
    rows: DataFrame, season: int, role: str = "position", group: str = "war", minimum: float = 0, team: str | None = None,
    text: str | None = None, sort: str | None = None, descending: bool = True,
) -> DataFrame:
    """Players of a season over the playing-time threshold, filtered and sorted; ties by name."""
    threshold = "IP" if role == "pitching" else "PA"
    columns = ["player", "teams", *GROUPS[(role, group)].split()]
    sort = sort or ("pitcher_war" if role == "pitching" else "position_war")
    if sort not in columns and sort not in ("pitcher_war", "position_war"):
        raise ValueError(f"no column {sort} to sort by in {columns}")
    kept = rows.where((F.col("season") == season) & (F.col(threshold) > 0) & (F.col(threshold) >= minimum))
    if team:
        kept = kept.where(F.array_contains("teams", team))
    if text:
        haystack = F.lower(F.concat_ws(" ", F.col("player"), F.array_join("teams", " ")))
        kept = kept.where(haystack.contains(text.strip().lower()))
    key = F.array_join("teams", " · ") if sort == "teams" else F.col(sort)
    order = key.desc() if descending else key.asc()
    return kept.orderBy(order, "player", "player_key").select("season", "player_key", *columns)


def page(ordered: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page; a number past the end gives the last page.

    The row count is a one-row action; the page itself is a sort with limit and offset, which
    keeps only the rows up to the page per task.
    """
    pages = max(1, -(-ordered.count() // size))
    start = (min(max(1, number), pages) - 1) * size
    return ordered.orderBy(*order).offset(start).limit(size)


CARDS = {
    # label: (column, direction, playing-time column, least value)
    "Best WAR": ("position_war", "max", "PA", 0),
    "Best Offensive WAR": ("offensive_war", "max", "PA", 0),
    "Best Defensive WAR": ("defensive_war", "max", "PA", 0),
    "Best BsR": ("baserunning_component_runs", "max", "PA", 0),
    "Best wOBA, 20+ PA": ("wOBA", "max", "PA", 20),
    "Best Pitching WAR": ("pitcher_war", "max", "IP", 0),
    "Best Pitching RAA": ("pitching_runs_above_average", "max", "IP", 0),
    "Lowest RA7, 7+ IP": ("RA7", "min", "IP", 7),
    "Lowest FIP, 7+ IP": ("FIP", "min", "IP", 7),
}


def leader_cards(rows: DataFrame) -> DataFrame:
    """Best player of every card and season, all in one aggregation."""
    best = []
    for label, (column, direction, time, least) in CARDS.items():
        allowed = (F.col(time) > 0) & (F.col(time) >= least)
        value = F.col(column).cast("double")
        # equal values: the first key wins in both directions
        order = F.struct(F.when(allowed, value if direction == "min" else -value).alias("o"), F.col("player_key"), value.alias("value"))
        best.append(F.struct(F.lit(label).alias("card"), F.min(F.when(allowed, order)).alias("b")))
    return rows.groupBy("season").agg(F.array(*best).alias("cards")).select("season", F.explode("cards").alias("c")).select(
        "season", "c.card", "c.b.player_key", "c.b.value"
    ).where(F.col("player_key").isNotNull())


def standings(records: DataFrame) -> DataFrame:
    return records.withColumn("pct", ratio("wins", "games")).withColumn("run_difference", F.col("runs") - F.col("runs_allowed"))


def top(rows: DataFrame, value: str, time: str, count: int = 10) -> DataFrame:
    """The ``count`` best by a value among those who played."""
    return rows.where(F.col(time) > 0).orderBy(F.desc(value), "player_key").limit(count)


def directory_search(
    directory: DataFrame, text: str | None = None, team: str | None = None, status: str = "all", first: int | None = None
) -> DataFrame:
    """Players by text over name, team and positions; the quick search keeps the first few."""
    rows = directory
    if text:
        haystack = F.lower(F.concat_ws(" ", F.col("player"), F.col("team"), F.array_join("positions", " ")))
        rows = rows.where(haystack.contains(text.strip().lower()))
    if team:
        rows = rows.where(F.col("team") == team)
    if status != "all":
        rows = rows.where(F.col("current") == (status == "current"))
    return rows.orderBy("player", "player_key").limit(first) if first else rows


def batting_rollup(hitters: DataFrame) -> DataFrame:
    """Team lines and the league line (team NULL) from player lines."""
    bases = F.coalesce("SLG", F.lit(0.0)) * F.col("AB")
    out = hitters.rollup("team").agg(*[F.sum(c).alias(c) for c in ("PA", "AB", "H", "HR", "BB", "SO", "HBP")], F.sum(bases).alias("TB"))
    reached, chances = F.col("H") + F.col("BB") + F.col("HBP"), F.col("AB") + F.col("BB") + F.col("HBP")
    return out.withColumns({
        "BA": ratio("H", "AB"), "OBP": ratio(reached, chances), "SLG": ratio("TB", "AB"), "OPS": ratio(reached, chances) + ratio("TB", "AB"),
        "K_pct": ratio("SO", "PA"), "BB_pct": ratio("BB", "PA"),
    })


def pitching_rollup(pitchers: DataFrame) -> DataFrame:
    earned = F.coalesce("ERA", F.lit(0.0)) * F.col("IP") / 7
    out = pitchers.rollup("team").agg(*[F.sum(c).alias(c) for c in ("App", "IP", "H", "BB", "SO", "Pitches", "Strikes")], F.sum(earned).alias("ER"))
    return out.withColumns({
        "ERA": ratio(F.col("ER") * 7, "IP"), "WHIP": ratio(F.col("H") + F.col("BB"), "IP"), "SO7": ratio(F.col("SO") * 7, "IP"),
        "BB7": ratio(F.col("BB") * 7, "IP"), "S_pct": ratio("Strikes", "Pitches"),
    })


def pitching_table(pitchers: DataFrame) -> DataFrame:
    """The pitching page of a report: a row per pitcher with rates per seven innings."""
    return pitchers.select(
        "player_key", "team", F.col("G").alias("App"), "IP", "ERA", "FIP", ratio(F.col("H_allowed") + F.col("BB_allowed"), "IP").alias("WHIP"),
        ratio(F.col("SO_pitching") * 7, "IP").alias("SO7"), ratio(F.col("BB_allowed") * 7, "IP").alias("BB7"), ratio("Strikes", "Pitches").alias("S_pct"), "pitcher_war",
    )


def hitting_table(hitters: DataFrame) -> DataFrame:
    """The hitting page of a report: a row per hitter with rates and values."""
    return hitters.select(
        "player_key", "team", "PA", "AB", "H", "HR", (F.col("2B") + F.col("3B") + F.col("HR")).alias("XBH"), "BA", "OBP", "SLG", "OPS", ratio("SO", "PA").alias("K_pct"),
        ratio("BB", "PA").alias("BB_pct"), "wOBA", "wRAA", "offensive_war", "baserunning_runs",
    )


def recent_games(context: DataFrame, team: str, count: int = 6) -> DataFrame:
    """A team's newest distinct games."""
    games = context.where(F.col("team") == team).select("canonical_id", "date", "opponent", "result").dropDuplicates(["canonical_id"])
    return games.orderBy(F.desc("date"), F.desc("canonical_id")).limit(count)


def sorted_by(rows: DataFrame, column: str, descending: bool = False, *ties: str) -> DataFrame:
    """Numbers by value where a text is a number, other texts alphabetically behind them."""
    number = F.col(column).try_cast("double")
    text = F.when(number.isNull(), F.col(column))
    order = [number.desc_nulls_last(), text.desc_nulls_first()] if descending else [number.asc_nulls_last(), text.asc_nulls_first()]
    return rows.orderBy(*order, *ties)


def matchup_search(matchups: DataFrame, text: str) -> DataFrame:
    return matchups.where(F.lower("pitcher_key").contains(text.strip().lower()))
