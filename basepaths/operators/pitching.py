"""Pitching totals, fielding-independent pitching, opponent-adjusted runs and player assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basepaths import schema as S
from basepaths.functions.lines import count_if, is_in, ratio0

SEASON = ["season"]
KEYS = ["season", "player_key"]
# --- fixed values: replacement level ---
WINS_PER_GAME = 1000 / 2430
POSITION_SHARE = 0.57
PITCHER_SHARE = 0.43
INNINGS = 7.0


def pitching_totals(box: DataFrame) -> DataFrame:
    """Season pitching lines; the first listed pitcher of a game and team has the start.

    ``box``: season, canonical_id, team, player, player_key, innings_decimal, H, R, ER, BB, SO,
    list_ordinal (place in the source list).
    """
    first = (
        box.groupBy("season", "canonical_id", "team")
        .agg(F.min_by("player_key", F.struct("list_ordinal", "player_key")).alias("player_key"))
        .groupBy(*KEYS)
        .agg(F.count("*").alias("GS"))
    )
    totals = box.groupBy(*KEYS).agg(
        F.min("player").alias("player"),
        F.array_sort(F.collect_set("team")).alias("teams"),
        F.sum(F.bround(F.col("innings_decimal") * 3, 0).cast("bigint")).alias("pitching_outs"),
        F.sum("H").alias("H_allowed"),
        F.sum("R").alias("R_allowed"),
        F.sum("ER").alias("ER"),
        F.sum("BB").alias("BB_allowed"),
        F.sum("SO").alias("SO_pitching"),
        F.count("*").alias("G"),
    )
    return totals.join(first, KEYS, "left").withColumn("GS", F.coalesce("GS", F.lit(0)))


def fip_counts(pas: DataFrame) -> DataFrame:
    return pas.where(F.col("is_plate_appearance") & (F.coalesce("pitcher_key", F.lit("")) != "")).groupBy(
        "season", F.col("pitcher_key").alias("player_key")
    ).agg(
        F.count("*").alias("FIP_BF"),
        count_if(F.col("event_type") == "home_run").alias("FIP_HR"),
        count_if(is_in(S.WALKS)).alias("FIP_BB"),
        count_if(F.col("event_type") == "hit_by_pitch").alias("FIP_HBP"),
        count_if(is_in(S.STRIKEOUTS)).alias("FIP_SO"),
    )


def _component(hr: Column, bb: Column, hbp: Column, so: Column, ip: Column) -> Column:
    return F.lit(INNINGS / 9) * (13 * hr + 3 * (bb + hbp) - 2 * so) / ip


def fip_league(pitching: DataFrame, counts: DataFrame) -> DataFrame:
    """Season constant that makes the innings-weighted FIP equal the league ERA."""
    innings = pitching.groupBy("season").agg(F.sum("IP").alias("league_IP"), F.sum("ER").alias("_er"))
    events = counts.groupBy("season").agg(*[F.sum(f"FIP_{c}").alias(f"league_{c}") for c in ("HR", "BB", "HBP", "SO")])
    league = innings.join(F.broadcast(events), SEASON)
    era = F.col("_er") / F.col("league_IP") * INNINGS
    component = _component(*[F.col(f"league_{c}") for c in ("HR", "BB", "HBP", "SO")], F.col("league_IP"))
    return league.select(
        "season", "league_IP", "league_HR", "league_BB", "league_HBP", "league_SO",
        era.alias("league_era"), component.alias("league_component"), (era - component).alias("constant"),
    )


def add_fip(pitching: DataFrame, pas: DataFrame) -> DataFrame:
    counts = fip_counts(pas)
    league = fip_league(pitching, counts)
    filled = pitching.join(counts, KEYS, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("FIP_BF", "FIP_HR", "FIP_BB", "FIP_HBP", "FIP_SO")}
    )
    own = _component(F.col("FIP_HR"), F.col("FIP_BB"), F.col("FIP_HBP"), F.col("FIP_SO"), F.col("IP"))
    return (
        filled.join(F.broadcast(league.select("season", "constant")), SEASON)
        .withColumn("ERA", F.col("ER") / F.col("IP") * INNINGS)
        .withColumn("FIP", own + F.col("constant"))
        .withColumn("ERA_minus_FIP", F.col("ERA") - F.col("FIP"))
        .drop("constant")
    )


def run_environment(team_runs: DataFrame, box: DataFrame, games: DataFrame) -> DataFrame:
    """Runs per win and replacement pools per season.

    ``team_runs``: season, team, runs; ``games``: season, canonical_id of completed games.
    """
    runs = team_runs.groupBy("season").agg(F.sum("runs").alias("league_runs"))
    innings = box.groupBy("season").agg(F.sum("innings_decimal").alias("league_ip"))
    played = games.groupBy("season").agg(F.count("*").alias("completed_games"))
    league = played.join(F.broadcast(runs), SEASON).join(F.broadcast(innings), SEASON)
    return (
        league.withColumn("league_ra7", F.col("league_runs") / F.col("league_ip") * INNINGS)
        .withColumn("runs_per_win", 1.5 * F.col("league_ra7") + 3)
        .withColumn("position_replacement_wins", F.col("completed_games") * WINS_PER_GAME * POSITION_SHARE)
        .withColumn("pitcher_replacement_wins", F.col("completed_games") * WINS_PER_GAME * PITCHER_SHARE)
    )


def official_team_runs(competitors: DataFrame) -> DataFrame:
    """Runs per season and team from completed games' competitor rows."""
    return competitors.groupBy("season", "team").agg(F.sum(F.coalesce("runs", F.lit(0))).alias("runs"))


def opponent_rates(pas: DataFrame, team_runs: DataFrame, prior_pa: float = 200.0) -> DataFrame:
    """Runs per plate appearance of every batting team, shrunk to the season rate."""
    faced = pas.where("is_plate_appearance").groupBy("season", F.col("batting_team").alias("team")).agg(F.count("*").alias("pa"))
    league = (
        faced.groupBy("season").agg(F.sum("pa").alias("pa"))
        .join(team_runs.groupBy("season").agg(F.sum("runs").alias("runs")), SEASON)
        .select("season", (F.col("runs") / F.col("pa")).alias("league_runs_per_pa"))
    )
    joined = faced.join(team_runs, ["season", "team"], "left").join(F.broadcast(league), SEASON)
    rate = (F.coalesce("runs", F.lit(0)) + prior_pa * F.col("league_runs_per_pa")) / (F.col("pa") + prior_pa)
    return joined.withColumn("rate", rate)


def aggregate_pitching(
    pas: DataFrame, box: DataFrame, team_runs: DataFrame, environment: DataFrame, prior_pa: float = 200.0
) -> DataFrame:
    """Opponent-adjusted runs above average and wins with a per-season balance."""
    rates = opponent_rates(pas, team_runs, prior_pa)
    league_rate = rates.groupBy("season").agg(F.any_value("league_runs_per_pa").alias("league_runs_per_pa"))
    faced = (
        pas.where(F.col("is_plate_appearance") & (F.coalesce("pitcher_key", F.lit("")) != ""))
        .groupBy("season", F.col("pitcher_key").alias("player_key"), F.col("batting_team").alias("team"))
        .agg(F.count("*").alias("n"))
        .join(rates.select("season", "team", "rate"), ["season", "team"])
        .groupBy(*KEYS)
        .agg(F.sum("n").alias("batters_faced_from_play_by_play"), (F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("opponent_rate"))
    )
    totals = pitching_totals(box)
    league = totals.groupBy("season").agg(
        (F.sum("pitching_outs") / 3).alias("_ip"), (F.sum("R_allowed") / (F.sum("pitching_outs") / 3) * INNINGS).alias("_ra7")
    )
    constants = league.join(F.broadcast(league_rate), SEASON).join(
        F.broadcast(environment.select("season", "runs_per_win", "pitcher_replacement_wins")), SEASON
    )
    rows = (
        totals.where(F.col("pitching_outs") > 0)
        .join(F.broadcast(constants), SEASON)
        .join(faced, KEYS, "left")
        .withColumn("IP", F.col("pitching_outs") / 3)
        .withColumn("RA7", F.col("R_allowed") / F.col("IP") * INNINGS)
        .withColumn("batters_faced_from_play_by_play", F.coalesce("batters_faced_from_play_by_play", F.lit(0)))
        .withColumn(
            "opponent_expected_RA7",
            F.col("_ra7") * F.coalesce("opponent_rate", "league_runs_per_pa") / F.col("league_runs_per_pa"),
        )
        .withColumn("opponent_strength_adjustment_runs", (F.col("opponent_expected_RA7") - F.col("_ra7")) / INNINGS * F.col("IP"))
        .withColumn("pitching_runs_above_average_raw", (F.col("opponent_expected_RA7") - F.col("RA7")) / INNINGS * F.col("IP"))
    )
    balance = rows.groupBy("season").agg((-F.sum("pitching_runs_above_average_raw") / F.any_value("_ip")).alias("correction"))
    return (
        rows.join(F.broadcast(balance), SEASON)
        .withColumn("pitching_runs_above_average", F.col("pitching_runs_above_average_raw") + F.col("correction") * F.col("IP"))
        .withColumn("pitching_replacement_runs", F.col("pitcher_replacement_wins") * F.col("runs_per_win") / F.col("_ip") * F.col("IP"))
        .withColumn("pitching_war", (F.col("pitching_runs_above_average") + F.col("pitching_replacement_runs")) / F.col("runs_per_win"))
        .drop("_ip", "_ra7", "league_runs_per_pa", "runs_per_win", "pitcher_replacement_wins", "opponent_rate", "correction")
    )


# --- assembly ----------------------------------------------------------------------------

def _zeros(df: DataFrame, **defaults) -> DataFrame:
    return df.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in defaults.items()})


POSITION_COMPONENTS = {
    "running": dict(
        baserunning_runs=0.0, sb_cs_runs=0.0, non_steal_advancement_runs=0.0, runner_advancement_runs=0.0,
        batter_advancement_runs=0.0, sb_cs_attempts=0, advancement_opportunities=0,
    ),
    "double_plays": dict(
        double_play_avoidance_runs=0.0, double_play_opportunities=0, actual_double_plays=0, expected_double_plays=0.0,
    ),
    "arms": dict(non_pitcher_arm_runs=0.0, non_pitcher_arm_runs_unshrunk=0.0, non_pitcher_arm_opportunities=0),
    "fielding": dict(non_pitcher_range_runs=0.0, non_pitcher_fielding_opportunities=0),
    "catchers": dict(
        catcher_stolen_bases_allowed=0, catcher_caught_stealing=0, catcher_steal_attempts=0, catcher_cs_rate=0.0,
        catcher_throwing_runs=0.0,
    ),
}


def component_union(offense: DataFrame, box_teams: DataFrame, **components: DataFrame) -> DataFrame:
    """Every player of any component; those without a plate appearance get an empty batting line.

    ``components``: running, double_plays, arms, fielding, catchers. ``box_teams``: season,
    player_key, team.
    """
    rows = offense
    for name, defaults in POSITION_COMPONENTS.items():
        part = components[name]
        extra = [F.col("teams").alias(f"_teams_{name}")] if "teams" in part.columns else []
        part = part.select(*KEYS, F.col("player").alias(f"_player_{name}"), *extra, *defaults)
        rows = rows.join(part, KEYS, "full_outer")
    box = box_teams.groupBy(*KEYS).agg(F.collect_set("team").alias("_box"))
    empty = F.array().cast("array<string>")
    # a component's own teams count only for players without a batting line
    listed = [F.coalesce(c, empty) for c in ("_box", "_teams_running", "_teams_arms")]
    batting = {c: 0 for c in offense.columns if offense.schema[c].dataType.typeName() in ("long", "integer") and c not in KEYS}
    batting |= {c: 0.0 for c in offense.columns if offense.schema[c].dataType.typeName() == "double"}
    defaults = {k: v for part in POSITION_COMPONENTS.values() for k, v in part.items()}
    named = [f"_player_{n}" for n in ("running", "arms", "fielding", "double_plays", "catchers")]
    return (
        _zeros(rows.join(box, KEYS, "left"), **batting, **defaults)
        .withColumn("player", F.coalesce("player", *named))
        .withColumn("teams", F.coalesce("teams", F.array_sort(F.array_distinct(F.concat(*listed)))))
        .drop("_box", *named, "_teams_running", "_teams_arms")
    )


def position_players(union: DataFrame, environment: DataFrame) -> DataFrame:
    """Balance the season total to zero, add replacement and split runs into wins."""
    above = sum(
        (F.col(c) for c in (
            "baserunning_runs", "double_play_avoidance_runs", "non_pitcher_range_runs", "non_pitcher_arm_runs", "catcher_throwing_runs",
        )),
        F.col("batting_runs"),
    )
    league = union.groupBy("season").agg((-F.sum(above) / F.sum("PA")).alias("_balance"), F.sum("PA").alias("_pa"))
    per_win = environment.select("season", "runs_per_win", "position_replacement_wins")
    constants = F.broadcast(league.join(F.broadcast(per_win), SEASON))
    c, rpw = F.col, F.col("runs_per_win")
    return (
        union.join(constants, SEASON)
        .withColumns({
            "hitting_runs": c("batting_runs"),
            "wRAA": c("batting_runs"),
            "range_runs": c("non_pitcher_range_runs"),
            "fielding_opportunities": c("non_pitcher_fielding_opportunities"),
            "arm_runs": c("non_pitcher_arm_runs"),
            "arm_runs_unshrunk": c("non_pitcher_arm_runs_unshrunk"),
            "arm_opportunities": c("non_pitcher_arm_opportunities"),
            "throwing_runs": c("non_pitcher_arm_runs") + c("catcher_throwing_runs"),
            "baserunning_component_runs": c("baserunning_runs") + c("double_play_avoidance_runs"),
            "defense_runs": c("non_pitcher_range_runs") + c("non_pitcher_arm_runs") + c("catcher_throwing_runs"),
            "positional_adjustment_runs": F.lit(0.0),
            "league_adjustment_runs": c("_balance") * c("PA"),
            "position_replacement_runs": c("position_replacement_wins") * rpw / c("_pa") * c("PA"),
        })
        .withColumn("_offense", c("hitting_runs") + c("baserunning_component_runs") + c("league_adjustment_runs") + c("position_replacement_runs"))
        .withColumns({
            "batting_war": c("hitting_runs") / rpw,
            "baserunning_war": c("baserunning_component_runs") / rpw,
            "defense_war": c("defense_runs") / rpw,
            "defensive_war": c("defense_runs") / rpw,
            "offensive_war": c("_offense") / rpw,
            "position_war": (c("_offense") + c("defense_runs")) / rpw,
        })
        .drop(
            "_balance", "_pa", "_offense", "runs_per_win", "position_replacement_wins", "non_pitcher_range_runs",
            "non_pitcher_fielding_opportunities", "non_pitcher_arm_runs", "non_pitcher_arm_runs_unshrunk", "non_pitcher_arm_opportunities",
        )
    )


def pitcher_rows(pitching: DataFrame, fielding: DataFrame, arms: DataFrame, environment: DataFrame) -> DataFrame:
    """Move a pitcher's own range and arm runs from results pitching to defense; the total stays."""
    joined = (
        pitching.join(fielding.select(*KEYS, "pitcher_range_runs"), KEYS, "left")
        .join(arms.select(*KEYS, "pitcher_arm_runs"), KEYS, "left")
        .join(F.broadcast(environment.select("season", "runs_per_win")), SEASON)
    )
    return (
        _zeros(joined, pitcher_range_runs=0.0, pitcher_arm_runs=0.0)
        .withColumn("pitcher_defense_runs", F.col("pitcher_range_runs") + F.col("pitcher_arm_runs"))
        .withColumn("pitcher_defense_war", F.col("pitcher_defense_runs") / F.col("runs_per_win"))
        .withColumn("ra7_pitching_runs_above_average", F.col("pitching_runs_above_average"))
        .withColumn("pitching_runs_above_average", F.col("pitching_runs_above_average") - F.col("pitcher_defense_runs"))
        .withColumn("pitcher_war", F.col("pitching_war"))
        .withColumn("pitching_war", F.col("pitcher_war") - F.col("pitcher_defense_war"))
        .drop("runs_per_win")
    )


def quality_flags(pa: Column, ip: Column, has_position: Column, has_pitching: Column) -> Column:
    return F.array_compact(F.array(
        F.when((pa > 0) & (pa < 20), "small_position_player_sample"),
        F.when((ip > 0) & (ip < 5), "small_pitching_sample"),
        F.when(has_position, "no_positional_adjustment"),
        F.when(has_pitching, "no_reliever_leverage_adjustment"),
    ))


COMBINED_POSITION = (
    "batting_runs hitting_runs wRAA batting_war baserunning_runs baserunning_component_runs baserunning_war sb_cs_runs "
    "non_steal_advancement_runs runner_advancement_runs batter_advancement_runs double_play_avoidance_runs range_runs arm_runs "
    "catcher_cs_rate catcher_throwing_runs throwing_runs defense_runs defense_war defensive_war offensive_war "
    "positional_adjustment_runs league_adjustment_runs position_replacement_runs position_war"
).split()
COMBINED_COUNTS = (
    "PA advancement_opportunities double_play_opportunities catcher_stolen_bases_allowed catcher_caught_stealing "
    "catcher_steal_attempts arm_opportunities"
).split()
COMBINED_PITCHING = (
    "IP RA7 ERA FIP ERA_minus_FIP opponent_expected_RA7 pitching_runs_above_average ra7_pitching_runs_above_average pitching_war "
    "pitcher_range_runs pitcher_arm_runs pitcher_defense_runs pitcher_defense_war pitcher_war"
).split()


def combined_players(position: DataFrame, pitchers: DataFrame) -> DataFrame:
    """All players with both roles side by side and the total."""
    left = position.select(
        *KEYS, F.col("player").alias("_p1"), F.col("teams").alias("_t1"), *COMBINED_COUNTS, *COMBINED_POSITION, F.lit(True).alias("_has1")
    )
    right = pitchers.select(
        *KEYS, F.col("player").alias("_p2"), F.col("teams").alias("_t2"), "FIP_BF", *COMBINED_PITCHING, F.lit(True).alias("_has2")
    )
    empty = F.array().cast("array<string>")
    rows = _zeros(
        left.join(right, KEYS, "full_outer"),
        **{c: 0.0 for c in COMBINED_POSITION + COMBINED_PITCHING}, **{c: 0 for c in [*COMBINED_COUNTS, "FIP_BF"]},
    )
    return rows.select(
        *KEYS,
        F.coalesce("_p1", "_p2").alias("player"),
        F.array_sort(F.array_union(F.coalesce("_t1", empty), F.coalesce("_t2", empty))).alias("teams"),
        *COMBINED_COUNTS, *COMBINED_POSITION, "FIP_BF", *COMBINED_PITCHING,
        (F.col("position_war") + F.col("pitcher_war")).alias("total_war"),
        quality_flags(F.col("PA"), F.col("IP"), F.col("_has1").isNotNull(), F.col("_has2").isNotNull()).alias("quality_flags"),
    )


def season_summary(position: DataFrame, pitchers: DataFrame, combined: DataFrame) -> DataFrame:
    """Component totals per season; the centered ones must be zero."""
    adjusted = sum(
        (F.col(c) for c in (
            "baserunning_runs", "double_play_avoidance_runs", "range_runs", "arm_runs", "catcher_throwing_runs", "league_adjustment_runs",
        )),
        F.col("batting_runs"),
    )
    first = position.groupBy("season").agg(
        F.count("*").alias("position_players"),
        F.sum("batting_runs").alias("league_position_batting_runs"),
        F.sum("baserunning_runs").alias("league_baserunning_runs"),
        F.sum("non_steal_advancement_runs").alias("league_non_steal_advancement_runs"),
        F.sum("double_play_avoidance_runs").alias("league_double_play_avoidance_runs"),
        F.sum("range_runs").alias("league_range_runs"),
        F.sum("arm_runs").alias("league_arm_runs"),
        F.sum("catcher_throwing_runs").alias("league_catcher_throwing_runs"),
        F.sum(adjusted).alias("league_adjusted_position_raa"),
        F.sum("position_war").alias("position_war_total"),
    )
    second = pitchers.groupBy("season").agg(
        F.count("*").alias("pitchers"),
        F.sum("pitcher_war").alias("pitching_war_total"),
        F.sum("pitching_war").alias("pitching_component_war_total"),
        F.sum("pitcher_defense_war").alias("pitcher_defense_war_total"),
    )
    third = combined.groupBy("season").agg(F.count("*").alias("combined_players"), F.sum("total_war").alias("total_war"))
    return first.join(F.broadcast(second), SEASON, "left").join(F.broadcast(third), SEASON, "left")


def impact_report(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Change of every player's wins against an earlier result, largest first."""
    old = baseline.select(*KEYS, F.col("position_war").alias("old_position_war"), F.col("total_war").alias("old_total_war"))
    return (
        _zeros(current.join(old, KEYS, "left"), old_position_war=0.0, old_total_war=0.0)
        .withColumn("position_war_change", F.col("position_war") - F.col("old_position_war"))
        .withColumn("total_war_change", F.col("total_war") - F.col("old_total_war"))
    )
