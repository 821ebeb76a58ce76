"""Batting, baserunning, fielding and catching value of players.

Everything is keyed by season so all seasons are valued in one job. League means come from
small grouped tables (closed vocabularies x season) that are broadcast; per-player tables are
joined without hints so their size decides the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basepaths import schema as S
from basepaths.functions import text as X
from basepaths.functions.identity import apply_aliases, person_key
from basepaths.functions.lines import count_if, flag, is_in, obp_denominator, ratio0, woba_denominator
from basepaths.functions.pooling import shrink
from basepaths.operators.expectancy import re_map, re_value
from basepaths.session import cut_lineage

SEASON = ["season"]


# --- offense -----------------------------------------------------------------------------

def raw_weights(valued: DataFrame) -> DataFrame:
    """One row: mean run value of an out and each event's mean above it (all seasons)."""
    per_type = (
        valued.where("is_plate_appearance").groupBy("event_type")
        .agg(F.sum("run_value").alias("total"), F.count("*").alias("n"))
    )
    out = is_in(S.OUT_EVENTS)
    means = F.collect_list(
        F.when(is_in(S.WOBA_EVENTS), F.struct(F.col("event_type"), (F.col("total") / F.col("n")).alias("mean")))
    )
    row = per_type.agg(
        (F.sum(F.when(out, F.col("total"))) / F.sum(F.when(out, F.col("n")))).alias("out_run_value"),
        F.map_from_entries(means).alias("means"),
    )
    above = F.transform_values("means", lambda _, mean: mean - F.col("out_run_value"))
    return row.select("out_run_value", above.alias("raw_weights"))


def weight_of(weights: str = "raw_weights") -> Column:
    return F.coalesce(F.try_element_at(F.col(weights), F.col("event_type")), F.lit(0.0))


def woba_constants(valued: DataFrame, target: DataFrame | None = None, keys=("season",)) -> DataFrame:
    """Scale, league rate and weights; weights from all of ``valued``, the rest per ``keys`` of ``target``."""
    target = valued if target is None else target
    raw = raw_weights(valued).select(F.struct("*").alias("w")).scalar()
    per_type = target.where("is_plate_appearance").groupBy(*keys, "event_type").agg(F.count("*").alias("n"))
    league = (
        per_type.withColumn("w", raw)
        .withColumn("raw_weights", F.col("w.raw_weights"))
        .groupBy(*keys)
        .agg(
            F.any_value("w").alias("w"),
            F.sum(woba_denominator() * F.col("n")).alias("calibration_pa"),
            F.sum(flag(is_in(S.OBP_EVENTS)) * F.col("n")).alias("reached"),
            F.sum(weight_of() * F.col("n")).alias("unscaled"),
        )
    )
    rate = F.col("reached") / F.col("calibration_pa")
    scale = rate / (F.col("unscaled") / F.col("calibration_pa"))
    return league.select(
        *keys,
        F.col("w.out_run_value").alias("out_run_value"),
        F.col("w.raw_weights").alias("raw_weights"),
        scale.alias("woba_scale"),
        rate.alias("league_woba"),
        rate.alias("league_obp"),
        "calibration_pa",
    )


def offense_counts() -> dict[str, Column]:
    return {
        "PA": F.lit(True),
        "H": is_in(S.HITS),
        "1B": F.col("event_type") == "single",
        "2B": F.col("event_type") == "double",
        "3B": F.col("event_type") == "triple",
        "HR": F.col("event_type") == "home_run",
        "BB": is_in(S.WALKS),
        "IBB": F.col("event_type") == "intentional_walk",
        "HBP": F.col("event_type") == "hit_by_pitch",
        "SO": is_in(S.STRIKEOUTS),
        "ROE": F.col("event_type") == "reached_on_error",
        "SF": F.col("event_type") == "sacrifice_fly",
        "SH": F.col("event_type") == "sacrifice_bunt",
        "reach_opportunities": is_in(S.ON_BASE_EVENTS),
        "obp_numerator": is_in(S.OBP_EVENTS),
    }


def _offense_rates(totals: DataFrame, constants: DataFrame) -> DataFrame:
    scale, denominator = F.col("woba_scale"), F.col("woba_denom")
    return (
        totals.join(F.broadcast(constants.select("season", "woba_scale", "league_woba")), SEASON)
        .withColumn("wOBA", ratio0("woba_raw_numerator", "woba_denom") * scale)
        .withColumn("OBP", ratio0("obp_numerator", "woba_denom"))
        .withColumn("batting_runs", (F.col("wOBA") - F.col("league_woba")) / scale * denominator)
        .drop("woba_scale", "league_woba")
    )


def offense_by_team(pas: DataFrame, constants: DataFrame) -> DataFrame:
    """Season line of every player and team."""
    return _offense_rates(_offense_totals(pas, constants), constants)


def _offense_totals(pas: DataFrame, constants: DataFrame) -> DataFrame:
    weights = constants.select("season", "raw_weights")
    rows = pas.where(F.col("is_plate_appearance") & (F.coalesce("batter", F.lit("")) != ""))
    return (
        rows.join(F.broadcast(weights), SEASON)
        .groupBy("season", F.col("batter_key").alias("player_key"), F.col("batting_team").alias("team"))
        .agg(
            F.min("batter").alias("player"),
            *[count_if(test).alias(name) for name, test in offense_counts().items()],
            F.sum(woba_denominator()).alias("woba_denom"),
            F.sum(weight_of()).alias("woba_raw_numerator"),
        )
    )


def aggregate_offense(pas: DataFrame, constants: DataFrame) -> DataFrame:
    """Season line of every player with the list of teams; rolls up the per-team line."""
    sums = [*offense_counts(), "woba_denom", "woba_raw_numerator"]
    totals = _offense_totals(pas, constants).groupBy("season", "player_key").agg(
        F.min("player").alias("player"),
        F.array_sort(F.collect_set("team")).alias("teams"),
        *[F.sum(name).alias(name) for name in sums],
    )
    return _offense_rates(totals, constants)


# --- stolen bases ------------------------------------------------------------------------

def steal_rows(valued: DataFrame) -> DataFrame:
    """Runner of every exactly labelled steal attempt: first advance or out action."""
    moved = F.get(F.filter("runner_actions", lambda a: a["action"].isin("advance", "out")), F.lit(0))
    return (
        valued.where(is_in(("stolen_base", "caught_stealing")))
        .select("season", "run_value", moved["runner"].alias("player"))
        .where(F.col("player").isNotNull())
        .withColumn("player_key", person_key(F.col("player")))
    )


def baserunning_runs(valued: DataFrame, offense: DataFrame) -> DataFrame:
    """Steal value above the league rate per opportunity."""
    steals = steal_rows(valued).groupBy("season", "player_key").agg(
        F.min("player").alias("runner"),
        F.count("*").alias("attempts"),
        F.sum("run_value").alias("raw"),
    )
    batters = offense.select("season", "player_key", "player", "reach_opportunities")
    rows = batters.join(steals, ["season", "player_key"], "full_outer").select(
        "season", "player_key",
        F.coalesce("player", "runner").alias("player"),
        F.coalesce("attempts", F.lit(0)).alias("sb_cs_attempts"),
        F.greatest(F.coalesce("reach_opportunities", F.lit(0)), F.coalesce("attempts", F.lit(0))).alias("baserunning_opportunities"),
        F.coalesce("raw", F.lit(0.0)).alias("sb_cs_raw_runs"),
    )
    league = rows.groupBy("season").agg(ratio0(F.sum("sb_cs_raw_runs"), F.sum("baserunning_opportunities")).alias("rate"))
    return (
        rows.join(F.broadcast(league), SEASON)
        .withColumn("baserunning_runs", F.col("sb_cs_raw_runs") - F.col("baserunning_opportunities") * F.col("rate"))
        .drop("rate")
    )


# --- advancement -------------------------------------------------------------------------

_NO_RUNNER = "incumbent runner absent after play without explicit action"
_NO_BATTER = "batter absent after advancement-eligible play without explicit action"
_NO_BASE = "eligible action has no valid destination"


def with_roster(events: DataFrame, rosters: DataFrame) -> DataFrame:
    """Attach each game's list of known players (a few dozen names per game)."""
    return events.join(rosters.select("canonical_id", "names"), "canonical_id", "left")


def game_rosters(*named: DataFrame) -> DataFrame:
    """Known players per game from (canonical_id, name) tables; one short list per game."""
    rows = named[0]
    for other in named[1:]:
        rows = rows.unionByName(other)
    return rows.distinct().groupBy("canonical_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def with_listed_names(events: DataFrame, rosters: DataFrame) -> DataFrame:
    """Attach each game's names as ``parse_listed`` compares them."""
    return with_roster(events, rosters.select("canonical_id", X.listed_names(F.col("names")).alias("names")))


def parse_plays(events: DataFrame, rosters: DataFrame) -> DataFrame:
    """Typed columns of the play text for events of the games in ``rosters``."""
    return parse_listed(with_listed_names(events, rosters))


def parse_listed(events: DataFrame) -> DataFrame:
    """Typed columns of the play text, computed once and stored with the events, which carry their game's listed names.

    Adds batted_type, first_position, position_mentions, spray, contact, fielder (known player
    named after the first position) and the person keys of runners, so later jobs compare plain columns.
    """
    text = F.coalesce("play_text", F.lit(""))
    keyed = events.withColumns({
        "batted_type": X.trajectory(text),
        "first_position": X.first_position(text),
        "position_mentions": X.position_mentions(text),
        "spray": X.spray_location(text),
        "contact": X.contact_type(text),
        "_tail": X.after_first_position(text),
        "action_keys": F.transform("runner_actions", lambda a: person_key(a["runner"])),
        "after_keys": F.transform_values("runners_after", lambda _, runner: person_key(runner)),
    })
    return keyed.withColumn("fielder", X.nearest_listed(F.col("_tail"), F.col("names"))).drop("_tail", "names")


def advancement_candidates(parsed: DataFrame, re24: DataFrame) -> DataFrame:
    """One row per non-forced runner or batter of an advancement-eligible play.

    ``reason`` is NULL for an opportunity and says why otherwise (unresolved rows). The
    explicit action and the base held afterwards are looked up inside the exploded array.
    """
    eligible = F.col("is_plate_appearance") & is_in(S.RUNNER_ADVANCE_EVENTS + S.BATTER_ADVANCE_EVENTS)
    attributed = (F.col("position_mentions") == 1) & F.col("fielder").isNotNull()
    none = F.array().cast("array<struct<role:string,player:string,start_base:int>>")
    runners = F.when(
        is_in(S.RUNNER_ADVANCE_EVENTS),
        F.transform(F.map_entries("runners_before"), lambda e: F.struct(
            F.lit("runner").alias("role"), e["value"].alias("player"), e["key"].alias("start_base"))),
    ).otherwise(none)
    batter = F.when(
        is_in(S.BATTER_ADVANCE_EVENTS) & F.col("batter").isNotNull(),
        F.array(F.struct(F.lit("batter").alias("role"), F.col("batter").alias("player"), F.lit(0).alias("start_base"))),
    ).otherwise(none)

    def keyed(person):
        return F.struct(
            person["role"].alias("role"), person["player"].alias("player"), person_key(person["player"]).alias("player_key"),
            person["start_base"].alias("start_base"),
        )

    def looked_up(person):
        key = person["player_key"]
        told = F.get(F.col("runner_actions"), F.array_position("action_keys", key).cast("int") - 1)
        held = F.get(F.map_keys(F.map_filter("after_keys", lambda _, k: k == key)), F.lit(0))
        return F.struct(
            person["role"].alias("role"), person["player"].alias("player"), key.alias("player_key"),
            person["start_base"].alias("start_base"), told.alias("told"), held.alias("held"),
        )

    # a person's key is made once, before it is compared with each action and each base
    people = F.transform(F.transform(F.filter(F.concat(runners, batter), lambda p: p["player"] != S.PLACED_RUNNER), keyed), looked_up)
    rows = (
        parsed.where(eligible)
        .select(
            "season", "canonical_id", "event_order", "event_type", "outs_before", "outs_after", "bases_after", "batting_team", "fielding_team",
            "play_text", F.coalesce("batted_type", F.lit("unknown")).alias("batted_type"),
            F.when(attributed, F.col("first_position")).otherwise("unattributed").alias("fielding_position"),
            F.when(attributed, F.col("fielder")).alias("fielder"), F.explode(people).alias("who"),
        )
        .select("*", "who.*").drop("who")
    )
    is_runner, explicit = F.col("role") == "runner", F.col("told").isNotNull()
    action = (
        F.when(explicit, F.col("told.action"))
        .when(is_runner & (F.col("held") == F.col("start_base")), "remain")
        .when(F.col("held").isNotNull(), "advance")
    )
    moved = (
        rows.where(~(is_runner & explicit & F.col("told.action").isin("forced", "state_correction")))
        .withColumns({"action": action, "destination": F.when(explicit, F.col("told.to_base")).otherwise(F.col("held"))})
    )
    scored, out = F.col("action") == "score", F.col("action") == "out"
    other_outs = F.greatest(F.col("outs_before"), F.col("outs_after") - flag(out))
    held_bit = F.coalesce(F.pow(F.lit(2), F.col("held") - 1).cast("int"), F.lit(0))
    without = F.col("bases_after").bitwiseAND(F.bitwise_not(held_bit))
    legal = F.col("destination").isin(1, 2, 3)
    to_bit = F.when(~scored & ~out & legal, F.pow(F.lit(2), F.col("destination") - 1).cast("int")).otherwise(0)
    value = flag(scored) + re_value(F.col("_re"), other_outs + flag(out), without.bitwiseOR(to_bit))
    reason = (
        F.when(F.col("action").isNull(), F.when(is_runner, _NO_RUNNER).otherwise(_NO_BATTER))
        .when(~scored & ~out & ~F.coalesce(legal, F.lit(False)), _NO_BASE)
    )
    return moved.withColumn("_re", re_map(re24)).select(
        "season", "canonical_id", "event_order", "player", "player_key", "role", "start_base", "action", "destination", "event_type",
        "outs_before", "batted_type", "fielding_position", "fielder", "batting_team", "fielding_team",
        F.when(reason.isNull(), value).alias("utility"), reason.alias("reason"), "play_text",
    )


ADVANCE_BROAD = ["season", "role", "start_base", "outs_before", "event_type"]
ADVANCE_DETAIL = ["batted_type", "fielding_position"]


def pooled_expectation(
    cells: DataFrame, broad: list[str], detail: list[str], k: float, value: str = "total", n: str = "n"
) -> DataFrame:
    """Expected value per detailed cell, pooled toward its broad cell.

    ``cells`` holds one row per (broad, detail) with a sum and a count. The keys come from
    closed vocabularies x season, so the result is small whatever the number of events.
    """
    coarse = cells.groupBy(*broad).agg((F.sum(value) / F.sum(n)).alias("_mean"))
    pooled = (F.col(value) + float(k) * F.col("_mean")) / (F.col(n) + F.lit(float(k)))
    return cells.join(F.broadcast(coarse), broad).withColumn("expected", pooled).drop("_mean")


def advancement_opportunities(candidates: DataFrame, k: float = 10.0) -> DataFrame:
    """Opportunities with pooled expectation and season-centered value.

    The center follows from the pooled cells alone, so the events are read only twice: once
    for the cell sums, which are written, and once to attach the expectation.
    """
    valid = candidates.where(F.col("reason").isNull()).drop("reason", "play_text")
    cells = cut_lineage(valid.groupBy(*ADVANCE_BROAD, *ADVANCE_DETAIL).agg(F.sum("utility").alias("total"), F.count("*").alias("n")))
    pooled = pooled_expectation(cells, ADVANCE_BROAD, ADVANCE_DETAIL, k)
    center = pooled.groupBy("season").agg((F.sum(F.col("total") - F.col("n") * F.col("expected")) / F.sum("n")).alias("center"))
    expectation = pooled.join(F.broadcast(center), SEASON).select(
        *ADVANCE_BROAD, *ADVANCE_DETAIL, F.col("expected").alias("expected_utility"), "center"
    )
    return (
        valid.join(F.broadcast(expectation), ADVANCE_BROAD + ADVANCE_DETAIL)
        .withColumn("raw_value", F.col("utility") - F.col("expected_utility"))
        .withColumn("advancement_runs", F.col("raw_value") - F.col("center"))
        .drop("center")
    )


def expanded_baserunning(opportunities: DataFrame, steals: DataFrame, offense: DataFrame) -> DataFrame:
    """Steals plus advancement per player, with opportunities and runs by role."""
    batter = F.col("role") == "batter"
    advance = opportunities.groupBy("season", "player_key").agg(
        F.min("player").alias("runner"),
        F.count("*").alias("advancement_opportunities"),
        count_if(~batter).alias("runner_advancement_opportunities"),
        count_if(batter).alias("batter_advancement_opportunities"),
        F.sum("advancement_runs").alias("non_steal_advancement_runs"),
        F.sum(F.when(batter, F.col("advancement_runs")).otherwise(0.0)).alias("batter_advancement_runs"),
        F.array_sort(F.collect_set("batting_team")).alias("teams"),
    )
    stolen = steals.select(
        "season", "player_key", F.col("player").alias("stealer"), "sb_cs_attempts", F.col("baserunning_runs").alias("sb_cs_runs")
    )
    names = offense.select("season", "player_key", "player")
    keys = ["season", "player_key"]
    rows = names.join(stolen, keys, "full_outer").join(advance, keys, "full_outer")

    def zero(name, value=0):
        return F.coalesce(name, F.lit(value)).alias(name)

    return rows.select(
        *keys,
        F.coalesce("player", "stealer", "runner").alias("player"),
        zero("sb_cs_attempts"),
        zero("sb_cs_runs", 0.0),
        zero("advancement_opportunities"),
        zero("runner_advancement_opportunities"),
        zero("batter_advancement_opportunities"),
        zero("non_steal_advancement_runs", 0.0),
        zero("batter_advancement_runs", 0.0),
        (F.coalesce("non_steal_advancement_runs", F.lit(0.0)) - F.coalesce("batter_advancement_runs", F.lit(0.0))).alias("runner_advancement_runs"),
        (F.coalesce("sb_cs_runs", F.lit(0.0)) + F.coalesce("non_steal_advancement_runs", F.lit(0.0))).alias("baserunning_runs"),
        F.coalesce("teams", F.array().cast("array<string>")).alias("teams"),
    )


def advancement_audit(candidates: DataFrame, opportunities: DataFrame, k: float = 10.0) -> DataFrame:
    found = candidates.groupBy("season").agg(
        count_if(F.col("reason").isNull()).alias("advancement_opportunities"),
        count_if(F.col("reason").isNull() & (F.col("role") == "runner")).alias("runner_opportunities"),
        count_if(F.col("reason").isNull() & (F.col("role") == "batter")).alias("batter_opportunities"),
        count_if(F.col("reason").isNotNull()).alias("unresolved_candidate_transitions"),
    )
    value = opportunities.groupBy("season").agg(F.sum("advancement_runs").alias("league_non_steal_advancement_runs"))
    return found.join(value, SEASON, "left").withColumn("prior_opportunities", F.lit(float(k)))


# --- double plays ------------------------------------------------------------------------

def double_play_cells(valued: DataFrame) -> DataFrame:
    """Double-play chances summed by player, outs and first fielding position."""
    chance = (
        F.col("is_plate_appearance") & (F.col("outs_before") < 2) & (F.col("bases_before").bitwiseAND(1) == 1)
        & F.col("batter").isNotNull() & (F.col("batted_type") == "ground")
    )
    turned = F.col("event_type") == "double_play"
    return (
        valued.where(chance)
        .groupBy(
            "season", person_key(F.col("batter")).alias("player_key"), F.col("outs_before").alias("outs"),
            F.coalesce("first_position", F.lit("unknown")).alias("position"),
        )
        .agg(
            F.min("batter").alias("player"),
            F.count("*").alias("n"),
            count_if(turned).alias("total"),
            F.sum(F.when(turned, F.col("run_value"))).alias("dp_value"),
            F.sum(F.when(~turned, F.col("run_value"))).alias("other_value"),
        )
    )


def _double_play_league(cells: DataFrame, k: float) -> tuple[DataFrame, DataFrame]:
    """Expected rate per (season, outs, position), and cost and center per season."""
    keys = ["season", "outs", "position"]
    totals = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "total", "dp_value", "other_value")])
    expected = pooled_expectation(totals, ["season", "outs"], ["position"], k)
    turned, missed = F.sum("total"), F.sum(F.col("n") - F.col("total"))
    difference = F.sum("other_value") / F.nullif(missed, F.lit(0)) - F.sum("dp_value") / F.nullif(turned, F.lit(0))
    league = expected.groupBy("season").agg(
        F.greatest(F.lit(0.25), F.coalesce(difference, F.lit(0.5))).alias("dp_cost"),
        (F.sum(F.col("n") * F.col("expected") - F.col("total")) / F.sum("n")).alias("mean_excess"),
    )
    return expected.select(*keys, "expected"), league


def double_play_avoidance(valued: DataFrame, k: float = 20.0) -> DataFrame:
    cells = double_play_cells(valued)
    expected, league = _double_play_league(cells, k)
    excess = F.col("n") * F.col("expected") - F.col("total")
    rows = cells.join(F.broadcast(expected), ["season", "outs", "position"]).join(F.broadcast(league), SEASON)
    return rows.groupBy("season", "player_key").agg(
        F.min("player").alias("player"),
        F.sum("n").alias("double_play_opportunities"),
        F.sum("total").alias("actual_double_plays"),
        F.sum(F.col("n") * F.col("expected")).alias("expected_double_plays"),
        F.sum((excess - F.col("n") * F.col("mean_excess")) * F.col("dp_cost")).alias("double_play_avoidance_runs"),
    )


def double_play_audit(valued: DataFrame, k: float = 20.0) -> DataFrame:
    cells = double_play_cells(valued)
    _, league = _double_play_league(cells, k)
    counts = cells.groupBy("season").agg(F.sum("n").alias("opportunities"), F.sum("total").alias("actual_double_plays"))
    return counts.join(F.broadcast(league), SEASON).select(
        "season", "opportunities", "actual_double_plays", F.col("dp_cost").alias("estimated_double_play_run_cost")
    )


# --- arms and range ----------------------------------------------------------------------

def arm_runs(opportunities: DataFrame, k: float = 40.0) -> DataFrame:
    """Attributed advancement with the sign turned, centered, split by role and shrunk."""
    from_mound = F.col("fielding_position") == "pitcher"
    runs = F.col("advancement_runs")
    sums = (
        opportunities.where(F.col("fielder").isNotNull())
        .groupBy("season", person_key(F.col("fielder")).alias("player_key"))
        .agg(
            F.min("fielder").alias("player"),
            F.array_sort(F.collect_set("fielding_team")).alias("teams"),
            F.count("*").alias("arm_opportunities"),
            count_if(from_mound).alias("pitcher_arm_opportunities"),
            F.sum(runs).alias("attributed_runner_runs"),
            F.sum(F.when(from_mound, runs).otherwise(0.0)).alias("_mound"),
        )
    )
    league = sums.groupBy("season").agg((-F.sum("attributed_runner_runs") / F.sum("arm_opportunities")).alias("center"))
    n, mound = F.col("arm_opportunities"), F.col("pitcher_arm_opportunities")
    whole = -F.col("attributed_runner_runs") - n * F.col("center")
    pitched = -F.col("_mound") - mound * F.col("center")
    return (
        sums.join(F.broadcast(league), SEASON)
        .withColumns({
            "non_pitcher_arm_opportunities": n - mound,
            "arm_runs_opposing_raw": -F.col("attributed_runner_runs"),
            "arm_runs_unshrunk": whole,
            "pitcher_arm_runs_unshrunk": pitched,
            "non_pitcher_arm_runs_unshrunk": whole - pitched,
        })
        .withColumns({
            name: F.col(f"{name}_unshrunk") * shrink(n, k)
            for name in ("arm_runs", "pitcher_arm_runs", "non_pitcher_arm_runs")
        })
        .drop("_mound", "center")
    )


def arm_audit(opportunities: DataFrame, arms: DataFrame) -> DataFrame:
    total = opportunities.groupBy("season").agg(
        F.count("*").alias("advancement_opportunities"),
        count_if(F.col("fielder").isNotNull()).alias("attributable_arm_opportunities"),
    )
    balance = arms.groupBy("season").agg(
        F.sum(F.col("arm_runs_opposing_raw") + F.col("attributed_runner_runs")).alias("raw_arm_plus_runner_balance"),
        F.sum("arm_runs_unshrunk").alias("league_arm_runs_unshrunk_centered"),
        F.sum("arm_runs").alias("league_arm_runs"),
    )
    return total.join(F.broadcast(balance), SEASON, "left").withColumn(
        "attribution_coverage", ratio0("attributable_arm_opportunities", "advancement_opportunities")
    )


def range_runs(parsed: DataFrame, constants: DataFrame, k: float = 20.0) -> DataFrame:
    """Batted balls converted above the league rate of (position, trajectory), valued at a single."""
    cells = (
        parsed.where(is_in(S.CONVERTIBLE_EVENTS) & F.col("batted_type").isNotNull() & F.col("fielder").isNotNull())
        .groupBy("season", "fielder", F.col("first_position").alias("position"), "batted_type")
        .agg(F.count("*").alias("n"), count_if(is_in(S.CONVERTED_EVENTS)).alias("made"))
        .withColumn("player_key", person_key(F.col("fielder")))
        .withColumnRenamed("fielder", "player")
    )
    rates = cells.groupBy("season", "position", "batted_type").agg((F.sum("made") / F.sum("n")).alias("rate"))
    worth = constants.select("season", F.col("raw_weights")["single"].alias("worth"))
    value = (F.col("made") - F.col("n") * F.col("rate")) * F.col("worth")
    from_mound = F.col("position") == "pitcher"
    sums = (
        cells.join(F.broadcast(rates), ["season", "position", "batted_type"])
        .join(F.broadcast(worth), SEASON)
        .groupBy("season", "player_key")
        .agg(
            F.min("player").alias("player"),
            F.array_sort(F.collect_set("position")).alias("positions"),
            F.sum("n").alias("fielding_opportunities"),
            F.sum(F.when(from_mound, F.col("n")).otherwise(0)).alias("pitcher_fielding_opportunities"),
            F.sum(value).alias("fielding_runs_unshrunk"),
            F.sum(F.when(from_mound, value).otherwise(0.0)).alias("pitcher_fielding_runs_unshrunk"),
        )
    )
    weight = shrink(F.col("fielding_opportunities"), k)
    return (
        sums.withColumns({
            "non_pitcher_fielding_opportunities": F.col("fielding_opportunities") - F.col("pitcher_fielding_opportunities"),
            "non_pitcher_fielding_runs_unshrunk": F.col("fielding_runs_unshrunk") - F.col("pitcher_fielding_runs_unshrunk"),
        })
        .withColumns({
            "range_runs": F.col("fielding_runs_unshrunk") * weight,
            "pitcher_range_runs": F.col("pitcher_fielding_runs_unshrunk") * weight,
            "non_pitcher_range_runs": F.col("non_pitcher_fielding_runs_unshrunk") * weight,
        })
    )


# --- catchers ----------------------------------------------------------------------------

def catcher_throwing(catching: DataFrame, valued: DataFrame, k: float = 20.0) -> DataFrame:
    """Caught stealing above the season rate, shrunk and centered again per attempt.

    ``catching``: season, player_key, player, sb, cs (one or more rows per catcher).
    """
    values = valued.where(is_in(("stolen_base", "caught_stealing"))).agg(
        F.coalesce(F.avg(F.when(F.col("event_type") == "stolen_base", F.col("run_value"))), F.lit(0.20)).alias("sb"),
        F.coalesce(F.avg(F.when(F.col("event_type") == "caught_stealing", F.col("run_value"))), F.lit(-0.45)).alias("cs"),
    )
    spread = values.select(F.col("sb") - F.col("cs")).scalar()
    rows = catching.groupBy("season", "player_key").agg(
        F.min("player").alias("player"),
        F.sum("sb").alias("catcher_stolen_bases_allowed"),
        F.sum("cs").alias("catcher_caught_stealing"),
    ).withColumn("catcher_steal_attempts", F.col("catcher_stolen_bases_allowed") + F.col("catcher_caught_stealing"))
    n, caught = F.col("catcher_steal_attempts"), F.col("catcher_caught_stealing")
    league = rows.groupBy("season").agg(ratio0(F.sum(caught), F.sum(n)).alias("rate"))
    shrunk = (
        rows.join(F.broadcast(league), SEASON)
        .withColumn("spread", spread)
        .withColumn("catcher_cs_rate", ratio0(caught, n))
        .withColumn("catcher_throwing_runs_unshrunk", (caught - n * F.col("rate")) * F.col("spread"))
        .withColumn("_shrunk", F.col("catcher_throwing_runs_unshrunk") * shrink(n, k))
    )
    center = shrunk.groupBy("season").agg(ratio0(F.sum("_shrunk"), F.sum("catcher_steal_attempts")).alias("center"))
    return (
        shrunk.join(F.broadcast(center), SEASON)
        .withColumn("catcher_throwing_runs", F.col("_shrunk") - n * F.col("center"))
        .drop("rate", "spread", "_shrunk", "center")
    )


# --- merging components ------------------------------------------------------------------

def canonicalize_components(rows: DataFrame, aliases: DataFrame, keys=("season",)) -> DataFrame:
    """Merge rows whose keys map to one player: numbers add up, lists unite, text keeps the first."""
    merged = []
    for field in rows.schema:
        kind = field.dataType.typeName()
        if field.name in (*keys, "player_key"):
            continue
        if kind == "array":
            merged.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(field.name)))).alias(field.name))
        elif kind == "string":
            merged.append(F.min_by(field.name, "_source").alias(field.name))
        else:
            merged.append(F.sum(field.name).alias(field.name))
    renamed = apply_aliases(rows.withColumn("_source", F.col("player_key")), "player_key", aliases)
    return renamed.groupBy(*keys, "player_key").agg(*merged)
