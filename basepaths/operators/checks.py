"""Reconciliation of events with box scores and the list of conservation checks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basepaths.functions.lines import count_if, ratio


def batters_faced_mismatches(events: DataFrame, box: DataFrame) -> DataFrame:
    """Games whose box-score batters faced differ from the plate appearances."""
    expected = box.groupBy("canonical_id").agg(F.sum(F.coalesce("BF", F.lit(0))).alias("expected_bf"))
    observed = events.where("is_plate_appearance").groupBy("canonical_id").agg(F.count("*").alias("observed_pa"))
    joined = expected.join(observed, "canonical_id", "left").withColumn("observed_pa", F.coalesce("observed_pa", F.lit(0)))
    return joined.where(F.col("expected_bf") != F.col("observed_pa"))


def snapshot_validation(events: DataFrame, box: DataFrame, audit: DataFrame) -> DataFrame:
    """One row: totals, failures and the pass flag. ``audit``: run_difference, state_errors per game."""
    mismatches = batters_faced_mismatches(events, box).agg(F.count("*").alias("n")).scalar()
    failing = (F.coalesce("run_difference", F.lit(1)) != 0) | (F.coalesce("state_errors", F.lit(0)) > 0)
    failures = audit.agg(count_if(failing).alias("n")).scalar()
    pa = F.col("is_plate_appearance")
    told = pa & (F.coalesce("pitch_text", F.lit("")) != "")
    return events.agg(
        F.count_distinct("canonical_id").alias("games"), F.count("*").alias("events"), count_if(pa).alias("plate_appearances"),
        ratio(count_if(told), count_if(pa)).alias("pitch_text_coverage"),
    ).withColumns({"run_or_state_failures": failures, "bf_mismatches": mismatches}).withColumn(
        "passed", (F.col("run_or_state_failures") == 0) & (F.col("bf_mismatches") == 0)
    )


def game_reconciliation(events: DataFrame, batting_box: DataFrame, pitching_box: DataFrame) -> DataFrame:
    """Per game observed and box runs, hits, walks and strikeouts, with unknown plays."""
    kind = F.col("event_type")
    observed = events.groupBy("canonical_id").agg(
        F.sum("runs_scored").alias("observed_runs"),
        count_if(kind.isin("single", "double", "triple", "home_run")).alias("observed_hits"),
        count_if(kind.isin("walk", "intentional_walk")).alias("observed_walks"),
        count_if(kind.isin("strikeout", "dropped_third_out", "dropped_third_reached")).alias("observed_strikeouts"),
        count_if(kind == "unknown").alias("unknown_events"),
        count_if(F.col("outs_after") > 3).alias("boundary_errors"),
    )
    hits = batting_box.groupBy("canonical_id").agg(F.sum("H").alias("box_hits"))
    pitched = pitching_box.groupBy("canonical_id").agg(F.sum("R").alias("box_runs"), F.sum("BB").alias("box_walks"), F.sum("SO").alias("box_strikeouts"))
    joined = observed.join(hits, "canonical_id", "left").join(pitched, "canonical_id", "left")
    same = reduce(
        lambda a, b: a & b, [F.col(f"observed_{c}").eqNullSafe(F.col(f"box_{c}")) for c in ("runs", "hits", "walks", "strikeouts")]
    )
    return joined.withColumn("reconciled", same & (F.col("unknown_events") == 0) & (F.col("boundary_errors") == 0))


class Rule(NamedTuple):
    """A check: the aggregate ``measure`` of a table must equal ``against`` (a number, or a measure of another table)."""

    name: str
    source: str
    measure: str
    against: float | tuple[str, str] = 0.0
    at_least: bool = False


def wrong(name: str, source: str, condition: str) -> Rule:
    """No row may fulfil ``condition``."""
    return Rule(name, source, f"count_if({condition})")


def unique(name: str, source: str, *keys: str) -> Rule:
    return Rule(name, source, f"count(*) - count(distinct struct({', '.join(keys)}))")


def adds_up(name: str, source: str, whole: str, parts: str, tolerance: float = 1e-9) -> Rule:
    return wrong(name, source, f"abs({whole} - ({parts})) >= {tolerance}")


def balances(name: str, source: str, column: str, tolerance: float = 1e-6) -> Rule:
    """Every season's total vanishes; ``source`` holds totals per season."""
    return wrong(name, source, f"abs({column}) >= {tolerance}")


_GAMES = ("contests", "count(distinct canonical_id)")
PLAY_RULES = (
    unique("canonical ids are unique", "contests", "canonical_id"),
    wrong("contests are between two teams", "contests", "home_team = away_team"),
    Rule("normalization covers every contest", "events", "count(distinct canonical_id)", _GAMES),
    *(wrong(f"all games reconcile {what}", "reconciled", f"not (observed_{what} <=> box_{what})") for what in ("runs", "hits", "walks", "strikeouts")),
    wrong("no game crosses a boundary of three outs", "reconciled", "boundary_errors > 0"),
    wrong("no plate appearances have unknown outcomes", "events", "is_plate_appearance and event_type = 'unknown'"),
    wrong("every half-inning before a game's last reaches three outs", "halves", "not last and outs <> 3"),
    wrong("no event begins with three outs", "events", "outs_before >= 3"),
    Rule("every base-out state has observations", "states", "count_if(sample_size > 0)", 24.0),
    Rule("all games reach the plate appearance data", "plate_appearances", "count(distinct canonical_id)", _GAMES),
    Rule("all plate appearances reach the plate appearance data", "plate_appearances", "count(*)", ("events", "count_if(is_plate_appearance)")),
)
VALUE_RULES = (
    unique("position player keys are unique", "position", "season", "player_key"),
    unique("pitcher keys are unique", "pitchers", "season", "player_key"),
    unique("combined keys are unique", "combined", "season", "player_key"),
    balances("batting runs balance", "position_totals", "batting_runs"),
    balances("position runs above average balance", "position_totals", "above_average"),
    balances("stolen base runs balance", "position_totals", "sb_cs_runs"),
    balances("double play runs balance", "position_totals", "double_play_avoidance_runs"),
    balances("catcher throwing runs balance", "position_totals", "catcher_throwing_runs"),
    balances("advancement runs balance", "advancement_totals", "advancement_runs"),
    wrong("advancement has no unresolved candidates", "advancement", "action is null or utility is null"),
    Rule("arm attribution coverage clears its gate", "advancement", "count(fielder) / count(*)", 0.25, at_least=True),
    balances("arm runs before shrinkage balance", "arm_totals", "arm_runs_unshrunk"),
    wrong("raw arm and runner value are opposing", "arms", "abs(arm_runs_opposing_raw + attributed_runner_runs) >= 1e-9"),
    adds_up("arm roles add up", "arms", "arm_runs", "pitcher_arm_runs + non_pitcher_arm_runs"),
    balances("pitching runs balance", "pitcher_totals", "ra7_pitching_runs_above_average"),
    wrong("every pitcher has opponent-adjusted context", "pitchers", "opponent_expected_RA7 is null"),
    wrong("every pitcher has FIP and ERA", "pitchers", "FIP is null or ERA is null or ERA_minus_FIP is null"),
    adds_up("ERA less FIP is exact", "pitchers", "ERA_minus_FIP", "ERA - FIP"),
    adds_up("pitcher wins add up", "pitchers", "pitcher_war", "pitching_war + pitcher_defense_war"),
    adds_up("pitching and pitcher defense runs add up", "pitchers", "ra7_pitching_runs_above_average", "pitching_runs_above_average + pitcher_defense_runs"),
    adds_up("defense runs add up", "position", "defense_runs", "range_runs + arm_runs + catcher_throwing_runs"),
    adds_up("baserunning runs add up", "position", "baserunning_component_runs", "baserunning_runs + double_play_avoidance_runs"),
    adds_up("throwing runs add up", "position", "throwing_runs", "arm_runs + catcher_throwing_runs"),
    adds_up("position wins add up", "position", "position_war", "offensive_war + defensive_war"),
    adds_up("total wins add up", "combined", "total_war", "position_war + pitcher_war"),
    adds_up("weighted runs are the batting runs", "combined", "wRAA", "batting_runs"),
    adds_up("batting wins convert weighted runs", "combined", "batting_war", "wRAA / runs_per_win"),
    adds_up("baserunning wins convert all baserunning", "combined", "baserunning_war", "baserunning_component_runs / runs_per_win"),
    adds_up("defense wins convert each defensive part once", "combined", "defense_war",
            "(range_runs + arm_runs + catcher_throwing_runs + positional_adjustment_runs) / runs_per_win"),
    wrong("the positional adjustment is zero", "combined", "abs(positional_adjustment_runs) >= 1e-12"),
    wrong("total wins equal the replacement pool", "pool", "abs(war - wins) >= 1e-6"),
    *(wrong(f"player rows tell {field}", "combined", f"{field} is null") for field in ("position_war", "pitcher_war", "pitching_war", "pitcher_defense_war", "total_war")),
)
FEED_RULES = (
    Rule("every contest has feed plays", "feed", "count(distinct canonical_id)", _GAMES),
    wrong("feed games reconcile runs", "feed", "run_difference <> 0"),
    wrong("feed games have valid runner states", "feed", "state_invariant_error_count > 0"),
    Rule("feed plate appearances are complete", "feed", "sum(plate_appearances)", ("events", "count_if(is_plate_appearance)")),
)


def evaluate(tables: dict[str, DataFrame], rules: Iterable[Rule]) -> DataFrame:
    """(check, passed, observed, expected) of every rule; every table is read once, by one aggregate of all its measures."""
    rules = list(rules)
    asked: dict[str, list[str]] = {}
    for rule in rules:
        for source, measure in [(rule.source, rule.measure), *([rule.against] if isinstance(rule.against, tuple) else [])]:
            held = asked.setdefault(source, [])
            if measure not in held:
                held.append(measure)
    spark = next(iter(tables.values())).sparkSession
    facts = spark.range(1).select(*[
        tables[source].agg(F.struct(*[F.expr(m).cast("double").alias(f"m{n}") for n, m in enumerate(measures)]).alias("f")).scalar().alias(source)
        for source, measures in asked.items()
    ])
    fact = lambda source, measure: F.coalesce(F.col(f"{source}.m{asked[source].index(measure)}"), F.lit(0.0))
    rows = []
    for rule in rules:
        observed = fact(rule.source, rule.measure)
        expected = fact(*rule.against) if isinstance(rule.against, tuple) else F.lit(float(rule.against))
        passed = observed >= expected if rule.at_least else observed == expected
        rows.append(F.struct(F.lit(rule.name).alias("check"), passed.alias("passed"), observed.alias("observed"), expected.alias("expected")))
    return facts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def require(checks: DataFrame) -> DataFrame:
    """Fail the job on a failed check."""
    message = F.concat(F.lit("check failed: "), F.col("check"))
    return checks.withColumn("passed", F.when(~F.col("passed"), F.raise_error(message).cast("boolean")).otherwise(F.col("passed")))


def half_innings(events: DataFrame) -> DataFrame:
    """Outs at the end of every half-inning, and whether it is its game's last."""
    halves = events.groupBy("canonical_id", "inning", "half").agg(F.max("outs_after").alias("outs"), F.max("event_order").alias("upto"))
    return halves.withColumn("last", F.col("upto") == F.max("upto").over(Window.partitionBy("canonical_id")))


def play_tables(contests: DataFrame, events: DataFrame, reconciled: DataFrame, states: DataFrame, plate_appearances: DataFrame) -> dict[str, DataFrame]:
    return {
        "contests": contests, "events": events, "reconciled": reconciled, "states": states, "plate_appearances": plate_appearances, "halves": half_innings(events),
    }


def value_tables(position: DataFrame, pitchers: DataFrame, combined: DataFrame, opportunities: DataFrame, arms: DataFrame, environment: DataFrame) -> dict[str, DataFrame]:
    """The player value tables, and their totals per season."""
    total = lambda df, *columns: df.groupBy("season").agg(*[F.sum(c).alias(c) for c in columns])
    runs = ("batting_runs", "baserunning_runs", "double_play_avoidance_runs", "range_runs", "arm_runs", "catcher_throwing_runs", "league_adjustment_runs")
    above = position.withColumn("above_average", sum((F.col(c) for c in runs[1:]), F.col(runs[0])))
    pool = combined.groupBy("season").agg(F.sum("total_war").alias("war")).join(
        environment.select("season", (F.col("position_replacement_wins") + F.col("pitcher_replacement_wins")).alias("wins")), "season"
    )
    return {
        "position": position, "pitchers": pitchers, "combined": combined.join(environment.select("season", "runs_per_win"), "season"), "advancement": opportunities,
        "arms": arms, "pool": pool, "position_totals": total(above, "batting_runs", "above_average", "sb_cs_runs", "double_play_avoidance_runs", "catcher_throwing_runs"),
        "advancement_totals": total(opportunities, "advancement_runs"), "arm_totals": total(arms, "arm_runs_unshrunk"),
        "pitcher_totals": total(pitchers, "ra7_pitching_runs_above_average"),
    }


def coverage_table(events: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Shares of attributed pitchers, positions, batted balls and opportunities per season."""
    pa = F.col("is_plate_appearance")
    played = events.where(pa).groupBy("season").agg(
        ratio(count_if(F.coalesce("pitcher", F.lit("")) != ""), F.count("*")).alias("pitcher_attribution"),
        ratio(count_if(F.coalesce("pitch_text", F.lit("")) != ""), F.count("*")).alias("pitch_text"),
        ratio(count_if(F.col("batted_type").isNotNull()), F.count("*")).alias("batted_ball_type"),
        ratio(count_if(F.col("first_position").isNotNull()), F.count("*")).alias("fielding_position"),
        ratio(count_if(F.col("fielder").isNotNull()), F.count("*")).alias("fielder"),
    )
    arms = opportunities.groupBy("season").agg(ratio(count_if(F.col("fielder").isNotNull()), F.count("*")).alias("arm_opportunities"))
    return played.join(F.broadcast(arms), "season", "left")
