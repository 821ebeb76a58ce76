"""Positional study: who played where, what hitting a position costs, how fielding transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basepaths import schema as S
from basepaths.functions.identity import literal_map, person_key, team_family
from basepaths.functions.lines import count_if, is_in, ratio, ratio0

# --- fixed values: standardized season of 175 innings ---
SEASON_OUTS = 525.0


def team_outs(events: DataFrame) -> DataFrame:
    gained = F.greatest(F.lit(0), F.col("outs_after") - F.col("outs_before"))
    return events.groupBy("canonical_id", F.col("fielding_team").alias("team")).agg(F.sum(gained).alias("defensive_outs"))


def listed_positions(position: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(position, F.lit("")), ","), lambda p: F.upper(F.trim(p)))
    return F.filter(parts, lambda p: p.isin(*S.POSITION_LABELS))


def position_map(box: DataFrame) -> DataFrame:
    """Standard positions of every hitter row."""
    return box.select("canonical_id", "season", "team", "player", "player_key", listed_positions(F.col("position")).alias("positions"))


def team_game_audit(box: DataFrame, events: DataFrame) -> DataFrame:
    """Which team games confirm who stood where: eight positions held once, nobody moved."""
    mapped = position_map(box)
    labels = mapped.select("canonical_id", "season", "team", F.explode_outer("positions").alias("position"))
    per_position = labels.groupBy("canonical_id", "season", "team", "position").agg(F.count("*").alias("holders"))
    complete = per_position.groupBy("canonical_id", "season", "team").agg(
        F.count("position").alias("held"), F.coalesce(F.max(F.when(F.col("position").isNotNull(), F.col("holders"))), F.lit(0)).alias("most")
    )
    multi = mapped.groupBy("canonical_id", "team").agg(F.bool_or(F.size("positions") > 1).alias("multi_position_player"))
    moved = events.where(F.coalesce("pitch_text", F.lit("")).rlike(S.SUBSTITUTION)).select("canonical_id").distinct()
    whole = F.col("held") == len(S.POSITION_LABELS)
    unique = whole & (F.col("most") == 1)
    return (
        complete.join(multi, ["canonical_id", "team"])
        .join(team_outs(events), ["canonical_id", "team"], "left")
        .join(moved.withColumn("_moved", F.lit(True)), "canonical_id", "left")
        .select(
            "canonical_id", "team", "season", F.coalesce("defensive_outs", F.lit(0)).alias("defensive_outs"),
            whole.alias("complete_standard_positions"), unique.alias("unique_standard_assignments"), "multi_position_player",
            F.coalesce("_moved", F.lit(False)).alias("game_has_recorded_substitution"),
            (unique & ~F.col("multi_position_player") & F.col("_moved").isNull()).alias("confirmed_for_innings"),
        )
    )


def fielding_mentions(parsed: DataFrame, box: DataFrame) -> DataFrame:
    """Plays that name a fielder at a standard position, per (season, player, team, position)."""
    short = F.try_element_at(literal_map(S.POSITION_NAMES), F.col("first_position"))
    named = parsed.where(F.col("fielder").isNotNull()).select(
        "canonical_id", "season", "fielding_team", short.alias("position"), person_key(F.col("fielder")).alias("player_key")
    ).where(F.col("position").isNotNull())
    owners = box.groupBy("canonical_id", "player_key").agg(F.max("team").alias("team"))
    return (
        named.join(owners, ["canonical_id", "player_key"], "left")
        .groupBy("season", "player_key", F.coalesce("team", "fielding_team").alias("team"), "position")
        .agg(F.count("*").alias("fielding_mentions"))
    )


def position_exposure(box: DataFrame, events: DataFrame) -> DataFrame:
    """Labels, confirmed outs and mentions of every player at every listed position."""
    audit = team_game_audit(box, events).select("canonical_id", "team", "defensive_outs", "confirmed_for_innings")
    labels = position_map(box).select("canonical_id", "season", "team", "player", "player_key", F.explode("positions").alias("position"))
    keys = ["season", "player_key", "team", "position"]
    sure = F.col("confirmed_for_innings")
    exposure = labels.join(audit, ["canonical_id", "team"]).groupBy(*keys).agg(
        F.min("player").alias("player"),
        F.count("*").alias("position_game_labels"),
        F.sum(F.when(sure, F.col("defensive_outs")).otherwise(0)).alias("confirmed_defensive_outs"),
        count_if(~sure).alias("ambiguous_position_games"),
    )
    return (
        exposure.join(fielding_mentions(events, box), keys, "left")
        .withColumn("fielding_mentions", F.coalesce("fielding_mentions", F.lit(0)))
        .withColumn("confirmed_defensive_innings", F.col("confirmed_defensive_outs") / 3)
        .withColumn(
            "coverage_status",
            F.when(F.col("confirmed_defensive_outs") > 0, "confirmed_clean_team_games_only").otherwise("position_label_only_no_defensive_innings"),
        )
    )


def coverage(audit: DataFrame) -> DataFrame:
    possible = F.sum(F.col("defensive_outs") * len(S.POSITION_LABELS))
    confirmed = F.sum(F.when(F.col("confirmed_for_innings"), F.col("defensive_outs") * len(S.POSITION_LABELS)).otherwise(0))
    return audit.agg(
        F.count("*").alias("team_games"),
        F.count_distinct("canonical_id").alias("games"),
        count_if(F.col("confirmed_for_innings")).alias("team_games_with_confirmed_position_innings"),
        count_if(F.col("complete_standard_positions")).alias("team_games_with_complete_standard_position_labels"),
        count_if(F.col("unique_standard_assignments")).alias("team_games_with_unique_standard_assignments"),
        confirmed.alias("confirmed_standard_position_outs"),
        possible.alias("possible_standard_position_outs"),
        ratio0(confirmed, possible).alias("confirmed_position_innings_coverage"),
    )


# --- hitting by position -----------------------------------------------------------------

def event_type_weights(valued: DataFrame) -> DataFrame:
    return valued.where("is_plate_appearance").groupBy("season", "event_type").agg(F.avg("run_value").alias("weight"))


def single_position(box: DataFrame) -> DataFrame:
    """Hitter rows listed at exactly one standard position."""
    return position_map(box).where(F.size("positions") == 1).select(
        "canonical_id", "player_key", F.col("positions")[0].alias("position")
    )


def hitting_cells(valued: DataFrame, box: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    """Plate appearances and weighted runs by (season, team family, position or NULL, player).

    Everything the study needs (season means, team omissions, position sums) follows from
    this one grouping, so the events are read and joined once for all variants.
    """
    pas = valued.where("is_plate_appearance").select(
        "season", "canonical_id", "batting_team", "event_type", person_key(F.col("batter")).alias("player_key")
    )
    return (
        pas.join(F.broadcast(event_type_weights(valued)), ["season", "event_type"])
        .join(single_position(box), ["canonical_id", "player_key"], "left")
        .groupBy("season", team_family(F.col("batting_team"), families).alias("family"), "position", "player_key")
        .agg(F.count("*").alias("pa"), F.sum("weight").alias("runs"))
    )


def position_sums(cells: DataFrame) -> DataFrame:
    """(variant, season, position, pa, runs, mean): all, each season, and all but one team family.

    A family is left out by subtraction: totals less its own. So a cell is read once however many
    families there are, and what grows with them is families x seasons x positions.
    """
    own = cells.groupBy("season", "family", "position").agg(F.sum("pa").alias("pa"), F.sum("runs").alias("runs"))
    of_family = own.groupBy("season", "family").agg(F.sum("pa").alias("fpa"), F.sum("runs").alias("fruns"))
    of_season = own.groupBy("season").agg(F.sum("pa").alias("spa"), F.sum("runs").alias("sruns"))
    families = own.agg(F.array_sort(F.collect_set("family"))).scalar()
    whole = own.where(F.col("position").isNotNull()).groupBy("season", "position").agg(F.sum("pa").alias("pa"), F.sum("runs").alias("runs")).join(of_season, "season")
    name = F.explode(F.array(F.lit("all"), F.concat(F.lit("season_"), F.col("season").cast("string"))))
    kept = whole.select(name.alias("variant"), "season", "position", "pa", "runs", (F.col("sruns") / F.col("spa")).alias("mean"))
    each = whole.withColumn("_f", families).select("*", F.explode("_f").alias("family")).drop("_f")
    mine = own.withColumnsRenamed({"pa": "opa", "runs": "oruns"})
    less = each.join(of_family, ["season", "family"], "left").join(mine, ["season", "family", "position"], "left").na.fill(0, ["fpa", "opa"]).na.fill(0.0, ["fruns", "oruns"])
    left = less.select(
        F.concat(F.lit("leave_team_out:"), "family").alias("variant"), "season", "position", (F.col("pa") - F.col("opa")).alias("pa"),
        (F.col("runs") - F.col("oruns")).alias("runs"), ratio(F.col("sruns") - F.col("fruns"), F.col("spa") - F.col("fpa")).alias("mean"),
    )
    return kept.unionByName(left)


def position_players(cells: DataFrame) -> DataFrame:
    """(variant, position, players): who was listed; without a family go those listed in it alone."""
    seen = cells.where(F.col("position").isNotNull())
    whole = seen.groupBy("position").agg(F.count_distinct("player_key").alias("players"))
    seasons = seen.groupBy(F.concat(F.lit("season_"), F.col("season").cast("string")).alias("variant"), "position").agg(F.count_distinct("player_key").alias("players"))
    homes = seen.groupBy("position", "player_key").agg(F.min("family").alias("family"), F.max("family").alias("_last")).where("family = _last")
    alone = homes.groupBy("position", "family").agg(F.count("*").alias("alone"))
    families = cells.agg(F.array_sort(F.collect_set("family"))).scalar()
    each = whole.withColumn("_f", families).select("position", "players", F.explode("_f").alias("family")).join(alone, ["position", "family"], "left")
    left = each.select(F.concat(F.lit("leave_team_out:"), "family").alias("variant"), "position", (F.col("players") - F.coalesce("alone", F.lit(0))).alias("players"))
    return whole.select(F.lit("all").alias("variant"), "position", "players").unionByName(seasons).unionByName(left)


def position_grid(keys: DataFrame, *names: str) -> DataFrame:
    return keys.select(*names).distinct().select(*names, F.explode(F.array(*map(F.lit, S.POSITION_LABELS))).alias("position"))


def center_scale(rows: DataFrame, value: str, weight: str, output: str, *keys: str) -> DataFrame:
    """Subtract the weighted mean over the eight positions."""
    mean = ratio0(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("_c")
    if not keys:
        return rows.withColumn("_c", rows.agg(mean).scalar()).withColumn(output, F.col(value) - F.col("_c")).drop("_c")
    center = rows.groupBy(*keys).agg(mean)
    return rows.join(F.broadcast(center), list(keys)).withColumn(output, F.col(value) - F.col("_c")).drop("_c")


def offensive_position_values(valued: DataFrame, box: DataFrame, families: dict[str, str] | None = None) -> DataFrame:
    """Scarcity of hitting at each position for all variants in one job. ``families``: team to family, where they differ."""
    cells = hitting_cells(valued, box, families)
    rows = position_sums(cells)
    sums = rows.groupBy("variant", "position").agg(
        F.sum("pa").alias("PA"), F.sum(F.col("runs") - F.col("pa") * F.col("mean")).alias("batting_runs_proxy")
    ).join(position_players(cells), ["variant", "position"], "left")
    filled = position_grid(rows, "variant").join(sums, ["variant", "position"], "left").withColumns({
        "PA": F.coalesce("PA", F.lit(0)), "players": F.coalesce("players", F.lit(0)),
        "batting_runs_proxy": F.coalesce("batting_runs_proxy", F.lit(0.0)),
    }).withColumn("raw_scarcity_runs_per_100_pa", ratio0(-100.0 * F.col("batting_runs_proxy"), "PA"))
    return center_scale(filled, "raw_scarcity_runs_per_100_pa", "PA", "centered_candidate_runs_per_25_games", "variant").withColumn(
        "method", F.lit("offensive_scarcity_proxy")
    )


def replacement_depth(valued: DataFrame, box: DataFrame) -> DataFrame:
    """The same scale over players at or below the upper median of playing time."""
    cells = hitting_cells(valued, box)
    means = cells.groupBy("season").agg((F.sum("runs") / F.sum("pa")).alias("mean"))
    players = (
        cells.where(F.col("position").isNotNull()).join(F.broadcast(means), "season")
        .groupBy("position", "player_key").agg(F.sum("pa").alias("pa"), F.sum(F.col("runs") - F.col("pa") * F.col("mean")).alias("runs"))
    )
    # upper median from counts per distinct playing time: the first value whose running count passes half
    counts = players.groupBy("position", "pa").agg(F.count("*").alias("n"))
    running = Window.partitionBy("position").orderBy("pa").rowsBetween(Window.unboundedPreceding, 0)
    half = players.groupBy("position").agg(F.floor(F.count("*") / 2.0).alias("half"))
    threshold = (
        counts.withColumn("upto", F.sum("n").over(running)).join(F.broadcast(half), "position")
        .where(F.col("upto") > F.col("half")).groupBy("position").agg(F.min("pa").alias("threshold"))
    )
    lower = players.join(F.broadcast(threshold), "position").where(F.col("pa") <= F.col("threshold")).groupBy("position").agg(
        F.sum("pa").alias("PA"), F.count("*").alias("players"), F.sum("runs").alias("runs"), F.any_value("threshold").alias("lower_half_PA_threshold")
    )
    grid = valued.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, S.POSITION_LABELS))).alias("position"))
    filled = grid.join(lower, "position", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("PA", "players", "lower_half_PA_threshold")}
    ).withColumn("raw", ratio0(-100.0 * F.coalesce("runs", F.lit(0.0)), "PA"))
    return center_scale(filled, "raw", "PA", "centered_candidate_runs_per_25_games").drop("raw", "runs").withColumns(
        {"method": F.lit("lower_playing_time_depth_proxy"), "variant": F.lit("all")}
    )


# --- fielding transfer -------------------------------------------------------------------

def fielding_cells(parsed: DataFrame) -> DataFrame:
    """Conversion residuals per player and position from one grouping of the plays."""
    short = F.try_element_at(literal_map(S.POSITION_NAMES), F.col("first_position"))
    cells = (
        parsed.where(F.col("fielder").isNotNull() & F.col("batted_type").isNotNull())
        .groupBy("fielder", short.alias("position"), "batted_type")
        .agg(F.count("*").alias("n"), count_if(is_in(S.CONVERTED_EVENTS)).alias("made"))
        .where(F.col("position").isNotNull())
        .withColumn("player_key", person_key(F.col("fielder")))
    )
    rates = cells.groupBy("position", "batted_type").agg((F.sum("made") / F.sum("n")).alias("rate"))
    return cells.join(F.broadcast(rates), ["position", "batted_type"]).groupBy("player_key", "position").agg(
        F.sum("n").alias("n"), F.sum(F.col("made") - F.col("n") * F.col("rate")).alias("residual")
    )


def fielding_samples(cells: DataFrame) -> DataFrame:
    sums = cells.groupBy("position").agg(F.count("*").alias("players"), F.sum("n").alias("opportunities"), F.sum("residual").alias("residual"))
    grid = cells.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, S.POSITION_LABELS))).alias("position"))
    return grid.join(sums, "position", "left").select(
        "position", F.coalesce("players", F.lit(0)).alias("players"), F.coalesce("opportunities", F.lit(0)).alias("opportunities"),
        ratio0(F.coalesce("residual", F.lit(0.0)), F.coalesce("opportunities", F.lit(0))).alias("mean_position_relative_conversion_residual"),
    )


def fielding_transitions(cells: DataFrame) -> DataFrame:
    """Residual difference of players seen at both positions, for all 28 position pairs.

    A player has at most eight positions: their sums sit in one map per player, and the fixed
    list of pairs is looked up in it.
    """
    order = S.POSITION_LABELS
    pairs = [(a, b) for i, a in enumerate(order) for b in order[i + 1:]]
    per_player = cells.groupBy("player_key").agg(
        F.map_from_entries(F.collect_list(F.struct("position", F.struct("n", "residual")))).alias("m")
    )
    options = F.array(*[F.struct(F.lit(a).alias("position_a"), F.lit(b).alias("position_b")) for a, b in pairs])
    rows = per_player.select("player_key", "m", F.explode(options).alias("o")).select(
        "o.*", F.try_element_at("m", F.col("o.position_a")).alias("a"), F.try_element_at("m", F.col("o.position_b")).alias("b")
    )
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    grouped = rows.groupBy("position_a", "position_b").agg(
        count_if(both).alias("players"),
        *[F.sum(F.when(both, F.col(f"{s}.{c}"))).alias(f"{s}_{c}") for s in "ab" for c in ("n", "residual")],
    )
    difference = F.col("b_residual") / F.nullif("b_n", F.lit(0)) - F.col("a_residual") / F.nullif("a_n", F.lit(0))
    return grouped.select(
        "position_a", "position_b", "players",
        F.coalesce("a_n", F.lit(0)).alias("opportunities_a"), F.coalesce("b_n", F.lit(0)).alias("opportunities_b"),
        F.coalesce(100 * difference, F.lit(0.0)).alias("residual_difference_b_minus_a_per_100_opportunities"),
    )


# --- stability ---------------------------------------------------------------------------

def position_index() -> Column:
    return F.array_position(F.array(*map(F.lit, S.POSITION_LABELS)), F.col("position"))


def ordinal_spearman(pairs: DataFrame, *keys: str) -> DataFrame:
    """Rank correlation with ordinal tie ranks (input order of the eight positions).

    ``pairs``: keys, position, first, second; eight rows per key.
    """
    def rank(c):
        return F.row_number().over(Window.partitionBy(*keys).orderBy(c, position_index()))

    ranked = pairs.withColumns({"_a": rank("first"), "_b": rank("second")})
    return ranked.groupBy(*keys).agg(F.coalesce(F.corr("_a", "_b"), F.lit(0.0)).alias("spearman"))


def cross_validation(candidates: DataFrame) -> DataFrame:
    """Every variant against the full scale."""
    value = "centered_candidate_runs_per_25_games"
    full = candidates.where("variant = 'all'").select("position", F.col(value).alias("first"))
    pairs = candidates.where("variant <> 'all'").select("variant", "position", F.col(value).alias("second")).join(F.broadcast(full), "position")
    other = pairs.groupBy("variant").agg(
        F.max(F.abs(F.col("first") - F.col("second"))).alias("maximum_absolute_run_change"),
        count_if((F.col("first") >= 0) == (F.col("second") >= 0)).alias("sign_agreement_positions"),
    )
    return ordinal_spearman(pairs, "variant").withColumnRenamed("spearman", "spearman_vs_full").join(other, "variant")


def season_stability(candidates: DataFrame) -> DataFrame:
    """Rank correlation between the two season scales; zero unless there are exactly two."""
    seasons = candidates.where(F.col("variant").startswith("season_"))
    wide = seasons.groupBy("position").agg(
        F.min_by("centered_candidate_runs_per_25_games", "variant").alias("first"),
        F.max_by("centered_candidate_runs_per_25_games", "variant").alias("second"),
        F.count("*").alias("n"),
    ).withColumn("one", F.lit(1))
    exact = wide.groupBy("one").agg(F.bool_and(F.col("n") == 2).alias("two"))
    return ordinal_spearman(wide, "one").join(exact, "one").select(
        F.when(F.col("two"), F.col("spearman")).otherwise(F.lit(0.0)).alias("direct_season_to_season_spearman")
    )


def reliability_gates(
    coverage_row: DataFrame, transitions: DataFrame, validation: DataFrame, candidates: DataFrame
) -> DataFrame:
    """One row: the six gates and the decision."""
    adequate = transitions.agg(
        (F.count_if((F.col("players") >= 15) & (F.least("opportunities_a", "opportunities_b") >= 200)) >= 7).alias("x")
    ).scalar()
    teams = validation.where(F.col("variant").startswith("leave_team_out:")).agg(
        F.coalesce(F.min("spearman_vs_full") >= 0.70, F.lit(False)).alias("x")
    ).scalar()
    several = validation.where(F.col("variant").startswith("season_")).agg((F.count("*") >= 2).alias("x")).scalar()
    stable = season_stability(candidates).select((F.col("direct_season_to_season_spearman") >= 0.70).alias("x")).scalar()
    centered = candidates.where("variant = 'all'").agg(
        (F.abs(F.sum(F.col("centered_candidate_runs_per_25_games") * F.col("PA"))) < 1e-8).alias("x")
    ).scalar()
    gates = coverage_row.select(
        (F.col("confirmed_position_innings_coverage") >= 0.80).alias("defensible_position_innings"),
        adequate.alias("adequate_transition_samples"),
        teams.alias("leave_one_team_out_stability"),
        (several & stable).alias("leave_one_season_out_stability"),
        centered.alias("league_centered_candidates"),
        F.lit(True).alias("no_double_counting_plan"),
    )
    passed = F.lit(True)
    for name in gates.columns:
        passed = passed & F.coalesce(name, F.lit(False))
    return gates.withColumn("decision", F.when(passed, "implement").otherwise("insufficient_data"))


def weighted_player_adjustment(exposure: DataFrame, scale: DataFrame) -> DataFrame:
    """Runs credited to a player for the positions held, per standardized season."""
    values = scale.select("position", F.col("centered_candidate_runs_per_25_games").alias("value"))
    return exposure.join(F.broadcast(values), "position", "left").groupBy("season", "player_key").agg(
        F.sum(F.coalesce("value", F.lit(0.0)) * F.col("confirmed_defensive_outs") / SEASON_OUTS).alias("adjustment_runs")
    )
