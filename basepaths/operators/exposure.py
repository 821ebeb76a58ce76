"""Repeat-exposure study: how often batter and pitcher have met, and what changes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basepaths import schema as S
from basepaths.functions.identity import literal_map
from basepaths.functions.lines import LINE_SUMS, banded, capped, count_if, game_sums, ratio, slash_line, stat_fields
from basepaths.session import cut_lineage


def derive_exposures(valued: DataFrame, series: DataFrame, weights: DataFrame, constants: DataFrame) -> DataFrame:
    """The plate-appearance fact table with meeting ordinals and stat columns.

    The in-game counters need no shuffle of rows that are dealt out by game. The series counter adds
    the meetings of earlier games, which come as one map per game.

    ``weights``: event_type, linear_weight; ``constants``: one row with raw_weights, woba_scale.
    """
    linear = weights.agg(F.map_from_entries(F.collect_list(F.struct("event_type", "linear_weight"))).alias("m")).scalar()
    scaled = constants.select(F.transform_values("raw_weights", lambda _, w: w * F.col("woba_scale")).alias("m")).scalar()
    schedule = series.select(
        "canonical_id", F.col("game_ts").alias("game_start"), F.col("game_id").alias("official_game_id"),
        "series_id", "series_game_number",
    )
    pas = valued.where("is_plate_appearance").join(schedule, "canonical_id")
    in_game = Window.partitionBy("canonical_id", "pitcher_key").orderBy("event_order")
    meeting = Window.partitionBy("canonical_id", "pitcher_key", "batter_key").orderBy("event_order")
    own = Window.partitionBy("canonical_id", "pitcher_key", "batter_key", "series_id", "game_start").orderBy("event_order")
    met_before = F.try_element_at("_met", F.struct("series_id", "game_start", "batter_key", "pitcher_key"))
    event = F.col("event_type")
    return (
        pas.withColumn("pitcher_batters_faced_before", F.row_number().over(in_game) - 1)
        .withColumn("same_game_matchup_number", F.row_number().over(meeting))
        .withColumn("_own", F.row_number().over(own))
        .join(_earlier_meetings(pas), "canonical_id", "left")
        .withColumn("series_matchup_number", F.col("_own") + F.coalesce(met_before, F.lit(0)))
        .withColumns({
            "prior_series_game_matchups": F.col("series_matchup_number") - F.col("same_game_matchup_number"),
            "mlb_tto_bf9": F.floor(F.col("pitcher_batters_faced_before") / 9.0).cast("int") + 1,
            "re24_run_value": F.col("run_value"),
            "_linear": linear,
            "_scaled": scaled,
            **stat_fields(),
        })
        .withColumns({
            "run_value": F.element_at("_linear", event),
            "wOBA_num_value": F.coalesce(F.try_element_at("_scaled", event), F.lit(0.0)),
        })
        .drop("_own", "_met", "_linear", "_scaled", "runners_before", "runners_after", "runner_actions", "action_keys", "after_keys")
    )


def _earlier_meetings(pas: DataFrame) -> DataFrame:
    """Per game, how often batter and pitcher met in earlier games of the series, where they did."""
    pair = ["series_id", "batter_key", "pitcher_key"]
    earlier = Window.partitionBy(*pair).orderBy("game_start", "canonical_id").rowsBetween(Window.unboundedPreceding, -1)
    met = (
        pas.groupBy("canonical_id", "game_start", *pair).agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(earlier).cast("int"))
    )
    entry = F.struct(F.struct("series_id", "game_start", "batter_key", "pitcher_key"), F.col("before"))
    return met.where("before > 0").groupBy("canonical_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_met"))


# --- bands -------------------------------------------------------------------------------

def prior_band(edge: int = 2) -> Column:
    """Meetings in earlier games of the series: 0, 1-2, 3+ in the study; 0, 1, 2+ on pages."""
    prior = F.col("prior_series_game_matchups")
    if edge == 2:
        return banded("band", (prior == 0, "0"), (prior <= 2, "1-2"), (prior > 2, "3+"))
    return banded("band", (prior == 0, "0"), (prior == 1, "1"), (prior > 1, "2+"))


def study_bands() -> dict[str, Column]:
    inning = F.col("inning")
    return {
        "same_game_matchup": capped("same_game_matchup_number", 4),
        "mlb_tto_bf9": capped("mlb_tto_bf9", 4),
        "series_matchup": capped("series_matchup_number", 5),
        "prior_series_games": prior_band(),
        "inning_bands": banded("band", (inning <= 2, "1-2"), (inning <= 4, "3-4"), (inning > 4, "5+")),
        "season_same_game": F.concat_ws("-", F.col("season").cast("string"), capped("same_game_matchup_number", 3)),
    }


def descriptive_tables(pas: DataFrame) -> DataFrame:
    """All six bandings in one pass over the plate appearances."""
    rows = F.array(*[F.struct(F.lit(name).alias("cut"), band.alias("label")) for name, band in study_bands().items()])
    labelled = pas.select("*", F.explode(rows).alias("c")).select("*", "c.cut", "c.label").drop("c")
    return slash_line(game_sums(labelled, "cut", "label"), "cut", "label")


# --- pitchers ----------------------------------------------------------------------------

def pitcher_names(pas: DataFrame, *keys: str) -> DataFrame:
    """Most frequent display name per key; the name seen first wins a tie."""
    seen = F.min(F.struct("game_start", "canonical_id", "event_order")).alias("seen")
    counted = pas.groupBy("pitcher_key", *keys, "pitcher").agg(F.count("*").alias("n"), seen)
    named = counted.groupBy("pitcher_key", *keys).agg(F.min_by("pitcher", F.struct(-F.col("n"), F.col("seen"))).alias("pitcher"))
    fixed = F.try_element_at(literal_map(S.PERSON_DISPLAY_NAMES), F.col("pitcher_key"))
    return named.withColumn("pitcher", F.coalesce(fixed, "pitcher"))


def pitcher_teams(pas: DataFrame) -> DataFrame:
    return pas.groupBy("pitcher_key").agg(F.array_sort(F.collect_set("fielding_team")).alias("teams"))


def pitcher_splits(pas: DataFrame) -> DataFrame:
    """Line per pitcher and meeting 1, 2, 3+."""
    rows = pas.withColumn("encounter", capped("same_game_matchup_number", 3))
    lines = slash_line(game_sums(rows, "pitcher_key", "encounter"), "pitcher_key", "encounter")
    return lines.join(pitcher_names(rows, "encounter"), ["pitcher_key", "encounter"]).join(pitcher_teams(pas), "pitcher_key")


def pitcher_penalties(pas: DataFrame) -> DataFrame:
    """Later meetings against the first one; pitchers without a first meeting are absent."""
    rows = pas.withColumn("phase", F.when(F.col("same_game_matchup_number") == 1, "first").otherwise("later"))
    lines = slash_line(game_sums(rows, "pitcher_key", "phase"), "pitcher_key", "phase")
    first, later = lines.where("phase = 'first'"), lines.where("phase = 'later'")
    measures = ("OPS", "wOBA", "RV_per_PA")
    bounds = ("wOBA_95_low", "wOBA_95_high")
    left = first.select("pitcher_key", F.col("PA").alias("first_PA"), *[F.col(m).alias(f"first_{m}") for m in (*measures, *bounds)])
    right = later.select("pitcher_key", F.col("PA").alias("_later"), *[F.col(m).alias(f"later_{m}") for m in (*measures, *bounds)])
    joined = left.join(right, "pitcher_key", "left").withColumn("later_PA", F.coalesce("_later", F.lit(0)))
    # the display name is that of the first-meeting split
    names = pitcher_names(rows.where("phase = 'first'"))
    return (
        joined.withColumn("PA", F.col("first_PA") + F.col("later_PA"))
        .withColumns({
            "OPS_penalty": F.col("later_OPS") - F.col("first_OPS"),
            "wOBA_penalty": F.col("later_wOBA") - F.col("first_wOBA"),
            "RV_per_PA_penalty": F.col("later_RV_per_PA") - F.col("first_RV_per_PA"),
            "quality_flag": F.when(F.col("later_PA") < 30, "small_later_sample").otherwise(""),
        })
        .drop("_later")
        .join(names, "pitcher_key").join(pitcher_teams(pas), "pitcher_key")
    )


# --- checks ------------------------------------------------------------------------------

def out_failures(events: DataFrame, box: DataFrame) -> DataFrame:
    """Pitchers whose attributed outs differ from the box score."""
    observed = events.groupBy("canonical_id", F.col("pitcher_key").alias("player_key")).agg(
        F.sum(F.col("outs_after") - F.col("outs_before")).alias("observed")
    )
    expected = F.bround(F.col("innings_decimal") * 3, 0).cast("bigint")
    return (
        box.select("canonical_id", "player_key", expected.alias("expected"))
        .join(observed, ["canonical_id", "player_key"], "left")
        .withColumn("observed", F.coalesce("observed", F.lit(0)))
        .where(F.col("observed") != F.col("expected"))
    )


def _consecutive(rows: DataFrame, name: str, keys: list[str], value: str, start: int) -> DataFrame:
    """Share of groups whose ordinals run without a gap from ``start``."""
    groups = rows.groupBy(*keys).agg(
        (
            (F.min(value) == start) & (F.max(value) == F.count("*") - 1 + start) & (F.count_distinct(value) == F.count("*"))
        ).alias("ok")
    )
    return groups.agg(count_if(F.col("ok")).alias("observed"), F.count("*").alias("expected")).select(
        F.lit(name).alias("check"), (F.col("observed") == F.col("expected")).alias("passed"), "observed", "expected"
    )


def validate_exposures(pas: DataFrame, completed: DataFrame) -> DataFrame:
    """The five dataset checks as rows; ``completed``: game_id of every completed official game."""
    # full outer join of the two id sets: equal sets leave nothing on one side only
    ids = pas.select("official_game_id").distinct().withColumn("_in", F.lit(1)).join(
        completed.select(F.col("game_id").alias("official_game_id")).distinct().withColumn("_due", F.lit(1)), "official_game_id", "full_outer"
    )
    games = ids.agg(
        F.count("_in").alias("observed"), F.count("_due").alias("expected"),
        F.coalesce(F.bool_and(F.col("_in").isNotNull() & F.col("_due").isNotNull()), F.lit(True)).alias("passed"),
    ).select(F.lit("every completed official game is represented").alias("check"), "passed", "observed", "expected")
    named = (F.coalesce("batter_key", F.lit("")) != "") & (F.coalesce("pitcher_key", F.lit("")) != "")
    identity = pas.agg(count_if(named).alias("observed"), F.count("*").alias("expected")).select(
        F.lit("every PA has batter and pitcher identity").alias("check"),
        (F.col("observed") == F.col("expected")).alias("passed"), "observed", "expected",
    )
    trio = ["batter_key", "pitcher_key"]
    return (
        games.unionByName(identity)
        .unionByName(_consecutive(pas, "same-game matchup ordinals are consecutive", ["canonical_id", *trio], "same_game_matchup_number", 1))
        .unionByName(_consecutive(pas, "series matchup ordinals are consecutive", ["series_id", *trio], "series_matchup_number", 1))
        .unionByName(_consecutive(pas, "pitcher batters-faced counters are consecutive", ["canonical_id", "pitcher_key"], "pitcher_batters_faced_before", 0))
    )


# --- page payload ------------------------------------------------------------------------

PERIODS = ("combined", "2025", "2026")
GAME_LABELS = ("1", "2", "3", "4+")
SERIES_LABELS = ("0", "1", "2+")


def with_periods(rows: DataFrame) -> DataFrame:
    """Every row under its own season and under ``combined``."""
    periods = F.array(F.lit("combined"), F.col("season").cast("string"))
    return rows.select("*", F.explode(periods).alias("period"))


def payload_sums(pas: DataFrame, entities: dict[str, str]) -> DataFrame:
    """Per-game sums for every entity kind x key x period x cut label, one pass.

    Plate appearances are summed per kind and pair of labels first; only these sums are spread over periods and cuts.
    ``entities`` maps a kind (league, team, pitcher, batter, ...) to the column holding its key.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in entities.items()])
    phase = F.when(F.col("same_game_matchup_number") == 1, "first").otherwise("later")
    labelled = pas.withColumns({"same_game": capped("same_game_matchup_number", 4), "prior_series": prior_band(1), "phase": phase, "everyone": F.lit("league")})
    rows = labelled.select("*", F.explode(kinds).alias("e")).select("*", "e.kind", "e.key").drop("e")
    names = ("same_game", "prior_series", "phase")
    sums = with_periods(game_sums(rows, "kind", "key", "season", *names))
    cuts = F.array(*[F.struct(F.lit(name).alias("cut"), F.col(name).alias("label")) for name in names])
    spread = sums.select("*", F.explode(cuts).alias("c")).select("*", "c.cut", "c.label").drop("c")
    return spread.groupBy("kind", "key", "period", "cut", "label", "canonical_id").agg(
        *[F.sum(name).alias(name) for name in ("PA", "run_value", *LINE_SUMS)]
    )


def period_payload(pas: DataFrame, entities: dict[str, str]) -> DataFrame:
    """Lines of every entity, period and label; labels without a plate appearance have PA 0."""
    keys = ["kind", "key", "period"]
    # written, as the grid and the lines both start here
    lines = cut_lineage(slash_line(payload_sums(pas, entities), *keys, "cut", "label", intervals=False))
    wanted = F.concat(
        F.transform(F.array(*map(F.lit, GAME_LABELS)), lambda v: F.struct(F.lit("same_game").alias("cut"), v.alias("label"))),
        F.transform(F.array(*map(F.lit, SERIES_LABELS)), lambda v: F.struct(F.lit("prior_series").alias("cut"), v.alias("label"))),
        F.transform(F.array(F.lit("first"), F.lit("later")), lambda v: F.struct(F.lit("phase").alias("cut"), v.alias("label"))),
    )
    grid = lines.select(*keys).distinct().select(*keys, F.explode(wanted).alias("c")).select(*keys, "c.cut", "c.label")
    return grid.join(lines, [*keys, "cut", "label"], "left").withColumn("PA", F.coalesce("PA", F.lit(0)))


def payload_penalties(payload: DataFrame) -> DataFrame:
    """Later minus first meeting per entity and period."""
    phase = payload.where("cut = 'phase'")

    def pick(label, measure):
        return F.max(F.when((F.col("label") == label) & (F.col("PA") > 0), F.col(measure)))

    return phase.groupBy("kind", "key", "period").agg(
        F.sum("PA").alias("PA"),
        *[(pick("later", m) - pick("first", m)).alias(f"{n}_penalty") for m, n in (("OPS", "OPS"), ("wOBA", "wOBA"), ("RV_per_PA", "RV"))],
    )


def study_summary(pas: DataFrame) -> DataFrame:
    return pas.agg(
        F.count_distinct("canonical_id").alias("games"),
        F.count("*").alias("plate_appearances"),
        F.count_distinct("pitcher_key").alias("pitchers"),
        F.count_distinct("series_id").alias("series"),
        ratio(count_if(F.coalesce("pitch_text", F.lit("")) != ""), F.count("*")).alias("pitch_text_coverage"),
    )
