"""From two teams' views of a schedule to canonical contests, official matches and series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basepaths.functions.identity import literal_map, person_key
from basepaths.functions.lines import count_if


def team_name_key(name: Column, league_prefix: str = "") -> Column:
    """Letters and digits of a team name; the league's own word is dropped."""
    words = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != league_prefix)
    return person_key(F.array_join(words, ""))


def contest_key(season: Column, team_ids: Column, start: Column, discriminator: Column, prefix: str = "contest") -> Column:
    raw = F.concat_ws("|", season.cast("string"), F.array_join(F.array_sort(team_ids), "+"), start, discriminator)
    return F.concat(F.lit(f"{prefix}-"), season.cast("string"), F.lit("-"), F.substring(F.sha2(raw, 256), 1, 16))


def resolve_opponents(schedule: DataFrame, teams: DataFrame, league_prefix: str = "") -> DataFrame:
    """Add ``opponent_team_id`` by (season, name key); NULL where no team has the name.

    ``schedule``: id, season, source_team_id, source_team_name, opponent_name, home_away,
    start_ts (text), game_status, score_team, score_opponent. ``teams``: season, team_id, name.
    """
    known = teams.select(
        "season", F.col("team_id").alias("opponent_team_id"), team_name_key(F.col("name"), league_prefix).alias("_key")
    ).groupBy("season", "_key").agg(F.max("opponent_team_id").alias("opponent_team_id"))
    keyed = schedule.withColumn("_key", team_name_key(F.col("opponent_name"), league_prefix))
    return keyed.join(known, ["season", "_key"], "left").drop("_key")


def split_same_time(rows: DataFrame, prefix: str = "contest") -> DataFrame:
    """Give every resolved row its contest.

    Rows of one (season, teams, start) key stay together unless more than two of them pair
    off by inverse final scores. Pairing is decided from counts per (key, score as the home
    team saw it): every score must have exactly one home and one away row. No row pairs are
    formed, so a hot key costs no more than its rows.
    """
    pair = F.array_sort(F.array("source_team_id", "opponent_team_id"))
    base = contest_key(F.col("season"), pair, F.col("start_ts"), F.lit(""), prefix)
    home, away = F.col("home_away") == "home", F.col("home_away") == "away"
    keyed = rows.withColumn("base_id", base).withColumns({
        "_home_score": F.when(home, F.col("score_team")).otherwise(F.col("score_opponent")),
        "_away_score": F.when(home, F.col("score_opponent")).otherwise(F.col("score_team")),
    })
    scores = ["base_id", "_home_score", "_away_score"]
    per_score = keyed.groupBy(*scores).agg(
        F.count("*").alias("n"), count_if(home).alias("homes"), count_if(away).alias("aways"),
        # read only where n = 2, so the two ids are the smallest and the largest
        F.concat_ws("+", F.min(F.col("id").cast("string")), F.max(F.col("id").cast("string"))).alias("ids"),
    )
    paired = (F.col("homes") == 1) & (F.col("aways") == 1) & (F.col("n") == 2) & F.col("_home_score").isNotNull() & F.col("_away_score").isNotNull()
    per_key = per_score.groupBy("base_id").agg((F.bool_and(paired) & (F.sum("n") > 2)).alias("splits"))
    verdict = per_score.join(per_key, "base_id").where("splits").select(*scores, "ids")
    joined = keyed.join(verdict, scores, "left")
    full = contest_key(F.col("season"), pair, F.col("start_ts"), F.coalesce("ids", F.lit("")), prefix)
    return joined.withColumn("canonical_id", full).drop("_home_score", "_away_score", "ids")


def contest_rows(rows: DataFrame) -> DataFrame:
    """One row per contest with quality flags; the home row is preferred."""
    place = F.struct("source_team_id", "id")
    preference = F.struct(F.when(F.col("home_away") == "home", 0).otherwise(1).alias("h"), F.col("source_team_id"), F.col("id"))
    per_score = rows.groupBy("canonical_id", "score_team", "score_opponent").agg(
        F.count("*").alias("n"), F.min(place).alias("place")
    ).where(F.col("score_team").isNotNull())
    first = F.min_by(F.struct("score_team", "score_opponent", "n"), "place")
    scores = per_score.groupBy("canonical_id").agg(
        first.alias("first"), F.sum("n").alias("scored"),
        F.collect_list(F.struct(F.col("score_team").alias("t"), F.col("score_opponent").alias("o"), F.col("n").alias("n"))).alias("all"),
    )
    others = F.filter(
        F.transform("all", lambda s: F.struct(
            s["t"].alias("t"), s["o"].alias("o"),
            (s["n"] - F.when((s["t"] == F.col("first.score_team")) & (s["o"].eqNullSafe(F.col("first.score_opponent"))), 1).otherwise(0)).alias("n"),
        )),
        lambda s: s["n"] > 0,
    )
    consistent = F.forall(others, lambda s: s["t"].eqNullSafe(F.col("first.score_opponent")) & s["o"].eqNullSafe(F.col("first.score_team")))
    scores = scores.select("canonical_id", consistent.alias("consistent"))
    grouped = rows.groupBy("canonical_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("source_team_id").alias("owners"),
        F.array_sort(F.array_union(F.collect_set("source_team_id"), F.collect_set("opponent_team_id"))).alias("team_ids"),
        F.array_sort(F.collect_set("source_team_name")).alias("team_names"),
        F.count_distinct(F.coalesce("start_ts", F.lit(""))).alias("starts"),
        F.count_distinct(F.coalesce("game_status", F.lit(""))).alias("statuses"),
        count_if(F.col("home_away") == "home").alias("homes"),
        count_if(F.col("home_away") == "away").alias("aways"),
        F.array_sort(F.collect_list("id")).alias("source_game_ids"),
        F.min_by(F.struct("season", "start_ts", "game_status", "id", "score_team", "score_opponent"), preference).alias("best"),
    ).join(scores, "canonical_id", "left")
    teams = F.size("team_ids")
    flags = F.array_compact(F.array(
        F.when(F.col("n") != 2, F.concat(F.lit("source_row_count_"), F.col("n").cast("string"))),
        F.when(F.col("owners") != 2, F.concat(F.lit("source_owner_count_"), F.col("owners").cast("string"))),
        F.when(teams != 2, F.concat(F.lit("team_count_"), teams.cast("string"))),
        F.when(F.col("starts") != 1, "start_time_mismatch"),
        F.when(F.col("statuses") != 1, "status_mismatch"),
        F.when((F.col("n") == 2) & ~((F.col("homes") == 1) & (F.col("aways") == 1)), "home_away_mismatch"),
        F.when(~F.coalesce("consistent", F.lit(True)), "score_mismatch"),
    ))
    return grouped.select(
        "canonical_id", F.col("best.season").alias("season"), "team_ids", "team_names", F.col("best.start_ts").alias("start_ts"),
        F.col("best.game_status").alias("status"), F.col("best.id").alias("preferred_source_game_id"), "source_game_ids",
        F.col("best.score_team").alias("score_team"), F.col("best.score_opponent").alias("score_opponent"), flags.alias("quality_flags"),
    )


def crosswalk(rows: DataFrame) -> DataFrame:
    return rows.select(
        "canonical_id", "season", "source_team_id", "source_team_name", F.col("id").alias("source_game_id"), "home_away",
        F.col("game_status").alias("status"), "start_ts",
    )


def schedule_audit(resolved: DataFrame, contests: DataFrame) -> DataFrame:
    rows = resolved.agg(
        F.count("*").alias("source_schedule_rows"),
        count_if(F.col("opponent_team_id").isNotNull()).alias("resolved_source_rows"),
        count_if(F.col("opponent_team_id").isNull()).alias("unresolved_source_rows"),
    )
    games = contests.agg(F.struct(
        F.count("*").alias("canonical_contests"),
        count_if(F.col("status") == "completed").alias("completed_canonical_contests"),
        (F.count("*") - F.count_distinct("canonical_id")).alias("duplicate_canonical_ids"),
        count_if(F.size("quality_flags") > 0).alias("contests_with_quality_flags"),
    ).alias("g")).scalar()
    return rows.withColumn("g", games).select("*", "g.*").drop("g")


def flag_counts(contests: DataFrame) -> DataFrame:
    return contests.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("contests"))


def schedule_summary(schedule: DataFrame) -> DataFrame:
    """Rows and completed rows per season and team."""
    return schedule.groupBy("season", "source_team_id").agg(
        F.count("*").alias("games"), count_if(F.col("game_status") == "completed").alias("completed")
    )


def capture_worklist(contests: DataFrame, captured: DataFrame, first: int) -> DataFrame:
    """Completed contests without a captured artifact, in schedule order, the first ``first``."""
    missing = contests.where(F.col("status") == "completed").join(captured.select("canonical_id"), "canonical_id", "left_anti")
    return missing.select(
        "canonical_id", "season", F.get("team_names", F.lit(0)).alias("team"), "start_ts", "preferred_source_game_id"
    ).orderBy("season", "team", "start_ts", "canonical_id").limit(first)


# --- official schedule -------------------------------------------------------------------

# fixed values: season ids of the official feed
SEASON_IDS = {2025: 270, 2026: 369}


def season_of(season_id: Column, season_ids: dict[int, int] = SEASON_IDS) -> Column:
    """Season of a season id; an unknown id fails the job."""
    season = F.try_element_at(literal_map({v: k for k, v in season_ids.items()}), season_id.cast("int"))
    return F.coalesce(season, F.raise_error(F.concat(F.lit("unknown season id "), F.coalesce(season_id.cast("string"), F.lit("null")))).cast("int"))


def completed_games(games: DataFrame, season_ids: dict[int, int] = SEASON_IDS) -> DataFrame:
    """Completed games whose season id belongs to their season; a season without an id fails the job."""
    legal = F.try_element_at(literal_map(season_ids), F.col("season").cast("int"))
    known = F.coalesce(legal, F.raise_error(F.concat(F.lit("no season id for "), F.coalesce(F.col("season").cast("string"), F.lit("null")))).cast("int"))
    return games.where((F.col("record_status") == "Completed") & (F.col("season_id") == known))


def official_contests(competitors: DataFrame, prefix: str = "official") -> DataFrame:
    """Contest rows of the official feed: both teams and a team -> score map.

    ``competitors``: season, game_id, game_ts, team, competitor_id, home_team_id, home_score,
    away_score (two rows per game).
    """
    is_home = F.col("competitor_id") == F.col("home_team_id")
    score = F.coalesce(F.when(is_home, F.col("home_score")).otherwise(F.col("away_score")), F.lit(0))
    return (
        competitors.withColumn("score", score)
        .groupBy("season", "game_id", "game_ts")
        .agg(
            F.array_sort(F.collect_list("team")).alias("team_names"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("team", "score")))).alias("score"),
        )
        .withColumn("canonical_id", F.concat_ws("-", F.lit(prefix), F.col("season").cast("string"), F.col("game_id").cast("string")))
        .withColumn("status", F.lit("completed"))
    )


def match_official(contests: DataFrame, official: DataFrame) -> DataFrame:
    """Official game of every completed contest: unique exact score, else unique nearest start.

    ``contests``: canonical_id, teams (sorted array), start_ts, scores (sorted array or NULL).
    ``official``: game_id, teams, game_ts, scores; completed games only. Candidates share the
    teams and lie within one calendar day. Neither rule forms pairs: exact scores are counted
    per (teams, day, scores), and the nearest start comes from carrying the previous and next
    official start over the union of both sides per (teams, day). ``match_method`` is NULL
    where no candidate or no unique nearest exists; :func:`require_matches` raises on those.
    """
    # an official game is a candidate for the day before, its own day and the day after
    day = F.to_date("game_ts")
    candidates = official.select(
        "teams", "game_id", F.col("game_ts").alias("at"), F.coalesce(F.array_join("scores", "-"), F.lit("none")).alias("scores"),
        F.explode(F.array(F.date_sub(day, 1), day, F.date_add(day, 1))).alias("day"),
    )
    games = contests.select(
        "canonical_id", "teams", "start_ts", F.coalesce(F.array_join("scores", "-"), F.lit("none")).alias("scores"), F.to_date("start_ts").alias("day")
    )
    exact = candidates.groupBy("teams", "day", "scores").agg(F.count("*").alias("same"), F.min("game_id").alias("exact_id"))
    starts = candidates.groupBy("teams", "day", "at").agg(F.count("*").alias("n"), F.min("game_id").alias("id"))
    both = starts.select("teams", "day", F.col("at"), F.struct("at", "n", "id").alias("o"), F.lit(None).cast("string").alias("canonical_id")).unionByName(
        games.select("teams", "day", F.col("start_ts").alias("at"), F.lit(None).cast(starts.select(F.struct("at", "n", "id").alias("o")).schema["o"].dataType).alias("o"), "canonical_id")
    )
    # officials sort before contests of the same instant, so "previous" includes equal starts
    order = [F.col("at"), F.col("canonical_id").asc_nulls_first()]
    w = Window.partitionBy("teams", "day").orderBy(*order)
    near = both.withColumns({
        "prev": F.last("o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.first("o", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    }).where(F.col("canonical_id").isNotNull())

    def micros(name):
        return F.unix_micros(F.col(name).cast("timestamp"))

    gap_prev, gap_next = micros("at") - micros("prev.at"), micros("next.at") - micros("at")
    near = near.withColumns({"gp": gap_prev, "gn": gap_next})
    use_prev = F.col("gn").isNull() | (F.col("gp") < F.col("gn"))
    use_next = F.col("gp").isNull() | (F.col("gn") < F.col("gp"))
    chosen = F.when(F.col("prev").isNotNull() & use_prev, F.col("prev")).when(F.col("next").isNotNull() & use_next, F.col("next"))
    near = near.withColumn("pick", chosen).select(
        "canonical_id", F.when(F.col("pick.n") == 1, F.col("pick.id")).alias("nearest_id")
    )
    joined = games.join(exact, ["teams", "day", "scores"], "left").join(near, "canonical_id", "left")
    unique = F.coalesce(F.col("same") == 1, F.lit(False))
    return joined.select(
        "canonical_id",
        F.when(unique, F.col("exact_id")).otherwise(F.col("nearest_id")).alias("official_game_id"),
        F.when(unique, "teams_date_score")
        .when(F.col("nearest_id").isNotNull(), "teams_datetime_nearest_score_disagreement")
        .alias("match_method"),
    )


def require_matches(matches: DataFrame) -> DataFrame:
    """Fail the job on a contest without a unique official game."""
    message = F.concat(F.lit("official schedule match is not unique for "), F.col("canonical_id"))
    checked = F.when(F.col("match_method").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("match_method"))
    return matches.withColumn("match_method", checked)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def assign_series(games: DataFrame, gap_days: int = 4) -> DataFrame:
    """Series id and game number.

    Regular games of (season, teams, venue) start a new series after more than ``gap_days``
    calendar days; postseason games follow the official series id. Games are first counted
    per calendar day, so the running logic sees at most one row per group and day; inside a
    day games are numbered by start.

    ``games``: canonical_id, season, teams (sorted array), venue, game_ts, game_type,
    official_series_id, official_series_game, series_type, and columns to keep.
    """
    post = (F.coalesce("game_type", F.lit("")) == "PS") | F.col("official_series_id").isNotNull()
    joined_teams = F.array_join("teams", "-")
    group = F.when(
        post,
        F.concat_ws("-", F.col("season").cast("string"), F.lit("ps"), joined_teams,
                    slug(F.coalesce("series_type", F.lit("postseason"))), F.coalesce("official_series_id", F.lit(0)).cast("string")),
    ).otherwise(
        F.concat_ws("-", F.col("season").cast("string"), F.lit("rs"), joined_teams, slug(F.coalesce("venue", F.lit("unknown-venue"))))
    )
    rows = games.withColumns({"_post": post, "_group": group, "_day": F.to_date("game_ts")})
    days = rows.groupBy("_group", "_post", "_day").agg(F.count("*").alias("n"))
    by_day = Window.partitionBy("_group").orderBy("_day")
    gap = F.datediff(F.col("_day"), F.lag("_day").over(by_day))
    started = days.withColumn("_new", F.when(F.col("_post"), 0).when(gap > gap_days, 1).otherwise(0))
    numbered = started.withColumn("_cluster", F.sum("_new").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    cluster = Window.partitionBy("_group", "_cluster").orderBy("_day")
    numbered = numbered.select(
        "_group", "_day",
        F.first("_day").over(cluster).alias("_first"),
        F.coalesce(F.sum("n").over(cluster.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    within = Window.partitionBy("_group", "_day").orderBy("game_ts", "canonical_id")
    placed = rows.withColumn("_place", F.row_number().over(within)).join(numbered, ["_group", "_day"])
    inferred = (F.col("_before") + F.col("_place")).cast("int")
    given = F.when(F.col("_post"), F.nullif(F.col("official_series_game"), F.lit(0)))
    return placed.withColumns({
        "series_id": F.when(F.col("_post"), F.col("_group")).otherwise(F.concat_ws("-", "_group", F.col("_first").cast("string"))),
        "series_game_number": F.coalesce(given, inferred),
        "series_source": F.when(~F.col("_post"), "official_teams_venue_date_cluster")
        .when(given.isNotNull(), "official_postseason_series_id")
        .otherwise("official_postseason_chronology"),
    }).drop("_post", "_group", "_day", "_first", "_before", "_place")


# --- names and cleanup -------------------------------------------------------------------

def identity_audit(rows: DataFrame, *keys: str) -> DataFrame:
    """Names, teams and seasons seen under each person key (few per person)."""
    return rows.groupBy("player_key").agg(
        F.array_sort(F.collect_set("player")).alias("names"),
        F.array_sort(F.collect_set("team")).alias("teams"),
        F.array_sort(F.collect_set("season")).alias("seasons"),
    )


def jersey_roster(rows: DataFrame) -> DataFrame:
    """Longest name seen per team and jersey number; the number comes from the info text.

    ``rows``: team, name, info.
    """
    number = F.regexp_extract(F.coalesce("info", F.lit("")), r"#?\s*(\d{1,3})\b", 1)
    return (
        rows.withColumn("jersey", number).where(F.col("jersey") != "")
        .groupBy("team", "jersey")
        .agg(F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("name"))
    )


def player_directory(players: DataFrame) -> DataFrame:
    """One row per player over all periods; the current-roster row gives team and positions.

    ``players``: player_key, player, season, team, positions, current (BOOLEAN).
    """
    newest = F.struct("current", "season", "team")
    return players.groupBy("player_key").agg(
        F.max_by("player", newest).alias("player"),
        F.max_by("team", newest).alias("team"),
        F.max_by("positions", newest).alias("positions"),
        F.bool_or("current").alias("current"),
        F.array_sort(F.collect_set("season")).alias("seasons"),
    )


def display_date(text: Column) -> Column:
    """ISO or written dates as M/D; M/D and unknown forms stay; nothing gives "Unknown Date"."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    parts = [F.regexp_extract(trimmed, r"^(\d{4})-(\d{2})-(\d{2})", group).try_cast("int") for group in (2, 3)]
    iso = F.concat(parts[0].cast("string"), F.lit("/"), parts[1].cast("string"))
    words = F.regexp_replace(trimmed, r"([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4}).*$", "$1 $2 $3")
    written = F.date_format(F.try_to_date(words, "MMM d yyyy"), "M/d")
    return F.when(trimmed == "", "Unknown Date").otherwise(F.coalesce(iso, written, trimmed))


def clean_url(url: Column) -> Column:
    """URL without one trailing slash and without the query part."""
    return F.substring_index(F.regexp_replace(F.trim(url), "/$", ""), "?", 1)
