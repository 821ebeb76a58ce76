"""Events from the official feed of plays.

The feed gives innings, outs, scores, batter and pitcher ids; names in its narratives are short. Outs
and runs are taken from the feed, bases come from the same fold over the moments of a
half-inning as for displayed plays. Positions are followed through the substitutions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basepaths import schema as S
from basepaths.functions import text as X
from basepaths.functions.identity import literal_map, person_key
from basepaths.operators import events as E
from basepaths.session import cut_by


def short_names(player: Column, stat_name: Column) -> Column:
    """Names a narrative may use: initial and surname; and given name and surname where the box has 'surname, given'."""
    first, surname = F.substring_index(player, " ", 1), F.regexp_extract(player, r"^\S* ?(.*)$", 1)
    listed = F.trim(F.substring_index(stat_name, ",", 1))
    given = F.regexp_replace(F.trim(F.regexp_extract(stat_name, r",(.*)$", 1)), r"\.+$", "")
    return F.array_compact(F.array(
        F.concat(F.substring(first, 1, 1), F.lit(" "), surname),
        F.when(F.contains(F.coalesce(stat_name, F.lit("")), F.lit(",")), F.concat(given, F.lit(" "), listed)),
    ))


def people_of_games(people: DataFrame) -> DataFrame:
    """Per game: names (longest first), aliases, the team of every person and players by id.

    ``people``: canonical_id, person_id, player, stat_name, team.
    """
    people = people.repartition("canonical_id")
    aliases = F.transform(short_names(F.col("player"), F.col("stat_name")), lambda a: F.struct(a.alias("alias"), F.col("player").alias("name")))
    named = people.select("canonical_id", "player", "team").distinct().groupBy("canonical_id").agg(
        E.longest_first(F.array_sort(F.collect_set("player"))).alias("names"),
        F.map_from_entries(F.array_sort(F.collect_set(F.struct(person_key(F.col("player")).alias("key"), "team")))).alias("team_of"),
    )
    short = people.select("canonical_id", F.explode(aliases).alias("a")).groupBy("canonical_id").agg(F.array_sort(F.collect_set("a")).alias("aliases"))
    ids = people.where("person_id is not null").groupBy("canonical_id", F.col("person_id").cast("string").alias("id")).agg(F.max("player").alias("player"))
    known = ids.groupBy("canonical_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "player"))).alias("player_of"))
    return named.join(short, "canonical_id", "left").join(known, "canonical_id", "left")


def mentioned(text: Column, aliases: Column) -> Column:
    """The aliases that occur in ``text``, so that only these are replaced."""
    known = F.coalesce(aliases, F.array().cast("array<struct<alias:string,name:string>>"))
    return X.let(F.lower(text), lambda low: F.filter(known, lambda a: F.contains(low, F.lower(a["alias"]))))


def action_position(action: Column) -> Column:
    """Position of the first fielder in an action code."""
    digit = F.regexp_extract(F.regexp_replace(F.upper(F.coalesce(action, F.lit(""))), S.ACTION_HEAD, ""), "[1-9]", 0)
    return F.try_element_at(literal_map({str(n): name for n, name in S.POSITION_NUMBERS.items()}), digit)


def told_position(text: Column) -> Column:
    """The position somebody moves to."""
    codes = {code.lower(): name for code, name in S.POSITION_CODES.items()}
    return F.try_element_at(literal_map(codes), F.regexp_extract(F.lower(text), r"\bto (" + "|".join(codes) + r")\b", 1))


def read_feed(plays: DataFrame, people: DataFrame, tasks: int | None = None) -> DataFrame:
    """Plays with names, full-name text, runs, half-innings, what kind of play each one is, and all that its text tells.

    Texts are read once: the result is a written table. Games are dealt out once, to ``tasks`` (as many as shuffles have
    if None), and stay together from then on.

    ``plays``: canonical_id, season, play_seqno, inning, is_top, batting_team, fielding_team, outs, team_score,
    batter_id, pitcher_id, action, narrative. Rows with a negative or null play_seqno are no plays.
    """
    in_order = Window.partitionBy("canonical_id").orderBy("play_seqno")
    side = F.struct("inning", "is_top")
    tasks = tasks or int(plays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = E.official_runs(plays.repartition(tasks, "canonical_id").withColumn("team_score", F.coalesce("team_score", F.lit(0))))
    known = scored.join(people_of_games(people), "canonical_id", "left").withColumn(
        "text", E.expand_names(F.col("narrative"), mentioned(F.coalesce("narrative", F.lit("")), F.col("aliases")))
    )
    named = known.withColumns({role: F.try_element_at("player_of", F.col(f"{role}_id").cast("string")) for role in ("batter", "pitcher")})
    is_pa = F.col("batter_id").isNotNull() & F.col("pitcher_id").isNotNull()
    low = F.lower("text")
    moves = F.when(low.contains("caught stealing"), "caught_stealing").when(low.contains(" steals "), "stolen_base").when(
        low.contains("wild pitch"), "wild_pitch").when(low.contains("passed ball"), "passed_ball").when(low.contains(" advances to "), "runner_advance")
    told = (
        named.withColumn("_new", F.when(~side.eqNullSafe(F.lag(side).over(in_order)), 1).otherwise(0))
        .withColumn("half_index", (F.sum("_new").over(in_order) - 1).cast("int"))
        .withColumns({
            "is_plate_appearance": is_pa, "runner_type": F.when(~is_pa, moves), "half": F.when(F.col("is_top"), "top").otherwise("bottom"),
            "mover": E.name_at_start(F.col("text"), F.col("names")), "mover_to": told_position(F.col("text")),
            "clauses": E.runner_clauses(F.col("text"), F.col("names")),
        })
        .withColumns({"mover_team": F.try_element_at("team_of", person_key(F.col("mover"))), "clauses": E.in_effect(F.col("clauses"))})
        .drop("_new", "aliases", "names", "team_of", "player_of")
    )
    return cut_by(told, "canonical_id", tasks)


def lineup_moves(read: DataFrame) -> DataFrame:
    """Who moves to which position, and when."""
    return read.where("mover is not null and mover_to is not null and mover_team is not null").select(
        "canonical_id", F.col("mover_team").alias("team"), F.col("mover_to").alias("position"), F.col("mover").alias("player"), F.col("play_seqno").alias("seq")
    )


def feed_events(plays: DataFrame, people: DataFrame, starters: DataFrame, tasks: int | None = None) -> DataFrame:
    """Feed plays as events, with source_kind, official_action and state_errors.

    ``starters``: canonical_id, team, position, player. Kept are plate appearances (both ids are there) and
    plays that move runners. outs_before is the feed's; runs are the growth of the team's score; the
    first fielder of the action code, if somebody holds that position, is told at the end of the text.
    """
    read = read_feed(plays, people, tasks)
    kept = read.where("is_plate_appearance or runner_type is not null").withColumns({
        "row_no": F.col("play_seqno").cast("int"), "position": action_position(F.col("action")),
        "play_type": F.when(F.col("is_plate_appearance"), X.official_play_type(F.col("action"), F.col("text"))),
        "feed_outs": F.coalesce(F.col("outs"), F.lit(0)).cast("int"),
    })
    nothing = F.array().cast(kept.schema["clauses"].dataType)
    typed = kept.withColumns({
        "ended": F.lit(False), "pinch": F.lit(None).cast("struct<new:string,old:string>"),
        "runner_clauses": F.when(~F.col("is_plate_appearance"), F.col("clauses")).otherwise(nothing),
        "play_clauses": F.when(F.col("is_plate_appearance"), F.col("clauses")).otherwise(nothing),
        "destination": X.batter_destination(F.col("play_type")), "play_outs": X.outs_on_play(F.col("play_type"), F.col("text")),
    })
    folded = E.fold_states(typed).drop("runs_scored", "batter", "is_plate_appearance")
    asked = kept.where("position is not null").select("canonical_id", F.col("fielding_team").alias("team"), "position", F.col("play_seqno").alias("seq"))
    holder = E.active_lineup(starters, lineup_moves(read), asked).select(
        "canonical_id", F.col("seq").cast("int").alias("row_no"), F.col("player").alias("fielder")
    )
    told = F.when(F.col("fielder").isNotNull(), F.concat(F.col("text"), F.lit(" Fielded by "), "position", F.lit(" "), "fielder", F.lit("."))).otherwise(F.col("text"))
    facts = kept.join(holder, ["canonical_id", "row_no"], "left").select(
        "canonical_id", "row_no", "season", "inning", "half", "batting_team", "fielding_team", "batter", "pitcher", "is_plate_appearance",
        F.col("runs_scored").cast("int").alias("runs_scored"), told.alias("play_text"), F.col("action").alias("official_action"),
    )
    in_game = Window.partitionBy("canonical_id").orderBy("display_row_index")
    events = folded.drop("step").join(facts, ["canonical_id", "row_no"]).withColumnRenamed("row_no", "display_row_index").withColumns({
        "event_order": F.row_number().over(in_game).cast("int"), "pitch_text": X.official_pitch_text(F.col("play_text"), F.col("is_plate_appearance")),
        "source_kind": F.lit("official_feed"),
    })
    return events.select(*S.EVENTS.names, "source_kind", "official_action", "state_errors")


def feed_audit(events: DataFrame, schedule: DataFrame) -> DataFrame:
    """Per game of ``schedule`` (canonical_id, season, expected_runs): events, plate appearances, runs against the final score, state errors."""
    seen = events.groupBy("canonical_id").agg(
        F.count("*").alias("events"), F.count_if("is_plate_appearance").alias("plate_appearances"), F.sum("runs_scored").alias("observed_runs"),
        F.sum("state_errors").alias("state_invariant_error_count"),
    )
    counts = ["events", "plate_appearances", "observed_runs", "state_invariant_error_count"]
    return schedule.join(seen, "canonical_id", "left").na.fill(0, counts).withColumn("run_difference", F.col("observed_runs") - F.col("expected_runs"))
