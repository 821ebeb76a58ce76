"""Stage tables shared by the registered queries.

``events``, ``valued`` (with run values, runner states and parsed text) and
``plate_appearances`` (with exposure counters) are the natural cuts of the data flow: many
queries read them, so they are written once per application to the shared folder, partitioned
by season and bucketed by game, so that joins and windows per game read them without another shuffle.
Small results many queries share (24 cells, constants, player tables) are written
the same way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basepaths.operators import contests, expectancy, exposure, value
from basepaths.session import DROP_SHUFFLES, fresh_path, settings
from basepaths.sources import fixtures

_WRITTEN: dict[tuple[str, str, str], tuple[str, object]] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build, values: dict[str, str] | None = None) -> DataFrame:
    """The stage table ``name``, written with the settings ``values`` if it is not there yet."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        df = build(spark, sf_dir)
        path = fresh_path(spark, name)
        writer = df.write.partitionBy("season") if len(df.columns) > 12 and "season" in df.columns else df.write
        with settings(spark, {DROP_SHUFFLES: "true"} | (values or {})):
            writer.parquet(path)
        _WRITTEN[key] = (path, df.schema)
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def game_tasks(spark, sf_dir) -> int:
    """Buckets by game: as many as shuffles have partitions, more where a bucket, which one task sorts, would pass 100,000 events."""
    events = fixtures.table(spark, sf_dir, "events").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events // 100_000))


def game_stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stage table dealt out by ``canonical_id`` and bucketed by it, so that Spark knows where a game's rows are."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        tasks = game_tasks(spark, sf_dir)
        df, table = build(spark, sf_dir, tasks), f"{name}_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").partitionBy("season").bucketBy(tasks, "canonical_id")
        writer.option("path", fresh_path(spark, name)).saveAsTable(table)
        _WRITTEN[key] = (table, df.columns)
    table, columns = _WRITTEN[key]
    return spark.table(table).select(*columns)


def pbp(spark, sf_dir) -> DataFrame:
    """The stored event table, clustered by game within its seasons."""
    return game_stage(spark, sf_dir, "events", fixtures.pbp_by_game)


def view(spark, sf_dir, name) -> DataFrame:
    """A stored grouping of the event table (games, schedule, box scores)."""
    source = "fx_games" if "from fx_games" in fixtures.VIEWS[name] else None
    return stage(
        spark, sf_dir, name,
        lambda s, d: fixtures.view(s, name, view(s, d, source) if source else pbp(s, d)),
    )


def annotated(spark, sf_dir) -> DataFrame:
    return expectancy.annotate_runs_remaining(pbp(spark, sf_dir))


def re24(spark, sf_dir) -> DataFrame:
    return stage(spark, sf_dir, "re24", lambda s, d: expectancy.estimate_re24(annotated(s, d)))


def _build_valued(spark, sf_dir, tasks) -> DataFrame:
    # names are joined first, while the rows are narrow
    listed = value.with_listed_names(pbp(spark, sf_dir), rosters(spark, sf_dir))
    valued_rows = expectancy.add_run_values(fixtures.with_state(listed), re24(spark, sf_dir))
    return value.parse_listed(valued_rows).repartition(tasks, "canonical_id")


def valued(spark, sf_dir) -> DataFrame:
    return game_stage(spark, sf_dir, "valued", _build_valued)


def plate_appearances(spark, sf_dir) -> DataFrame:
    return game_stage(
        spark, sf_dir, "plate_appearances", lambda s, d, tasks: build_plate_appearances(s, d).repartition(tasks, "canonical_id")
    )


def series(spark, sf_dir) -> DataFrame:
    """Series id and start of every game, from the schedule view."""
    games = view(spark, sf_dir, "fx_official").select(
        F.concat(F.lit("g"), F.lpad(F.col("game_id").cast("string"), 6, "0")).alias("canonical_id"),
        F.col("game_id"), "season", "game_ts", "game_type", F.col("series_no").alias("official_series_id"),
        F.lit(None).cast("int").alias("official_series_game"), F.lit(None).cast("string").alias("series_type"),
        F.array_sort(F.array("home_team", "away_team")).alias("teams"), "venue",
    )
    return contests.assign_series(games)


def build_plate_appearances(spark, sf_dir) -> DataFrame:
    rows = valued(spark, sf_dir)
    constants = value.woba_constants(rows, keys=())
    weights = expectancy.event_linear_weights(rows.where("is_plate_appearance"))
    return exposure.derive_exposures(rows, series(spark, sf_dir), weights, constants)


def constants(spark, sf_dir) -> DataFrame:
    return stage(spark, sf_dir, "constants", lambda s, d: value.woba_constants(valued(s, d)))


def offense(spark, sf_dir) -> DataFrame:
    return stage(spark, sf_dir, "offense", lambda s, d: value.aggregate_offense(valued(s, d), constants(s, d)))


def opportunities(spark, sf_dir) -> DataFrame:
    return stage(
        spark, sf_dir, "opportunities",
        lambda s, d: value.advancement_opportunities(value.advancement_candidates(valued(s, d), re24(s, d))),
    )


def rosters(spark, sf_dir) -> DataFrame:
    rows = pbp(spark, sf_dir).select(
        "canonical_id", F.explode(F.array("batter", "pitcher", "fielder")).alias("name")
    )
    return value.game_rosters(rows)


def box_pitching(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "fx_box_pitching").select(
        "season", "canonical_id", F.col("fielding_team").alias("team"), F.col("pitcher").alias("player"),
        F.col("pitcher_key").alias("player_key"), (F.col("outs") / 3.0).alias("innings_decimal"),
        F.col("h").alias("H"), F.col("r").alias("R"), F.col("er").alias("ER"), F.col("bb").alias("BB"),
        F.col("so").alias("SO"), F.col("hr").alias("HR"), F.col("bf").alias("BF"), "list_ordinal",
    )


def box_hitting(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "fx_box_hitting").select(
        "season", "canonical_id", F.col("batting_team").alias("team"), F.col("batter").alias("player"),
        F.col("batter_key").alias("player_key"), "position", F.col("r").alias("R"), F.col("h").alias("H"),
        F.col("pa").alias("PA"), "list_ordinal",
    )


def catching(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "fx_catchers").select(
        "season", F.col("catcher").alias("player"), value.person_key(F.col("catcher")).alias("player_key"), "team", "sb", "cs"
    )


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places without negative zero; arrays as joined text."""
    columns = []
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind == "double":
            columns.append((F.round(field.name, 6) + F.lit(0.0)).alias(field.name))
        elif kind == "array":
            columns.append(F.array_join(field.name, "|").alias(field.name))
        else:
            columns.append(F.col(f"`{field.name}`"))
    return df.select(*columns)
