"""Nested season documents: schedules, season statistics and box scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basepaths.functions.identity import person_key
from basepaths.functions.lines import ratio
from basepaths.functions.text import innings_to_decimal, listed_position

FIELDING = T.ArrayType(T.StructType([
    T.StructField("position", T.StringType()), T.StructField("totalChances", T.LongType()), T.StructField("putOuts", T.LongType()),
    T.StructField("assists", T.LongType()), T.StructField("errors", T.LongType()), T.StructField("stolenBases", T.LongType()),
    T.StructField("caughtStealing", T.LongType()), T.StructField("inningsPlayed", T.DoubleType()),
]))
PLAYER = T.StructType([
    T.StructField("firstName", T.StringType()), T.StructField("lastName", T.StringType()), T.StructField("franchiseName", T.StringType()),
    T.StructField("primaryPosition", T.StructType([T.StructField("shortDescription", T.StringType())])),
    T.StructField("battingStats", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))),
    T.StructField("pitchingStats", T.ArrayType(T.MapType(T.StringType(), T.DoubleType()))),
    T.StructField("fieldingStats", FIELDING),
])
SEASON_STATS = T.StructType([T.StructField("seasonId", T.IntegerType()), T.StructField("stats", T.ArrayType(PLAYER))])
GAME = T.StructType([
    T.StructField("gameId", T.LongType()), T.StructField("seasonId", T.IntegerType()), T.StructField("gameDateIso", T.TimestampType()),
    T.StructField("recordStatus", T.StringType()), T.StructField("homeTeamId", T.LongType()), T.StructField("homeTeamScore", T.IntegerType()),
    T.StructField("awayTeamScore", T.IntegerType()),
    T.StructField("competitors", T.ArrayType(T.StructType([T.StructField("eventTeamId", T.LongType()), T.StructField("name", T.StringType())]))),
])
SCHEDULE = T.StructType([T.StructField("games", T.ArrayType(GAME))])


def read_documents(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """JSON documents with a declared schema; one document per line splits across tasks."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=multiline)


def season_players(documents: DataFrame, season_ids: dict[int, int]) -> DataFrame:
    """Player rows of the season documents; an unexpected season id fails the job."""
    season = F.lit(None).cast("int")
    for year, season_id in season_ids.items():
        season = F.when(F.col("seasonId") == season_id, year).otherwise(season)
    message = F.concat(F.lit("unexpected season id "), F.col("seasonId").cast("string"))
    checked = F.coalesce(season, F.raise_error(message).cast("int"))
    return documents.select(checked.alias("season"), F.explode("stats").alias("s")).select("season", "s.*")


def schedule_games(documents: DataFrame) -> DataFrame:
    return documents.select(F.explode("games").alias("g")).select("g.*")


def player_map(players: DataFrame) -> DataFrame:
    """One row per player and season: first lines, positions with the primary first, summed fielding."""
    fielding = F.coalesce("fieldingStats", F.array().cast(FIELDING))

    def total(field: str, only: str | None = None) -> Column:
        rows = F.filter(fielding, lambda r: r["position"] == only) if only else fielding
        return F.aggregate(rows, F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r[field], F.lit(0)))

    listed = F.array_distinct(F.filter(F.transform(fielding, lambda r: F.trim(r["position"])), lambda p: F.coalesce(p, F.lit("")) != ""))
    primary = F.trim(F.coalesce(F.col("primaryPosition.shortDescription"), F.lit("")))
    positions = F.when((primary != "") & ~F.array_contains(listed, primary), F.concat(F.array(primary), listed)).otherwise(listed)
    out = players.select(
        "season", person_key(F.concat("firstName", "lastName")).alias("player_key"), F.trim(F.concat_ws(" ", "firstName", "lastName")).alias("player"),
        F.col("franchiseName").alias("team"), positions.alias("positions"), F.get("battingStats", F.lit(0)).alias("batting"),
        F.get("pitchingStats", F.lit(0)).alias("pitching"), total("errors").alias("errors"), total("putOuts").alias("put_outs"),
        total("assists").alias("assists"), total("totalChances").alias("total_chances"), total("stolenBases", "C").alias("stolen_bases_allowed"),
        total("caughtStealing", "C").alias("caught_stealing"),
    )
    return out.withColumn("fielding_pct", ratio(F.col("put_outs") + F.col("assists"), "total_chances"))


def box_rows(games: DataFrame) -> DataFrame:
    """Two nested sections as one long table with list places, innings and position read.

    ``games``: canonical_id, season, hitting and pitching arrays of structs.
    """
    bats = games.select("canonical_id", "season", F.posexplode("hitting").alias("n", "r")).select(
        "canonical_id", "season", F.lit("hitting").alias("role"), (F.col("n") + 1).alias("list_ordinal"), "r.*"
    ).withColumn("position", listed_position(F.col("Info")))
    arms = games.select("canonical_id", "season", F.posexplode("pitching").alias("n", "r")).select(
        "canonical_id", "season", F.lit("pitching").alias("role"), (F.col("n") + 1).alias("list_ordinal"), "r.*"
    ).withColumn("innings_decimal", innings_to_decimal(F.col("IP")))
    return bats.unionByName(arms, allowMissingColumns=True).withColumn("player_key", person_key(F.col("Player")))


def supplemental_rows(boxes: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Box rows of games not present yet, and one audit row per added game."""
    added = boxes.join(existing.select("canonical_id").distinct(), "canonical_id", "left_anti")
    audit = added.groupBy("season", "canonical_id").agg(
        F.count_if(F.col("role") == "hitting").alias("hitting_rows"), F.count_if(F.col("role") == "pitching").alias("pitching_rows")
    )
    return added, audit


def latest_snapshot(snapshots: DataFrame, override: str | None = None) -> DataFrame:
    """Rows of the newest snapshot, or of the named one; the id is a partition column."""
    wanted = F.lit(override) if override else snapshots.agg(F.max("snapshot_id")).scalar()
    return snapshots.where(F.col("snapshot_id") == wanted)

