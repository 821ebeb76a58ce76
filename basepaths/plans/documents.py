"""Source and sink queries: data derived from the events is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from basepaths.operators import contests as C
from basepaths.plans import inputs as I
from basepaths.plans import scouting as PS
from basepaths.plans import value as PV
from basepaths.plans.registry import cte, query
from basepaths.session import fresh_path
from basepaths.sources import documents as D
from basepaths.sources import manifest as M
from basepaths.sources import pages as G
from basepaths.sources import sinks as K

_IDS = {2025: 270, 2026: 369}
_MADE = "event_type in ('out','double_play','fielders_choice','sacrifice_fly','sacrifice_bunt','infield_fly')"


def _written(spark, sf, name, build):
    """Path of a document folder written once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PATHS:
        _PATHS[key] = fresh_path(spark, name)
        build(spark, sf).write.json(_PATHS[key])
    return _PATHS[key]


_PATHS: dict[tuple[str, str, str], str] = {}


def _stat_documents(spark, sf):
    """Season statistics, one document per season and team, with a fielding list per player."""
    lines = I.pbp(spark, sf).groupBy("season", "fielding_team", "fielder", F.expr("g % 2").alias("part"), F.expr("upper(substr(position, 1, 1))").alias("position")).agg(
        F.count("*").alias("totalChances"), F.count_if(F.expr(_MADE)).alias("putOuts"), F.count_if(F.expr("r % 5 = 0")).alias("assists"),
        F.count_if(F.col("event_type") == "reached_on_error").alias("errors"), F.count_if(F.col("event_type") == "stolen_base").alias("stolenBases"),
        F.count_if(F.col("event_type") == "caught_stealing").alias("caughtStealing"),
    )
    fields = ["part", "position", "totalChances", "putOuts", "assists", "errors", "stolenBases", "caughtStealing"]
    players = lines.groupBy("season", "fielding_team", "fielder").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("fieldingStats"))
    number = F.regexp_extract("fielder", "N(.*)$", 1).cast("int")
    batting = F.array(F.create_map(F.lit("hits"), number.cast("double"), F.lit("atBat"), (number * 2).cast("double")))
    player = F.struct(
        F.lit("Fielder").alias("firstName"), F.regexp_replace("fielder", "^Fielder ", "").alias("lastName"), F.col("fielding_team").alias("franchiseName"),
        F.struct(F.lit("DP").alias("shortDescription")).alias("primaryPosition"), batting.alias("battingStats"), "fieldingStats",
    )
    # a document holds the lines of one player, so it has a bound
    return players.select("season", F.array(player).alias("stats")).select(
        F.when(F.col("season") == 2025, 270).otherwise(369).alias("seasonId"), "stats"
    )


def _schedule_documents(spark, sf):
    games = I.view(spark, sf, "fx_official")
    sides = F.array(
        F.struct((F.col("game_id") * 2).cast("bigint").alias("eventTeamId"), F.col("home_team").alias("name")),
        F.struct((F.col("game_id") * 2 + 1).cast("bigint").alias("eventTeamId"), F.col("away_team").alias("name")),
    )
    game = F.struct(
        F.col("game_id").cast("bigint").alias("gameId"), F.col("season_id").alias("seasonId"), F.date_format("game_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("gameDateIso"),
        F.col("record_status").alias("recordStatus"), (F.col("game_id") * 2).cast("bigint").alias("homeTeamId"), F.col("home_score").alias("homeTeamScore"),
        F.col("away_score").alias("awayTeamScore"), sides.alias("competitors"),
    )
    # a document holds the home games of a team on one day
    return games.groupBy("season", "home_team", F.to_date("game_ts")).agg(F.collect_list(game).alias("games")).select("games")


def schedule(spark, sf):
    path = _written(spark, sf, "schedule", _schedule_documents)
    return D.schedule_games(D.read_documents(spark, path, D.SCHEDULE))


def stats(spark, sf):
    path = _written(spark, sf, "season-stats", _stat_documents)
    return D.season_players(D.read_documents(spark, path, D.SEASON_STATS), _IDS)


@query("src1_json_documents", "select game_id as \"gameId\", season_id as \"seasonId\", record_status as \"recordStatus\", home_score as \"homeTeamScore\" from (select cast(game_id as bigint) as game_id, season_id, record_status, home_score from fx_official) x")
def src1(spark, sf):
    return schedule(spark, sf).select("gameId", "seasonId", "recordStatus", "homeTeamScore")


@query("src2_season_statistics", """
select season, fielding_team as team, count(*) as players from (select distinct season, fielding_team, fielder from pbp) x group by season, fielding_team""")
def src2(spark, sf):
    return stats(spark, sf).groupBy("season", F.col("franchiseName").alias("team")).agg(F.count("*").alias("players"))


@query("src3_completed_schedule", """
select season, cast(game_id as bigint) as game_id, home_score, away_score from fx_official where record_status = 'Completed'""")
def src3(spark, sf):
    season = C.season_of(F.col("seasonId"))
    games = schedule(spark, sf).select(
        season.alias("season"), F.col("gameId").alias("game_id"), F.col("seasonId").alias("season_id"), F.col("recordStatus").alias("record_status"),
        "gameDateIso", F.col("homeTeamScore").alias("home_score"), F.col("awayTeamScore").alias("away_score"),
    )
    return C.completed_games(games).orderBy("season", "gameDateIso", "game_id").select("season", "game_id", "home_score", "away_score")


def _pages(spark, sf):
    """Game pages: a JSON object escaped into two pushed chunks."""
    games = I.view(spark, sf, "fx_games")
    body = F.to_json(F.struct("canonical_id", "season", "home_team", "home_runs", F.array("home_team", "away_team").alias("teams")))
    whole = F.concat(F.lit('{"page":1,"gameBox":'), body, F.lit(',"tail":"x}"}'))
    escaped = F.replace(F.replace(whole, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    half = F.position(F.lit("gameBox"), escaped) + 3

    def chunk(text):
        return F.concat(F.lit('<script>self.__next_f.push([1,"'), text, F.lit('"])</script>'))

    return games.select(
        "canonical_id", F.concat(chunk(F.substring(escaped, F.lit(1), half)), F.lit("<b>-</b>"), chunk(F.substring(escaped, half + 1, F.length(escaped)))).alias("html")
    )


@query("src4_embedded_objects", """
select canonical_id, season, home_team, home_runs, concat(home_team, '|', away_team) as teams from fx_games""")
def src4(spark, sf):
    schema = "struct<canonical_id:string,season:int,home_team:string,home_runs:int,teams:array<string>>"
    return G.embedded_object(_pages(spark, sf), "gameBox", schema).select("data.*")




@query("src5_page_pitching_lines", """
select canonical_id, pitcher as player, pitcher_key as player_key, h as "H", r as "R", er as "ER", bb as "BB", so as "SO", hr as "HR", bf as "BF",
  (outs // 3) + (outs % 3) / 3.0 as innings_decimal from fx_box_pitching""", "innings_decimal")
def src5(spark, sf):
    box = I.box_pitching(spark, sf).withColumn("outs", F.bround(F.col("innings_decimal") * 3, 0).cast("int"))
    ip = F.concat(F.floor(F.col("outs") / 3.0).cast("string"), F.lit("."), (F.col("outs") % 3).cast("string"))
    fields = [("h", "H"), ("r", "R"), ("er", "ER"), ("bb", "BB"), ("so", "SO"), ("hr", "HR"), ("ab", "BF"), ("bf", "BF"), ("np", "BF")]
    numbers = F.concat_ws(",", *[F.concat(F.lit(f'\\"{k}\\":'), F.col(c).cast("string")) for k, c in fields])
    line = F.concat(
        F.lit('{\\"personId\\":1,\\"eventTeamId\\":2,\\"displayName\\":\\"'), F.col("player"), F.lit('\\",\\"position\\":\\"P\\",'), numbers,
        F.lit(',\\"ip\\":\\"'), ip, F.lit('\\"}'),
    )
    pages = box.groupBy("canonical_id").agg(F.concat_ws(",", F.collect_list(line)).alias("html"))
    return G.pitching_lines(pages).select("canonical_id", "player", "player_key", "H", "R", "ER", "BB", "SO", "HR", "BF", "innings_decimal")


def _boxes(spark, sf):
    bats = I.box_hitting(spark, sf).groupBy("canonical_id", "season").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "list_ordinal", F.col("player").alias("Player"), F.col("team").alias("teamName"), F.concat(F.lit("#7 ("), "position", F.lit(") (W)")).alias("Info"), "H"))),
        lambda r: r.dropFields("list_ordinal")).alias("hitting"))
    outs = F.bround(F.col("innings_decimal") * 3, 0).cast("int")
    ip = F.concat(F.floor(outs / 3.0).cast("string"), F.lit("."), (outs % 3).cast("string"))
    arms = I.box_pitching(spark, sf).groupBy("canonical_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "list_ordinal", F.col("player").alias("Player"), F.col("team").alias("teamName"), ip.alias("IP"), "ER"))), lambda r: r.dropFields("list_ordinal")).alias("pitching"))
    return bats.join(arms, "canonical_id")


cte("box_long", """
select canonical_id, season, 'hitting' as role, batter_key as player_key, position, null::double as innings_decimal from fx_box_hitting
union all select canonical_id, season, 'pitching', pitcher_key, null, outs / 3.0 from fx_box_pitching""")


@query("src6_box_rows", "select * from box_long", "innings_decimal")
def src6(spark, sf):
    return D.box_rows(_boxes(spark, sf)).select("canonical_id", "season", "role", "player_key", "position", "innings_decimal")


@query("src7_supplemental_audit", """
select season, canonical_id, count(*) filter (where role = 'hitting') as hitting_rows, count(*) filter (where role = 'pitching') as pitching_rows
from box_long where cast(right(canonical_id, 1) as int) % 2 = 1 group by season, canonical_id""")
def src7(spark, sf):
    boxes = D.box_rows(_boxes(spark, sf))
    # the even games are already there
    existing = I.view(spark, sf, "fx_games").where("g % 2 = 0").select("canonical_id")
    return D.supplemental_rows(boxes, existing)[1]


@query("src7_supplemental_rows", "select canonical_id, role, player_key from box_long where cast(right(canonical_id, 1) as int) % 2 = 1")
def src7_rows(spark, sf):
    existing = I.view(spark, sf, "fx_games").where("g % 2 = 0").select("canonical_id")
    return D.supplemental_rows(D.box_rows(_boxes(spark, sf)), existing)[0].select("canonical_id", "role", "player_key")


@query("src8_player_map", f"""
select season, replace(lower(fielder), ' ', '') as player_key, fielding_team as team, concat('DP|', string_agg(distinct upper(substr(position, 1, 1)), '|')) as positions,
  count(*) filter (where {_MADE}) as put_outs, count(*) filter (where r % 5 = 0) as assists, count(*) filter (where event_type = 'reached_on_error') as errors, count(*) as total_chances,
  count(*) filter (where event_type = 'stolen_base' and position like 'c%') as stolen_bases_allowed, count(*) filter (where event_type = 'caught_stealing' and position like 'c%') as caught_stealing,
  (count(*) filter (where {_MADE}) + count(*) filter (where r % 5 = 0)) / count(*) as fielding_pct, cast(cast(right(fielder, 2) as int) as double) as hits
from pbp group by season, fielder, fielding_team""", "fielding_pct hits")
def src8(spark, sf):
    rows = D.player_map(stats(spark, sf))
    return rows.withColumn("hits", F.col("batting")["hits"]).drop("batting", "pitching", "player")


@query("src9_latest_snapshot", """
select 's' || lpad(cast(max(g // 50) as varchar), 4, '0') as snapshot_id, count(*) as events from pbp where g // 50 = (select max(g // 50) from pbp)""")
def src9(spark, sf):
    stamped = I.pbp(spark, sf).withColumn("snapshot_id", F.concat(F.lit("s"), F.lpad(F.floor(F.col("g") / 50.0).cast("string"), 4, "0")))
    return D.latest_snapshot(stamped).groupBy("snapshot_id").agg(F.count("*").alias("events"))


_LINE = "concat_ws(',', canonical_id, away_team, cast(home_runs as varchar(10)), cast(away_runs as varchar(10)))"


@query("src10_file_fingerprints", f"""
select concat(season, '/', home_team) as file, cast(length(body) as bigint) as bytes, sha256(body) as sha256,
  case when home_team = 'team_1' then 'changed' else '' end as problem
from (select season, home_team, concat(string_agg({_LINE}, chr(10) order by {_LINE}), chr(10)) as body from fx_games group by season, home_team) x
union all select distinct concat(season, '/nobody'), null, null, 'missing' from fx_games""")
def src10(spark, sf):
    """One file per season and home team; the manifest comes from the rows, has other scores for one team, and a file that is not there."""
    games = I.view(spark, sf, "fx_games").select("season", F.col("home_team").alias("team"), F.expr(_LINE).alias("value"), "canonical_id")
    path = fresh_path(spark, "scores")
    lines = games.select("season", "team", "value").repartition("season", "team").sortWithinPartitions("season", "team", "value")
    lines.write.partitionBy("season", "team").text(path)
    name = F.concat(F.regexp_extract("path", r"season=(\d+)/", 1), F.lit("/"), F.regexp_extract("path", r"team=([^/]+)/", 1))
    files = M.fingerprints(spark, path, "*.txt").withColumn("path", name)
    told = F.when(F.col("team") == "team_1", F.concat("value", F.lit("9"))).otherwise(F.col("value"))
    body = F.concat(F.array_join(F.array_sort(F.collect_list(told)), "\n"), F.lit("\n"))
    manifest = games.groupBy(F.concat(F.col("season").cast("string"), F.lit("/"), "team").alias("path")).agg(F.sha2(body, 256).alias("sha256"))
    lost = games.select(F.concat(F.col("season").cast("string"), F.lit("/nobody")).alias("path"), F.lit("-").alias("sha256")).distinct()
    problems = M.changed_files(manifest.unionByName(lost), files).select("path", "problem")
    return files.join(problems, "path", "full").select(F.col("path").alias("file"), "bytes", "sha256", F.coalesce("problem", F.lit("")).alias("problem"))


@query("src11_capture_worklist", """
select canonical_id, season, team, start_ts from (select canonical_id, season, least(home_team, away_team) as team, start_ts from fx_games where g % 3 <> 0) x
order by season, team, start_ts, canonical_id limit 20""")
def src11(spark, sf):
    games = I.view(spark, sf, "fx_games")
    contests = games.select(
        "canonical_id", "season", F.array_sort(F.array("home_team", "away_team")).alias("team_names"), "start_ts", F.lit("completed").alias("status"),
        F.col("canonical_id").alias("preferred_source_game_id"),
    )
    return C.capture_worklist(contests, games.where("g % 3 = 0"), 20).drop("preferred_source_game_id")


@query("snk1_sorted_json", "select season, player_key, total_war from combined", "total_war")
def snk1(spark, sf):
    path = fresh_path(spark, "snk1")
    K.write_json(PV.combined(spark, sf).select("season", "player_key", "total_war"), path, "season", "player_key")
    return spark.read.schema("player_key string, season int, total_war double").json(path).select("season", "player_key", "total_war")


@query("snk2_flat_csv", "select season, player_key, teams, quality_flags from combined")
def snk2(spark, sf):
    path = fresh_path(spark, "snk2")
    K.write_csv(PV.combined(spark, sf).select("season", "player_key", "teams", "quality_flags"), path)
    return spark.read.schema("season int, player_key string, teams string, quality_flags string").option("header", "true").csv(path)


@query("snk3_report_leaders", """
select season, player, total_war from combined qualify row_number() over (partition by season order by round(total_war, 6) desc, player_key) <= 20""", "total_war")
def snk3(spark, sf):
    from basepaths.operators.scouting import team_leaders

    rows = PV.combined(spark, sf)
    order = [F.round("total_war", 6).desc(), F.col("player_key")]
    return team_leaders(rows, {"total": (order, 20)}, "season").join(rows, ["season", "player_key"]).select("season", "player", "total_war")


@query("snk4_period_documents", """
select r.period, r.team, r.games, count(player_key) as roster_size, coalesce(cast(sum("PA") as bigint), 0) as roster_pa from records r left join hit_bats h on h.period = r.period and h.team = r.team
group by r.period, r.team, r.games""")
def snk4(spark, sf):
    path = fresh_path(spark, "snk4")
    players = PS.hitters(spark, sf).select("period", "team", "player_key", "PA", "OPS")
    K.period_documents(PS.records(spark, sf).select("period", "team", "games"), players).write.json(path)
    read = spark.read.schema("period string, team string, games long, players array<struct<player_key:string,PA:long,OPS:double>>").json(path)
    listed = F.coalesce("players", F.array().cast("array<struct<player_key:string,PA:bigint,OPS:double>>"))
    return read.select(
        "period", "team", "games", F.size(listed).cast("bigint").alias("roster_size"), F.aggregate(listed, F.lit(0).cast("bigint"), lambda a, p: a + p["PA"]).alias("roster_pa")
    )


@query("ldr12_csv_export", """
select player, position_war, "PA" from board where season = 2026 and "PA" >= 5""", "position_war")
def ldr12(spark, sf):
    from basepaths.operators.leaderboard import leaderboard
    from basepaths.plans.boards import board

    path = fresh_path(spark, "ldr12")
    K.write_csv(leaderboard(board(spark, sf), 2026, minimum=5).select("player", "position_war", "PA"), path)
    return spark.read.schema("player string, position_war double, PA long").option("header", "true").csv(path)
