"""Board, directory and check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basepaths.operators import checks as K
from basepaths.operators import contests as C
from basepaths.operators import leaderboard as L
from basepaths.operators import scouting as S
from basepaths.plans import inputs as I
from basepaths.plans import scouting as PS
from basepaths.plans import value as PV
from basepaths.plans.registry import cte, query

cte("board", 'select c.*, o."wOBA", baserunning_runs + c.double_play_avoidance_runs as baserunning_component_runs, c.defense_war as defensive_war '
             "from combined c left join (select season, player_key, \"wOBA\" from offense) o using (season, player_key)")


def board(spark, sf):
    return S.leaderboard_rows(PV.combined(spark, sf), I.offense(spark, sf))


@query("ldr1_position_board", """
select season, player_key, player, teams, position_war, "PA", "wOBA" from board where season = 2026 and "PA" > 0 and "PA" >= 5
  and list_contains(string_split(teams, '|'), 'team_1') and lower(concat(player, ' ', teams)) like '%n0%'""", "position_war wOBA")
def ldr1(spark, sf):
    return L.leaderboard(board(spark, sf), 2026, minimum=5, team="team_1", text="N0").select(
        "season", "player_key", "player", "teams", "position_war", "PA", "wOBA"
    )


@query("ldr1_pitching_board", """
select season, player_key, player, teams, "IP", "ERA", "RA7", "FIP" from board where season = 2025 and "IP" >= 5""", "IP ERA RA7 FIP")
def ldr1_pitching(spark, sf):
    return L.leaderboard(board(spark, sf), 2025, "pitching", "pitching", minimum=5, sort="ERA", descending=False).select(
        "season", "player_key", "player", "teams", "IP", "ERA", "RA7", "FIP"
    )


@query("ldr2_board_page", """
select player_key, position_war from (select player_key, position_war, row_number() over (order by round(position_war, 6) desc, player_key) as n
  from board where season = 2026 and "PA" > 0) x where n > 25 and n <= 50""", "position_war")
def ldr2(spark, sf):
    rows = board(spark, sf).where("season = 2026 and PA > 0").select("player_key", F.round("position_war", 6).alias("position_war"))
    return L.page(rows, [F.desc("position_war"), F.col("player_key")], number=2, size=25)


_CARDS = [
    ("Best WAR", "position_war", "desc", '"PA" > 0'), ("Best Offensive WAR", "offensive_war", "desc", '"PA" > 0'),
    ("Best Defensive WAR", "defensive_war", "desc", '"PA" > 0'), ("Best BsR", "baserunning_component_runs", "desc", '"PA" > 0'),
    ("Best wOBA, 20+ PA", '"wOBA"', "desc", '"PA" >= 20'), ("Best Pitching WAR", "pitcher_war", "desc", '"IP" > 0'),
    ("Best Pitching RAA", "pitching_runs_above_average", "desc", '"IP" > 0'), ("Lowest RA7, 7+ IP", '"RA7"', "asc", '"IP" >= 7'),
    ("Lowest FIP, 7+ IP", '"FIP"', "asc", '"IP" >= 7'),
]


@query("ldr3_leader_cards", " union all ".join(
    f"""select season, '{label}' as card, player_key, value from (select season, player_key, round({column}, 6) as value,
    row_number() over (partition by season order by round({column}, 6) {direction}, player_key) as n from board where {test}) x where n = 1"""
    for label, column, direction, test in _CARDS), "value")
def ldr3(spark, sf):
    rows = board(spark, sf)
    return L.leader_cards(rows.withColumns({c: F.round(c, 6) for c, *_ in L.CARDS.values()}))


@query("ldr4_standings", """
select period, team, games, wins, losses, ties, runs, runs_allowed, runs_per_game, wins / games as pct, runs - runs_allowed as run_difference from records where period = '2026'""",
       "runs_per_game pct")
def ldr4(spark, sf):
    return L.standings(PS.records(spark, sf)).where("period = '2026'").orderBy(F.desc("pct"), "team")


@query("ldr4_home_leaders", """
select * from (select 'position' as board, player_key, position_war as war from board where season = 2026 and "PA" > 0 order by round(position_war, 6) desc, player_key limit 10) a
union all select * from (select 'pitching', player_key, pitcher_war from board where season = 2026 and "IP" > 0 order by round(pitcher_war, 6) desc, player_key limit 10) b""", "war")
def ldr4_home(spark, sf):
    rows = board(spark, sf).where("season = 2026").withColumns({c: F.round(c, 6) for c in ("position_war", "pitcher_war")})
    bats = L.top(rows, "position_war", "PA").select(F.lit("position").alias("board"), "player_key", F.col("position_war").alias("war"))
    arms = L.top(rows, "pitcher_war", "IP").select(F.lit("pitching").alias("board"), "player_key", F.col("pitcher_war").alias("war"))
    return bats.unionByName(arms)


cte("directory", """
select player_key, arg_max(player, season) as player, arg_max(teams, season) as team, arg_max(positions, season) as positions, bool_or(season = 2026) as current,
  string_agg(distinct cast(season as varchar), '|' order by cast(season as varchar)) as seasons
from (select season, c.player_key, player, teams, coalesce(positions, '') as positions from combined c
  left join (select season, batter_key as player_key, min(position) as positions from fx_box_hitting group by season, batter_key) p using (season, player_key)) x group by player_key""")


def directory(spark, sf):
    listed = I.box_hitting(spark, sf).groupBy("season", "player_key").agg(F.min("position").alias("positions"))
    players = PV.combined(spark, sf).join(listed, ["season", "player_key"], "left").select(
        "player_key", "player", "season", F.array_join("teams", "|").alias("team"), F.array_compact(F.array("positions")).alias("positions"),
        (F.col("season") == 2026).alias("current"),
    )
    return C.player_directory(players)


@query("ent14_player_directory", "select * from directory")
def ent14(spark, sf):
    return directory(spark, sf)


@query("ldr5_directory_search", """
select player_key, player, team from directory where current and team = 'team_2' and lower(concat(player, ' ', team, ' ', positions)) like '%batter%' order by player, player_key limit 8""")
def ldr5(spark, sf):
    return L.directory_search(directory(spark, sf), text="Batter", team="team_2", status="current", first=8).select("player_key", "player", "team")


@query("ldr6_batting_rollup", """
select team, cast(sum("PA") as bigint) as "PA", cast(sum("AB") as bigint) as "AB", cast(sum("H") as bigint) as "H", cast(sum("HR") as bigint) as "HR", cast(sum("BB") as bigint) as "BB",
  cast(sum("SO") as bigint) as "SO", cast(sum("HBP") as bigint) as "HBP", sum(coalesce("SLG", 0) * "AB") as "TB", sum("H") / nullif(sum("AB"), 0) as "BA",
  sum("H" + "BB" + "HBP") / nullif(sum("AB" + "BB" + "HBP"), 0) as "OBP", sum(coalesce("SLG", 0) * "AB") / nullif(sum("AB"), 0) as "SLG",
  sum("H" + "BB" + "HBP") / nullif(sum("AB" + "BB" + "HBP"), 0) + sum(coalesce("SLG", 0) * "AB") / nullif(sum("AB"), 0) as "OPS",
  sum("SO") / sum("PA") as "K_pct", sum("BB") / sum("PA") as "BB_pct"
from (select b.*, c.team from bat_lines b join hit_bats c on c.period = b.period and c.player_key = b.batter_key where b.period = '2026') x group by rollup (team)""",
       "TB BA OBP SLG OPS K_pct BB_pct")
def ldr6(spark, sf):
    return L.batting_rollup(PS.hitters(spark, sf).where("period = '2026'"))


cte("thrown", "select pitcher_key as player_key, count(*) as n, count(*) filter (where strike) as s from pitch_rows where period = '2026' group by pitcher_key")


@query("ldr6_pitching_rollup", """
select teams as team, cast(sum("G") as bigint) as "App", sum("IP") as "IP", cast(sum("H_allowed") as bigint) as "H", cast(sum("BB_allowed") as bigint) as "BB",
  cast(sum("SO_pitching") as bigint) as "SO", cast(sum(coalesce(n, 0)) as bigint) as "Pitches", cast(sum(coalesce(s, 0)) as bigint) as "Strikes", sum("ER")::double as "ER",
  sum("ER") * 7 / sum("IP") as "ERA", sum("H_allowed" + "BB_allowed") / sum("IP") as "WHIP", sum("SO_pitching") * 7 / sum("IP") as "SO7", sum("BB_allowed") * 7 / sum("IP") as "BB7",
  sum(s) / nullif(sum(n), 0) as "S_pct" from pitching left join thrown using (player_key) where season = 2026 group by rollup (teams)""", "IP ER ERA WHIP SO7 BB7 S_pct")
def ldr6_pitching(spark, sf):
    rows = PV.pitcher_stage(spark, sf).where("season = 2026").join(_thrown(spark, sf), "player_key", "left").select(
        F.array_join("teams", "|").alias("team"), F.col("G").alias("App"), "IP", F.col("H_allowed").alias("H"), F.col("BB_allowed").alias("BB"),
        F.col("SO_pitching").alias("SO"), F.coalesce("Pitches", F.lit(0)).alias("Pitches"), F.coalesce("Strikes", F.lit(0)).alias("Strikes"), "ERA",
    )
    return L.pitching_rollup(rows)


def _thrown(spark, sf):
    """Pitches and strikes of every pitcher of 2026, from the pitch sequences."""
    rows = S.pitch_rows(PS.pas(spark, sf).where("period = '2026'"), "pitcher_key")
    return rows.groupBy(F.col("pitcher_key").alias("player_key")).agg(F.count("*").alias("Pitches"), F.count_if("strike").alias("Strikes"))


@query("ldr7_recent_games", """
select canonical_id, date, opponent, result from ctx where team = 'team_3' order by date desc, canonical_id desc limit 6""")
def ldr7(spark, sf):
    return L.recent_games(PS.context(spark, sf), "team_3")


@query("ldr8_rank_card", """
select team, cast(n as int) as place, run_difference, best from (select team, row_number() over (order by wins / games desc, team) as n, runs - runs_allowed as run_difference
  from records where period = '2026') r join (select team, player_key as best from hit_bats where period = '2026'
  qualify row_number() over (partition by team order by round(war, 6) desc, player_key) = 1) b using (team)""")
def ldr8(spark, sf):
    teams = L.standings(PS.records(spark, sf)).where("period = '2026'").withColumn("pct", F.round("pct", 9))
    place = S.team_rankings(teams, {"record": ("pct", True)}).select("team", "place")
    players = PS.hitters(spark, sf).where("period = '2026'")
    best = S.team_leaders(players, {"war": ([F.round("war", 6).desc(), F.col("player_key")], 1)}, "team").select("team", F.col("player_key").alias("best"))
    return teams.select("team", "run_difference").join(F.broadcast(place), "team").join(best, "team")


@query("ldr9_season_history", """
select season, player_key, 'hitting' as role, teams, "PA" as played, position_war as war from (select season, player_key, teams, cast("PA" as double) as "PA", position_war from combined where "PA" > 0) a
union all select season, player_key, 'pitching', teams, "IP", pitcher_war from combined where "IP" > 0""", "played war")
def ldr9(spark, sf):
    rows = PV.combined(spark, sf)
    bats = rows.where("PA > 0").select("season", "player_key", F.lit("hitting").alias("role"), "teams", F.col("PA").cast("double").alias("played"), F.col("position_war").alias("war"))
    arms = rows.where("IP > 0").select("season", "player_key", F.lit("pitching").alias("role"), "teams", F.col("IP").alias("played"), F.col("pitcher_war").alias("war"))
    return bats.unionByName(arms)


@query("ldr10_matchup_search", """
select batter_key, pitcher_key, count(*) as "PA" from pas where lower(pitcher_key) like '%t1%' group by batter_key, pitcher_key""")
def ldr10(spark, sf):
    rows = I.plate_appearances(spark, sf).groupBy("batter_key", "pitcher_key").agg(F.count("*").alias("PA"))
    return L.sorted_by(L.matchup_search(rows, "T1").withColumn("shown", F.col("PA").cast("string")), "shown", True, "batter_key", "pitcher_key").drop("shown")


@query("ldr11_report_tables", """
select season, player_key, teams, fielding_opportunities, range_runs, arm_runs from (
  select season, player_key, n - pitch_n as fielding_opportunities, non_pitcher_range_runs as range_runs from ranges) r
join (select season, player_key, teams, arm_runs from union_rows) u using (season, player_key) where fielding_opportunities > 0""", "range_runs arm_runs")
def ldr11(spark, sf):
    return PV.position_stage(spark, sf).where("fielding_opportunities > 0").select(
        "season", "player_key", "teams", "fielding_opportunities", "range_runs", "arm_runs"
    )


@query("ldr11_pitching_table", """
select player_key, teams as team, "G" as "App", "IP", "ERA", "FIP", ("H_allowed" + "BB_allowed") / "IP" as "WHIP", "SO_pitching" * 7 / "IP" as "SO7", "BB_allowed" * 7 / "IP" as "BB7",
  s / nullif(n, 0) as "S_pct", pitcher_war from pitcher_final join (select season, player_key, pitcher_war from combined) c using (season, player_key) left join thrown using (player_key)
where season = 2026 and "IP" > 0""", "IP ERA FIP WHIP SO7 BB7 S_pct pitcher_war")
def ldr11_pitching(spark, sf):
    lines = PV.pitcher_stage(spark, sf).where("season = 2026 and IP > 0").join(_thrown(spark, sf), "player_key", "left")
    return L.pitching_table(lines.withColumn("team", F.array_join("teams", "|")))


@query("ldr11_hitting_table", """
select b.player_key, b.team, l."PA", l."AB", l."H", l."HR", l."2B" + l."3B" + l."HR" as "XBH", "BA", l."OBP", "SLG", l."OPS", l."SO" / l."PA" as "K_pct", l."BB" / l."PA" as "BB_pct",
  "wOBA", c.batting_runs as "wRAA", offensive_war, c.baserunning_runs
from bat_lines l join hit_bats b on b.period = l.period and b.player_key = l.batter_key join combined c on c.season = 2026 and c.player_key = b.player_key
left join (select player_key, "wOBA" from offense where season = 2026) o on o.player_key = b.player_key where l.period = '2026'""",
       "BA OBP SLG OPS K_pct BB_pct wOBA wRAA offensive_war baserunning_runs")
def ldr11_hitting(spark, sf):
    values = PV.combined(spark, sf).where("season = 2026").select("player_key", "wRAA", "offensive_war", "baserunning_runs")
    lines = PS.hitters(spark, sf).where("period = '2026'").join(values, "player_key")
    return L.hitting_table(lines.join(I.offense(spark, sf).where("season = 2026").select("player_key", "wOBA"), "player_key", "left"))


# --- checks ------------------------------------------------------------------------------

_AUDIT = """select canonical_id, cast(sum(runs_scored) as bigint) - (select cast(home_runs + away_runs as bigint) from fx_games f where f.canonical_id = p.canonical_id) as run_difference from pbp p group by canonical_id"""


@query("val1_batters_faced", """
select canonical_id, cast(sum(bf + case when list_ordinal % 2 = 1 then 1 else 0 end) as bigint) as expected_bf, (select count(*) from pa where pa.canonical_id = b.canonical_id) as observed_pa
from box b group by canonical_id having sum(bf + case when list_ordinal % 2 = 1 then 1 else 0 end) <> (select count(*) from pa where pa.canonical_id = b.canonical_id)""")
def val1_mismatches(spark, sf):
    # one batter too many for every second listed pitcher, so mismatches exist
    box = I.box_pitching(spark, sf).withColumn("BF", F.col("BF") + F.expr("cast(list_ordinal % 2 as int)"))
    return K.batters_faced_mismatches(I.pbp(spark, sf), box)


@query("val1_snapshot_validation", f"""
select count(distinct canonical_id) as games, count(*) as events, count(*) filter (where is_plate_appearance) as plate_appearances,
  count(*) filter (where is_plate_appearance and pitch_text <> '') / count(*) filter (where is_plate_appearance) as pitch_text_coverage,
  (select count(*) from ({_AUDIT}) a where run_difference <> 0) as run_or_state_failures, cast(0 as bigint) as bf_mismatches,
  (select count(*) from ({_AUDIT}) a where run_difference <> 0) = 0 as passed from pbp""", "pitch_text_coverage")
def val1(spark, sf):
    events = I.pbp(spark, sf)
    scores = I.view(spark, sf, "fx_games").select("canonical_id", (F.col("home_runs") + F.col("away_runs")).alias("runs"))
    audit = events.groupBy("canonical_id").agg(F.sum("runs_scored").alias("seen")).join(scores, "canonical_id").select(
        "canonical_id", (F.col("seen") - F.col("runs")).alias("run_difference"), F.lit(0).alias("state_errors")
    )
    return K.snapshot_validation(events, I.box_pitching(spark, sf), audit)


@query("evt12_game_reconciliation", """
select canonical_id, cast(o.r as bigint) as observed_runs, o.h as observed_hits, o.w as observed_walks, o.k as observed_strikeouts, cast(0 as bigint) as unknown_events,
  cast(0 as bigint) as boundary_errors, cast(bh as bigint) as box_hits, cast(br as bigint) as box_runs, cast(bw as bigint) as box_walks, cast(bk as bigint) as box_strikeouts,
  o.r = br and o.h = bh and o.w = bw and o.k = bk as reconciled
from (select canonical_id, sum(runs_scored) as r, count(*) filter (where event_type in ('single','double','triple','home_run')) as h,
  count(*) filter (where event_type in ('walk','intentional_walk')) as w, count(*) filter (where event_type in ('strikeout','dropped_third_out','dropped_third_reached')) as k
  from pbp group by canonical_id) o
join (select canonical_id, sum(h) as bh from fx_box_hitting group by canonical_id) b using (canonical_id)
join (select canonical_id, sum(r) + max(case when cast(right(canonical_id, 1) as int) = 3 then 1 else 0 end) as br, sum(bb) as bw, sum(so) as bk from fx_box_pitching group by canonical_id) p using (canonical_id)""")
def evt12(spark, sf):
    # games whose number ends in 3 miss a run, so both outcomes occur
    listed = I.box_pitching(spark, sf)
    extra = listed.where(F.col("canonical_id").endswith("3")).select("canonical_id").distinct().select(
        "canonical_id", F.lit(1).alias("R"), F.lit(0).alias("BB"), F.lit(0).alias("SO")
    )
    box = listed.select("canonical_id", "R", "BB", "SO").unionByName(extra)
    return K.game_reconciliation(I.pbp(spark, sf), I.box_hitting(spark, sf), box)


@query("evt13_snapshot_summary", """
select event_type, count(*) as events, count(*) filter (where is_plate_appearance) as plate_appearances, count(distinct canonical_id) as games from pbp group by rollup (event_type)""")
def evt13(spark, sf):
    rows = I.pbp(spark, sf).rollup("event_type")
    return rows.agg(F.count("*").alias("events"), F.count_if("is_plate_appearance").alias("plate_appearances"), F.count_distinct("canonical_id").alias("games"))


# What the rules of operators.checks must find: nothing wrong, and equal counts. Values are counted on the tables of the twin.
_WRONG = ", ".join("'" + r.name.replace("'", "''") + "'" for r in (*K.PLAY_RULES, *K.VALUE_RULES) if r.against == 0.0)
cte("val2_counts", f"""
select 'normalization covers every contest' as "check", count(distinct canonical_id)::double as observed, (select count(*) from fx_games)::double as expected from pbp
union all select 'every base-out state has observations', count(*) filter (where sample_size > 0), 24 from re_cells
union all select 'all games reach the plate appearance data', count(distinct canonical_id), (select count(*) from fx_games) from pas
union all select 'all plate appearances reach the plate appearance data', count(*), (select count(*) from pa) from pas
union all select 'arm attribution coverage clears its gate', count(fielder) / count(*), 0.25 from opportunities
union all select unnest([{_WRONG}]), 0, 0""")


def _check_tables(spark, sf):
    reconciled = K.game_reconciliation(I.pbp(spark, sf), I.box_hitting(spark, sf), I.box_pitching(spark, sf))
    plays = K.play_tables(I.view(spark, sf, "fx_games"), I.pbp(spark, sf), reconciled, I.re24(spark, sf), I.plate_appearances(spark, sf))
    return plays | K.value_tables(
        PV.position_stage(spark, sf), PV.pitcher_stage(spark, sf), PV.combined(spark, sf), I.opportunities(spark, sf), PV.stored(spark, sf, PV.arms), PV.stored(spark, sf, PV.environment)
    )


@query("val2_check_list", """select "check", case when "check" like 'arm attribution%' then observed >= expected else observed = expected end as passed, observed, expected
from val2_counts""", "observed expected")
def val2(spark, sf):
    return K.evaluate(_check_tables(spark, sf), (*K.PLAY_RULES, *K.VALUE_RULES))


@query("val2_feed_checks", """
select unnest(['every contest has feed plays', 'feed games reconcile runs', 'feed games have valid runner states', 'feed plate appearances are complete']) as "check",
  unnest([true, bad = 0, true, seen = told]) as passed, unnest([games, bad, 0, seen])::double as observed, unnest([games, 0, 0, told])::double as expected
from (select count(distinct canonical_id) as games, (select count(*) from pa) as told, count(*) filter (is_plate_appearance) as seen,
  (select count(*) from fx_official where game_id % 10 = 0) as bad from feed_events) x""")
def val2_feed(spark, sf):
    from basepaths.plans import normalization as N

    # the schedule has a run too many in every tenth game
    return K.evaluate({"contests": I.view(spark, sf, "fx_games"), "events": I.pbp(spark, sf), "feed": N.evt8_audit(spark, sf)}, K.FEED_RULES)


#: One fault for each table: columns that are overwritten. Totals per season are faulty where a column of every player is.
_FAULTS = {
    "contests": {"away_team": "home_team", "canonical_id": "'g'"}, "events": {"event_type": "'unknown'", "outs_before": "3", "canonical_id": "concat(canonical_id, half)"},
    "reconciled": {**{f"box_{c}": f"observed_{c} + 1" for c in ("runs", "hits", "walks", "strikeouts")}, "boundary_errors": "1"}, "halves": {"last": "false", "outs": "2"},
    "states": {"sample_size": "0"}, "plate_appearances": {"canonical_id": "'g'"},
    "position": {"season": "1", "player_key": "'x'", "defense_runs": "defense_runs + 1", "baserunning_component_runs": "baserunning_component_runs + 1", "throwing_runs": "throwing_runs + 1",
                 "position_war": "position_war + 1"},
    "pitchers": {"season": "1", "player_key": "'x'", "opponent_expected_RA7": "null", "ERA_minus_FIP": "ERA_minus_FIP + 1", "FIP": "FIP", "pitcher_war": "pitcher_war + 1",
                 "ra7_pitching_runs_above_average": "ra7_pitching_runs_above_average + 1"},
    "combined": {"season": "1", "player_key": "'x'", "wRAA": "wRAA + 1", "batting_war": "batting_war + 1", "baserunning_war": "baserunning_war + 1", "defense_war": "defense_war + 1",
                 "positional_adjustment_runs": "1.0", "pitching_war": "null", "total_war": "total_war + 1"},
    "advancement": {"action": "null", "fielder": "null"}, "arms": {"arm_runs_opposing_raw": "arm_runs_opposing_raw + 1", "arm_runs": "arm_runs + 1"},
    "pool": {"war": "war + 1"}, **{name: None for name in ("position_totals", "advancement_totals", "arm_totals", "pitcher_totals")},
}


def _faulty(name, df):
    changes = _FAULTS[name]
    if changes is None:
        changes = {c: f"{c} + 1" for c in df.columns if c != "season"}
    return df.withColumns({c: F.expr(e).cast(df.schema[c].dataType) for c, e in changes.items()})


@query("val2_faults", """
select unnest(['canonical ids are unique', 'contests are between two teams', 'normalization covers every contest', 'all games reconcile runs', 'all games reconcile hits', 'all games reconcile walks',
  'all games reconcile strikeouts', 'no game crosses a boundary of three outs', 'no plate appearances have unknown outcomes', 'every half-inning before a game''s last reaches three outs',
  'no event begins with three outs', 'every base-out state has observations', 'position player keys are unique', 'pitcher keys are unique', 'combined keys are unique',
  'batting runs balance', 'position runs above average balance', 'stolen base runs balance', 'double play runs balance', 'catcher throwing runs balance', 'advancement runs balance',
  'advancement has no unresolved candidates', 'arm attribution coverage clears its gate', 'arm runs before shrinkage balance', 'raw arm and runner value are opposing', 'arm roles add up',
  'pitching runs balance', 'every pitcher has opponent-adjusted context', 'ERA less FIP is exact', 'pitcher wins add up', 'pitching and pitcher defense runs add up', 'defense runs add up',
  'baserunning runs add up', 'throwing runs add up', 'position wins add up', 'total wins add up', 'weighted runs are the batting runs', 'batting wins convert weighted runs',
  'baserunning wins convert all baserunning', 'defense wins convert each defensive part once', 'the positional adjustment is zero', 'total wins equal the replacement pool', 'player rows tell pitching_war']) as "check",
  unnest([games - 1, games, sides, games, games, games, games, games, pas, halves, events, 0, position - 1, pitchers - 1, combined - 1, seasons, seasons, seasons, seasons, seasons, seasons, moves, 0, seasons,
    arms, arms, seasons, pitchers, pitchers, pitchers, pitchers, position, position, position, position, combined, combined, combined, combined, combined, combined, seasons, combined])::double as observed,
  false as passed, unnest([0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 24, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.25, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0])::double as expected
from (select (select count(*) from fx_games) as games, (select count(*) from pbp) as events, (select count(*) from pa) as pas, (select count(*) from position_final) as position,
  (select count(*) from pitcher_final) as pitchers, (select count(*) from combined) as combined, (select count(*) from opportunities) as moves, (select count(*) from arms) as arms,
  (select count(*) from (select distinct canonical_id, inning, half from pbp) h) as halves, (select count(distinct concat(canonical_id, half)) from pbp) as sides,
  (select count(*) from environment) as seasons) n""")
def val2_faults(spark, sf):
    """The checks that fail when every table has its faults."""
    tables = {name: _faulty(name, df) for name, df in _check_tables(spark, sf).items()}
    return K.evaluate(tables, (*K.PLAY_RULES, *K.VALUE_RULES)).where("not passed and check not like 'all % plate appearance data'")


@query("val3_coverage", """
select season, 1.0::double as pitcher_attribution, count(*) filter (where pitch_text <> '') / count(*) as pitch_text, count(traj) / count(*) as batted_ball_type,
  count(first_pos) / count(*) as fielding_position, count(named) / count(*) as fielder,
  (select count(fielder) / count(*) from opportunities o where o.season = t.season) as arm_opportunities from texted t where is_plate_appearance group by season""",
       "pitch_text batted_ball_type fielding_position fielder arm_opportunities")
def val3(spark, sf):
    return K.coverage_table(I.valued(spark, sf), I.opportunities(spark, sf))
