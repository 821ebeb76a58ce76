"""Scouting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basepaths.operators import exposure as E
from basepaths.operators import scouting as S
from basepaths.functions.lines import ratio
from basepaths.plans import inputs as I
from basepaths.plans import value as PV
from basepaths.plans.registry import cte, query

_CONTACT = "('single','double','triple','home_run','out','fielders_choice','double_play','reached_on_error','infield_fly','sacrifice_bunt','sacrifice_fly')"
_COUNTS = "('0-0','0-1','0-2','1-0','1-1','1-2','2-0','2-1','2-2','3-0','3-1','3-2')"

cte("ppas", """
select p.*, period, case when low like '%bunt%' or (low like '%sacrifices%' and low not like '%sacrifice fly%') then 'Bunt' when low like '%ground%' then 'Ground'
    when low like '%line%' then 'Line' when low like '%pop%' or low like '%infield fly%' then 'Pop' when low like '%fly%' or low like '%flies%' then 'Fly' else 'Other' end as contact,
  case regexp_extract(low, '(first baseman|second baseman|third baseman|shortstop|left fielder|center fielder|right fielder|pitcher|catcher)', 1)
    when 'pitcher' then 'Pitcher' when 'catcher' then 'Catcher' when 'first baseman' then 'First Base' when 'second baseman' then 'Second Base'
    when 'third baseman' then 'Third Base' when 'shortstop' then 'Shortstop' when 'left fielder' then 'Left Field' when 'center fielder' then 'Center Field'
    when 'right fielder' then 'Right Field' end as spray
from (select *, lower(play_text) as low from pas) p cross join lateral (select 'combined' as period union all select cast(season as varchar)) s""")


def bat_sql(source: str, keys: str) -> str:
    return f"""select {keys}, count(*) as "PA", cast(sum(ab) as bigint) as "AB", cast(sum(hit) as bigint) as "H", cast(sum(bb) as bigint) as "BB",
  cast(sum(hbp) as bigint) as "HBP", cast(sum(so) as bigint) as "SO", cast(sum(sf) as bigint) as "SF", count(*) filter (where event_type = 'single') as "1B",
  count(*) filter (where event_type = 'double') as "2B", count(*) filter (where event_type = 'triple') as "3B", count(*) filter (where event_type = 'home_run') as "HR",
  sum(hit) / nullif(sum(ab), 0) as "BA", sum(obn) / nullif(sum(obd), 0) as "OBP", sum(tb) / nullif(sum(ab), 0) as "SLG",
  coalesce(sum(obn) / nullif(sum(obd), 0), 0.0) + coalesce(sum(tb) / nullif(sum(ab), 0), 0.0) as "OPS" from {source} group by {keys}"""


cte("bat_lines", bat_sql("ppas", "period, batter_key"))
cte("pitch_rows", f"""
select canonical_id, event_order, period, season, batter_key, pitcher_key, cast(i as int) as pitch_number, codes[i] as action,
  concat(state // 10, '-', state % 10) as count, codes[i] in ('S','F','X') as swing, codes[i] in ('K','C') as called, codes[i] not in ('B','H') as strike
from (select *, list_reduce(list_transform(codes[1:i - 1], lambda c: case c when 'B' then 1 when 'F' then 2 when 'H' then 0 when 'X' then 0 else 3 end),
    lambda a, c: case when c = 1 then least(40, a - a % 10 + 10) + a % 10 when c = 2 and a % 10 < 2 then a + 1 when c = 3 and a % 10 < 3 then a + 1 else a end, 0) as state
  from (select *, unnest(range(1, len(codes) + 1)) as i from (
    select *, string_split(case when event_type in {_CONTACT} and raw not like '%X' then raw || 'X' when event_type = 'hit_by_pitch' then raw || 'H' else raw end, '') as codes
    from (select *, case when pitch_text = '' and event_type in {_CONTACT} then 'X' when pitch_text = '' and event_type = 'hit_by_pitch' then 'H' else pitch_text end as raw
      from ppas) a where raw <> '') b) c) d""")
cte("ctx", """
select canonical_id, x.season, team, opponent, runs, allowed, concat(case when runs > allowed then 'W' when runs < allowed then 'L' else 'T' end, ' ', runs, '-', allowed) as result,
  cast((game_ts at time zone 'UTC') at time zone 'America/New_York' as date) as date
from (select canonical_id, season, g, home_team as team, away_team as opponent, cast(home_runs as bigint) as runs, cast(away_runs as bigint) as allowed from fx_games
  union all select canonical_id, season, g, away_team, home_team, cast(away_runs as bigint), cast(home_runs as bigint) from fx_games) x join fx_official o on o.game_id = x.g""")
cte("pctx", "select c.*, period from ctx c cross join lateral (select 'combined' as period union all select cast(season as varchar)) s")
cte("records", """
select period, team, count(*) as games, count(*) filter (where runs > allowed) as wins, count(*) filter (where runs < allowed) as losses,
  count(*) filter (where runs = allowed) as ties, cast(sum(runs) as bigint) as runs, cast(sum(allowed) as bigint) as runs_allowed, sum(runs) / count(*) as runs_per_game
from pctx group by period, team""")
cte("official_lines", """
select season, player_key, case when ord % 3 = 0 then 0 else "PA" + 1 end as pa, "H" as h, "HR" as hr, "BB" as bb, "SO" as so, "PA" - "BB" as ab
from (select *, cast(substr(player_key, length(player_key) - 1) as int) as ord from offense) x where ord % 2 = 0""")
cte("hit_bats", """
select b.period, batter_key as player_key, team, "PA", "OPS", defensive_war, "HR", "BB", "SO", war, br from bat_lines b join (
  select period, player_key, max(teams) as team, sum(defense_war) as defensive_war, sum(position_war) as war, sum(baserunning_runs) as br
  from (select c.*, period from combined c cross join lateral (select 'combined' as period union all select cast(season as varchar)) s) x group by period, player_key) c
  on c.player_key = b.batter_key and c.period = b.period""")


def pas(spark, sf):
    return E.with_periods(I.plate_appearances(spark, sf))


def context(spark, sf):
    def build(s, d):
        return S.game_context(I.pbp(s, d), I.series(s, d))
    return I.stage(spark, sf, "game_context", build)


def records(spark, sf):
    return S.team_records(E.with_periods(context(spark, sf)))


def hitters(spark, sf):
    """Period line of every hitter with team and values."""
    lines = S.batting_lines(pas(spark, sf), "period", "batter_key").withColumnRenamed("batter_key", "player_key")
    values = E.with_periods(PV.combined(spark, sf)).groupBy("period", "player_key").agg(
        F.max(F.array_join("teams", "|")).alias("team"), F.sum("defense_war").alias("defensive_war"),
        F.sum("position_war").alias("war"), F.sum("baserunning_runs").alias("br"),
    )
    return lines.join(values, ["period", "player_key"])


_BAT = "BA OBP SLG OPS"


@query("sct1_batting_lines", "select * from bat_lines", _BAT)
def sct1(spark, sf):
    return S.batting_lines(pas(spark, sf), "period", "batter_key")


@query("sct2_combined_seasons", """
select player_key, arg_max(player, season) as player, count(*) as seasons, cast(sum("PA") as bigint) as "PA", sum(batting_runs) as batting_runs,
  case when count(*) = 1 then any_value("wOBA") else sum("wOBA" * "PA") / nullif(sum("PA"), 0) end as "wOBA",
  case when count(*) = 1 then any_value("OBP") else sum("OBP" * "PA") / nullif(sum("PA"), 0) end as "OBP" from offense group by player_key""",
       "batting_runs wOBA OBP")
def sct2(spark, sf):
    rows = I.offense(spark, sf).select("season", "player_key", "player", "PA", "batting_runs", "wOBA", "OBP")
    return S.combine_seasons(rows, "position")


@query("sct2_combined_pitching_seasons", """
select player_key, arg_max(player, season) as player, count(*) as seasons, sum("IP") as "IP", cast(sum("ER") as bigint) as "ER", cast(sum("FIP_BF") as bigint) as "FIP_BF",
  case when count(*) = 1 then any_value("ERA") else 7 * sum("ER") / nullif(sum("IP"), 0) end as "ERA",
  case when count(*) = 1 then any_value("FIP") else sum("FIP" * "FIP_BF") / nullif(sum("FIP_BF"), 0) end as "FIP" from fip group by player_key""", "IP ERA FIP")
def sct2_pitching(spark, sf):
    rows = PV.pitcher_stage(spark, sf).select("season", "player_key", "player", "IP", "ER", "FIP_BF", "ERA", "FIP")
    return S.combine_seasons(rows, "pitcher")


def official_batting(spark, sf):
    """Official season lines of every second lineup place; every third of them lacks its PA."""
    number = F.regexp_extract("player_key", "([0-9]{2})$", 1).cast("int")
    rows = I.offense(spark, sf).withColumn("ord", number).where("ord % 2 = 0")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "season", "player_key", F.when(F.col("ord") % 3 == 0, zero).otherwise(F.col("PA") + 1).alias("plateAppearances"),
        (F.col("PA") - F.col("BB")).alias("atBat"), F.col("H").alias("hits"), F.col("HR").alias("homeRuns"), F.col("BB").alias("baseonBalls"),
        F.col("SO").alias("strikeOuts"),
        *[zero.alias(c) for c in ("doubles", "triples", "hitByPitch", "stolenBasesAttempts", "stolenBases", "caughtStealing", "sacrificeFly")],
    )


@query("sct3_merged_official_batting", """
select player_key, cast(sum(pa) as bigint) as "plateAppearances", cast(sum(ab) as bigint) as "atBat", cast(sum(h) as bigint) as hits, cast(sum(hr) as bigint) as "homeRuns",
  sum(h) / nullif(sum(ab), 0) as "battingAverage", sum(h + bb) / nullif(sum(ab + bb), 0) as "onBasePercentage", sum(h + 3 * hr) / nullif(sum(ab), 0) as "sluggingPercentage",
  coalesce(sum(h + bb) / nullif(sum(ab + bb), 0), 0.0) + coalesce(sum(h + 3 * hr) / nullif(sum(ab), 0), 0.0) as "opsPercentage" from official_lines group by player_key""",
       "battingAverage onBasePercentage sluggingPercentage opsPercentage")
def sct3(spark, sf):
    return S.merge_official_batting(official_batting(spark, sf)).select(
        "player_key", "plateAppearances", "atBat", "hits", "homeRuns", "battingAverage", "onBasePercentage", "sluggingPercentage", "opsPercentage"
    )


def official_pitching(spark, sf):
    zero = F.lit(0).cast("bigint")
    box = PV.P.pitching_totals(I.box_pitching(spark, sf))
    innings = F.floor(F.col("pitching_outs") / 3.0) + (F.col("pitching_outs") % 3) / 10.0
    return box.select(
        "season", "player_key", innings.alias("inningsPitched"), F.col("G").alias("appearances"), F.col("GS").alias("gamesStarted"),
        F.col("H_allowed").alias("hitsAllowed"), F.col("BB_allowed").alias("baseOnBalls"), F.col("SO_pitching").alias("strikeOuts"),
        F.col("ER").alias("earnedRuns"), *[zero.alias(c) for c in ("numberOfPitches", "strikes", "wins", "losses")],
    )


@query("sct3_merged_official_pitching", """
select player_key, cast(sum("G") as bigint) as appearances, cast(sum("ER") as bigint) as "earnedRuns", sum(pitching_outs) / 3 as "inningsPitched",
  7 * sum("ER") / (sum(pitching_outs) / 3) as "earnedRunAverage", sum("H_allowed" + "BB_allowed") / (sum(pitching_outs) / 3) as whip from pitch_totals group by player_key""",
       "inningsPitched earnedRunAverage whip")
def sct3_pitching(spark, sf):
    return S.merge_official_pitching(official_pitching(spark, sf)).select(
        "player_key", "appearances", "earnedRuns", "inningsPitched", "earnedRunAverage", "whip"
    )


@query("sct4_hitting_lines", """
select player_key, coalesce(nullif(o.pa, 0), d."PA", 0) as "PA", coalesce(nullif(o.ab, 0), d."AB", 0) as "AB", coalesce(nullif(o.h, 0), d."H", 0) as "H",
  coalesce(nullif(o.so, 0), d."SO", 0) as "K", coalesce(nullif(o.bb, 0), d."BB", 0) as "BB", coalesce(nullif(o.hr, 0), d."HR", 0) as "HR",
  coalesce(d."2B", 0) + coalesce(d."3B", 0) + coalesce(nullif(o.hr, 0), d."HR", 0) as "XBH",
  coalesce(nullif(o.so, 0), d."SO", 0) / coalesce(nullif(o.pa, 0), d."PA") as "K_pct",
  case when o.ab is null then d."BA" else o.h / nullif(o.ab, 0) end as "BA", coalesce(bunts, 0) as "Bunts", gb as "GB_pct"
from (select batter_key as player_key, * from bat_lines where period = 'combined') d
full join (select player_key, cast(sum(pa) as bigint) as pa, cast(sum(ab) as bigint) as ab, cast(sum(h) as bigint) as h, cast(sum(hr) as bigint) as hr,
  cast(sum(bb) as bigint) as bb, cast(sum(so) as bigint) as so from official_lines group by player_key) o using (player_key)
left join (select batter_key as player_key, count(*) filter (where contact = 'Bunt') as bunts,
  count(*) filter (where contact = 'Ground') / nullif(count(*) filter (where contact <> 'Other' or (spray is not null and event_type in """ + _CONTACT + """)), 0) as gb
  from ppas where period = 'combined' group by batter_key) c using (player_key)""", "K_pct BA GB_pct")
def sct4(spark, sf):
    rows = pas(spark, sf).where("period = 'combined'")
    derived = S.batting_lines(rows, "batter_key").withColumnRenamed("batter_key", "player_key")
    contact = S.small_ball(rows, "batter_key").select(F.col("batter_key").alias("player_key"), "bunts", "GB_pct")
    return S.hitting_line(derived, S.merge_official_batting(official_batting(spark, sf)), contact).select(
        "player_key", "PA", "AB", "H", "K", "BB", "HR", "XBH", "K_pct", "BA", "Bunts", "GB_pct"
    )


@query("sct4_pitching_lines", """
select player_key, ip as "IP", h as "H", bb as "BB", so as "SO", cast(coalesce(n, 0) as bigint) as "Pitches", cast(coalesce(s, 0) as bigint) as "Strikes",
  er * 7 / ip as "ERA", (h + bb) / ip as "WHIP", 7 * so / ip as "SO7", 7 * bb / ip as "BB7", s / nullif(n, 0) as "S_pct"
from (select player_key, sum(pitching_outs) / 3 as ip, cast(sum("H_allowed") as bigint) as h, cast(sum("BB_allowed") as bigint) as bb, cast(sum("SO_pitching") as bigint) as so,
  sum("ER") as er from pitch_totals group by player_key) a
left join (select pitcher_key as player_key, count(*) as n, count(*) filter (where strike) as s from pitch_rows where period = 'combined' group by pitcher_key) b using (player_key)
where ip > 0""", "IP ERA WHIP SO7 BB7 S_pct")
def sct4_pitching(spark, sf):
    seen = S.pitch_rows(pas(spark, sf).where("period = 'combined'"), "pitcher_key").groupBy(F.col("pitcher_key").alias("player_key")).agg(
        F.count("*").alias("pitches"), F.count_if("strike").alias("strikes_seen")
    )
    advanced = PV.pitcher_stage(spark, sf).groupBy("player_key").agg(
        F.sum("IP").alias("IP"), F.sum("H_allowed").alias("H_allowed"), F.sum("BB_allowed").alias("BB_allowed"), F.sum("SO_pitching").alias("SO_pitching"),
        F.sum("G").alias("G"), F.sum("GS").alias("GS"), (7 * F.sum("ER") / F.sum("IP")).alias("ERA"),
    )
    return S.pitching_line(advanced, S.merge_official_pitching(official_pitching(spark, sf)), seen).select(
        "player_key", "IP", "H", "BB", "SO", "Pitches", "Strikes", "ERA", "WHIP", "SO7", "BB7", "S_pct"
    )


@query("sct5_matchups", bat_sql("ppas", "period, batter_key, pitcher_key"), _BAT)
def sct5(spark, sf):
    return S.matchups(pas(spark, sf), "period")


@query("sct6_hitter_game_logs", f"""
select l.*, c.opponent, c.result, c.date, results from ({bat_sql('pas', 'canonical_id, batter_key, batting_team')}) l
join (select canonical_id, batter_key, string_agg(case event_type when 'single' then '1B' when 'double' then '2B' when 'triple' then '3B' when 'home_run' then 'HR' when 'walk' then 'BB'
  when 'intentional_walk' then 'IBB' when 'hit_by_pitch' then 'HBP' when 'strikeout' then 'K' when 'dropped_third_out' then 'K' when 'dropped_third_reached' then 'K / Reach'
  when 'reached_on_error' then 'ROE' when 'fielders_choice' then 'FC' when 'double_play' then 'DP' when 'sacrifice_bunt' then 'SAC' when 'sacrifice_fly' then 'SF'
  when 'out' then 'Out' when 'infield_fly' then 'Out' when 'catcher_interference' then 'CI' end, '|' order by event_order) as results from pas group by canonical_id, batter_key) r
  using (canonical_id, batter_key) left join ctx c on c.canonical_id = l.canonical_id and c.team = l.batting_team""", _BAT)
def sct6(spark, sf):
    logs = S.hitter_game_logs(I.plate_appearances(spark, sf), context(spark, sf))
    return logs.withColumn("results", F.array_join(F.transform("plate_appearances", lambda p: p["result"]), "|")).drop("plate_appearances")


@query("sct7_pitcher_game_logs", """
select p.canonical_id, p.pitcher_key, p.team, case when b.outs is not null then b.outs / 3.0 else floor(p.outs / 3.0) + (p.outs % 3) / 10.0 end as "IP",
  cast(coalesce(b.h, p.h) as bigint) as "H", cast(coalesce(b.r, p.r) as bigint) as "R", cast(coalesce(b.er, p.r) as bigint) as "ER", cast(coalesce(b.bb, p.bb) as bigint) as "BB",
  cast(coalesce(b.so, p.so) as bigint) as "SO", p.bf as "BF", c.opponent, c.result, c.date
from (select canonical_id, pitcher_key, fielding_team as team, count(*) as bf, sum(greatest(0, outs_after - outs_before)) as outs, sum(runs_scored) as r, sum(hit) as h,
    sum(bb) as bb, sum(so) as so from pas group by canonical_id, pitcher_key, fielding_team) p
left join (select * from fx_box_pitching where list_ordinal % 2 = 0) b using (canonical_id, pitcher_key) left join ctx c on c.canonical_id = p.canonical_id and c.team = p.team""", "IP")
def sct7(spark, sf):
    # the box knows every second listed pitcher only, so both branches are used
    box = I.box_pitching(spark, sf).where("list_ordinal % 2 = 0")
    return S.pitcher_game_logs(I.plate_appearances(spark, sf), box, context(spark, sf))


@query("sct8_game_context", "select * from ctx")
def sct8(spark, sf):
    return S.game_context(I.pbp(spark, sf), I.series(spark, sf))


_LOCATIONS = "('Pitcher'),('Catcher'),('First Base'),('Second Base'),('Third Base'),('Shortstop'),('Left Field'),('Center Field'),('Right Field')"


@query("sct9_spray_counts", f"""
select period, batter_key, location, coalesce(n, 0) as n, total, coalesce(n, 0) / total as share,
  case when coalesce(n, 0) / total > 0.3 then 'hot' when coalesce(n, 0) / total > 0.2 then 'warm' when coalesce(n, 0) / total > 0.1 then 'mild' else 'cold' end as band
from (select period, batter_key, count(*) as total from ppas where spray is not null and event_type in {_CONTACT} group by period, batter_key) t
cross join (values {_LOCATIONS}) l(location)
left join (select period, batter_key, spray as location, count(*) as n from ppas where spray is not null and event_type in {_CONTACT} group by period, batter_key, spray) s
  using (period, batter_key, location)""", "share")
def sct9(spark, sf):
    return S.spray_counts(pas(spark, sf), "period", "batter_key")


@query("sct9_batted_balls", f"""
select canonical_id, event_order, batter_key, spray as location, case when contact = 'Other' then 'Batted Ball' else contact end as contact, cast(game_ts as date) as date, pitcher
from ppas where period = 'combined' and spray is not null and event_type in {_CONTACT}""")
def sct9_balls(spark, sf):
    return S.batted_balls(I.plate_appearances(spark, sf)).drop("result")


cte("approach_rows", f"""
select k.batter_key, k.count, coalesce(n, 0) as pitches, coalesce(s, 0) as swings, coalesce(c, 0) as called_strikes, s / nullif(n, 0) as swing_pct, c / nullif(n, 0) as called_strike_pct
from (select distinct batter_key, count from (select distinct batter_key from pitch_rows where count in {_COUNTS}) a
  cross join (select unnest(['0-0','0-1','0-2','1-0','1-1','1-2','2-0','2-1','2-2','3-0','3-1','3-2']) as count) b) k
left join (select batter_key, count, count(*) as n, count(*) filter (where swing) as s, count(*) filter (where called) as c from pitch_rows
  where period = 'combined' and count in {_COUNTS} group by batter_key, count) x using (batter_key, count)
union all select null, count, count(*), count(*) filter (where swing), count(*) filter (where called), count(*) filter (where swing) / count(*), count(*) filter (where called) / count(*)
from pitch_rows where period = 'combined' and count in {_COUNTS} group by count""")


@query("sct10_approach", "select * from approach_rows", "swing_pct called_strike_pct")
def sct10(spark, sf):
    return S.approach(S.pitch_rows(I.plate_appearances(spark, sf), "batter_key"), "batter_key")


@query("sct10_approach_difference", """
select batter_key, count, a.swing_pct - l.swing_pct as difference,
  case when a.swing_pct - l.swing_pct > 0.025 then 'above' when a.swing_pct - l.swing_pct < -0.025 then 'below' when a.swing_pct - l.swing_pct is not null then 'even' end as band
from approach_rows a join (select count, swing_pct from approach_rows where batter_key is null) l using (count) where batter_key is not null""", "difference")
def sct10_difference(spark, sf):
    return S.approach_difference(S.approach(S.pitch_rows(I.plate_appearances(spark, sf), "batter_key"), "batter_key"), "batter_key")


@query("sct11_small_ball", f"""
select period, batter_key, count(*) filter (where contact = 'Bunt') as bunts, count(*) filter (where contact = 'Ground') as ground_balls,
  count(*) filter (where contact = 'Ground' and spray in ('Pitcher','Catcher','First Base','Second Base','Third Base','Shortstop')) as infield_ground_balls,
  count(*) filter (where contact <> 'Other' or (spray is not null and event_type in {_CONTACT})) as balls_in_play,
  count(*) filter (where contact = 'Ground') / nullif(count(*) filter (where contact <> 'Other' or (spray is not null and event_type in {_CONTACT})), 0) as "GB_pct"
from ppas group by period, batter_key""", "GB_pct")
def sct11(spark, sf):
    return S.small_ball(pas(spark, sf), "period", "batter_key")


@query("sct12_running_routes", """
select season, player_key, count(*) as opportunities,
  count(*) filter (where action in ('advance','score') and coalesce(destination, 0) - start_base >= 2) as extra_bases_taken,
  count(*) filter (where action = 'advance' and start_base = 1 and destination = 3) as first_to_third,
  count(*) filter (where action = 'score' and start_base = 2 and destination = 4) as second_to_home,
  count(*) filter (where action = 'score' and start_base = 1 and destination = 4) as first_to_home, count(*) filter (where action = 'out') as advancement_outs
from opportunities where role = 'runner' group by season, player_key""")
def sct12(spark, sf):
    return S.running_routes(I.opportunities(spark, sf), "season", "player_key")


cte("quals", """
select period, round_even(avg(games), 0) as qualifier_games, cast(ceil(1.5 * round_even(avg(games), 0)) as bigint) as hitting_pa,
  0.75 * round_even(avg(games), 0) as pitching_ip from (select period, team, count(distinct canonical_id) as games from pctx group by period, team) x group by period""")


@query("sct13_qualifiers", "select * from quals", "qualifier_games pitching_ip")
def sct13(spark, sf):
    return S.qualifiers(E.with_periods(context(spark, sf)))


# fixed values: metrics of the percentile cards and whether a low value is good
HITTER_METRICS = {
    "wOBA": ("wOBA", False), "BB%": ("BB_pct", False), "K%": ("K_pct", True), "HR rate": ("HR_pct", False), "Baserunning": ("br", False),
    "Range": ("range_runs", False), "Arm": ("arm", False), "Position WAR": ("war", False),
}
PITCHER_METRICS = {
    "ERA": ("ERA", True), "FIP": ("FIP", True), "WHIP": ("WHIP", True), "K/7": ("K7", False), "BB/7": ("BB7", True), "Pitcher WAR": ("war", False),
}

cte("hit_values", """
select period, player_key, sum("wOBA" * "PA") / nullif(sum("PA"), 0) as "wOBA", sum(range_runs) as range_runs, sum(arm) as arm,
  cast(sum(chances) as bigint) as chances, cast(sum(attempts) as bigint) as attempts from (
  select p.season, p.player_key, coalesce(o."wOBA", 0.0) as "wOBA", p."PA", p.range_runs, arm_runs + catcher_throwing_runs as arm,
    coalesce(g.n - g.pitch_n, 0) as chances, coalesce(b.sb_cs_attempts, 0) as attempts, period
  from position_final p left join offense o using (season, player_key) left join ranges g using (season, player_key) left join running b using (season, player_key) cross join lateral (select 'combined' as period union all select cast(p.season as varchar)) s) x
group by period, player_key""")
cte("pitch_values", """
select period, player_key, sum("IP") as "IP", 7 * sum("ER") / sum("IP") as "ERA", sum("FIP" * "FIP_BF") / nullif(sum("FIP_BF"), 0) as "FIP",
  sum("H_allowed" + "BB_allowed") / sum("IP") as "WHIP", 7 * sum("SO_pitching") / sum("IP") as "K7", 7 * sum("BB_allowed") / sum("IP") as "BB7", sum(pitching_war0) as war
from (select f.*, period from pitcher_final f cross join lateral (select 'combined' as period union all select cast(season as varchar)) s) x group by period, player_key""")
cte("metric_rows", """
select period, player_key, metric, round(coalesce(value, 0.0), 6) as value, lower from (
  select h.*, hitting_pa, v."wOBA", v.range_runs, v.arm from hit_bats h join quals using (period) left join hit_values v using (period, player_key)) b
cross join lateral (select 'wOBA' as metric, "wOBA" as value, false as lower union all select 'BB%', "BB" / "PA", false union all select 'K%', "SO" / "PA", true
  union all select 'HR rate', "HR" / "PA", false union all select 'Baserunning', br, false union all select 'Range', range_runs, false
  union all select 'Arm', arm, false union all select 'Position WAR', war, false) m
where "PA" >= hitting_pa
union all
select period, player_key, metric, round(coalesce(value, 0.0), 6) as value, lower from (select p.*, pitching_ip from pitch_values p join quals using (period)) b
cross join lateral (select 'ERA' as metric, "ERA" as value, true as lower union all select 'FIP', "FIP", true union all select 'WHIP', "WHIP", true
  union all select 'K/7', "K7", false union all select 'BB/7', "BB7", true union all select 'Pitcher WAR', war, false) m
where "IP" >= pitching_ip""")


def hitter_values(spark, sf):
    rows = E.with_periods(PV.position_stage(spark, sf))
    return rows.groupBy("period", "player_key").agg(
        ratio(F.sum(F.col("wOBA") * F.col("PA")), F.sum("PA")).alias("wOBA"), F.sum("range_runs").alias("range_runs"), F.sum("throwing_runs").alias("arm"),
        F.sum("fielding_opportunities").alias("chances"), F.sum("sb_cs_attempts").alias("attempts"),
    )


def pitcher_values(spark, sf):
    rows, ip = E.with_periods(PV.pitcher_stage(spark, sf)), F.sum("IP")
    return rows.groupBy("period", "player_key").agg(
        ip.alias("IP"), ratio(7 * F.sum("ER"), ip).alias("ERA"), ratio(F.sum(F.col("FIP") * F.col("FIP_BF")), F.sum("FIP_BF")).alias("FIP"),
        ratio(F.sum(F.col("H_allowed") + F.col("BB_allowed")), ip).alias("WHIP"), ratio(7 * F.sum("SO_pitching"), ip).alias("K7"),
        ratio(7 * F.sum("BB_allowed"), ip).alias("BB7"), F.sum("pitcher_war").alias("war"),
    )


def metric_table(spark, sf):
    least = F.broadcast(S.qualifiers(E.with_periods(context(spark, sf))))
    bats = hitters(spark, sf).join(least, "period").where(F.col("PA") >= F.col("hitting_pa")).join(hitter_values(spark, sf), ["period", "player_key"], "left")
    bats = bats.withColumns({"BB_pct": F.col("BB") / F.col("PA"), "K_pct": F.col("SO") / F.col("PA"), "HR_pct": F.col("HR") / F.col("PA")})
    arms = pitcher_values(spark, sf).join(least, "period").where(F.col("IP") >= F.col("pitching_ip"))
    rows = S.unpivot_metrics(bats, HITTER_METRICS, "period").unionByName(S.unpivot_metrics(arms, PITCHER_METRICS, "period"))
    return rows.withColumn("value", F.round("value", 6))


@query("sct14_percentiles", """
select period, metric, player_key, value, cast(greatest(1, least(99, round_even(case when lower then 100 - score else score end, 0))) as int) as percentile,
  case when lower then row_number() over (partition by period, metric order by value, player_key) else row_number() over (partition by period, metric order by value desc, player_key) end as rank,
  n as of
from (select *, count(*) over (partition by period, metric) as n,
    100 * (rank() over (partition by period, metric order by value) - 1 + 0.5 * count(*) over (partition by period, metric, value)) / count(*) over (partition by period, metric) as score
  from metric_rows) x""", "value")
def sct14(spark, sf):
    return S.percentiles(metric_table(spark, sf), "period")


cte("team_sum", """
select r.*, b."OPS", b.defensive_war, p."ERA", sb as stolen_bases_allowed, cs as caught_stealing, sb + cs as attempts, cs / nullif(sb + cs, 0) as caught_pct
from records r left join (select period, team, sum("OPS" * "PA") / nullif(sum("PA"), 0) as "OPS", sum(defensive_war) as defensive_war from hit_bats group by period, team) b using (period, team)
left join (select period, teams as team, 7 * sum("ER") / nullif(sum("IP"), 0) as "ERA" from (select p.*, period from pitching p cross join lateral (select 'combined' as period union all select cast(season as varchar)) s) x
  group by period, teams) p using (period, team)
left join (select period, team, cast(sum(sb) as bigint) as sb, cast(sum(cs) as bigint) as cs from (
  select period, c.team, sb, cs from fx_catchers c cross join lateral (select 'combined' as period union all select cast(season as varchar)) s) y group by period, team) c using (period, team)""")


def team_summary(spark, sf):
    staff = E.with_periods(PV.pitcher_stage(spark, sf)).select("period", F.array_join("teams", "|").alias("team"), "IP", "ER")
    catching = E.with_periods(I.catching(spark, sf)).select("period", "team", "sb", "cs")
    return S.team_summary(records(spark, sf), hitters(spark, sf), staff, catching)


@query("sct15_team_summary", "select * from team_sum", "runs_per_game OPS defensive_war ERA caught_pct")
def sct15(spark, sf):
    return team_summary(spark, sf)


cte("leader_rows", """
select h.period, h.team, h.player_key, h."PA", h.defensive_war, h.br, v."wOBA", coalesce(chances, 0) as chances, coalesce(extra, 0) as extra,
  coalesce(attempts, 0) + coalesce(bunts, 0) + coalesce(infield, 0) as small
from hit_bats h left join hit_values v using (period, player_key)
left join (select period, batter_key as player_key, count(*) filter (where contact = 'Bunt') as bunts,
    count(*) filter (where contact = 'Ground' and spray in ('Pitcher','Catcher','First Base','Second Base','Third Base','Shortstop')) as infield
  from ppas group by period, batter_key) s using (period, player_key)
left join (select period, player_key, count(*) filter (where action in ('advance','score') and coalesce(destination, 0) - start_base >= 2) as extra
  from (select o.*, period from opportunities o cross join lateral (select 'combined' as period union all select cast(season as varchar)) z) y
  where role = 'runner' group by period, player_key) r using (period, player_key)""")


@query("sct16_team_leaders", """
select period, team, list, cast(place as int) as place, player_key from (
  select period, team, 'hitters' as list, row_number() over (partition by period, team order by round(coalesce("wOBA", 0.0), 6) desc, "PA" desc, player_key) as place, player_key, 6 as size from leader_rows
  union all select period, team, 'pitchers', row_number() over (partition by period, team order by round(war, 6) desc, round("IP", 6) desc, player_key), player_key, 6
    from (select v.*, t.team from pitch_values v join (select period, player_key, max(teams) as team from (select f.*, period from pitcher_final f
      cross join lateral (select 'combined' as period union all select cast(season as varchar)) s) x group by period, player_key) t using (period, player_key)) y
  union all select period, team, 'small_ball', row_number() over (partition by period, team order by small desc, player_key), player_key, 6 from leader_rows
  union all select period, team, 'baserunners', row_number() over (partition by period, team order by round(br, 6) desc, extra desc, player_key), player_key, 6 from leader_rows
  union all select period, team, 'defenders_best', row_number() over (partition by period, team order by round(defensive_war, 6) desc, player_key), player_key, 4 from leader_rows where chances >= 10
  union all select period, team, 'defenders_worst', row_number() over (partition by period, team order by round(defensive_war, 6), player_key), player_key, 4 from leader_rows where chances >= 10
  union all select period, team, 'spray_overview', row_number() over (partition by period, team order by "PA" desc, player_key), player_key, 12 from leader_rows) x where place <= size""")
def sct16(spark, sf):
    keys, key = ["period", "player_key"], F.col("player_key")
    small = S.small_ball(pas(spark, sf), "period", "batter_key").select("period", F.col("batter_key").alias("player_key"), "bunts", "infield_ground_balls")
    routes = S.running_routes(E.with_periods(I.opportunities(spark, sf)), "period", "player_key").select(*keys, "extra_bases_taken")
    rows = hitters(spark, sf).join(hitter_values(spark, sf), keys, "left").join(small, keys, "left").join(routes, keys, "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    small_ball = none("attempts") + none("bunts") + none("infield_ground_balls")
    worth, woba = F.round("defensive_war", 6), F.round(F.coalesce("wOBA", F.lit(0.0)), 6)
    enough = none("chances") >= 10
    bats = S.team_leaders(rows, {
        "hitters": ([woba.desc(), F.desc("PA"), key], 6), "small_ball": ([small_ball.desc(), key], 6),
        "baserunners": ([F.round("br", 6).desc(), none("extra_bases_taken").desc(), key], 6), "defenders_best": ([worth.desc(), key], 4, enough),
        "defenders_worst": ([worth.asc(), key], 4, enough), "spray_overview": ([F.desc("PA"), key], 12),
    }, "period", "team")
    staff = E.with_periods(PV.pitcher_stage(spark, sf)).groupBy(*keys).agg(F.max(F.array_join("teams", "|")).alias("team"))
    arms = pitcher_values(spark, sf).join(staff, keys)
    return bats.unionByName(S.team_leaders(arms, {"pitchers": ([F.round("war", 6).desc(), F.round("IP", 6).desc(), key], 6)}, "period", "team"))


@query("sct17_team_rankings", """
select period, team, metric, cast(row_number() over (partition by period, metric order by round(sort, 6), team) as int) as place from team_sum
cross join lateral (select 'record' as metric, -(wins / games) as sort union all select 'runsPerGame', -runs_per_game union all select 'ERA', coalesce("ERA", 0.0)
  union all select 'OPS', -coalesce("OPS", 0.0)) m""")
def sct17(spark, sf):
    teams = team_summary(spark, sf).withColumn("pct", F.round(F.col("wins") / F.col("games"), 6))
    teams = teams.withColumns({c: F.round(c, 6) for c in ("runs_per_game", "ERA", "OPS")})
    return S.team_rankings(teams, {"record": ("pct", True), "runsPerGame": ("runs_per_game", True), "ERA": ("ERA", False), "OPS": ("OPS", True)})


@query("sct18_pythagorean", """
select period, team, games, wins, p as expected_pct, p * games as expected_wins, wins - p * games as luck, cast(round(p * games, 0) as bigint) as rounded_wins,
  games - cast(round(p * games, 0) as bigint) as rounded_losses
from (select *, pow(runs, 2) / nullif(pow(runs, 2) + pow(runs_allowed, 2), 0) as p from records) x""", "expected_pct expected_wins luck")
def sct18(spark, sf):
    return S.pythagorean(records(spark, sf))


cte("pyth_rows", """
select period, e / 100.0 as exponent, pow(pow(runs, e / 100.0) / (pow(runs, e / 100.0) + pow(runs_allowed, e / 100.0)) - wins / (wins + losses), 2) as se
from records cross join (select unnest(range(50, 351)) as e) x where period <> 'combined' and runs > 0 and runs_allowed > 0 and wins + losses > 0""")
cte("pyth_folds", "select f as fold, exponent, avg(se) as mse, count(*) as n from pyth_rows cross join lateral (select 'pooled' as f union all select period) x group by f, exponent")


@query("sct19_pythagorean_study", """
select b.fold, fitted_exponent, training_mse, standard_training_mse, team_seasons, t.mse as test_mse, s.mse as standard_test_mse
from (select fold, arg_min(exponent, struct_pack(m := mse, e := exponent)) as fitted_exponent, min(mse) as training_mse, max(mse) filter (where exponent = 2.0) as standard_training_mse,
  any_value(n) as team_seasons from pyth_folds group by fold) b
left join (select p.fold, q.exponent, avg(q.se) as mse from (select distinct fold from pyth_folds where fold <> 'pooled') p join pyth_rows q on q.period <> p.fold group by p.fold, q.exponent) t
  on t.fold = b.fold and t.exponent = b.fitted_exponent
left join (select p.fold, avg(q.se) as mse from (select distinct fold from pyth_folds where fold <> 'pooled') p join pyth_rows q on q.period <> p.fold and q.exponent = 2.0 group by p.fold) s
  on s.fold = b.fold""", "fitted_exponent training_mse standard_training_mse test_mse standard_test_mse")
def sct19(spark, sf):
    return S.pythagorean_study(records(spark, sf))


@query("sct20_base_override", """
select c.period, c.team, b.games, b.wins, b.losses, c.runs, c.runs_allowed from records c join records b on b.period = '2026' and b.team = c.team where c.period = 'combined'""")
def sct20(spark, sf):
    rows = records(spark, sf).select("period", "team", "games", "wins", "losses", "runs", "runs_allowed")
    return S.base_override(rows.where("period = 'combined'"), rows.where("period = '2026'"), ["games", "wins", "losses"])


@query("sct21_leaderboard_rows", """
select season, player_key, total_war, o."wOBA", o."H", o."HR", o."BB", o."SO" from combined left join offense o using (season, player_key)""", "total_war wOBA")
def sct21(spark, sf):
    return S.leaderboard_rows(PV.combined(spark, sf), I.offense(spark, sf)).select("season", "player_key", "total_war", "wOBA", "H", "HR", "BB", "SO")


@query("evt14_pitches", """
select canonical_id, event_order, pitch_number, action, count, swing, called, strike from pitch_rows where period = 'combined'""")
def evt14(spark, sf):
    return S.pitch_rows(I.plate_appearances(spark, sf), "canonical_id", "event_order")
