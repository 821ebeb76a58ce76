"""Player value queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basepaths.operators import pitching as P
from basepaths.operators import value as V
from basepaths.plans import inputs as I
from basepaths.plans.registry import cte, query

_OUT = "('out','strikeout','double_play','fielders_choice','infield_fly','batter_interference','dropped_third_out')"
_WOBA = "('single','double','triple','home_run','walk','hit_by_pitch')"
_OBP = "('single','double','triple','home_run','walk','intentional_walk','hit_by_pitch')"
_NOT_DEN = "('intentional_walk','sacrifice_bunt','catcher_interference')"
_REACH = ("('single','double','triple','home_run','walk','intentional_walk','hit_by_pitch','reached_on_error',"
          "'fielders_choice','dropped_third_reached')")

cte("pa", "select * from valued where is_plate_appearance")
cte("out_mean", f"select avg(run_value) as out_run_value from pa where event_type in {_OUT}")
cte("raw_w", f"""select event_type, avg(run_value) - (select out_run_value from out_mean) as w from pa
where event_type in {_WOBA} group by event_type""")
cte("league", f"""
select season, count(*) filter (where event_type not in {_NOT_DEN}) as den,
  count(*) filter (where event_type in {_OBP}) / count(*) filter (where event_type not in {_NOT_DEN}) as league_woba,
  (count(*) filter (where event_type in {_OBP})) / sum(coalesce(w, 0)) as woba_scale
from pa left join raw_w using (event_type) group by season""")
cte("offense_team", f"""
select season, player_key, team, player, "PA", woba_denom, "H", "1B", "2B", "3B", "HR", "BB", "IBB", "HBP", "SO", "ROE", "SF", "SH",
  reach_opportunities, woba_raw_numerator,
  coalesce(woba_raw_numerator / nullif(woba_denom, 0), 0.0) * woba_scale as "wOBA",
  coalesce(onbase / nullif(woba_denom, 0), 0.0) as "OBP",
  (coalesce(woba_raw_numerator / nullif(woba_denom, 0), 0.0) * woba_scale - league_woba) / woba_scale * woba_denom as batting_runs, onbase
from (select season, batter_key as player_key, batting_team as team, min(batter) as player, count(*) as "PA",
  count(*) filter (where event_type not in {_NOT_DEN}) as woba_denom,
  count(*) filter (where event_type in ('single','double','triple','home_run')) as "H",
  count(*) filter (where event_type = 'single') as "1B", count(*) filter (where event_type = 'double') as "2B",
  count(*) filter (where event_type = 'triple') as "3B", count(*) filter (where event_type = 'home_run') as "HR",
  count(*) filter (where event_type in ('walk','intentional_walk')) as "BB", count(*) filter (where event_type = 'intentional_walk') as "IBB",
  count(*) filter (where event_type = 'hit_by_pitch') as "HBP",
  count(*) filter (where event_type in ('strikeout','dropped_third_out','dropped_third_reached')) as "SO",
  count(*) filter (where event_type = 'reached_on_error') as "ROE", count(*) filter (where event_type = 'sacrifice_fly') as "SF",
  count(*) filter (where event_type = 'sacrifice_bunt') as "SH", count(*) filter (where event_type in {_REACH}) as reach_opportunities,
  sum(coalesce(w, 0)) as woba_raw_numerator, count(*) filter (where event_type in {_OBP}) as onbase
  from pa left join raw_w using (event_type) group by season, batter_key, batting_team) x join league using (season)""")
cte("offense", """
select season, player_key, min(player) as player, string_agg(distinct team, '|' order by team) as teams, cast(sum("PA") as bigint) as "PA",
  cast(sum("H") as bigint) as "H", cast(sum("HR") as bigint) as "HR", cast(sum("BB") as bigint) as "BB", cast(sum("SO") as bigint) as "SO",
  cast(sum(reach_opportunities) as bigint) as reach_opportunities, cast(sum(woba_denom) as bigint) as woba_denom,
  coalesce(sum(woba_raw_numerator) / nullif(sum(woba_denom), 0), 0.0) * any_value(woba_scale) as "wOBA",
  coalesce(sum(onbase) / nullif(sum(woba_denom), 0), 0.0) as "OBP",
  (coalesce(sum(woba_raw_numerator) / nullif(sum(woba_denom), 0), 0.0) * any_value(woba_scale) - any_value(league_woba)) / any_value(woba_scale)
    * sum(woba_denom) as batting_runs
from offense_team join league using (season) group by season, player_key""")

_POS = "first baseman|second baseman|third baseman|center fielder|right fielder|left fielder|shortstop|pitcher|catcher"
cte("texted", f"""
select *, case when low like '%bunt%' then 'bunt' when regexp_matches(low, 'ground ball|grounds |grounded ') then 'ground'
  when regexp_matches(low, 'line drive|lines |lined ') then 'line' when regexp_matches(low, 'pop fly|pops |popped |infield fly') then 'pop'
  when regexp_matches(low, 'fly ball|flies |flied ') then 'fly' end as traj,
  nullif(regexp_extract(low, '({_POS})', 1), '') as first_pos, len(regexp_extract_all(low, '({_POS})')) as mentions,
  nullif(regexp_extract(regexp_extract(play_text, '^.*?({_POS})(.*)$', 2), '(Fielder|Batter|Pitcher) T[0-9]+ N[0-9]+'), '') as named
from (select *, lower(play_text) as low from valued) x""")
cte("runner_rows", """
select t.*, b as start_base, cast((event_id + b) % 5 as int) as a,
  concat('Batter T', bat_no, ' N', lpad(cast((slot + 15 - b) % 15 as varchar), 2, '0')) as runner
from texted t cross join (select cast(unnest([1, 2, 3]) as int) as b) x where (bases_before >> (b - 1)) % 2 = 1""")
cte("candidates", """
select *, case when action is null then case when role = 'runner' then 'incumbent runner absent after play without explicit action'
    else 'batter absent after advancement-eligible play without explicit action' end
  when action not in ('score', 'out') and coalesce(destination, 0) not in (1, 2, 3) then 'eligible action has no valid destination' end as reason,
  greatest(outs_before, outs_after - case when action = 'out' then 1 else 0 end) + case when action = 'out' then 1 else 0 end as u_outs,
  (case when held is null then bases_after else bases_after & ~(1 << (held - 1)) end)
    | (case when action in ('score', 'out') or destination not in (1, 2, 3) then 0 else 1 << (destination - 1) end) as u_bases
from (
  select event_id, season, canonical_id, event_order, event_type, outs_before, outs_after, bases_after, batting_team, fielding_team,
    coalesce(traj, 'unknown') as batted_type, case when mentions = 1 and named is not null then first_pos else 'unattributed' end as fielding_position,
    case when mentions = 1 then named end as fielder, 'runner' as role, runner as player, start_base,
    case when a = 0 then 'score' when a = 1 then 'out' when a < 4 then 'advance' when event_id % 11 <> 0 then 'remain' end as action,
    case when a = 0 then 4 when a = 1 then null when a = 4 then (case when event_id % 11 <> 0 then start_base end) else least(3, start_base + 1) end as destination,
    case when a = 4 and event_id % 11 <> 0 then start_base end as held
  from runner_rows where is_plate_appearance and event_type in ('single','double','out','sacrifice_fly','infield_fly','reached_on_error')
    and not (a in (2, 3) and event_id % 7 = 0)
  union all
  select event_id, season, canonical_id, event_order, event_type, outs_before, outs_after, bases_after, batting_team, fielding_team,
    coalesce(traj, 'unknown'), case when mentions = 1 and named is not null then first_pos else 'unattributed' end,
    case when mentions = 1 then named end, 'batter', batter, 0,
    case when event_id % 3 = 0 or seen then 'advance' end, case when event_id % 3 = 0 or seen then bb end, case when seen then bb end
  from (select *, case event_type when 'double' then 2 else 1 end as bb,
      event_id % 3 <> 0 and event_id % 6 <> 2 and not exists (select 1 from runner_rows r where r.event_id = t.event_id and r.a = 4
        and r.event_id % 11 <> 0 and r.start_base = case t.event_type when 'double' then 2 else 1 end) as seen
    from texted t where is_plate_appearance and event_type in ('single','double','reached_on_error')) y
) z""")
cte("opportunities0", """
select c.*, (case when action = 'score' then 1.0 else 0.0 end) + coalesce(r.smoothed_re, 0.0) as utility, replace(lower(player), ' ', '') as player_key
from candidates c left join re_cells r on r.outs = u_outs and r.bases = u_bases where reason is null""")
cte("opportunities1", """
select *, (sum(utility) over d + 10.0 * avg(utility) over b) / (count(*) over d + 10.0) as expected_utility from opportunities0
window b as (partition by season, role, start_base, outs_before, event_type),
  d as (partition by season, role, start_base, outs_before, event_type, batted_type, fielding_position)""")
cte("opportunities", """
select *, utility - expected_utility as raw_value, utility - expected_utility - avg(utility - expected_utility) over (partition by season) as advancement_runs
from opportunities1""")
cte("steals", """
select season, replace(lower(arg_min(runner, start_base)), ' ', '') as player_key, arg_min(runner, start_base) as runner, any_value(run_value) as run_value
from runner_rows where event_type in ('stolen_base','caught_stealing') and a < 4 and (a = 1 or (a in (2, 3) and event_id % 7 <> 0))
group by season, event_id""")
cte("steal_players", """
select *, sb_cs_raw_runs - baserunning_opportunities * coalesce(sum(sb_cs_raw_runs) over (partition by season)
  / nullif(sum(baserunning_opportunities) over (partition by season), 0), 0) as baserunning_runs
from (select season, player_key, coalesce(player, runner) as player, coalesce(n, 0) as sb_cs_attempts,
  greatest(coalesce(reach_opportunities, 0), coalesce(n, 0)) as baserunning_opportunities, coalesce(raw, 0.0) as sb_cs_raw_runs
  from offense full join (select season, player_key, min(runner) as runner, count(*) as n, sum(run_value) as raw from steals group by season, player_key) s
  using (season, player_key)) x""")
cte("running", """
select season, player_key, coalesce(o.player, s.player, a.player) as player, coalesce(sb_cs_attempts, 0) as sb_cs_attempts,
  coalesce(s.baserunning_runs, 0.0) as sb_cs_runs, coalesce(adv_n, 0) as advancement_opportunities,
  coalesce(adv_n - bat_n, 0) as runner_advancement_opportunities, coalesce(bat_n, 0) as batter_advancement_opportunities,
  coalesce(adv, 0.0) as non_steal_advancement_runs, coalesce(bat, 0.0) as batter_advancement_runs,
  coalesce(adv - bat, 0.0) as runner_advancement_runs, coalesce(s.baserunning_runs, 0.0) + coalesce(adv, 0.0) as baserunning_runs,
  coalesce(a.teams, '') as teams
from offense o full join steal_players s using (season, player_key) full join (
  select season, player_key, min(player) as player, count(*) as adv_n, count(*) filter (where role = 'batter') as bat_n,
    sum(advancement_runs) as adv, coalesce(sum(advancement_runs) filter (where role = 'batter'), 0.0) as bat,
    string_agg(distinct batting_team, '|' order by batting_team) as teams
  from opportunities group by season, player_key) a using (season, player_key)""")
cte("dp_rows", """
select season, batter as player, batter_key as player_key, outs_before as outs, coalesce(first_pos, 'unknown') as position,
  case when event_type = 'double_play' then 1 else 0 end as dp, run_value
from texted where is_plate_appearance and outs_before < 2 and bases_before % 2 = 1 and traj = 'ground'""")
cte("dp_valued", """
select *, (e - dp) * cost as raw from (
  select *, (sum(dp) over (partition by season, outs, position) + 20.0 * avg(dp) over (partition by season, outs))
      / (count(*) over (partition by season, outs, position) + 20.0) as e,
    greatest(0.25, coalesce(avg(case when dp = 0 then run_value end) over (partition by season)
      - avg(case when dp = 1 then run_value end) over (partition by season), 0.5)) as cost
  from dp_rows) x""")
cte("double_plays", """
select season, player_key, min(player) as player, count(*) as double_play_opportunities, cast(sum(dp) as bigint) as actual_double_plays,
  sum(e) as expected_double_plays, sum(raw - mean_raw) as double_play_avoidance_runs
from (select *, avg(raw) over (partition by season) as mean_raw from dp_valued) x group by season, player_key""")
cte("arms", """
select *, w * n as arm_runs_unshrunk0, arm_u * n / (n + 40.0) as arm_runs, pitch_u * n / (n + 40.0) as pitcher_arm_runs,
  (arm_u - pitch_u) * n / (n + 40.0) as non_pitcher_arm_runs
from (select season, replace(lower(fielder), ' ', '') as player_key, min(fielder) as player, count(*) as n, 1.0 as w,
  string_agg(distinct fielding_team, '|' order by fielding_team) as teams,
  count(*) filter (where fielding_position = 'pitcher') as pitch_n, sum(advancement_runs) as attributed,
  sum(-advancement_runs - center) as arm_u, coalesce(sum(-advancement_runs - center) filter (where fielding_position = 'pitcher'), 0.0) as pitch_u
  from (select *, -avg(advancement_runs) over (partition by season) as center from opportunities where fielder is not null) y
  group by season, replace(lower(fielder), ' ', '')) x""")
cte("ranges", """
select *, u * n / (n + 20.0) as range_runs, pitch_u * n / (n + 20.0) as pitcher_range_runs, (u - pitch_u) * n / (n + 20.0) as non_pitcher_range_runs
from (select season, replace(lower(named), ' ', '') as player_key, min(named) as player, string_agg(distinct first_pos, '|' order by first_pos) as positions,
    count(*) as n, count(*) filter (where first_pos = 'pitcher') as pitch_n, sum((made - rate) * (select w from raw_w where event_type = 'single')) as u,
    coalesce(sum((made - rate) * (select w from raw_w where event_type = 'single')) filter (where first_pos = 'pitcher'), 0.0) as pitch_u
  from (select *, case when event_type in ('out','double_play','fielders_choice','sacrifice_fly','sacrifice_bunt','infield_fly') then 1.0 else 0.0 end as made,
      avg(case when event_type in ('out','double_play','fielders_choice','sacrifice_fly','sacrifice_bunt','infield_fly') then 1.0 else 0.0 end)
        over (partition by season, first_pos, traj) as rate
    from texted where event_type in ('single','double','triple','out','double_play','fielders_choice','reached_on_error','sacrifice_fly','sacrifice_bunt','infield_fly')
      and traj is not null and named is not null) x
  group by season, replace(lower(named), ' ', '')) y""")
cte("catcher_rows", """
select season, player_key, player, sb as catcher_stolen_bases_allowed, cs as catcher_caught_stealing, n as catcher_steal_attempts,
  coalesce(cs / nullif(n, 0), 0.0) as catcher_cs_rate, u as catcher_throwing_runs_unshrunk,
  s - n * coalesce(sum(s) over (partition by season) / nullif(sum(n) over (partition by season), 0), 0.0) as catcher_throwing_runs
from (select *, u * case when n > 0 then n / (n + 20.0) else 0.0 end as s from (
  select *, (cs - n * coalesce(sum(cs) over (partition by season) / nullif(sum(n) over (partition by season), 0), 0)) * (select
      coalesce(avg(run_value) filter (where event_type = 'stolen_base'), 0.2) - coalesce(avg(run_value) filter (where event_type = 'caught_stealing'), -0.45)
      from valued) as u
  from (select season, replace(lower(catcher), ' ', '') as player_key, min(catcher) as player, cast(sum(sb) as bigint) as sb, cast(sum(cs) as bigint) as cs,
    cast(sum(sb + cs) as bigint) as n from fx_catchers group by season, replace(lower(catcher), ' ', '')) a) b) c""")

_OFFENSE = 'season, player_key, player, "PA", "H", "HR", "BB", "SO", reach_opportunities, woba_denom, "wOBA", "OBP", batting_runs'


@query("war1_woba_constants", f"""
select season, (select out_run_value from out_mean) as out_run_value, den as calibration_pa, league_woba, league_woba as league_obp, woba_scale,
  {', '.join(f"(select w from raw_w where event_type = '{e}') as raw_{e}" for e in ('single','double','triple','home_run','walk','hit_by_pitch'))}
from league""", "out_run_value league_woba league_obp woba_scale raw_single raw_double raw_triple raw_home_run raw_walk raw_hit_by_pitch")
def war1(spark, sf):
    rows = V.woba_constants(I.valued(spark, sf))
    weights = [F.col("raw_weights")[e].alias(f"raw_{e}") for e in ("single", "double", "triple", "home_run", "walk", "hit_by_pitch")]
    return rows.select("*", *weights).drop("raw_weights")


@query("war2_offense_by_player", f"select {_OFFENSE}, teams from offense", "wOBA OBP batting_runs")
def war2(spark, sf):
    names = [c.strip().strip('"') for c in _OFFENSE.split(",")]
    return V.aggregate_offense(I.valued(spark, sf), I.constants(spark, sf)).select(*names, "teams")


@query("war2_offense_by_team", 'select * exclude (onbase) from offense_team', "woba_raw_numerator wOBA OBP batting_runs")
def war2_team(spark, sf):
    return V.offense_by_team(I.valued(spark, sf), I.constants(spark, sf)).drop("obp_numerator")


def steal_players(spark, sf):
    return V.baserunning_runs(I.valued(spark, sf), I.offense(spark, sf))


def candidates(spark, sf):
    return V.advancement_candidates(I.valued(spark, sf), I.re24(spark, sf))


def opportunities(spark, sf):
    return I.opportunities(spark, sf)


def running(spark, sf):
    return V.expanded_baserunning(opportunities(spark, sf), steal_players(spark, sf), I.offense(spark, sf))


def double_plays(spark, sf):
    return V.double_play_avoidance(I.valued(spark, sf))


def arms(spark, sf):
    return V.arm_runs(opportunities(spark, sf))


def ranges(spark, sf):
    return V.range_runs(I.valued(spark, sf), I.constants(spark, sf))


def catchers(spark, sf):
    return V.catcher_throwing(I.catching(spark, sf), I.valued(spark, sf))


@query("war3_baserunning_steals", "select * from steal_players", "sb_cs_raw_runs baserunning_runs")
def war3(spark, sf):
    return steal_players(spark, sf)


@query("war4_advancement_candidates", """
select season, canonical_id, event_order, role, player, cast(start_base as int) as start_base, action, cast(destination as int) as destination, event_type, batted_type,
  fielding_position, fielder, reason from candidates""")
def war4(spark, sf):
    return candidates(spark, sf).select(
        "season", "canonical_id", "event_order", "role", "player", "start_base", "action", "destination", "event_type", "batted_type",
        "fielding_position", "fielder", "reason",
    )


@query("war5_outcome_utility", "select canonical_id, event_order, player_key, action, utility from opportunities0", "utility")
def war5(spark, sf):
    return candidates(spark, sf).where("reason is null").select("canonical_id", "event_order", "player_key", "action", "utility")


@query("war6_pooled_advancement", """
select canonical_id, event_order, player_key, expected_utility, raw_value, advancement_runs from opportunities""",
       "expected_utility raw_value advancement_runs")
def war6(spark, sf):
    return V.advancement_opportunities(candidates(spark, sf)).select("canonical_id", "event_order", "player_key", "expected_utility", "raw_value", "advancement_runs")


@query("war7_baserunning_rollup", "select * from running",
       "sb_cs_runs non_steal_advancement_runs batter_advancement_runs runner_advancement_runs baserunning_runs")
def war7(spark, sf):
    return running(spark, sf)


@query("war7_advancement_audit", """
select season, count(*) filter (where reason is null) as advancement_opportunities,
  count(*) filter (where reason is null and role = 'runner') as runner_opportunities,
  count(*) filter (where reason is null and role = 'batter') as batter_opportunities,
  count(*) filter (where reason is not null) as unresolved_candidate_transitions,
  0.0::double as league_non_steal_advancement_runs, 10.0::double as prior_opportunities from candidates group by season""")
def war7_audit(spark, sf):
    rows = candidates(spark, sf)
    return V.advancement_audit(rows, V.advancement_opportunities(rows))


@query("war8_double_play_avoidance", "select * from double_plays", "expected_double_plays double_play_avoidance_runs")
def war8(spark, sf):
    return double_plays(spark, sf)


@query("war8_double_play_audit", """
select season, count(*) as opportunities, cast(sum(dp) as bigint) as actual_double_plays, any_value(cost) as estimated_double_play_run_cost
from dp_valued group by season""", "estimated_double_play_run_cost")
def war8_audit(spark, sf):
    return V.double_play_audit(I.valued(spark, sf))


@query("war9_arm_runs", """
select season, player_key, player, teams, n as arm_opportunities, pitch_n as pitcher_arm_opportunities, n - pitch_n as non_pitcher_arm_opportunities,
  attributed as attributed_runner_runs, -attributed as arm_runs_opposing_raw, arm_u as arm_runs_unshrunk, pitch_u as pitcher_arm_runs_unshrunk,
  arm_u - pitch_u as non_pitcher_arm_runs_unshrunk, arm_runs, pitcher_arm_runs, non_pitcher_arm_runs from arms""",
       "attributed_runner_runs arm_runs_opposing_raw arm_runs_unshrunk pitcher_arm_runs_unshrunk non_pitcher_arm_runs_unshrunk "
       "arm_runs pitcher_arm_runs non_pitcher_arm_runs")
def war9(spark, sf):
    return arms(spark, sf)


@query("war9_arm_audit", """
select season, advancement_opportunities, attributable_arm_opportunities, coalesce(bal, 0.0) as raw_arm_plus_runner_balance,
  coalesce(u, 0.0) as league_arm_runs_unshrunk_centered, coalesce(s, 0.0) as league_arm_runs,
  attributable_arm_opportunities / advancement_opportunities as attribution_coverage
from (select season, count(*) as advancement_opportunities, count(fielder) as attributable_arm_opportunities from opportunities group by season) x
left join (select season, sum(attributed - attributed) as bal, sum(arm_u) as u, sum(arm_runs) as s from arms group by season) y using (season)""",
       "raw_arm_plus_runner_balance league_arm_runs_unshrunk_centered league_arm_runs attribution_coverage")
def war9_audit(spark, sf):
    rows = opportunities(spark, sf)
    return V.arm_audit(rows, V.arm_runs(rows))


@query("war10_range_runs", """
select season, player_key, player, positions, n as fielding_opportunities, cast(pitch_n as bigint) as pitcher_fielding_opportunities,
  cast(n - pitch_n as bigint) as non_pitcher_fielding_opportunities, u as fielding_runs_unshrunk, pitch_u as pitcher_fielding_runs_unshrunk,
  u - pitch_u as non_pitcher_fielding_runs_unshrunk, range_runs, pitcher_range_runs, non_pitcher_range_runs from ranges""",
       "fielding_runs_unshrunk pitcher_fielding_runs_unshrunk non_pitcher_fielding_runs_unshrunk range_runs pitcher_range_runs non_pitcher_range_runs")
def war10(spark, sf):
    return ranges(spark, sf)


@query("war11_catcher_throwing", "select * from catcher_rows", "catcher_cs_rate catcher_throwing_runs_unshrunk catcher_throwing_runs")
def war11(spark, sf):
    return catchers(spark, sf)


# --- pitching ----------------------------------------------------------------------------

cte("box", """
select season, canonical_id, fielding_team as team, pitcher as player, pitcher_key as player_key, outs / 3.0 as innings, outs, h, r, er, bb, so, hr, bf, list_ordinal
from fx_box_pitching""")
cte("environment", """
select season, completed_games, league_runs, league_ip, league_runs / league_ip * 7 as league_ra7, 1.5 * (league_runs / league_ip * 7) + 3 as runs_per_win,
  completed_games * (1000.0 / 2430) * 0.57 as position_replacement_wins, completed_games * (1000.0 / 2430) * 0.43 as pitcher_replacement_wins
from (select season, count(*) as completed_games, cast(sum(home_runs + away_runs) as bigint) as league_runs from fx_games group by season) g
join (select season, sum(outs) / 3.0 as league_ip from box group by season) b using (season)""")
cte("pitch_totals", """
select b.season, b.player_key, min(b.player) as player, string_agg(distinct b.team, '|' order by b.team) as teams, cast(sum(outs) as bigint) as pitching_outs,
  cast(sum(h) as bigint) as "H_allowed", cast(sum(r) as bigint) as "R_allowed", cast(sum(er) as bigint) as "ER", cast(sum(bb) as bigint) as "BB_allowed",
  cast(sum(so) as bigint) as "SO_pitching", count(*) as "G", count(*) filter (where first_listed) as "GS"
from (select *, row_number() over (partition by canonical_id, team order by list_ordinal, player_key) = 1 as first_listed from box) b group by b.season, b.player_key""")
cte("team_rates", """
select season, team, league_rate, (coalesce(runs, 0) + 200.0 * league_rate) / (pa + 200.0) as rate
from (select season, batting_team as team, count(*) as pa, sum(count(*)) over (partition by season) as league_pa from pa group by season, batting_team) p
left join (select season, team, sum(runs) as runs from (select season, home_team as team, home_runs as runs from fx_games
  union all select season, away_team, away_runs from fx_games) u group by season, team) r using (season, team)
join (select season, sum(home_runs + away_runs) / (select count(*) from pa where pa.season = fx_games.season) as league_rate from fx_games group by season) l using (season)""")
cte("pitching", """
select *, raw + corr * "IP" as raa, wins * rpw / lip * "IP" as repl, (raw + corr * "IP" + wins * rpw / lip * "IP") / rpw as pitching_war0
from (select *, -sum(raw) over (partition by season) / lip as corr from (
  select t.*, pitching_outs / 3.0 as "IP", "R_allowed" / (pitching_outs / 3.0) * 7 as "RA7", coalesce(bf, 0) as bf, lra7, lip,
    lra7 * coalesce(opp, lrate) / lrate as opp_ra7, (lra7 * coalesce(opp, lrate) / lrate - "R_allowed" / (pitching_outs / 3.0) * 7) / 7 * (pitching_outs / 3.0) as raw,
    runs_per_win as rpw, pitcher_replacement_wins as wins
  from pitch_totals t
  join (select season, sum(pitching_outs) / 3.0 as lip, sum("R_allowed") / (sum(pitching_outs) / 3.0) * 7 as lra7 from pitch_totals group by season) l using (season)
  join environment e using (season)
  join (select season, any_value(league_rate) as lrate from team_rates group by season) q using (season)
  left join (select pa.season, pitcher_key as player_key, count(*) as bf, avg(rate) as opp from pa join team_rates r on r.season = pa.season and r.team = pa.batting_team
    group by pa.season, pitcher_key) o using (season, player_key)
  where pitching_outs > 0) x) y""")
cte("fip_counts", """
select season, pitcher_key as player_key, count(*) as bf, count(*) filter (where event_type = 'home_run') as hr,
  count(*) filter (where event_type in ('walk','intentional_walk')) as bb, count(*) filter (where event_type = 'hit_by_pitch') as hbp,
  count(*) filter (where event_type in ('strikeout','dropped_third_out','dropped_third_reached')) as so from pa group by season, pitcher_key""")
cte("fip_league", """
select season, lip as "league_IP", cast(hr as bigint) as "league_HR", cast(bb as bigint) as "league_BB", cast(hbp as bigint) as "league_HBP", cast(so as bigint) as "league_SO",
  er / lip * 7 as league_era, 7.0 / 9 * (13 * hr + 3 * (bb + hbp) - 2 * so) / lip as league_component,
  er / lip * 7 - 7.0 / 9 * (13 * hr + 3 * (bb + hbp) - 2 * so) / lip as constant
from (select season, sum("IP") as lip, sum("ER") as er from pitching group by season) a
join (select season, sum(hr) as hr, sum(bb) as bb, sum(hbp) as hbp, sum(so) as so from fip_counts group by season) b using (season)""")
cte("fip", """
select p.*, "ER" / "IP" * 7 as "ERA", 7.0 / 9 * (13 * coalesce(hr, 0) + 3 * (coalesce(bb, 0) + coalesce(hbp, 0)) - 2 * coalesce(so, 0)) / "IP" + constant as "FIP",
  coalesce(f.bf, 0) as "FIP_BF", coalesce(hr, 0) as "FIP_HR", coalesce(bb, 0) as "FIP_BB", coalesce(hbp, 0) as "FIP_HBP", coalesce(so, 0) as "FIP_SO"
from pitching p left join fip_counts f using (season, player_key) join fip_league l using (season)""")
cte("pitcher_final", """
select f.*, coalesce(r.pitcher_range_runs, 0.0) as pitcher_range_runs, coalesce(a.pitcher_arm_runs, 0.0) as pitcher_arm_runs,
  coalesce(r.pitcher_range_runs, 0.0) + coalesce(a.pitcher_arm_runs, 0.0) as pdr
from fip f left join ranges r using (season, player_key) left join arms a using (season, player_key)""")
cte("union0", """
select season, player_key, coalesce(o.player, b.player, a.player, r.player, d.player, c.player) as player, o.teams as own_teams, b.teams as run_teams, a.teams as arm_teams,
  coalesce("PA", 0) as "PA", coalesce(batting_runs, 0.0) as batting_runs,
  coalesce(b.baserunning_runs, 0.0) as baserunning_runs, coalesce(sb_cs_runs, 0.0) as sb_cs_runs, coalesce(non_steal_advancement_runs, 0.0) as non_steal_advancement_runs,
  coalesce(runner_advancement_runs, 0.0) as runner_advancement_runs, coalesce(batter_advancement_runs, 0.0) as batter_advancement_runs,
  coalesce(advancement_opportunities, 0) as advancement_opportunities,
  coalesce(double_play_avoidance_runs, 0.0) as double_play_avoidance_runs, coalesce(double_play_opportunities, 0) as double_play_opportunities,
  coalesce(non_pitcher_arm_runs, 0.0) as arm_runs, coalesce(a.n - a.pitch_n, 0) as arm_opportunities, coalesce(non_pitcher_range_runs, 0.0) as range_runs,
  coalesce(catcher_stolen_bases_allowed, 0) as catcher_stolen_bases_allowed, coalesce(catcher_caught_stealing, 0) as catcher_caught_stealing,
  coalesce(catcher_steal_attempts, 0) as catcher_steal_attempts, coalesce(catcher_cs_rate, 0.0) as catcher_cs_rate,
  coalesce(catcher_throwing_runs, 0.0) as catcher_throwing_runs
from offense o full join running b using (season, player_key) full join double_plays d using (season, player_key) full join arms a using (season, player_key)
full join ranges r using (season, player_key) full join catcher_rows c using (season, player_key)""")
cte("box_teams", """
select distinct season, player_key, team from (select season, player_key, team from box
union all select season, batter_key, batting_team from fx_box_hitting) t""")
cte("union_rows", """
select u.*, coalesce(own_teams, (select coalesce(string_agg(distinct team, '|' order by team), '') from (
    select team from box_teams x where x.season = u.season and x.player_key = u.player_key
    union all select unnest(string_split(coalesce(run_teams, ''), '|')) union all select unnest(string_split(coalesce(arm_teams, ''), '|'))) y where team <> '')) as teams
from union0 u""")
cte("position_final", """
select *, (off + def) / rpw as position_war, off / rpw as offensive_war, def / rpw as defense_war, batting_runs / rpw as batting_war,
  (baserunning_runs + double_play_avoidance_runs) / rpw as baserunning_war
from (select *, batting_runs + baserunning_runs + double_play_avoidance_runs + league_adjustment_runs + position_replacement_runs as off,
    range_runs + arm_runs + catcher_throwing_runs as def
  from (select u.*, runs_per_win as rpw, -sum(batting_runs + baserunning_runs + double_play_avoidance_runs + range_runs + arm_runs + catcher_throwing_runs)
      over (partition by season) / sum("PA") over (partition by season) * "PA" as league_adjustment_runs,
    position_replacement_wins * runs_per_win / sum("PA") over (partition by season) * "PA" as position_replacement_runs
    from union_rows u join environment using (season)) x) y""")
cte("combined", """
select season, player_key, coalesce(p.player, q.player) as player, p.teams as t1, q.teams as t2, coalesce("PA", 0) as "PA", coalesce("IP", 0.0) as "IP",
  coalesce(batting_runs, 0.0) as batting_runs, coalesce(baserunning_runs, 0.0) as baserunning_runs, coalesce(p.double_play_avoidance_runs, 0.0) as double_play_avoidance_runs,
  coalesce(range_runs, 0.0) as range_runs, coalesce(arm_runs, 0.0) as arm_runs, coalesce(catcher_throwing_runs, 0.0) as catcher_throwing_runs,
  coalesce(sb_cs_runs, 0.0) as sb_cs_runs, coalesce(non_steal_advancement_runs, 0.0) as non_steal_advancement_runs,
  coalesce(position_war, 0.0) as position_war, coalesce(offensive_war, 0.0) as offensive_war, coalesce(defense_war, 0.0) as defense_war, coalesce("RA7", 0.0) as "RA7",
  coalesce("ERA", 0.0) as "ERA", coalesce("FIP", 0.0) as "FIP", coalesce(raa - pdr, 0.0) as pitching_runs_above_average,
  coalesce(pitching_war0 - pdr / q.rpw, 0.0) as pitching_war, coalesce(pdr / q.rpw, 0.0) as pitcher_defense_war, coalesce(pitching_war0, 0.0) as pitcher_war,
  coalesce(position_war, 0.0) + coalesce(pitching_war0, 0.0) as total_war,
  array_to_string(list_filter([case when "PA" > 0 and "PA" < 20 then 'small_position_player_sample' end, case when "IP" > 0 and "IP" < 5 then 'small_pitching_sample' end,
    case when p.player is not null then 'no_positional_adjustment' end, case when q.player is not null then 'no_reliever_leverage_adjustment' end], lambda x: x is not null), '|') as quality_flags,
  array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(coalesce(p.teams, ''), '|'), string_split(coalesce(q.teams, ''), '|')), lambda x: x <> ''))), '|') as teams
from position_final p full join pitcher_final q using (season, player_key)""")


def environment(spark, sf):
    games = I.view(spark, sf, "fx_games")
    return P.run_environment(team_runs(spark, sf), I.box_pitching(spark, sf), games.select("season", "canonical_id"))


def team_runs(spark, sf):
    games = I.view(spark, sf, "fx_games")
    sides = F.array(
        F.struct(F.col("home_team").alias("team"), F.col("home_runs").alias("runs")),
        F.struct(F.col("away_team").alias("team"), F.col("away_runs").alias("runs")),
    )
    return P.official_team_runs(games.select("season", F.explode(sides).alias("s")).select("season", "s.*"))


def pitching(spark, sf):
    return P.aggregate_pitching(I.valued(spark, sf), I.box_pitching(spark, sf), team_runs(spark, sf), environment(spark, sf))


def stored(spark, sf, component):
    """A component table, written once and shared by the assembly queries."""
    return I.stage(spark, sf, component.__name__, component)


def with_fip(spark, sf):
    return P.add_fip(stored(spark, sf, pitching), I.valued(spark, sf))


def pitchers(spark, sf):
    return P.pitcher_rows(stored(spark, sf, with_fip), stored(spark, sf, ranges), stored(spark, sf, arms), stored(spark, sf, environment))


def union(spark, sf):
    box = I.box_pitching(spark, sf).select("season", "player_key", "team").unionByName(I.box_hitting(spark, sf).select("season", "player_key", "team"))
    return P.component_union(
        I.offense(spark, sf), box, running=stored(spark, sf, running), double_plays=stored(spark, sf, double_plays), arms=stored(spark, sf, arms),
        fielding=stored(spark, sf, ranges), catchers=stored(spark, sf, catchers),
    )


def positions(spark, sf):
    return P.position_players(stored(spark, sf, union), stored(spark, sf, environment))


def combined(spark, sf):
    """Written once: the boards, the scouting tables and the checks all start here."""
    return I.stage(spark, sf, "combined", lambda s, d: P.combined_players(I.stage(s, d, "positions", positions), I.stage(s, d, "pitchers", pitchers)))


def position_stage(spark, sf):
    return I.stage(spark, sf, "positions", positions)


def pitcher_stage(spark, sf):
    return I.stage(spark, sf, "pitchers", pitchers)


@query("war12_fip", """
select season, player_key, "IP", "ERA", "FIP", "ERA" - "FIP" as "ERA_minus_FIP", "FIP_BF", "FIP_HR", "FIP_BB", "FIP_HBP", "FIP_SO" from fip""",
       "IP ERA FIP ERA_minus_FIP")
def war12(spark, sf):
    return with_fip(spark, sf).select(
        "season", "player_key", "IP", "ERA", "FIP", "ERA_minus_FIP", "FIP_BF", "FIP_HR", "FIP_BB", "FIP_HBP", "FIP_SO"
    )


@query("war12_fip_constants", "select * from fip_league", "league_IP league_era league_component constant")
def war12_league(spark, sf):
    return P.fip_league(stored(spark, sf, pitching), P.fip_counts(I.valued(spark, sf)))


@query("war13_pitching_totals", "select * from pitch_totals")
def war13(spark, sf):
    return P.pitching_totals(I.box_pitching(spark, sf))


@query("war14_opponent_adjusted_runs", """
select season, player_key, "IP", "RA7", bf as batters_faced_from_play_by_play, opp_ra7 as "opponent_expected_RA7",
  (opp_ra7 - lra7) / 7 * "IP" as opponent_strength_adjustment_runs, raw as pitching_runs_above_average_raw, raa as pitching_runs_above_average,
  repl as pitching_replacement_runs, pitching_war0 as pitching_war from pitching""",
       "IP RA7 opponent_expected_RA7 opponent_strength_adjustment_runs pitching_runs_above_average_raw pitching_runs_above_average "
       "pitching_replacement_runs pitching_war")
def war14(spark, sf):
    return pitching(spark, sf).select(
        "season", "player_key", "IP", "RA7", "batters_faced_from_play_by_play", "opponent_expected_RA7", "opponent_strength_adjustment_runs",
        "pitching_runs_above_average_raw", "pitching_runs_above_average", "pitching_replacement_runs", "pitching_war",
    )


@query("war15_run_environment", "select * from environment",
       "league_ip league_ra7 runs_per_win position_replacement_wins pitcher_replacement_wins")
def war15(spark, sf):
    return environment(spark, sf)


@query("war16_merge_aliases", """
select season, case when player_key like 'battert%n14' then replace(player_key, 'n14', 'n13') else player_key end as player_key, min(player) as player,
  cast(sum(sb_cs_attempts) as bigint) as sb_cs_attempts, sum(baserunning_runs) as baserunning_runs,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(case when teams = '' then [] else string_split(teams, '|') end)))), '|'), '') as teams
from running group by season, case when player_key like 'battert%n14' then replace(player_key, 'n14', 'n13') else player_key end""", "baserunning_runs")
def war16(spark, sf):
    keys = I.pbp(spark, sf).where("slot = 14").select(F.col("batter_key").alias("alias")).distinct()
    aliases = keys.withColumn("target", F.regexp_replace("alias", "n14$", "n13"))
    rows = stored(spark, sf, running).select("season", "player_key", "player", "sb_cs_attempts", "baserunning_runs", "teams")
    return V.canonicalize_components(rows, aliases)


@query("war17_component_union", """
select season, player_key, player, teams, "PA", batting_runs, baserunning_runs, double_play_avoidance_runs, arm_runs as non_pitcher_arm_runs,
  range_runs as non_pitcher_range_runs, catcher_throwing_runs from union_rows""",
       "batting_runs baserunning_runs double_play_avoidance_runs non_pitcher_arm_runs non_pitcher_range_runs catcher_throwing_runs")
def war17(spark, sf):
    return union(spark, sf).select(
        "season", "player_key", "player", "teams", "PA", "batting_runs", "baserunning_runs", "double_play_avoidance_runs", "non_pitcher_arm_runs",
        "non_pitcher_range_runs", "catcher_throwing_runs",
    )


@query("war18_position_players", """
select season, player_key, "PA", batting_runs as "wRAA", baserunning_runs + double_play_avoidance_runs as baserunning_component_runs, def as defense_runs,
  league_adjustment_runs, position_replacement_runs, batting_war, baserunning_war, defense_war, offensive_war, position_war from position_final""",
       "wRAA baserunning_component_runs defense_runs league_adjustment_runs position_replacement_runs batting_war baserunning_war defense_war "
       "offensive_war position_war")
def war18(spark, sf):
    return position_stage(spark, sf).select(
        "season", "player_key", "PA", "wRAA", "baserunning_component_runs", "defense_runs", "league_adjustment_runs", "position_replacement_runs",
        "batting_war", "baserunning_war", "defense_war", "offensive_war", "position_war",
    )


@query("war19_pitchers", """
select season, player_key, "IP", raa as ra7_pitching_runs_above_average, raa - pdr as pitching_runs_above_average, pitcher_range_runs, pitcher_arm_runs,
  pdr as pitcher_defense_runs, pdr / rpw as pitcher_defense_war, pitching_war0 as pitcher_war, pitching_war0 - pdr / rpw as pitching_war from pitcher_final""",
       "IP ra7_pitching_runs_above_average pitching_runs_above_average pitcher_range_runs pitcher_arm_runs pitcher_defense_runs pitcher_defense_war "
       "pitcher_war pitching_war")
def war19(spark, sf):
    return pitcher_stage(spark, sf).select(
        "season", "player_key", "IP", "ra7_pitching_runs_above_average", "pitching_runs_above_average", "pitcher_range_runs", "pitcher_arm_runs",
        "pitcher_defense_runs", "pitcher_defense_war", "pitcher_war", "pitching_war",
    )


_COMBINED = ('season, player_key, player, "PA", "IP", batting_runs, baserunning_runs, position_war, offensive_war, defense_war, "RA7", "ERA", "FIP", '
             "pitching_runs_above_average, pitching_war, pitcher_defense_war, pitcher_war, total_war")


@query("war20_combined_players", f"select {_COMBINED}, teams from combined",
       "IP batting_runs baserunning_runs position_war offensive_war defense_war RA7 ERA FIP pitching_runs_above_average pitching_war "
       "pitcher_defense_war pitcher_war total_war")
def war20(spark, sf):
    return combined(spark, sf).select(*[c.strip().strip('"') for c in _COMBINED.split(",")], "teams")


@query("war21_quality_flags", "select season, player_key, quality_flags from combined")
def war21(spark, sf):
    return combined(spark, sf).select("season", "player_key", "quality_flags")


@query("war22_impact_report", """
select c.player_key, c.position_war as new_position_war, coalesce(o.position_war, 0.0) as old_position_war, c.total_war - coalesce(o.total_war, 0.0) as total_war_change
from combined c left join combined o on o.season = 2025 and o.player_key = c.player_key where c.season = 2026
qualify row_number() over (order by abs(c.total_war - coalesce(o.total_war, 0.0)) desc, c.player_key) <= 30""",
       "new_position_war old_position_war total_war_change")
def war22(spark, sf):
    rows = combined(spark, sf)
    earlier = rows.where("season = 2025").withColumn("season", F.lit(2026))
    report = P.impact_report(rows.where("season = 2026"), earlier)
    return report.orderBy(F.desc(F.abs("total_war_change")), "player_key").limit(30).select(
        "player_key", F.col("position_war").alias("new_position_war"), "old_position_war", "total_war_change"
    )


@query("war23_season_summary", """
select season, count(*) as position_players, sum(batting_runs) as league_position_batting_runs, sum(baserunning_runs) as league_baserunning_runs,
  sum(non_steal_advancement_runs) as league_non_steal_advancement_runs, sum(double_play_avoidance_runs) as league_double_play_avoidance_runs,
  sum(range_runs) as league_range_runs, sum(arm_runs) as league_arm_runs, sum(catcher_throwing_runs) as league_catcher_throwing_runs,
  sum(batting_runs + baserunning_runs + double_play_avoidance_runs + range_runs + arm_runs + catcher_throwing_runs + league_adjustment_runs) as league_adjusted_position_raa,
  sum(position_war) as position_war_total,
  (select count(*) from pitcher_final q where q.season = p.season) as pitchers, (select sum(pitching_war0) from pitcher_final q where q.season = p.season) as pitching_war_total,
  (select sum(pitching_war0 - pdr / rpw) from pitcher_final q where q.season = p.season) as pitching_component_war_total,
  (select sum(pdr / rpw) from pitcher_final q where q.season = p.season) as pitcher_defense_war_total,
  (select count(*) from combined q where q.season = p.season) as combined_players, (select sum(total_war) from combined q where q.season = p.season) as total_war
from position_final p group by season""",
       "league_position_batting_runs league_baserunning_runs league_non_steal_advancement_runs league_double_play_avoidance_runs league_range_runs "
       "league_arm_runs league_catcher_throwing_runs league_adjusted_position_raa position_war_total pitching_war_total pitching_component_war_total "
       "pitcher_defense_war_total total_war")
def war23(spark, sf):
    return P.season_summary(position_stage(spark, sf), pitcher_stage(spark, sf), combined(spark, sf))
