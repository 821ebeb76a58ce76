"""Positional study queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basepaths.operators import positional as P
from basepaths.plans import inputs as I
from basepaths.plans.registry import cte, query

_STD = "('C','1B','2B','3B','SS','LF','CF','RF')"
_SHORT = ("case first_pos when 'catcher' then 'C' when 'first baseman' then '1B' when 'second baseman' then '2B' when 'third baseman' then '3B' "
          "when 'shortstop' then 'SS' when 'left fielder' then 'LF' when 'center fielder' then 'CF' when 'right fielder' then 'RF' end")

cte("grid8", "select unnest(['C','1B','2B','3B','SS','LF','CF','RF']) as position, unnest(range(8)) as position_no")
cte("box_positions", f"""
select b.canonical_id, season, batting_team as team, batter as player, batter_key as player_key,
  list_filter(string_split(replace(position, ' ', ''), ','), lambda x: x in {_STD}) as positions from fx_box_hitting b""")
cte("team_outs", """
select canonical_id, fielding_team as team, cast(sum(greatest(0, outs_after - outs_before)) as bigint) as defensive_outs from pbp group by canonical_id, fielding_team""")
cte("pos_audit", """
select canonical_id, team, season, coalesce(defensive_outs, 0) as defensive_outs, held = 8 as complete_standard_positions,
  held = 8 and most = 1 as unique_standard_assignments, multi as multi_position_player, false as game_has_recorded_substitution,
  held = 8 and most = 1 and not multi as confirmed_for_innings
from (select canonical_id, team, season, count(distinct pos) as held, max(n) as most from (
    select canonical_id, team, season, pos, count(*) as n from (select *, unnest(positions) as pos from box_positions) a group by all) b group by canonical_id, team, season) c
join (select canonical_id, team, bool_or(len(positions) > 1) as multi from box_positions group by canonical_id, team) d using (canonical_id, team)
left join team_outs using (canonical_id, team)""")
cte("hit_rows", """
select v.season, v.canonical_id, case when v.batting_team = 'team_5' then 'team_1' else v.batting_team end as family, v.batter_key as player_key, w.weight, case when len(positions) = 1 then positions[1] end as position
from pa v join (select season, event_type, avg(run_value) as weight from pa group by season, event_type) w using (season, event_type)
left join box_positions b on b.canonical_id = v.canonical_id and b.player_key = v.batter_key""")
cte("variant_rows", """
select *, 'all' as variant from hit_rows union all select *, concat('season_', season) from hit_rows
union all select h.*, concat('leave_team_out:', t.team) from hit_rows h join (select distinct family as team from hit_rows) t on t.team <> h.family""")
cte("scarcity0", """
select variant, position, position_no, coalesce(n, 0) as "PA", coalesce(players, 0) as players, coalesce(runs, 0.0) as runs, coalesce(-100.0 * runs / n, 0.0) as raw
from (select distinct variant from variant_rows) v cross join grid8
left join (select variant, position, count(*) as n, count(distinct player_key) as players, sum(weight - m) as runs
  from (select *, avg(weight) over (partition by variant, season) as m from variant_rows) x where position is not null group by variant, position) s using (variant, position)""")
cte("scarcity", """select *, raw - coalesce(sum(raw * "PA") over (partition by variant) / nullif(sum("PA") over (partition by variant), 0), 0.0) as centered from scarcity0""")
cte("field_rows", f"""
select replace(lower(named), ' ', '') as player_key, {_SHORT} as position, traj,
  case when event_type in ('out','double_play','fielders_choice','sacrifice_fly','sacrifice_bunt','infield_fly') then 1.0 else 0.0 end as made
from texted where named is not null and traj is not null and {_SHORT} is not null""")
cte("field_res", "select *, made - avg(made) over (partition by position, traj) as res from field_rows")
cte("transitions", """
select a.position as position_a, b.position as position_b, a.position_no as na, b.position_no as nb,
  coalesce(players, 0) as players, coalesce(n1, 0) as opportunities_a, coalesce(n2, 0) as opportunities_b, coalesce(100 * (r2 / n2 - r1 / n1), 0.0) as diff
from grid8 a join grid8 b on a.position_no < b.position_no left join (
  select x.position as p1, y.position as p2, count(*) as players, cast(sum(x.n) as bigint) as n1, cast(sum(y.n) as bigint) as n2, sum(x.r) as r1, sum(y.r) as r2
  from (select player_key, position, count(*) as n, sum(res) as r from field_res group by player_key, position) x
  join (select player_key, position, count(*) as n, sum(res) as r from field_res group by player_key, position) y using (player_key) group by x.position, y.position) t
  on t.p1 = a.position and t.p2 = b.position""")
cte("cv_pairs", """
select v.variant, v.position, v.position_no, f.centered as a, v.centered as b, row_number() over (partition by v.variant order by f.centered, v.position_no) as ra,
  row_number() over (partition by v.variant order by v.centered, v.position_no) as rb
from scarcity v join scarcity f on f.variant = 'all' and f.position = v.position where v.variant <> 'all'""")
cte("cv", """
select variant, coalesce(corr(ra, rb), 0.0) as spearman_vs_full, max(abs(a - b)) as maximum_absolute_run_change,
  count(*) filter (where (a >= 0) = (b >= 0)) as sign_agreement_positions from cv_pairs group by variant""")
cte("season_rho", """
select case when count(distinct variant) = 2 then (select coalesce(corr(ra, rb), 0.0) from (
    select row_number() over (order by x.centered, x.position_no) as ra, row_number() over (order by y.centered, y.position_no) as rb
    from scarcity x join scarcity y using (position) where x.variant = 'season_2025' and y.variant = 'season_2026') z) else 0.0 end as rho
from scarcity where variant like 'season_%'""")


def _candidates(spark, sf):
    # two of the teams are one franchise
    return P.offensive_position_values(I.valued(spark, sf), I.box_hitting(spark, sf), {"team_5": "team_1"})


def _staged_candidates(spark, sf):
    return I.stage(spark, sf, "position_candidates", _candidates)


def _audit(spark, sf):
    return P.team_game_audit(I.box_hitting(spark, sf), I.valued(spark, sf))


def _cells(spark, sf):
    return P.fielding_cells(I.valued(spark, sf))


@query("pos1_team_outs", "select * from team_outs")
def pos1(spark, sf):
    return P.team_outs(I.pbp(spark, sf))


@query("pos2_team_game_audit", "select * from pos_audit")
def pos2_audit(spark, sf):
    return _audit(spark, sf)


cte("position_exposure", f"""
select season, player_key, team, position, player, position_game_labels, confirmed_defensive_outs, ambiguous_position_games,
  coalesce(m, 0) as fielding_mentions, confirmed_defensive_outs / 3 as confirmed_defensive_innings,
  case when confirmed_defensive_outs > 0 then 'confirmed_clean_team_games_only' else 'position_label_only_no_defensive_innings' end as coverage_status
from (select b.season, player_key, b.team, pos as position, min(player) as player, count(*) as position_game_labels,
    cast(sum(case when confirmed_for_innings then defensive_outs else 0 end) as bigint) as confirmed_defensive_outs,
    count(*) filter (where not confirmed_for_innings) as ambiguous_position_games
  from (select *, unnest(positions) as pos from box_positions) b join pos_audit a using (canonical_id, team) group by b.season, player_key, b.team, pos) e
left join (select season, replace(lower(named), ' ', '') as player_key, fielding_team as team, {_SHORT} as position, count(*) as m
  from texted where named is not null group by all) f using (season, player_key, team, position)""")


@query("pos2_position_exposure", "select * from position_exposure", "confirmed_defensive_innings")
def pos2(spark, sf):
    return P.position_exposure(I.box_hitting(spark, sf), I.valued(spark, sf))


@query("pos2_coverage", """
select count(*) as team_games, count(distinct canonical_id) as games, count(*) filter (where confirmed_for_innings) as team_games_with_confirmed_position_innings,
  count(*) filter (where complete_standard_positions) as team_games_with_complete_standard_position_labels,
  count(*) filter (where unique_standard_assignments) as team_games_with_unique_standard_assignments,
  cast(sum(case when confirmed_for_innings then defensive_outs * 8 else 0 end) as bigint) as confirmed_standard_position_outs,
  cast(sum(defensive_outs * 8) as bigint) as possible_standard_position_outs,
  sum(case when confirmed_for_innings then defensive_outs * 8 else 0 end) / sum(defensive_outs * 8) as confirmed_position_innings_coverage from pos_audit""",
       "confirmed_position_innings_coverage")
def pos2_coverage(spark, sf):
    return P.coverage(_audit(spark, sf))


@query("pos3_event_type_weights", "select season, event_type, avg(run_value) as weight from pa group by season, event_type", "weight")
def pos3(spark, sf):
    return P.event_type_weights(I.valued(spark, sf))


_SCARCITY = """select variant, position, "PA", players, runs as batting_runs_proxy, raw as raw_scarcity_runs_per_100_pa,
  centered as centered_candidate_runs_per_25_games, 'offensive_scarcity_proxy' as method from scarcity"""


@query("pos4_offensive_position_values", _SCARCITY + " where variant = 'all'",
       "batting_runs_proxy raw_scarcity_runs_per_100_pa centered_candidate_runs_per_25_games")
def pos4(spark, sf):
    return _candidates(spark, sf).where("variant = 'all'")


@query("pos5_leave_one_out_variants", _SCARCITY, "batting_runs_proxy raw_scarcity_runs_per_100_pa centered_candidate_runs_per_25_games")
def pos5(spark, sf):
    return _candidates(spark, sf)


@query("pos6_replacement_depth", """
select 'all' as variant, position, "PA", players, threshold as "lower_half_PA_threshold", 'lower_playing_time_depth_proxy' as method,
  raw - coalesce(sum(raw * "PA") over () / nullif(sum("PA") over (), 0), 0.0) as centered_candidate_runs_per_25_games
from (select position, cast(coalesce(sum(n), 0) as bigint) as "PA", count(n) as players, coalesce(any_value(t), 0) as threshold,
    coalesce(-100.0 * sum(runs) / sum(n), 0.0) as raw
  from grid8 left join (select * from (
    select *, list_sort(list(n) over (partition by position))[cast(floor(count(*) over (partition by position) / 2.0) as int) + 1] as t from (
      select position, player_key, count(*) as n, sum(weight - m) as runs from (select *, avg(weight) over (partition by season) as m from hit_rows) a
      where position is not null group by position, player_key) b) c where n <= t) d using (position) group by position) e""",
       "centered_candidate_runs_per_25_games")
def pos6(spark, sf):
    return P.replacement_depth(I.valued(spark, sf), I.box_hitting(spark, sf))


@query("pos7_fielding_samples", """
select position, count(distinct player_key) as players, count(player_key) as opportunities, coalesce(avg(res), 0.0) as mean_position_relative_conversion_residual
from grid8 left join field_res using (position) group by position""", "mean_position_relative_conversion_residual")
def pos7_samples(spark, sf):
    return P.fielding_samples(_cells(spark, sf))


@query("pos7_fielding_transitions", """
select position_a, position_b, players, opportunities_a, opportunities_b, diff as residual_difference_b_minus_a_per_100_opportunities from transitions""",
       "residual_difference_b_minus_a_per_100_opportunities")
def pos7(spark, sf):
    return P.fielding_transitions(_cells(spark, sf))


@query("pos8_ordinal_spearman", "select variant, spearman_vs_full as spearman from cv", "spearman")
def pos8(spark, sf):
    rows = _staged_candidates(spark, sf)
    value = "centered_candidate_runs_per_25_games"
    full = rows.where("variant = 'all'").select("position", F.col(value).alias("first"))
    pairs = rows.where("variant <> 'all'").select("variant", "position", F.col(value).alias("second")).join(F.broadcast(full), "position")
    return P.ordinal_spearman(pairs, "variant")


@query("pos9_cross_validation", "select * from cv", "spearman_vs_full maximum_absolute_run_change")
def pos9(spark, sf):
    return P.cross_validation(_staged_candidates(spark, sf))


@query("pos9_reliability_gates", """
select *, case when defensible_position_innings and adequate_transition_samples and leave_one_team_out_stability and leave_one_season_out_stability
    and league_centered_candidates and no_double_counting_plan then 'implement' else 'insufficient_data' end as decision
from (select (select sum(case when confirmed_for_innings then defensive_outs else 0 end) / sum(defensive_outs) from pos_audit) >= 0.8 as defensible_position_innings,
  (select count(*) from transitions where players >= 15 and least(opportunities_a, opportunities_b) >= 200) >= 7 as adequate_transition_samples,
  coalesce((select min(spearman_vs_full) from cv where variant like 'leave_team_out:%') >= 0.7, false) as leave_one_team_out_stability,
  (select count(*) from cv where variant like 'season_%') >= 2 and (select rho from season_rho) >= 0.7 as leave_one_season_out_stability,
  (select abs(sum(centered * "PA")) < 1e-8 from scarcity where variant = 'all') as league_centered_candidates, true as no_double_counting_plan) x""")
def pos9_gates(spark, sf):
    candidates = _staged_candidates(spark, sf)
    return P.reliability_gates(P.coverage(_audit(spark, sf)), P.fielding_transitions(_cells(spark, sf)), P.cross_validation(candidates), candidates)


@query("pos10_player_adjustment", """
select season, player_key, sum(coalesce(centered, 0.0) * confirmed_defensive_outs / 525.0) as adjustment_runs
from position_exposure left join (select position, centered from scarcity where variant = 'all') s using (position) group by season, player_key""", "adjustment_runs")
def pos10(spark, sf):
    exposure = P.position_exposure(I.box_hitting(spark, sf), I.valued(spark, sf))
    return P.weighted_player_adjustment(exposure, _staged_candidates(spark, sf).where("variant = 'all'"))
