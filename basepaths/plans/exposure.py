"""Repeat-exposure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basepaths.operators import contests as C
from basepaths.operators import exposure as E
from basepaths.operators import regression as R
from basepaths.plans import inputs as I
from basepaths.plans.registry import cte, query

_NOT_DEN = "('intentional_walk','sacrifice_bunt','catcher_interference')"

cte("linear_w", "select event_type, avg(run_value) as lw from pa group by event_type")
cte("scaled_w", """
select event_type, w * (select count(*) filter (where event_type in ('single','double','triple','home_run','walk','intentional_walk','hit_by_pitch'))
  / sum(coalesce(rw.w, 0)) from pa left join raw_w rw using (event_type)) as sw from raw_w""")
cte("series_days", """
select *, sum(fresh) over (partition by grp order by day rows unbounded preceding) as cluster from (
  select *, case when post then 0 when day - lag(day) over (partition by grp order by day) > 4 then 1 else 0 end as fresh from (
    select distinct grp, post, day from (
      select *, cast(game_ts as date) as day, game_type = 'PS' or series_no is not null as post,
        case when game_type = 'PS' or series_no is not null
          then concat(season, '-ps-', least(home_team, away_team), '-', greatest(home_team, away_team), '-postseason-', coalesce(series_no, 0))
          else concat(season, '-rs-', least(home_team, away_team), '-', greatest(home_team, away_team), '-', replace(venue, '_', '-')) end as grp
      from fx_official) a) b) c""")
cte("series", """
select canonical_id, game_id, season, game_ts, case when post then grp else concat(grp, '-', first_day) end as series_id,
  cast(row_number() over (partition by grp, cluster order by game_ts, canonical_id) as int) as series_game_number,
  case when post then 'official_postseason_chronology' else 'official_teams_venue_date_cluster' end as series_source
from (select o.*, concat('g', lpad(cast(game_id as varchar), 6, '0')) as canonical_id, d.grp, d.post, d.cluster,
    min(d.day) over (partition by d.grp, d.cluster) as first_day
  from (select *, case when game_type = 'PS' or series_no is not null
      then concat(season, '-ps-', least(home_team, away_team), '-', greatest(home_team, away_team), '-postseason-', coalesce(series_no, 0))
      else concat(season, '-rs-', least(home_team, away_team), '-', greatest(home_team, away_team), '-', replace(venue, '_', '-')) end as grp0 from fx_official) o
  join series_days d on d.grp = o.grp0 and d.day = cast(o.game_ts as date)) x""")
cte("pas", f"""
select *, series_matchup_number - same_game_matchup_number as prior_series_game_matchups, cast(floor(pitcher_batters_faced_before / 9.0) as int) + 1 as mlb_tto_bf9
from (select p.* exclude (run_value), p.run_value as re24_run_value, lw as run_value, coalesce(sw, 0.0) as wn, s.game_ts, s.game_id, s.series_id,
    cast(row_number() over (partition by canonical_id, pitcher_key order by event_order) - 1 as int) as pitcher_batters_faced_before,
    cast(row_number() over (partition by canonical_id, pitcher_key, batter_key order by event_order) as int) as same_game_matchup_number,
    cast(row_number() over (partition by series_id, batter_key, pitcher_key order by game_ts, canonical_id, event_order) as int) as series_matchup_number,
    case when event_type in ('walk','intentional_walk','hit_by_pitch','sacrifice_fly','sacrifice_bunt','catcher_interference') then 0 else 1 end as ab,
    case when event_type in ('single','double','triple','home_run') then 1 else 0 end as hit,
    case event_type when 'single' then 1 when 'double' then 2 when 'triple' then 3 when 'home_run' then 4 else 0 end as tb,
    case when event_type in ('walk','intentional_walk') then 1 else 0 end as bb, case when event_type = 'hit_by_pitch' then 1 else 0 end as hbp,
    case when event_type in ('strikeout','dropped_third_out','dropped_third_reached') then 1 else 0 end as so,
    case when event_type = 'home_run' then 1 else 0 end as hr, case when event_type = 'sacrifice_fly' then 1 else 0 end as sf,
    case when event_type in ('single','double','triple','home_run','walk','intentional_walk','hit_by_pitch') then 1 else 0 end as obn,
    case when event_type in ('sacrifice_bunt','catcher_interference') then 0 else 1 end as obd,
    case when event_type in {_NOT_DEN} then 0 else 1 end as wd
  from pa p join series s using (canonical_id) left join linear_w l using (event_type) left join scaled_w using (event_type)) x""")


def line_sql(source: str, keys: str, intervals: bool = True) -> str:
    """Rates with game-clustered intervals, from influences written out per game."""
    bounds = """, case when games > 1 then woba - 1.96 * sqrt(games / (games - 1.0) * w2 / (wd * wd)) end as "wOBA_95_low",
  case when games > 1 then woba + 1.96 * sqrt(games / (games - 1.0) * w2 / (wd * wd)) end as "wOBA_95_high",
  case when games > 1 then rv - 1.96 * sqrt(games / (games - 1.0) * r2 / (pa * pa)) end as "RV_per_PA_95_low",
  case when games > 1 then rv + 1.96 * sqrt(games / (games - 1.0) * r2 / (pa * pa)) end as "RV_per_PA_95_high\"""" if intervals else ""
    return f"""
select {keys}, games, cast(pa as bigint) as "PA", cast(ab as bigint) as "AB", cast(hit as bigint) as "H", cast(bb as bigint) as "BB", cast(hbp as bigint) as "HBP",
  cast(so as bigint) as "SO", cast(hr as bigint) as "HR", hit / nullif(ab, 0) as "AVG", obn / nullif(obd, 0) as "OBP", tb / nullif(ab, 0) as "SLG",
  coalesce(obn / nullif(obd, 0), 0.0) + coalesce(tb / nullif(ab, 0), 0.0) as "OPS", so / pa as "K_pct", bb / pa as "BB_pct", hr / pa as "HR_pct",
  woba as "wOBA", rv as "RV_per_PA"{bounds}
from (select {keys}, count(*) as games, sum(pa) as pa, sum(ab) as ab, sum(hit) as hit, sum(tb) as tb, sum(bb) as bb, sum(hbp) as hbp, sum(so) as so, sum(hr) as hr,
    sum(obn) as obn, sum(obd) as obd, sum(wd) as wd, any_value(w) as woba, any_value(q) as rv, sum(pow(wn - w * wd, 2)) as w2, sum(pow(rvs - q * pa, 2)) as r2
  from (select *, sum(wn) over (partition by {keys}) / nullif(sum(wd) over (partition by {keys}), 0) as w,
      sum(rvs) over (partition by {keys}) / sum(pa) over (partition by {keys}) as q
    from (select {keys}, canonical_id, count(*) as pa, sum(run_value) as rvs, sum(ab) as ab, sum(hit) as hit, sum(tb) as tb, sum(bb) as bb, sum(hbp) as hbp,
        sum(so) as so, sum(hr) as hr, sum(obn) as obn, sum(obd) as obd, sum(wn) as wn, sum(wd) as wd from {source} group by {keys}, canonical_id) g) h
  group by {keys}) k"""


RATES = "AVG OBP SLG OPS K_pct BB_pct HR_pct wOBA RV_per_PA"
BOUNDS = " wOBA_95_low wOBA_95_high RV_per_PA_95_low RV_per_PA_95_high"


def cap(column: str, top: int) -> str:
    return f"case when {column} < {top} then cast({column} as varchar) else '{top}+' end"


cte("bands", f"""
select *, 'same_game_matchup' as cut, {cap('same_game_matchup_number', 4)} as label from pas
union all select *, 'mlb_tto_bf9', {cap('mlb_tto_bf9', 4)} from pas
union all select *, 'series_matchup', {cap('series_matchup_number', 5)} from pas
union all select *, 'prior_series_games', case when prior_series_game_matchups = 0 then '0' when prior_series_game_matchups <= 2 then '1-2' else '3+' end from pas
union all select *, 'inning_bands', case when inning <= 2 then '1-2' when inning <= 4 then '3-4' else '5+' end from pas
union all select *, 'season_same_game', concat(season, '-', {cap('same_game_matchup_number', 3)}) from pas""")
cte("pitcher_meta", "select pitcher_key, min(pitcher) as pitcher, string_agg(distinct fielding_team, '|' order by fielding_team) as teams from pas group by pitcher_key")
cte("pas3", f"select *, {cap('same_game_matchup_number', 3)} as encounter, case when same_game_matchup_number = 1 then 'first' else 'later' end as phase from pas")
cte("phase_lines", line_sql("pas3", "pitcher_key, phase"))
cte("payload_rows", f"""
select k.*, cut, label from (
  select p.*, kind, key, period from pas p
  cross join lateral (select 'league' as kind, 'league' as key union all select 'team', fielding_team union all select 'pitcher', pitcher_key
    union all select 'batter', batter_key union all select 'offense', batting_team) e
  cross join lateral (select 'combined' as period union all select cast(season as varchar)) s) k
cross join lateral (select 'same_game' as cut, {cap('same_game_matchup_number', 4)} as label
  union all select 'prior_series', case when prior_series_game_matchups = 0 then '0' when prior_series_game_matchups = 1 then '1' else '2+' end
  union all select 'phase', case when same_game_matchup_number = 1 then 'first' else 'later' end) c""")
cte("payload_lines", line_sql("payload_rows", "kind, key, period, cut, label", intervals=False))
cte("payload", """
select g.kind, g.key, g.period, g.cut, g.label, l.* exclude (kind, key, period, cut, label, "PA"), coalesce(l."PA", 0) as "PA"
from (select distinct kind, key, period, cut, label from (select distinct kind, key, period from payload_rows) a cross join (
  select * from (values ('same_game', '1'), ('same_game', '2'), ('same_game', '3'), ('same_game', '4+'), ('prior_series', '0'), ('prior_series', '1'),
    ('prior_series', '2+'), ('phase', 'first'), ('phase', 'later')) t(cut, label)) b) g
left join payload_lines l using (kind, key, period, cut, label)""")

# both sides of a meeting: who pitched and who batted
ENTITIES = {"league": "everyone", "team": "fielding_team", "pitcher": "pitcher_key", "batter": "batter_key", "offense": "batting_team"}


@query("tto2_pitcher_out_failures", """
select canonical_id, player_key, cast(outs + 1 as bigint) as expected, cast(outs as bigint) as observed from box where list_ordinal % 2 = 1""")
def tto2(spark, sf):
    # every pitcher with an odd list place gets one out too many in the box, so failures exist
    box = I.box_pitching(spark, sf).withColumn("innings_decimal", F.col("innings_decimal") + F.expr("list_ordinal % 2") / 3.0)
    return E.out_failures(I.pbp(spark, sf), box)


@query("tto3_stat_fields", """
select canonical_id, event_order, ab as "AB_value", hit as "H_value", tb as "TB_value", bb as "BB_value", hbp as "HBP_value", sf as "SF_value", so as "SO_value",
  hr as "HR_value", obn as "OBP_num_value", obd as "OBP_den_value", wn as "wOBA_num_value", wd as "wOBA_den_value" from pas""", "wOBA_num_value")
def tto3(spark, sf):
    return I.plate_appearances(spark, sf).select(
        "canonical_id", "event_order", *[f"{n}_value" for n in ("AB", "H", "TB", "BB", "HBP", "SF", "SO", "HR", "OBP_num", "OBP_den", "wOBA_num", "wOBA_den")]
    )


@query("tto4_exposures", """
select canonical_id, event_order, series_id, game_ts as game_start, same_game_matchup_number, pitcher_batters_faced_before, mlb_tto_bf9, series_matchup_number,
  prior_series_game_matchups, re24_run_value, run_value from pas""", "re24_run_value run_value")
def tto4(spark, sf):
    return I.build_plate_appearances(spark, sf).select(
        "canonical_id", "event_order", "series_id", "game_start", "same_game_matchup_number", "pitcher_batters_faced_before", "mlb_tto_bf9",
        "series_matchup_number", "prior_series_game_matchups", "re24_run_value", "run_value",
    )


@query("tto5_slash_lines", line_sql("pas", "season, batter_key", intervals=False), RATES)
def tto5(spark, sf):
    return E.slash_line(E.game_sums(I.plate_appearances(spark, sf), "season", "batter_key"), "season", "batter_key", intervals=False)


@query("tto6_clustered_intervals", f"""
select season, "wOBA", "wOBA_95_low", "wOBA_95_high", "RV_per_PA", "RV_per_PA_95_low", "RV_per_PA_95_high" from ({line_sql('pas', 'season')}) x""",
       "wOBA RV_per_PA" + BOUNDS)
def tto6(spark, sf):
    lines = E.slash_line(E.game_sums(I.plate_appearances(spark, sf), "season"), "season")
    return lines.select("season", "wOBA", "wOBA_95_low", "wOBA_95_high", "RV_per_PA", "RV_per_PA_95_low", "RV_per_PA_95_high")


@query("tto7_descriptive_tables", line_sql("bands", "cut, label"), RATES + BOUNDS)
def tto7(spark, sf):
    return E.descriptive_tables(I.plate_appearances(spark, sf))


@query("tto8_pitcher_splits", f"select l.*, pitcher, teams from ({line_sql('pas3', 'pitcher_key, encounter')}) l join pitcher_meta using (pitcher_key)", RATES + BOUNDS)
def tto8(spark, sf):
    return E.pitcher_splits(I.plate_appearances(spark, sf))


@query("tto8_pitcher_penalties", """
select f.pitcher_key, m.pitcher, m.teams, f."PA" as "first_PA", coalesce(l."PA", 0) as "later_PA", f."PA" + coalesce(l."PA", 0) as "PA",
  f."OPS" as "first_OPS", f."wOBA" as "first_wOBA", f."RV_per_PA" as "first_RV_per_PA", f."wOBA_95_low" as "first_wOBA_95_low", f."wOBA_95_high" as "first_wOBA_95_high",
  l."OPS" as "later_OPS", l."wOBA" as "later_wOBA", l."RV_per_PA" as "later_RV_per_PA", l."wOBA_95_low" as "later_wOBA_95_low", l."wOBA_95_high" as "later_wOBA_95_high",
  l."OPS" - f."OPS" as "OPS_penalty", l."wOBA" - f."wOBA" as "wOBA_penalty", l."RV_per_PA" - f."RV_per_PA" as "RV_per_PA_penalty",
  case when coalesce(l."PA", 0) < 30 then 'small_later_sample' else '' end as quality_flag
from (select * from phase_lines where phase = 'first') f left join (select * from phase_lines where phase = 'later') l using (pitcher_key) join pitcher_meta m using (pitcher_key)""",
       "first_OPS first_wOBA first_RV_per_PA first_wOBA_95_low first_wOBA_95_high later_OPS later_wOBA later_RV_per_PA later_wOBA_95_low later_wOBA_95_high "
       "OPS_penalty wOBA_penalty RV_per_PA_penalty")
def tto8_penalties(spark, sf):
    return E.pitcher_penalties(I.plate_appearances(spark, sf))


def fits(spark, sf):
    return I.stage(spark, sf, "fits", lambda s, d: R.fit_fixed_effects(I.plate_appearances(s, d)))


# The twin writes every dummy out and sweeps the cross products column by column; exposure terms are numbered 1 to 8, the season is 5.
cte("fe_pa", """
select m, row_number() over () as id, canonical_id, batter_key, pitcher_key, [cast(same_game_matchup_number = 2 as double), cast(same_game_matchup_number >= 3 as double),
  cast(prior_series_game_matchups between 1 and 2 as double), cast(prior_series_game_matchups >= 3 as double), cast(season = 2026 as double),
  pitcher_batters_faced_before / 9.0, cast(inning between 3 and 4 as double), cast(inning >= 5 as double)] as terms,
  case when m = 0 then [cast(run_value as double), cast(obn as double)] else [cast(wn as double), 0.0] end as ys
from pas cross join (values (0), (1)) populations(m) where m = 0 or wd > 0""")
cte("fe_players", """
select m, side, key, cast(row_number() over (partition by m, side order by key) as int) as n from (
  select distinct m, 0 as side, batter_key as key from fe_pa union select distinct m, 1, pitcher_key from fe_pa) a""")
cte("fe_size", """
select m, cast(count(*) filter (side = 0) as int) as nb, cast(count(*) filter (side = 1) as int) as np, cast(count(*) - 1 as int) as base from fe_players group by m""")
cte("fe_x", """
select m, id, canonical_id, 1 as col, 1.0 as x from fe_pa
union all select f.m, id, canonical_id, n, 1.0 from fe_pa f join fe_players p on p.m = f.m and side = 0 and key = batter_key where n > 1
union all select f.m, id, canonical_id, nb + n - 1, 1.0 from fe_pa f join fe_size z on z.m = f.m join fe_players p on p.m = f.m and side = 1 and key = pitcher_key where n > 1
union all select f.m, id, canonical_id, base + t, terms[t] from fe_pa f join fe_size z on z.m = f.m cross join (select cast(unnest(range(1, 9)) as int) as t) a where terms[t] <> 0
union all select f.m, id, canonical_id, base + 8 + o, ys[o] from fe_pa f join fe_size z on z.m = f.m cross join (select cast(unnest(range(1, 3)) as int) as o) a where ys[o] <> 0""")
cte("fe_products", """
select z.m, i, j, coalesce(v, 0.0) as v, max(case when i = j then coalesce(v, 0.0) end) over (partition by z.m, i) as own
from fe_size z cross join lateral (select cast(unnest(range(1, base + 11)) as int) as i) r cross join lateral (select cast(unnest(range(1, base + 11)) as int) as j) c
left join (select a.m, a.col as i, b.col as j, sum(a.x * b.x) as v from fe_x a join fe_x b on b.m = a.m and b.id = a.id group by all) g using (m, i, j)""")
cte("fe_swept", """
with recursive s as (
  select m, 0 as k, i, j, v, own from fe_products
  union all
  select t.m, t.k + 1, t.i, t.j, case when d.v <= 1e-9 * d.own then t.v when t.i = t.k + 1 and t.j = t.k + 1 then -1 / d.v
    when t.i = t.k + 1 or t.j = t.k + 1 then t.v / d.v else t.v - c.v * r.v / d.v end, t.own
  from s t join s d on d.m = t.m and d.i = t.k + 1 and d.j = t.k + 1 join s c on c.m = t.m and c.i = t.i and c.j = t.k + 1 join s r on r.m = t.m and r.j = t.j and r.i = t.k + 1
  join fe_size z on z.m = t.m where t.k < z.base + 8)
select s.m, cast(s.k - base as int) as terms, i, j, v, base from s join fe_size z using (m) where s.k - base in (5, 8)""")
cte("fe_there", "select m, terms, i as col, base from fe_swept where i = j and v < 0 and i <= base + terms")
cte("fe_beta", """
select m, terms, col, j - base - 8 as o, v as beta, base from fe_there t join fe_swept s using (m, terms, base) where s.i = t.col and j > base + 8 and (m = 0 or j = base + 9)""")
cte("fe_left", """
select x.m, b.terms, o, x.id, any_value(ys[o]) - sum(x * beta) as r from fe_x x join fe_beta b on b.m = x.m and b.col = x.col join fe_pa f on f.m = x.m and f.id = x.id group by all""")
cte("fe_scores", """
select x.m, l.terms, o, canonical_id, x.col, sum(x * r) as score from fe_x x join fe_left l on l.m = x.m and l.id = x.id join fe_there t on t.m = x.m and t.terms = l.terms and t.col = x.col group by all""")
cte("fe_errors", """
select m, terms, o, t, sum(pow(moved, 2)) as total from (
  select c.m, c.terms, o, canonical_id, s.i - base as t, sum(-s.v * score) as moved from fe_scores c join fe_swept s on s.m = c.m and s.terms = c.terms and s.j = c.col
  where s.i between base + 1 and base + c.terms group by all) a group by all""")
cte("fe_fitted", """
select case when m = 1 then 'wOBA_value' when o = 1 then 'run_value' else 'on_base' end as outcome, case terms when 5 then 'total_exposure_association' else 'workload_decomposition' end as model_spec,
  n, games, cast(nb as bigint) as batter_fixed_effects, cast(np as bigint) as pitcher_fixed_effects, cast(base + terms as bigint) as design_columns, design_rank,
  ['same_game_encounter_2', 'same_game_encounter_3plus', 'prior_series_games_1_2', 'prior_series_games_3plus', 'season_2026', 'pitcher_bf_before_per_9', 'inning_3_4', 'inning_5plus'][t] as term,
  estimate, se as standard_error, estimate - 1.96 * se as ci_95_low, estimate + 1.96 * se as ci_95_high
from (select e.*, nb, np, z.base, n, games, design_rank, sqrt(games / (games - 1.0) * total) as se, coalesce(beta, 0.0) as estimate
  from fe_errors e join fe_size z using (m) join (select m, count(*) as n, count(distinct canonical_id) as games from fe_pa group by m) f using (m)
  join (select m, terms, count(*) as design_rank from fe_there group by all) d using (m, terms)
  left join fe_beta b on b.m = e.m and b.terms = e.terms and b.o = e.o and b.col = z.base + e.t) q""")
_FITTED = "estimate standard_error ci_95_low ci_95_high"


@query("tto9_fixed_effect_model", "select * from fe_fitted where model_spec = 'total_exposure_association'", _FITTED)
def tto9(spark, sf):
    return fits(spark, sf).where("model_spec = 'total_exposure_association'")


@query("tto9_workload_model", "select * from fe_fitted where model_spec = 'workload_decomposition'", _FITTED)
def tto9_workload(spark, sf):
    return fits(spark, sf).where("model_spec = 'workload_decomposition'")


@query("tto10_dataset_checks", """
select 'every completed official game is represented' as check, a = b and c = b as passed, a as observed, b as expected from (
  select (select count(distinct game_id) from pas) as a, (select count(*) from fx_official where record_status = 'Completed') as b,
    (select count(distinct p.game_id) from pas p join fx_official o on o.game_id = p.game_id and o.record_status = 'Completed') as c) x
union all select 'every PA has batter and pitcher identity', true, count(*), count(*) from pas
union all select 'same-game matchup ordinals are consecutive', true, count(*), count(*) from (select distinct canonical_id, batter_key, pitcher_key from pas) y
union all select 'series matchup ordinals are consecutive', true, count(*), count(*) from (select distinct series_id, batter_key, pitcher_key from pas) y
union all select 'pitcher batters-faced counters are consecutive', true, count(*), count(*) from (select distinct canonical_id, pitcher_key from pas) y""")
def tto10(spark, sf):
    completed = C.completed_games(I.view(spark, sf, "fx_official"))
    return E.validate_exposures(I.plate_appearances(spark, sf), completed)


@query("tto11_period_payload", "select * from payload", RATES)
def tto11(spark, sf):
    return E.period_payload(I.plate_appearances(spark, sf), ENTITIES)


@query("tto11_payload_penalties", """
select kind, key, period, cast(sum("PA") as bigint) as "PA",
  max("OPS") filter (where label = 'later' and "PA" > 0) - max("OPS") filter (where label = 'first' and "PA" > 0) as "OPS_penalty",
  max("wOBA") filter (where label = 'later' and "PA" > 0) - max("wOBA") filter (where label = 'first' and "PA" > 0) as "wOBA_penalty",
  max("RV_per_PA") filter (where label = 'later' and "PA" > 0) - max("RV_per_PA") filter (where label = 'first' and "PA" > 0) as "RV_penalty"
from payload where cut = 'phase' group by kind, key, period""", "OPS_penalty wOBA_penalty RV_penalty")
def tto11_penalties(spark, sf):
    return E.payload_penalties(E.period_payload(I.plate_appearances(spark, sf), ENTITIES))


@query("tto12_study_summary", """
select count(distinct canonical_id) as games, count(*) as plate_appearances, count(distinct pitcher_key) as pitchers, count(distinct series_id) as series,
  count(*) filter (where pitch_text <> '') / count(*) as pitch_text_coverage from pas""", "pitch_text_coverage")
def tto12(spark, sf):
    return E.study_summary(I.plate_appearances(spark, sf))


@query("ent10_series", """
select canonical_id, series_id, series_game_number, series_source from series""")
def ent10(spark, sf):
    return I.series(spark, sf).select("canonical_id", "series_id", "series_game_number", "series_source")
