"""Text, event and identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basepaths.functions import identity as N
from basepaths.functions import text as X
from basepaths.operators import attribution as A
from basepaths.operators import contests as C
from basepaths.operators import events as E
from basepaths.operators import feed as D

from basepaths.plans import inputs as I
from basepaths.plans.registry import cte, query
from basepaths.session import DEAL_BY_ALL_KEYS
from basepaths.sources.fixtures import runner_structs

_CODES = {
    "home_run": "HR", "triple": "3B", "double": "2B", "single": "1B 8", "intentional_walk": "IBB", "walk": "BB", "hit_by_pitch": "HBP",
    "sacrifice_fly": "SF 7", "sacrifice_bunt": "SAC", "catcher_interference": "CI", "fielders_choice": "FC 6", "reached_on_error": "E5",
    "strikeout": "KS", "double_play": "6-4-3 DP", "out": "6-3",
}
_CODE_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _CODES.items()) + " else '' end"


@query("evt1_play_classification", f"""
select canonical_id, event_order, case when is_plate_appearance then event_type else 'unknown' end as play_type,
  case when {_CODE_SQL} = '' then 'unknown' else event_type end as code_type,
  cast(case event_type when 'home_run' then 4 when 'triple' then 3 when 'double' then 2 when 'single' then 1 when 'walk' then 1 when 'intentional_walk' then 1
    when 'hit_by_pitch' then 1 when 'catcher_interference' then 1 when 'dropped_third_reached' then 1 when 'reached_on_error' then 1 when 'fielders_choice' then 1 end as int) as destination,
  cast(case event_type when 'double_play' then 2 when 'strikeout' then 1 when 'dropped_third_out' then 1 when 'sacrifice_fly' then 1 when 'sacrifice_bunt' then 1
    when 'infield_fly' then 1 when 'out' then 1 else 0 end as int) as outs_on_play from pbp""")
def evt1(spark, sf):
    rows = I.pbp(spark, sf).withColumn("code", F.expr(_CODE_SQL)).select(
        "canonical_id", "event_order", X.play_type(F.col("play_text")).alias("play_type"),
        X.official_play_type(F.col("code"), F.lit("")).alias("code_type"), "play_text",
    )
    return rows.select(
        "canonical_id", "event_order", "play_type", "code_type", X.batter_destination(F.col("play_type")).alias("destination"),
        X.outs_on_play(F.col("play_type"), F.col("play_text")).alias("outs_on_play"),
    )


@query("evt2_batted_balls", """
select canonical_id, event_order, traj as batted_type, first_pos as first_position, cast(mentions as int) as position_mentions, named as fielder from texted""")
def evt2(spark, sf):
    return I.valued(spark, sf).select("canonical_id", "event_order", "batted_type", "first_position", "position_mentions", "fielder")


@query("evt3_spray_locations", "select canonical_id, event_order, spray, contact from ppas where period = 'combined'")
def evt3(spark, sf):
    text = F.col("play_text")
    return I.pbp(spark, sf).where("is_plate_appearance").select(
        "canonical_id", "event_order", X.spray_location(text).alias("spray"), X.contact_type(text).alias("contact")
    )


# --- raw plays ---------------------------------------------------------------------------

_CHANGE = "case when k in (45, 50) then concat(pitcher, ' in for pitcher') end"


def raw_plays(spark, sf):
    """Display rows: a plate appearance has play text, a runner event pitch text."""
    moved = (
        "case event_type when 'stolen_base' then concat(who, ' steals 2nd') when 'caught_stealing' then concat(who, ' caught stealing, ', who, ' out at 2nd') "
        "when 'wild_pitch' then concat(who, ' advances to 3rd on wild pitch') end"
    )
    first = "coalesce(get(_runners, 0).runner, concat('Batter T', cast(bat_no as string), ' N', lpad(cast((slot + 14) % 15 as string), 2, '0')))"
    return I.pbp(spark, sf).selectExpr("*", f"{runner_structs()} as _runners").selectExpr("*", f"{first} as who").selectExpr(
        "canonical_id", "k as row_no", f"concat_ws(', ', {_CHANGE}, {moved}) as pitch", "case when is_plate_appearance then play_text else '' end as play"
    )


def hitters(spark, sf):
    key = N.person_key(F.col("player"))
    # whoever bats or runs in a game, as listed in its box score
    people = I.pbp(spark, sf).selectExpr("canonical_id", "batting_team as team", f"{runner_structs()} as _r", "batter", "bat_no", "slot").selectExpr(
        "canonical_id", "team",
        "explode(concat(array(batter, concat('Batter T', cast(bat_no as string), ' N', lpad(cast((slot + 14) % 15 as string), 2, '0'))), transform(_r, x -> x.runner))) as player",
    ).distinct()
    return people.groupBy("canonical_id").agg(
        F.array_sort(F.collect_set("player")).alias("names"), F.map_from_entries(F.collect_set(F.struct(key, F.col("team")))).alias("team_of")
    )


def staffs(spark, sf):
    listed = F.array_sort(F.collect_list(F.struct("list_ordinal", "player")))
    return I.box_pitching(spark, sf).groupBy("canonical_id", "team").agg(F.transform(listed, lambda p: p["player"]).alias("pitchers"))


def _games(spark, sf):
    return I.view(spark, sf, "fx_games").select("canonical_id", "season", "home_team", "away_team")


cte("halves", """
select *, cast(sum(fresh) over (partition by canonical_id order by k rows unbounded preceding) - 1 as int) as half_index from (
  select *, case when bt is not null and bt is distinct from lag(bt ignore nulls) over (partition by canonical_id order by k) then 1 else 0 end as fresh,
    last_value(bt ignore nulls) over (partition by canonical_id order by k rows unbounded preceding) as team from (
    select *, case when is_plate_appearance then batting_team end as bt from pbp) a) b""")


@query("evt4_half_innings", """
select canonical_id, k as row_no, team as batting_team, half_index, cast(floor(half_index / 2.0) as int) + 1 as inning, case when half_index % 2 = 0 then 'top' else 'bottom' end as half from halves""")
def evt4(spark, sf):
    return E.detect_halves(raw_plays(spark, sf), hitters(spark, sf)).select("canonical_id", "row_no", "batting_team", "half_index", "inning", "half")


@query("evt5_pitcher_carry", """
select canonical_id, k as row_no, fielding_team, pitcher from pbp""")
def evt5(spark, sf):
    rows = raw_plays(spark, sf).join(I.pbp(spark, sf).select("canonical_id", F.col("k").alias("row_no"), "fielding_team"), ["canonical_id", "row_no"])
    return E.carry_pitchers(rows, staffs(spark, sf)).select("canonical_id", "row_no", "fielding_team", "pitcher")


def normalized(spark, sf):
    return I.stage(
        spark, sf, "normalized", lambda s, d: E.normalize_games(raw_plays(s, d), hitters(s, d), staffs(s, d), _games(s, d))
    )


# Display rows in order within their half-inning, with the runner a text names (on the lowest base drawn) and what the play does.
cte("shown_rows", """
select canonical_id, half_index, k, cast(row_number() over (partition by canonical_id, half_index order by k) as int) as n, event_type, batter,
  concat('Batter T', bat_no, ' N', lpad(cast((slot + 15 - case when bases_before % 2 = 1 then 1 when bases_before in (2, 6) then 2 when bases_before = 4 then 3 else 1 end) % 15 as varchar), 2, '0')) as who,
  is_plate_appearance and event_type in ('walk', 'intentional_walk', 'hit_by_pitch', 'catcher_interference') as walk,
  case when event_type in ('caught_stealing', 'double_play') then 2
    when event_type in ('strikeout', 'dropped_third_out', 'sacrifice_fly', 'sacrifice_bunt', 'infield_fly', 'out') then 1 else 0 end as gone,
  case when event_type = 'home_run' then 4 when event_type = 'triple' then 3 when event_type = 'double' then 2
    when event_type in ('single', 'walk', 'intentional_walk', 'hit_by_pitch', 'catcher_interference', 'dropped_third_reached', 'reached_on_error', 'fielders_choice') then 1 else 0 end as dest
from halves where half_index >= 0""")
cte("shown_states", """
with recursive f as (
  select canonical_id, half_index, 0 as n, 0 as o0, cast(null as varchar) as a1, cast(null as varchar) as a2, cast(null as varchar) as a3, 0 as outs, cast(null as varchar) as r1,
    cast(null as varchar) as r2, cast(null as varchar) as r3 from shown_rows group by canonical_id, half_index
  union all
  select canonical_id, half_index, n, outs, o1, o2, o3, least(3, outs + gone),
    case when dest = 1 then batter when dest > 1 then null else r1 end,
    case when dest = 2 then batter when dest > 2 then null when dest = 1 and r1 is not null then r1 else r2 end,
    case when dest = 3 then batter when dest = 4 then null when dest = 2 then case when r1 is not null then r1 else r3 end when dest = 1 and r1 is not null and r2 is not null then r2 else r3 end
  from (
    select * replace (case when walk then null else r1 end as r1, case when walk and r1 is not null then r1 else r2 end as r2,
      case when walk and r1 is not null and r2 is not null then r2 else r3 end as r3) from (
    -- on a wild pitch the named runner stands on third; caught, he is off
    select * replace (case when event_type in ('wild_pitch', 'caught_stealing') and r1 = who then null else r1 end as r1,
      case when event_type in ('wild_pitch', 'caught_stealing') and r2 = who then null else r2 end as r2,
      case when event_type = 'wild_pitch' then who when event_type = 'caught_stealing' and r3 = who then null else r3 end as r3) from (
    select r.canonical_id, r.half_index, r.n, f.outs, f.r1 as o1, f.r2 as o2, f.r3 as o3, f.r1, f.r2, f.r3, r.event_type, r.who, r.batter, r.walk, r.gone, r.dest
    from f join shown_rows r on r.canonical_id = f.canonical_id and r.half_index = f.half_index and r.n = f.n + 1) a) b) c)
select * from f where n > 0""")


@query("evt6_base_out_states", """
select canonical_id, cast(row_number() over (partition by canonical_id order by k) as int) as event_order, event_type, cast(o0 as int) as outs_before,
  cast((a1 is not null)::int + 2 * (a2 is not null)::int + 4 * (a3 is not null)::int as int) as bases_before, cast(outs as int) as outs_after,
  cast((r1 is not null)::int + 2 * (r2 is not null)::int + 4 * (r3 is not null)::int as int) as bases_after, cast((event_type = 'home_run')::int as int) as runs_scored, cast(0 as int) as state_errors
from shown_states join shown_rows using (canonical_id, half_index, n)""")
def evt6(spark, sf):
    return E.normalize_games(raw_plays(spark, sf), hitters(spark, sf), staffs(spark, sf), _games(spark, sf)).select(
        "canonical_id", "event_order", "event_type", "outs_before", "bases_before", "outs_after", "bases_after", "runs_scored", "state_errors"
    )


@query("evt7_event_types", """
select canonical_id, k as display_row_index, event_type, is_plate_appearance from pbp
where k >= (select min(k) from pbp q where q.canonical_id = pbp.canonical_id and q.is_plate_appearance)""")
def evt7(spark, sf):
    return normalized(spark, sf).select("canonical_id", "display_row_index", "event_type", "is_plate_appearance")


@query("evt7_unresolved_rows", """
select canonical_id, k as row_no from pbp where k < (select min(k) from pbp q where q.canonical_id = pbp.canonical_id and q.is_plate_appearance)""")
def evt7_unresolved(spark, sf):
    return E.unresolved_rows(raw_plays(spark, sf), normalized(spark, sf)).select("canonical_id", "row_no")


@query("evt8_official_runs", """
select canonical_id, k as play_seqno, batting_team, cast(runs_scored as bigint) as runs_scored from pbp""")
def evt8(spark, sf):
    from pyspark.sql import Window

    total = F.sum("runs_scored").over(Window.partitionBy("canonical_id", "batting_team").orderBy("k"))
    feed = I.pbp(spark, sf).select("canonical_id", F.col("k").alias("play_seqno"), "batting_team", total.alias("team_score"))
    return E.official_runs(feed).select("canonical_id", "play_seqno", "batting_team", "runs_scored")


# Feed plays that count, with what the fold does to the bases: one and two are the runners a text may name.
cte("feed_rows", """
select e.*, 2 * k + 1 as seq, case when event_type = 'dropped_third_out' then 'strikeout' else event_type end as kind,
  concat('Batter T', bat_no, ' N', lpad(cast((slot + 14) % 15 as varchar), 2, '0')) as one, concat('Batter T', bat_no, ' N', lpad(cast((slot + 13) % 15 as varchar), 2, '0')) as two,
  case when event_type = 'stolen_base' then '' when event_type = 'caught_stealing' then 'out' when event_type = 'wild_pitch' then 'to 3'
    when event_id % 6 = 0 then 'score' when event_id % 6 = 1 then 'to 3' when event_id % 6 = 2 then 'out' when event_id % 6 = 3 then 'to 2' else '' end as told,
  is_plate_appearance and event_id % 10 = 3 as two_scores,
  case when not is_plate_appearance or event_type in ('strikeout', 'dropped_third_out', 'double_play', 'sacrifice_fly', 'sacrifice_bunt', 'infield_fly', 'out') then 0
    when event_type = 'home_run' then 4 when event_type = 'triple' then 3 when event_type = 'double' then 2 else 1 end as dest
from pbp e""")
cte("feed_folded", """
with recursive f as (
  select canonical_id, h, -1 as p, cast(null as varchar) as a1, cast(null as varchar) as a2, cast(null as varchar) as a3, cast(null as varchar) as r1, cast(null as varchar) as r2,
    cast(null as varchar) as r3, 0 as actions from feed_rows group by canonical_id, h
  union all
  select canonical_id, h, p, o1, o2, o3,
    -- the batter arrives: on first after whoever is there has made room, on second and third with the others ahead of him
    case when dest = 1 then batter when dest > 1 then null else r1 end,
    case when dest = 2 then batter when dest > 2 then null when dest = 1 and r1 is not null then r1 else r2 end,
    case when dest = 3 then batter when dest = 4 then null when dest = 2 then case when r1 is not null then r1 else r3 end when dest = 1 and r1 is not null and r2 is not null then r2 else r3 end,
    actions + case dest
      when 1 then case when r1 is null then 0 when r2 is null then 1 when r3 is null then 2 else 3 end
      when 2 then (r1 is not null)::int + (r2 is not null)::int + (r1 is not null and r3 is not null)::int
      when 0 then 0 else (r1 is not null)::int + (r2 is not null)::int + (r3 is not null)::int end
  from (
    -- a walk moves the forced runners
    select * replace (case when walk then null else r1 end as r1, case when walk and r1 is not null then r1 else r2 end as r2,
      case when walk and r1 is not null and r2 is not null then r2 else r3 end as r3) from (
    -- the runner stands on his new base
    select * replace (case when told[1:2] = 'to' and r1 = one then null else r1 end as r1,
      case when told = 'to 2' then one when told = 'to 3' and r2 = one then null else r2 end as r2,
      case when told = 'to 3' then one when told = 'to 2' and r3 = one then null else r3 end as r3) from (
    -- whoever stands there goes on; nobody scores unnamed
    select * replace (case when told = 'to 2' and r2 <> one then null else r2 end as r2,
      case when told = 'to 2' and r2 <> one then r2 when told = 'to 3' and r3 <> one then null else r3 end as r3,
      actions + case when told = 'to 2' and r2 <> one then case when r3 is null then 1 else 2 end when told = 'to 3' and r3 <> one then 1 else 0 end as actions) from (
    -- outs and scores come first
    select canonical_id, h, p, o1, o2, o3, one, told, batter, dest, walk,
      case when (told in ('out', 'score') and o1 = one) or (two_scores and o1 = two) then null else o1 end as r1,
      case when (told in ('out', 'score') and o2 = one) or (two_scores and o2 = two) then null else o2 end as r2,
      case when (told in ('out', 'score') and o3 = one) or (two_scores and o3 = two) then null else o3 end as r3,
      (told <> '')::int + two_scores::int + (event_type = 'dropped_third_out')::int as actions
    from (select r.*, f.r1 as o1, f.r2 as o2, f.r3 as o3, r.is_plate_appearance and r.event_type in ('walk', 'intentional_walk', 'hit_by_pitch', 'catcher_interference') as walk
      from f join feed_rows r on r.canonical_id = f.canonical_id and r.h = f.h and r.p = f.p + 1) a) b) c) d) e)
select * from f where p >= 0""")
cte("feed_lineup", """
select distinct canonical_id, fielding_team as team, position, fielder as player, -1 as seq from pbp
union all select canonical_id, fielding_team, position, concat('Fielder T', fld_no, ' N', lpad(cast((f + 1) % 9 as varchar), 2, '0')), 2 * k from pbp where event_id % 17 = 0""")
cte("feed_events", """
select canonical_id, season, inning, half, cast(row_number() over (partition by canonical_id order by seq) as int) as event_order, cast(seq as int) as display_row_index, kind as event_type,
  is_plate_appearance, batting_team, fielding_team, case when is_plate_appearance then batter end as batter, case when is_plate_appearance then pitcher end as pitcher, outs_before, bases_before, runners_before,
  cast(least(3, outs_before + greatest((told = 'out')::int + (event_type = 'dropped_third_out')::int, outs)) as int) as outs_after, bases_after, runners_after, runs_scored, cast(actions as int) as actions,
  case when not is_plate_appearance then '' when pitch_text = '' then 'X' else pitch_text end as pitch_text,
  concat(text, case when keeper is not null then concat(' Fielded by ', spot, ' ', keeper, '.') else '' end) as play_text, action as official_action, cast(0 as int) as state_errors
from (
  select s.*, case when w.position = s.spot then s.held end as keeper from (
    select q.*, c.player as held from (
      select r.* exclude (bases_before, bases_after), f.actions,
        cast((f.a1 is not null)::int + 2 * (f.a2 is not null)::int + 4 * (f.a3 is not null)::int as int) as bases_before, concat_ws('|', coalesce(f.a1, ''), coalesce(f.a2, ''), coalesce(f.a3, '')) as runners_before,
        cast((f.r1 is not null)::int + 2 * (f.r2 is not null)::int + 4 * (f.r3 is not null)::int as int) as bases_after, concat_ws('|', coalesce(f.r1, ''), coalesce(f.r2, ''), coalesce(f.r3, '')) as runners_after,
        case when kind in ('single', 'out') then position when kind = 'sacrifice_fly' then 'left fielder' when kind in ('fielders_choice', 'double_play') then 'shortstop'
          when kind = 'reached_on_error' then 'third baseman' end as spot,
        case when kind = 'double_play' then 2 when kind in ('strikeout', 'sacrifice_fly', 'sacrifice_bunt', 'infield_fly', 'out') then 1 else 0 end as outs,
        n.action, case event_type when 'stolen_base' then concat(one, ' steals 2nd.') when 'caught_stealing' then concat(one, ' caught stealing second.')
          when 'wild_pitch' then concat(one, ' advances to 3rd on a wild pitch.') else concat(
            replace(play_text[:-2], ' is out at first on', ' is out at 1st on'), case when pitch_text = '' then ' (1-1)' else concat(' (1-1 ', pitch_text, ')') end,
            case told when 'score' then concat(', ', one, ' scores') when 'to 3' then concat(', ', one, ' advances to 3rd') when 'out' then concat(', ', one, ' out at 2nd')
              when 'to 2' then concat(', ', one, ' advances to 2nd') else '' end, case when two_scores then concat(', ', two, ' scores') else '' end, '.') end as text
      from feed_rows r join feed_folded f on f.canonical_id = r.canonical_id and f.h = r.h and f.p = r.p join fx_feed n on n.canonical_id = r.canonical_id and n.play_seqno = r.seq) q
    asof left join feed_lineup c on c.canonical_id = q.canonical_id and c.team = q.fielding_team and c.position = q.spot and c.seq <= q.seq) s
  asof left join feed_lineup w on w.canonical_id = s.canonical_id and w.team = s.fielding_team and w.player = s.held and w.seq <= s.seq) x""")


def _feed(spark, sf):
    base = I.pbp(spark, sf)
    starters = base.select("canonical_id", F.col("fielding_team").alias("team"), "position", F.col("fielder").alias("player")).distinct()
    return I.stage(
        spark, sf, "feed_events", lambda s, d: D.feed_events(I.view(s, d, "fx_feed"), I.view(s, d, "fx_people"), starters, I.game_tasks(s, d)),
        {DEAL_BY_ALL_KEYS: "false"},
    )


@query("evt8_events", "select * from feed_events")
def evt8_events(spark, sf):
    side = lambda c: F.concat_ws("|", *[F.coalesce(F.try_element_at(c, F.lit(b)), F.lit("")) for b in (1, 2, 3)]).alias(c)
    return _feed(spark, sf).select(
        "canonical_id", "season", "inning", "half", "event_order", "display_row_index", "event_type", "is_plate_appearance", "batting_team", "fielding_team", "batter",
        "pitcher", "outs_before", "bases_before", side("runners_before"), "outs_after", "bases_after", side("runners_after"), "runs_scored",
        F.size("runner_actions").alias("actions"), "pitch_text", "play_text", "official_action", "state_errors",
    )


@query("evt8_feed_audit", """
select o.canonical_id, o.season, cast(o.home_score + o.away_score as bigint) as expected_runs, count(*) as events, count(*) filter (is_plate_appearance) as plate_appearances,
  cast(sum(runs_scored) as bigint) as observed_runs, cast(0 as bigint) as state_invariant_error_count, cast(sum(runs_scored) - any_value(o.home_score + o.away_score) as bigint) as run_difference
from (select *, concat('g', lpad(cast(game_id as varchar), 6, '0')) as canonical_id from fx_official) o join feed_events e using (canonical_id) group by o.canonical_id, o.season, o.home_score, o.away_score""")
def evt8_audit(spark, sf):
    schedule = I.view(spark, sf, "fx_official").select(
        F.concat(F.lit("g"), F.lpad(F.col("game_id").cast("string"), 6, "0")).alias("canonical_id"), "season",
        (F.col("home_score") + F.col("away_score")).cast("long").alias("expected_runs"),
    )
    return D.feed_audit(_feed(spark, sf), schedule)


_STARTER = "concat('Fielder T', cast(fld_no as varchar(10)), ' N', lpad(cast(f as varchar(10)), 2, '0'))"
cte("lineup_changes", """
select distinct canonical_id, fielding_team as team, position, fielder as player, -1 as seq from pbp
union all select canonical_id, fielding_team, position, concat('Fielder T', fld_no, ' N', lpad(cast((f + 1) % 9 as varchar), 2, '0')), k from pbp where event_id % 17 = 0""")


@query("evt9_active_lineup", """
select a.canonical_id, a.fielding_team as team, a.position, a.seq, case when w.position = a.position then a.player else '' end as player from (
  select p.canonical_id, p.fielding_team, p.position, p.k as seq, c.player from pbp p
  asof left join lineup_changes c on c.canonical_id = p.canonical_id and c.team = p.fielding_team and c.position = p.position and c.seq <= p.k) a
asof left join lineup_changes w on w.canonical_id = a.canonical_id and w.team = a.fielding_team and w.player = a.player and w.seq <= a.seq""")
def evt9(spark, sf):
    events = I.pbp(spark, sf)
    starters = events.select("canonical_id", F.col("fielding_team").alias("team"), "position", F.col("fielder").alias("player")).distinct()
    other = F.expr("concat('Fielder T', cast(fld_no as string), ' N', lpad(cast((f + 1) % 9 as string), 2, '0'))")
    moves = events.where("event_id % 17 = 0").select("canonical_id", F.col("fielding_team").alias("team"), "position", other.alias("player"), F.col("k").alias("seq"))
    plays = events.select("canonical_id", F.col("fielding_team").alias("team"), "position", F.col("k").alias("seq"))
    return E.active_lineup(starters, moves, plays).withColumn("player", F.coalesce("player", F.lit("")))


@query("evt10_box_line_differences", """
select canonical_id, pitcher_key as player_key, bf as "BF", h + 1 as "H", bb as "BB", so as "SO", hr as "HR", cast(bf as bigint) as "BF_seen", cast(h as bigint) as "H_seen",
  cast(bb as bigint) as "BB_seen", cast(so as bigint) as "SO_seen", cast(hr as bigint) as "HR_seen", cast(0 as bigint) as unknown from fx_box_pitching where list_ordinal % 4 = 1 and bf > 0""")
def evt10(spark, sf):
    # every fourth list place has a hit too many in the box, so differences exist
    box = I.box_pitching(spark, sf).withColumn("H", F.col("H") + F.expr("case when list_ordinal % 4 = 1 then 1 else 0 end"))
    return E.box_line_differences(I.pbp(spark, sf), box)


@query("evt11_state_violations", """
select canonical_id, event_order, false as illegal_base, true as duplicate_runner from (
  select r.canonical_id, r.event_order, r.runner, b.runner as other from runner_rows r join runner_rows b on b.event_id = r.event_id and b.start_base > r.start_base
  where r.event_id % 13 = 0) x group by canonical_id, event_order""")
def evt11(spark, sf):
    # every thirteenth event names its first runner on all occupied bases
    rows = I.valued(spark, sf).select("canonical_id", "event_order", "event_id", "runners_before")
    first = F.get(F.map_values("runners_before"), F.lit(0))
    changed = F.when(F.col("event_id") % 13 == 0, F.transform_values("runners_before", lambda b, r: first)).otherwise(F.col("runners_before"))
    return E.state_violations(rows.withColumn("runners_after", changed)).select("canonical_id", "event_order", "illegal_base", "duplicate_runner")


#: A play as a document; lists, objects in lists, missing keys, nulls and numbers of two kinds.
_BODY = (
    "concat('{\"game\":\"', canonical_id, '\",\"plays\":[{\"k\":', cast(k as varchar(10)), ',\"type\":\"', event_type, '\"', case when is_plate_appearance then "
    "concat(',\"batter\":{\"key\":\"', batter_key, '\",\"slot\":', cast(slot as varchar(10)), '}') else '' end, '},{\"runs\":', cast(runs_scored as varchar(10)), '}],\"outs\":[', "
    "cast(outs_before as varchar(10)), ',', cast(outs_after as varchar(10)), '],\"share\":', case when k % 2 = 0 then '0.5' else '1' end, ',\"note\":', "
    "case when k % 3 = 0 then 'null' when k % 3 = 1 then 'true' else '[]' end, '}')"
)


@query("evt15_schema_inventory", f"""
select regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') as path, case when t.type in ('UBIGINT', 'BIGINT') then 'BIGINT' when t.type = 'VARCHAR' then 'STRING' when t.type = 'DOUBLE' then 'DECIMAL'
  when t.type = 'NULL' then 'VOID' else t.type end as type, count(*) as "values" from (select {_BODY} as body from pbp) d, json_tree(d.body) t group by all""")
def evt15(spark, sf):
    return E.schema_inventory(I.pbp(spark, sf).select(F.expr(_BODY).alias("body")), "body")


@query("evt16_semantic_presence", """
select category, count(*) as documents from (
  select unnest(list_filter([case when regexp_matches(low, 'batter|hitter') then 'batter_identity' end, case when low like '%pitcher%' then 'pitcher_identity' end,
    case when regexp_matches(low, 'runner|baserunner') then 'runner_identity' end, case when regexp_matches(low, 'fielder|fielding|putout|assist') then 'fielder_identity' end,
    case when regexp_matches(low, 'base|first|second|third|on_1|on_2|on_3') then 'base_occupancy' end, case when low like '%out%' then 'outs' end,
    case when low like '%error%' then 'errors' end, case when regexp_matches(low, 'double_play|double play') then 'double_plays' end,
    case when regexp_matches(low, 'batted|hit_type|direction|trajectory') then 'batted_ball' end,
    case when regexp_matches(low, 'advance|scored') then 'runner_advancement' end], lambda x: x is not null)) as category
  from (select lower(play_text) as low from pbp) a) b group by category""")
def evt16(spark, sf):
    return E.category_counts(E.semantic_presence(I.pbp(spark, sf).select("play_text"), "play_text"))


@query("evt16_best_copy", """
select canonical_id, copy_id, plays, players from (
  select canonical_id, copy_id, plays, players, row_number() over (partition by canonical_id order by plays desc, players desc, copy_id desc) as n from (
    select canonical_id, k % 3 as copy_id, count(*) as plays, count(distinct batter) as players from pbp group by canonical_id, k % 3) a) b where n = 1""")
def evt16_copy(spark, sf):
    copies = I.pbp(spark, sf).groupBy("canonical_id", F.expr("k % 3").alias("copy_id")).agg(
        F.count("*").alias("plays"), F.count_distinct("batter").alias("players")
    )
    return E.best_copy(copies.withColumn("categories", F.array(F.lit("all"))), "canonical_id").drop("categories")


# --- identities --------------------------------------------------------------------------

@query("ent1_person_keys", """
select distinct translate(batter, 'aeo', 'áéö') as name, regexp_replace(lower(strip_accents(translate(batter, 'aeo', 'áéö'))), '[^a-z0-9]', '', 'g') as player_key from pbp""")
def ent1(spark, sf):
    names = I.pbp(spark, sf).select(F.translate("batter", "aeo", "áéö").alias("name")).distinct()
    return names.select("name", N.person_key(F.col("name")).alias("player_key"))


@query("ent2_alias_keys", """
select batter_key as original, case when slot = 14 then replace(batter_key, 'n14', 'n13') else batter_key end as player_key, count(*) as events from pbp
group by batter_key, case when slot = 14 then replace(batter_key, 'n14', 'n13') else batter_key end""")
def ent2(spark, sf):
    rows = I.pbp(spark, sf)
    aliases = rows.where("slot = 14").select(F.col("batter_key").alias("alias")).distinct().withColumn("target", F.regexp_replace("alias", "n14$", "n13"))
    keyed = N.apply_aliases(rows.select(F.col("batter_key").alias("original"), F.col("batter_key").alias("player_key")), "player_key", aliases)
    return keyed.groupBy("original", "player_key").agg(F.count("*").alias("events"))


_NICKS = ("bandits", "blaze", "cascade", "spark", "talons", "volts")
_NAME = "concat('League ', upper(substr(nick, 1, 1)), substr(nick, 2))"
cte("named_teams", "select distinct season, batting_team as team, ['bandits','blaze','cascade','spark','talons','volts'][bat_no + 1] as nick from pbp")


@query("ent3_team_keys", f"""
select season, team, nick as team_key, case when season = 2025 then concat(upper(substr(nick, 1, 1)), substr(nick, 2))
  else concat(case nick when 'bandits' then 'Chicago' when 'blaze' then 'Carolina' when 'cascade' then 'Portland' when 'spark' then 'Oklahoma City' when 'talons' then 'Utah' else 'Texas' end,
    ' ', upper(substr(nick, 1, 1)), substr(nick, 2)) end as display from named_teams""")
def ent3(spark, sf):
    nick = F.element_at(F.array(*map(F.lit, _NICKS)), F.col("bat_no") + 1)
    rows = I.pbp(spark, sf).select("season", F.col("batting_team").alias("team"), nick.alias("nick")).distinct()
    named = rows.withColumn("name", F.concat(F.lit("League "), F.initcap("nick")))
    return named.select(
        "season", "team", N.team_key(F.col("name")).alias("team_key"), N.display_team(F.col("name"), F.col("season"), league_prefix="League").alias("display")
    )


# --- contests ----------------------------------------------------------------------------

def _schedule(spark, sf):
    rows = I.view(spark, sf, "fx_schedule")
    # every 40th row names an opponent nobody knows
    name = F.when(F.col("id") % 40 == 7, "League Unknown").otherwise(F.concat(F.lit("League "), F.col("opponent_name")))
    return rows.select(
        F.col("id").cast("string").alias("id"), "season", F.col("source_team").alias("source_team_id"), F.col("source_team").alias("source_team_name"),
        name.alias("opponent_name"), "home_away", F.date_format("start_ts", "yyyy-MM-dd").alias("start_ts"), "game_status", "score_team", "score_opponent",
    )


def _resolved(spark, sf):
    teams = I.pbp(spark, sf).select("season", F.col("batting_team").alias("team_id"), F.col("batting_team").alias("name")).distinct()
    return C.resolve_opponents(_schedule(spark, sf), teams, "league")


def _split(spark, sf):
    return C.split_same_time(_resolved(spark, sf).where("opponent_team_id is not null"))


cte("sched", """
select cast(id as varchar) as id, season, source_team, case when id % 40 = 7 then null else opponent_name end as opponent, home_away, strftime(start_ts, '%Y-%m-%d') as start_ts, game_status,
  score_team, score_opponent from fx_schedule""")
cte("keyed_rows", """
select *, concat('contest-', season, '-', substr(sha256(concat(season, '|', least(source_team, opponent), '+', greatest(source_team, opponent), '|', start_ts, '|')), 1, 16)) as base_id,
  case when home_away = 'home' then score_team else score_opponent end as hs, case when home_away = 'home' then score_opponent else score_team end as aws
from sched where opponent is not null""")
cte("split_rows", """
select k.*, concat('contest-', season, '-', substr(sha256(concat(season, '|', least(source_team, opponent), '+', greatest(source_team, opponent), '|', start_ts, '|',
  case when splits then (select string_agg(q.id, '+' order by q.id) from keyed_rows q where q.base_id = k.base_id and q.hs = k.hs and q.aws = k.aws) else '' end)), 1, 16)) as canonical_id
from keyed_rows k join (
  select a.base_id, count(*) > 2 and count(*) filter (where home_away = 'home') = count(*) filter (where home_away = 'away')
    and bool_and(home_away <> 'home' or (select count(*) from keyed_rows b where b.base_id = a.base_id and b.home_away = 'away' and b.hs = a.hs and b.aws = a.aws) = 1)
    and bool_and(home_away <> 'away' or (select count(*) from keyed_rows b where b.base_id = a.base_id and b.home_away = 'home' and b.hs = a.hs and b.aws = a.aws) = 1) as splits
  from keyed_rows a group by a.base_id) s using (base_id)""")
cte("contest_rows", """
select canonical_id, arg_min(season, pref) as season, string_agg(distinct source_team, '|' order by source_team) as owners,
  arg_min(start_ts, pref) as start_ts, arg_min(game_status, pref) as status, arg_min(id, pref) as preferred_source_game_id, string_agg(id, '|' order by id) as source_game_ids,
  array_to_string(list_filter([case when count(*) <> 2 then concat('source_row_count_', count(*)) end,
    case when count(distinct source_team) <> 2 then concat('source_owner_count_', count(distinct source_team)) end,
    case when count(*) = 2 and count(distinct home_away) <> 2 then 'home_away_mismatch' end,
    case when not bool_and(place = 1 or (score_team = fo and score_opponent = ft)) then 'score_mismatch' end], lambda x: x is not null), '|') as quality_flags
from (select *, case when home_away = 'home' then '0' else '1' end || source_team || '/' || id as pref, row_number() over w as place,
    first_value(score_team) over w as ft, first_value(score_opponent) over w as fo from split_rows window w as (partition by canonical_id order by source_team, id)) x group by canonical_id""")


@query("ent4_opponents", "select id, season, source_team as source_team_id, opponent as opponent_team_id from sched")
def ent4(spark, sf):
    return _resolved(spark, sf).select("id", "season", "source_team_id", "opponent_team_id")


@query("ent5_contest_keys", "select id, base_id from keyed_rows")
def ent5(spark, sf):
    rows = _resolved(spark, sf).where("opponent_team_id is not null")
    key = C.contest_key(F.col("season"), F.array("source_team_id", "opponent_team_id"), F.col("start_ts"), F.lit(""))
    return rows.select("id", key.alias("base_id"))


@query("ent6_same_time_split", "select id, base_id, canonical_id from split_rows")
def ent6(spark, sf):
    return _split(spark, sf).select("id", "base_id", "canonical_id")


@query("ent7_contests", """
select canonical_id, season, owners as team_names, start_ts, status, preferred_source_game_id, source_game_ids, quality_flags from contest_rows""")
def ent7(spark, sf):
    return C.contest_rows(_split(spark, sf)).select(
        "canonical_id", "season", "team_names", "start_ts", "status", "preferred_source_game_id", "source_game_ids", "quality_flags"
    )


@query("ent8_crosswalk", """
select canonical_id, season, source_team as source_team_id, source_team as source_team_name, id as source_game_id, home_away, game_status as status, start_ts from split_rows""")
def ent8(spark, sf):
    return C.crosswalk(_split(spark, sf))


@query("ent8_schedule_audit", """
select (select count(*) from sched) as source_schedule_rows, (select count(*) from sched where opponent is not null) as resolved_source_rows,
  (select count(*) from sched where opponent is null) as unresolved_source_rows, count(*) as canonical_contests, count(*) filter (where status = 'completed') as completed_canonical_contests,
  count(*) - count(distinct canonical_id) as duplicate_canonical_ids, count(*) filter (where quality_flags <> '') as contests_with_quality_flags from contest_rows""")
def ent8_audit(spark, sf):
    return C.schedule_audit(_resolved(spark, sf), C.contest_rows(_split(spark, sf)))


@query("ent8_flag_counts", "select flag, count(*) as contests from (select unnest(string_split(quality_flags, '|')) as flag from contest_rows where quality_flags <> '') x group by flag")
def ent8_flags(spark, sf):
    return C.flag_counts(C.contest_rows(_split(spark, sf)))


cte("match_games", """
select canonical_id, concat(least(home_team, away_team), '-', greatest(home_team, away_team)) as pair, start_ts, least(home_runs, away_runs) as lo, greatest(home_runs, away_runs) as hi from fx_games""")
cte("match_candidates", """
select c.canonical_id, o.game_id, abs(epoch_ms(c.start_ts) - epoch_ms(o.game_ts)) as gap, c.lo = least(o.home_score, o.away_score) and c.hi = greatest(o.home_score, o.away_score) as exact
from match_games c join (select *, concat(least(home_team, away_team), '-', greatest(home_team, away_team)) as pair from fx_official where record_status = 'Completed') o
  on o.pair = c.pair and abs(cast(c.start_ts as date) - cast(o.game_ts as date)) <= 1""")


@query("ent9_official_matches", """
select g.canonical_id, case when exacts = 1 then exact_id when ties = 1 then near_id end as official_game_id,
  case when exacts = 1 then 'teams_date_score' when ties = 1 then 'teams_datetime_nearest_score_disagreement' end as match_method
from match_games g left join (
  select canonical_id, count(*) filter (where exact) as exacts, min(game_id) filter (where exact) as exact_id, count(*) filter (where gap = least_gap) as ties,
    min(game_id) filter (where gap = least_gap) as near_id
  from (select *, min(gap) over (partition by canonical_id) as least_gap from match_candidates) x group by canonical_id) m using (canonical_id)""")
def ent9(spark, sf):
    games = I.view(spark, sf, "fx_games").select(
        "canonical_id", F.array_sort(F.array("home_team", "away_team")).alias("teams"), "start_ts", F.array_sort(F.array("home_runs", "away_runs")).alias("scores")
    )
    official = C.completed_games(I.view(spark, sf, "fx_official")).select(
        "game_id", F.array_sort(F.array("home_team", "away_team")).alias("teams"), "game_ts", F.array_sort(F.array("home_score", "away_score")).alias("scores")
    )
    return C.match_official(games, official)


@query("ent11_identity_audit", """
select batter_key as player_key, string_agg(distinct batter, '|' order by batter) as names, string_agg(distinct batting_team, '|' order by batting_team) as teams,
  string_agg(distinct cast(season as varchar), '|' order by cast(season as varchar)) as seasons from pbp group by batter_key""")
def ent11(spark, sf):
    return C.identity_audit(I.pbp(spark, sf).select(F.col("batter_key").alias("player_key"), F.col("batter").alias("player"), F.col("batting_team").alias("team"), "season"))


@query("ent12_jersey_roster", """
select batting_team as team, lpad(cast(slot as varchar), 2, '0') as jersey, max(case when g % 2 = 0 then concat(batter, ' Jr') else batter end) as name from pbp
group by batting_team, slot""")
def ent12(spark, sf):
    info = F.concat(F.lit("#"), F.lpad(F.col("slot").cast("string"), 2, "0"), F.lit(" (SS)"))
    name = F.when(F.col("g") % 2 == 0, F.concat("batter", F.lit(" Jr"))).otherwise(F.col("batter"))
    return C.jersey_roster(I.pbp(spark, sf).select(F.col("batting_team").alias("team"), name.alias("name"), info.alias("info")))


@query("ent13_name_variants", """
select distinct concat('Mike ', replace(batter, ' ', ''), ' (RS-So)') as raw, concat('Mike ', replace(batter, ' ', '')) as stripped,
  concat('michael ', lower(replace(batter, ' ', ''))) as plain, concat('m', lower(replace(batter, ' ', ''))) as short from pbp""")
def ent13(spark, sf):
    raw = F.concat(F.lit("Mike "), F.replace("batter", F.lit(" "), F.lit("")), F.lit(" (RS-So)"))
    rows = I.pbp(spark, sf).select(raw.alias("raw")).distinct().withColumn("stripped", N.strip_class_year(F.col("raw")))
    return rows.withColumns({"plain": N.plain_name(F.col("stripped")), "short": N.initial_surname_key(F.col("stripped"))})


@query("ent15_expanded_names", """
select canonical_id, event_order, concat(batter, case event_type when 'stolen_base' then ' steals 2nd' when 'caught_stealing' then ' out at 2nd' else ' advances to 3rd' end) as text
from pbp where not is_plate_appearance""")
def ent15(spark, sf):
    events = I.pbp(spark, sf)
    alias = F.concat(F.lit("B. "), F.regexp_replace("batter", "^Batter ", ""))
    listed = events.select("canonical_id", F.struct(alias.alias("alias"), F.col("batter").alias("name")).alias("a")).distinct().groupBy("canonical_id").agg(F.collect_set("a").alias("aliases"))
    said = F.concat(alias, F.expr("case event_type when 'stolen_base' then ' stole second' when 'caught_stealing' then ' out at second' else ' advanced to third' end"))
    return events.where("not is_plate_appearance").withColumn("said", said).join(listed, "canonical_id").select(
        "canonical_id", "event_order", E.expand_names(F.col("said"), F.col("aliases")).alias("text")
    )


@query("ent16_official_contests", """
select concat('official-', season, '-', game_id) as canonical_id, season, game_id, game_ts, 'completed' as status,
  concat(least(home_team, away_team), '|', greatest(home_team, away_team)) as team_names, home_score, away_score from fx_official where record_status = 'Completed'""")
def ent16(spark, sf):
    games = C.completed_games(I.view(spark, sf, "fx_official"))
    sides = F.array(
        F.struct(F.col("home_team").alias("team"), F.lit(1).alias("competitor_id")), F.struct(F.col("away_team").alias("team"), F.lit(2).alias("competitor_id"))
    )
    rows = games.select("season", "game_id", "game_ts", F.lit(1).alias("home_team_id"), "home_score", "away_score", F.explode(sides).alias("c")).select("*", "c.*").drop("c")
    contests = C.official_contests(rows).join(games.select("game_id", "home_team", "away_team"), "game_id")
    return contests.withColumns({"home_score": F.element_at("score", F.col("home_team")), "away_score": F.element_at("score", F.col("away_team"))}).drop(
        "score", "home_team", "away_team"
    )


@query("ent17_schedule_summary", """
select season, source_team as source_team_id, count(*) as games, count(*) filter (where game_status = 'completed') as completed from sched group by season, source_team""")
def ent17(spark, sf):
    return C.schedule_summary(_schedule(spark, sf))


@query("ent18_dates_and_urls", """
select game_id, concat(month(game_ts), '/', day(game_ts)) as from_iso, concat(month(game_ts), '/', day(game_ts)) as from_text, concat('https://x.test/games/', game_id) as url from fx_official""")
def ent18(spark, sf):
    rows = I.view(spark, sf, "fx_official")
    return rows.select(
        "game_id", C.display_date(F.date_format("game_ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("from_iso"),
        C.display_date(F.date_format("game_ts", "MMMM d, yyyy")).alias("from_text"),
        C.clean_url(F.concat(F.lit(" https://x.test/games/"), F.col("game_id").cast("string"), F.lit("?tab=box"))).alias("url"),
    )


# --- pitcher attribution -----------------------------------------------------------------

def attribution(spark, sf):
    events = I.pbp(spark, sf).select(
        "canonical_id", "fielding_team", F.col("k").alias("display_row_index"), "event_order", "outs_before", "outs_after",
        F.lit("").alias("play_text"), F.expr(f"coalesce({_CHANGE}, '')").alias("pitch_text"),
        # every third earlier value is not known, so some plays have several possible pitchers
        F.when(F.col("event_id") % 3 != 0, F.col("pitcher")).alias("pitcher"),
    )
    box = I.box_pitching(spark, sf).select("canonical_id", "team", "player", F.bround(F.col("innings_decimal") * 3, 0).cast("int").alias("outs"), "list_ordinal")
    return A.attribute_pitchers(A.play_blocks(events, staffs(spark, sf)), box)


# The twin goes through the plays one by one: least cost to every state, least cost from there on, and the states of cheapest paths.
cte("stints", """
select b.canonical_id, b.fielding_team as team, k, cast(row_number() over (partition by b.canonical_id, b.fielding_team order by k) as int) as n, outs_after - outs_before as outs,
  case when k in (45, 50) then pitcher end as hint, case when event_id % 3 <> 0 then pitcher end as old, names, targets
from pbp b join (select canonical_id, fielding_team, list(pitcher order by list_ordinal) as names, list(outs order by list_ordinal) as targets from fx_box_pitching group by all) x
  on x.canonical_id = b.canonical_id and x.fielding_team = b.fielding_team""")
cte("stint_choices", """
select s.*, i, (case when hint <> names[i] then 2 else 0 end) + (case when old <> names[i] then 1 else 0 end) as price from stints s cross join lateral (select unnest(range(1, len(names) + 1)) as i) p""")
cte("stint_ahead", """
with recursive f as (
  select canonical_id, team, 0 as n, list_transform(any_value(targets), lambda t: 0) as used, 0 as last, 0 as cost from stints group by canonical_id, team
  union all
  select canonical_id, team, n + 1, next_used, i, min(cost) from (
    select f.canonical_id, f.team, f.n, c.i, f.cost + c.price + case when f.last in (0, c.i) then 0 else 10 end as cost,
      list_transform(f.used, lambda u, j: case when j = c.i then u + c.outs else u end) as next_used, c.targets
    from f join stint_choices c on c.canonical_id = f.canonical_id and c.team = f.team and c.n = f.n + 1) x
  where next_used[i] <= targets[i] group by canonical_id, team, n, next_used, i)
select * from f""")
cte("stint_arcs", """
select f.canonical_id, f.team, f.n, f.used, f.last, f.cost, c.i, c.price + case when f.last in (0, c.i) then 0 else 10 end as price,
  list_transform(f.used, lambda u, j: case when j = c.i then u + c.outs else u end) as next_used from stint_ahead f join stint_choices c on c.canonical_id = f.canonical_id and c.team = f.team and c.n = f.n + 1""")
cte("stint_back", """
with recursive b as (
  select f.canonical_id, f.team, f.n, f.used, f.last, 0 as rest, cast(1 as hugeint) as ways from stint_ahead f
    join (select canonical_id, team, max(n) as n, any_value(targets) as targets from stints group by all) e on e.canonical_id = f.canonical_id and e.team = f.team and e.n = f.n and e.targets = f.used
  union all
  select canonical_id, team, n, used, last, any_value(least), sum(ways) from (
    select *, min(rest) over (partition by canonical_id, team, n, used, last) as least from (
      select a.canonical_id, a.team, a.n, a.used, a.last, a.price + b.rest as rest, b.ways
      from b join stint_arcs a on a.canonical_id = b.canonical_id and a.team = b.team and a.n = b.n - 1 and a.next_used = b.used and a.i = b.last) x) y
  where rest = least group by canonical_id, team, n, used, last)
select * from b""")
cte("stint_cheapest", """
select a.*, s.ways as all_ways from stint_arcs a join stint_back b on b.canonical_id = a.canonical_id and b.team = a.team and b.n = a.n + 1 and b.used = a.next_used and b.last = a.i
join stint_back s on s.canonical_id = a.canonical_id and s.team = a.team and s.n = 0 where a.cost + a.price + b.rest = s.rest""")
cte("stint_first", """
with recursive w as (
  select distinct canonical_id, team, 0 as n, list_transform(targets, lambda t: 0) as used, 0 as last from stints
  union all
  select canonical_id, team, n + 1, arg_min(next_used, i), min(i) from (
    select a.* from w join stint_cheapest a on a.canonical_id = w.canonical_id and a.team = w.team and a.n = w.n and a.used = w.used and a.last = w.last) x group by canonical_id, team, n)
select * from w where n > 0""")


@query("tto1_pitcher_attribution", """
select s.canonical_id, s.team, s.k as block, names[w.last] as pitcher, possible > 1 as ambiguous,
  case when possible > 1 then 'boxscore_constrained_tied' else 'boxscore_constrained_unique' end as method, cast(all_ways as varchar) as optimal_paths
from stints s join stint_first w on w.canonical_id = s.canonical_id and w.team = s.team and w.n = s.n
join (select canonical_id, team, n + 1 as n, count(distinct i) as possible, any_value(all_ways) as all_ways from stint_cheapest group by all) p
  on p.canonical_id = s.canonical_id and p.team = s.team and p.n = s.n""")
def tto1(spark, sf):
    return attribution(spark, sf)
