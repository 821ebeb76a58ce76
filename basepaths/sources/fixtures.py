"""Play-by-play views derived from the driver table ``events``.

Every view is a projection or a grouping of the whole table; the expressions are plain SQL
that Spark and DuckDB both accept, so the checks in ``plans`` can use the same views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PBP_GAME = "cast(floor(event_id / 64.0) as int)"
PBP_CONTEST = "concat('g', lpad(cast(g as varchar(10)), 6, '0'))"

PBP_LAYERS: list[list[tuple[str, str]]] = [
    [
        ("event_id", "event_id"),
        ("ts", "ts"),
        ("g", PBP_GAME),
        ("k", "cast(event_id % 64 as int)"),
        ("r", "cast((event_id * 7919 + 13) % 100 as int)"),
        ("f", "cast((event_id * 13) % 9 as int)"),
        ("t", "cast((event_id * 17) % 4 as int)"),
    ],
    [
        ("h", "cast(floor(k / 5.0) as int)"),
        ("p", "cast(k % 5 as int)"),
        ("home_no", "cast(g % 6 as int)"),
        ("away_no", "cast((g + 1 + cast(floor(g / 6.0) as int) % 5) % 6 as int)"),
    ],
    [
        ("bat_no", "case when h % 2 = 0 then away_no else home_no end"),
        ("fld_no", "case when h % 2 = 0 then home_no else away_no end"),
        ("slot", "cast(((cast(floor(k / 10.0) as int) * 5 + p) % 9 + g) % 15 as int)"),
        ("pslot", "cast((cast(floor(k / 45.0) as int) + g) % 5 as int)"),
        ("outs_before", "case when p = 0 then 0 when p < 4 then cast(floor(p / 2.0) as int) else 2 end"),
        ("outs_after", "case when p = 4 then 3 when p = 3 then 2 else cast(floor((p + 1) / 2.0) as int) end"),
        ("bases_before", "case when p = 0 then 0 else cast((event_id * 31) % 8 as int) end"),
        ("bases_after", "case when p = 4 then 0 else cast(((event_id + 1) * 31) % 8 as int) end"),
        (
            "event_type",
            "case when r < 16 then 'single' when r < 21 then 'double' when r < 22 then 'triple' "
            "when r < 26 then 'home_run' when r < 34 then 'walk' when r < 35 then 'intentional_walk' "
            "when r < 38 then 'hit_by_pitch' when r < 52 then 'strikeout' when r < 53 then 'dropped_third_reached' "
            "when r < 55 then 'reached_on_error' when r < 57 then 'fielders_choice' when r < 59 then 'double_play' "
            "when r < 61 then 'sacrifice_fly' when r < 63 then 'sacrifice_bunt' when r < 90 then 'out' "
            "when r < 91 then 'infield_fly' when r < 92 then 'dropped_third_out' when r < 93 then 'catcher_interference' "
            "when r < 97 then 'stolen_base' when r < 99 then 'caught_stealing' else 'wild_pitch' end",
        ),
        (
            "position",
            "case f when 0 then 'pitcher' when 1 then 'catcher' when 2 then 'first baseman' when 3 then 'second baseman' "
            "when 4 then 'third baseman' when 5 then 'shortstop' when 6 then 'left fielder' when 7 then 'center fielder' "
            "else 'right fielder' end",
        ),
        (
            "pitch_text",
            "case cast((event_id * 29) % 7 as int) when 0 then 'B' when 1 then 'KB' when 2 then 'BBS' when 3 then 'FFB' "
            "when 4 then 'KKBF' when 5 then 'BBB' else '' end",
        ),
    ],
    [
        ("canonical_id", PBP_CONTEST),
        ("season", "cast(2025 + cast(floor(g / 6.0) as int) % 2 as int)"),
        ("inning", "cast(cast(floor(h / 2.0) as int) + 1 as int)"),
        ("half", "case when h % 2 = 0 then 'top' else 'bottom' end"),
        ("event_order", "cast(k + 1 as int)"),
        ("is_plate_appearance", "r < 93"),
        ("batting_team", "concat('team_', cast(bat_no as varchar(10)))"),
        ("fielding_team", "concat('team_', cast(fld_no as varchar(10)))"),
        ("batter", "concat('Batter T', cast(bat_no as varchar(10)), ' N', lpad(cast(slot as varchar(10)), 2, '0'))"),
        ("pitcher", "concat('Pitcher T', cast(fld_no as varchar(10)), ' N', lpad(cast(pslot as varchar(10)), 2, '0'))"),
        ("fielder", "concat('Fielder T', cast(fld_no as varchar(10)), ' N', lpad(cast(f as varchar(10)), 2, '0'))"),
        (
            "runs_scored",
            "cast(case when r >= 22 and r < 26 then 1 + (bases_before % 2) + (cast(floor(bases_before / 2.0) as int) % 2) "
            "+ cast(floor(bases_before / 4.0) as int) when event_id % 9 = 0 then 1 else 0 end as int)",
        ),
    ],
    [
        ("batter_key", "replace(replace(lower(batter), ' ', ''), '_', '')"),
        ("pitcher_key", "replace(replace(lower(pitcher), ' ', ''), '_', '')"),
        (
            "play_text",
            "concat(batter, case event_type when 'single' then ' singles' when 'double' then ' doubles' "
            "when 'triple' then ' triples' when 'home_run' then ' homers' when 'walk' then ' walks' "
            "when 'intentional_walk' then ' is intentionally walked' when 'hit_by_pitch' then ' is hit by pitch' "
            "when 'strikeout' then ' strikes out swinging' when 'dropped_third_reached' then ' reaches on dropped 3rd strike' "
            "when 'reached_on_error' then ' reaches on an error' when 'fielders_choice' then ' grounds into fielder''s choice' "
            "when 'double_play' then ' grounds into a double play' when 'sacrifice_fly' then ' hits a sacrifice fly' "
            "when 'sacrifice_bunt' then ' sacrifices' when 'infield_fly' then ' hits an infield fly' "
            "when 'dropped_third_out' then ' is out at first on dropped 3rd strike' "
            "when 'catcher_interference' then ' reaches on catcher''s interference' "
            "when 'out' then (case t when 0 then ' grounds out' when 1 then ' lines out' when 2 then ' flies out' else ' pops out' end) "
            "else '' end, case when event_type in ('single','double','triple','home_run') then "
            "(case t when 0 then ' on a ground ball' when 1 then ' on a line drive' when 2 then ' on a fly ball' else ' on a pop fly' end) "
            "else '' end, case when event_type in ('single','double','triple','home_run','reached_on_error','fielders_choice',"
            "'double_play','sacrifice_fly','sacrifice_bunt','infield_fly','out') then concat(' to ', position, ' ', fielder) else '' end, '.')",
        ),
    ],
]

# One struct per occupied base; the runner's draw decides how the play text would have told
# about the runner: an explicit action, a forced move, or nothing (position after decides).
RUNNER_COLUMNS = {
    "runner": "concat('Batter T', cast(bat_no as varchar(10)), ' N', lpad(cast((slot + 15 - b) % 15 as varchar(10)), 2, '0'))",
    "action": "case cast((event_id + b) % 5 as int) when 0 then 'score' when 1 then 'out' when 4 then 'remain' "
    "else (case when event_id % 7 = 0 then 'forced' else 'advance' end) end",
    "to_base": "cast(case cast((event_id + b) % 5 as int) when 0 then 4 when 1 then null when 4 then b else least(3, b + 1) end as int)",
    "seen_after": "cast((event_id + b) % 5 as int) = 4 and event_id % 11 <> 0",
}

VIEWS: dict[str, str] = {
    "fx_games": (
        "select canonical_id, g, season, home_no, away_no, concat('team_', cast(home_no as varchar(10))) as home_team, "
        "concat('team_', cast(away_no as varchar(10))) as away_team, min(ts) as start_ts, "
        "cast(sum(case when bat_no = home_no then runs_scored else 0 end) as int) as home_runs, "
        "cast(sum(case when bat_no = away_no then runs_scored else 0 end) as int) as away_runs "
        "from pbp group by canonical_id, g, season, home_no, away_no"
    ),
    "fx_schedule": (
        "select 2 * g + 0 as id, season, home_team as source_team, away_team as opponent_name, 'home' as home_away, "
        "date_trunc('day', start_ts) as start_ts, home_runs as score_team, away_runs as score_opponent, "
        "'completed' as game_status from fx_games union all "
        "select 2 * g + 1 as id, season, away_team as source_team, home_team as opponent_name, 'away' as home_away, "
        "date_trunc('day', start_ts) as start_ts, away_runs as score_team, home_runs as score_opponent, "
        "'completed' as game_status from fx_games"
    ),
    "fx_box_pitching": (
        "select canonical_id, season, fielding_team, pitcher, pitcher_key, "
        "cast(sum(outs_after - outs_before) as int) as outs, "
        "cast(sum(case when event_type in ('single','double','triple','home_run') then 1 else 0 end) as int) as h, "
        "cast(sum(runs_scored) as int) as r, cast(sum(runs_scored) - sum(runs_scored) % 3 as int) as er, "
        "cast(sum(case when event_type in ('walk','intentional_walk') then 1 else 0 end) as int) as bb, "
        "cast(sum(case when event_type in ('strikeout','dropped_third_out','dropped_third_reached') then 1 else 0 end) as int) as so, "
        "cast(sum(case when event_type = 'home_run' then 1 else 0 end) as int) as hr, "
        "cast(sum(case when is_plate_appearance then 1 else 0 end) as int) as bf, min(event_order) as list_ordinal "
        "from pbp group by canonical_id, season, fielding_team, pitcher, pitcher_key"
    ),
    "fx_catchers": (
        "select season, fielding_team as team, concat('Fielder T', cast(fld_no as varchar(10)), ' N', "
        "lpad(cast(g % 3 as varchar(10)), 2, '0')) as catcher, "
        "cast(sum(case when event_type = 'stolen_base' then 1 else 0 end) as int) as sb, "
        "cast(sum(case when event_type = 'caught_stealing' then 1 else 0 end) as int) as cs "
        "from pbp group by season, fielding_team, fld_no, g % 3"
    ),
    "fx_box_hitting": (
        "select canonical_id, season, batting_team, batter, batter_key, case slot % 9 when 0 then 'C' when 1 then '1B' "
        "when 2 then '2B' when 3 then '3B' when 4 then 'SS' when 5 then 'LF' when 6 then 'CF' when 7 then 'RF' "
        "else (case when g % 2 = 0 then 'DH' else '1B, LF' end) end as position, cast(slot % 2 as int) as r, "
        "cast(sum(case when event_type in ('single','double','triple','home_run') then 1 else 0 end) as int) as h, "
        "cast(sum(case when is_plate_appearance then 1 else 0 end) as int) as pa, min(event_order) as list_ordinal "
        "from pbp group by canonical_id, season, batting_team, batter, batter_key, slot, g"
    ),
    # the official feed: one row per play with short names, substitutions before plays, and a row that is no play
    "fx_feed": (
        "select canonical_id, season, 2 * k + 1 as play_seqno, inning, half = 'top' as is_top, batting_team, fielding_team, outs_before as outs, "
        "cast(sum(runs_scored) over (partition by canonical_id, batting_team order by k) as int) as team_score, "
        "case when is_plate_appearance then bat_no * 100 + slot end as batter_id, case when is_plate_appearance then fld_no * 100 + 50 + pslot end as pitcher_id, "
        "case event_type when 'home_run' then 'HR' when 'triple' then '3B' when 'double' then '2B' when 'single' then concat('1B ', cast(f + 1 as varchar(10))) "
        "when 'intentional_walk' then 'IBB' when 'walk' then 'BB' when 'hit_by_pitch' then 'HBP' when 'sacrifice_fly' then 'SF 7' when 'sacrifice_bunt' then 'SAC' "
        "when 'catcher_interference' then 'CI' when 'fielders_choice' then 'FC 6' when 'reached_on_error' then 'E5' when 'strikeout' then 'KS' "
        "when 'dropped_third_out' then 'KS' when 'double_play' then '6-4-3 DP' when 'out' then concat(cast(f + 1 as varchar(10)), '-3') else '' end as action, "
        "case event_type when 'stolen_base' then concat(one, ' stole second.') when 'caught_stealing' then concat(one, ' caught stealing second.') "
        "when 'wild_pitch' then concat(one, ' advanced to third on a wild pitch.') else concat("
        "replace(replace(substring(play_text, 1, length(play_text) - 1), 'Batter T', 'B T'), 'Fielder T', 'F T'), "
        "case when pitch_text = '' then ' (1-1)' else concat(' (1-1 ', pitch_text, ')') end, "
        "case cast(event_id % 6 as int) when 0 then concat(', ', one, ' scored') when 1 then concat(', ', one, ' advanced to third') "
        "when 2 then concat(', ', one, ' out at second') when 3 then concat(', ', one, ' advanced to second') else '' end, "
        "case when event_id % 10 = 3 then concat(', ', two, ' scored') else '' end, '.') end as narrative "
        "from (select *, concat('B T', cast(bat_no as varchar(10)), ' N', lpad(cast((slot + 14) % 15 as varchar(10)), 2, '0')) as one, "
        "concat('B T', cast(bat_no as varchar(10)), ' N', lpad(cast((slot + 13) % 15 as varchar(10)), 2, '0')) as two from pbp) a union all "
        "select canonical_id, season, 2 * k, inning, half = 'top', batting_team, fielding_team, outs_before, "
        "score - runs_scored, null, null, '/', "
        "concat('F T', cast(fld_no as varchar(10)), ' N', lpad(cast((f + 1) % 9 as varchar(10)), 2, '0'), ' to ', "
        "case f when 0 then 'p' when 1 then 'c' when 2 then '1b' when 3 then '2b' when 4 then '3b' when 5 then 'ss' when 6 then 'lf' when 7 then 'cf' else 'rf' end, '.') "
        "from (select *, cast(sum(runs_scored) over (partition by canonical_id, batting_team order by k) as int) as score from pbp) b where event_id % 17 = 0 union all "
        "select canonical_id, season, -1, 1, true, batting_team, fielding_team, 0, 0, null, null, '', 'Game starts.' from pbp where k = 0"
    ),
    "fx_people": (
        "select distinct canonical_id, bat_no * 100 + (slot + 15 - n) % 15 as person_id, "
        "concat('Batter T', cast(bat_no as varchar(10)), ' N', lpad(cast((slot + 15 - n) % 15 as varchar(10)), 2, '0')) as player, cast(null as varchar(10)) as stat_name, "
        "batting_team as team from (select *, 0 as n from pbp union all select *, 1 as n from pbp union all select *, 2 as n from pbp) a union "
        "select distinct canonical_id, fld_no * 100 + 50 + pslot, pitcher, concat(substring(pitcher, 9, 6), ', Pitcher'), fielding_team from pbp union "
        "select distinct canonical_id, fld_no * 100 + 70 + (f + n) % 9, concat('Fielder T', cast(fld_no as varchar(10)), ' N', lpad(cast((f + n) % 9 as varchar(10)), 2, '0')), "
        "null, fielding_team from (select *, 0 as n from pbp union all select *, 1 as n from pbp) b"
    ),
    "fx_official": (
        "select g as game_id, case when season = 2025 then 270 else 369 end as season_id, season, "
        "start_ts + cast(g % 3 as int) * interval '1' hour as game_ts, home_team, away_team, "
        "case when g % 10 = 0 then home_runs + 1 else home_runs end as home_score, away_runs as away_score, "
        "home_team as venue, case when g % 20 = 0 then g % 4 + 1 else null end as series_no, "
        "case when g % 20 = 0 then 'PS' else 'RS' end as game_type, "
        "case when g % 97 = 96 then 'Scheduled' else 'Completed' end as record_status from fx_games"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``events`` table as play-by-play rows; only two columns are read."""
    return _layered(table(spark, sf_dir, "events").select("event_id", "ts"))


def pbp_by_game(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    """The same rows with games kept together; they are dealt out before the other columns are made, as two columns."""
    contest = F.expr(PBP_CONTEST.replace("cast(g ", f"cast({_in_doubles(PBP_GAME)} "))
    return _layered(table(spark, sf_dir, "events").select("event_id", "ts").repartition(tasks, contest))


def _layered(df: DataFrame) -> DataFrame:
    for depth, layer in enumerate(PBP_LAYERS):
        keep = [] if depth == 0 else ["*"]
        df = df.selectExpr(*keep, *[f"{_in_doubles(expr)} as {name}" for name, expr in layer])
    return df


def _in_doubles(expr: str) -> str:
    """The same floors: Spark reads ``5.0`` as a decimal and divides those digit by digit."""
    return re.sub(r"/ (\d+\.0)\b", r"/ \1D", expr)


def view(spark: SparkSession, name: str, base: DataFrame) -> DataFrame:
    """A derived view over ``base`` (the events, or the games for views built on them)."""
    sql = VIEWS[name]
    source = "fx_games" if "from fx_games" in sql else "pbp"
    return spark.sql(sql.replace(f"from {source}", "from {base}"), base=base)


def runner_structs() -> str:
    """Array of the occupied bases with the drawn runner, action and destination."""
    occupied = "(case b when 1 then bases_before % 2 when 2 then cast(floor(bases_before / 2.0) as int) % 2 else cast(floor(bases_before / 4.0) as int) end) = 1"
    fields = ", ".join(f"'{name}', {expr}" for name, expr in RUNNER_COLUMNS.items())
    return f"transform(filter(sequence(1, 3), b -> {occupied}), b -> named_struct('start_base', b, {fields}))"


BATTER_BASE = "case event_type when 'double' then 2 else 1 end"


def with_state(events: DataFrame) -> DataFrame:
    """Events plus runners_before, runners_after and runner_actions in the event schema."""
    df = events.selectExpr("*", f"{_in_doubles(runner_structs())} as _runners")
    batter_seen = (
        "event_type in ('single', 'double', 'reached_on_error') and event_id % 6 <> 2 and event_id % 3 <> 0 "
        f"and not exists(_runners, x -> x.seen_after and x.start_base = ({BATTER_BASE}))"
    )
    return df.selectExpr(
        "*",
        "map_from_entries(transform(_runners, x -> struct(x.start_base, x.runner))) as runners_before",
        "map_from_entries(concat(transform(filter(_runners, x -> x.seen_after), x -> named_struct('b', x.start_base, 'n', x.runner)), "
        f"case when {batter_seen} then array(named_struct('b', {BATTER_BASE}, 'n', batter)) else array() end)) as runners_after",
        "concat(transform(filter(_runners, x -> x.action <> 'remain'), x -> named_struct('runner', x.runner, 'action', x.action, "
        "'from_base', x.start_base, 'to_base', x.to_base, 'reason', cast(null as string))), "
        "case when event_type in ('single', 'double', 'reached_on_error') and event_id % 3 = 0 then array(named_struct("
        f"'runner', batter, 'action', 'advance', 'from_base', 0, 'to_base', cast({BATTER_BASE} as int), 'reason', cast(null as string))) "
        "else array() end) as runner_actions",
    ).drop("_runners")
