from basepaths import schema as S
from basepaths.operators import events as E
from basepaths.operators import feed as D

PLAYS = (
    "canonical_id string, season int, play_seqno int, inning int, is_top boolean, batting_team string, fielding_team string, outs int, team_score int, "
    "batter_id int, pitcher_id int, action string, narrative string"
)
PEOPLE = [
    (1, "Ann Lee", None, "away"), (2, "Bea Kim", "Kim, Beatrice", "away"), (3, "Cat Fox", None, "away"), (4, "Dee Van Hall", None, "away"),
    (9, "Pia Ace", None, "home"), (10, "Sue Short", None, "home"), (11, "Lou Left", None, "home"),
]
STARTERS = [("shortstop", "Sue Short"), ("left fielder", "Lou Left")]


def fold(spark, *plays, inning=1):
    """plays: (outs, score, batter id, action, narrative), one half-inning of the away team unless a dict says otherwise."""
    rows = []
    for n, p in enumerate(plays):
        row = dict(zip(("outs", "team_score", "batter_id", "action", "narrative"), p)) if isinstance(p, tuple) else p
        row = {"canonical_id": "g", "season": 2025, "play_seqno": n, "inning": inning, "is_top": True, "batting_team": "away", "fielding_team": "home"} | row
        row.setdefault("pitcher_id", 9 if row.get("batter_id") else None)
        rows.append(tuple(row.get(c.split()[0]) for c in PLAYS.split(", ")))
    feed = spark.createDataFrame(rows, PLAYS).repartition(3)
    people = spark.createDataFrame([("g", *p) for p in PEOPLE], "canonical_id string, person_id int, player string, stat_name string, team string")
    starters = spark.createDataFrame([("g", "home", *s) for s in STARTERS], "canonical_id string, team string, position string, player string")
    events = D.feed_events(feed, people, starters)
    assert events.columns[: len(S.EVENTS.names)] == S.EVENTS.names
    assert [str(f.dataType) for f in events.schema][: len(S.EVENTS.names)] == [str(f.dataType) for f in S.EVENTS]
    return events.orderBy("event_order").collect()


def test_short_names_and_phrases_become_clauses(spark):
    out = fold(spark, (0, 0, 1, "1B 7", "A Lee singled to left field, LF (1-1 BK)."), (0, 1, 2, "2B", "Beatrice Kim doubled, A Lee scored."),
               (0, 1, 4, "6-3", "D Van Hall grounds out, B Kim advanced to third."))
    assert out[1].play_text == "Bea Kim doubled, Ann Lee scores."
    assert [e.runners_after for e in out] == [{1: "Ann Lee"}, {2: "Bea Kim"}, {3: "Bea Kim"}]
    assert [e.runs_scored for e in out] == [0, 1, 0] and out[0].pitch_text == "BK" and out[0].pitcher == "Pia Ace"
    assert [e.event_type for e in out] == ["single", "double", "out"]


def test_outs_and_runs_come_from_the_feed(spark):
    out = fold(spark, (1, 0, 1, "HR", "A Lee homered."), (2, 3, 3, "KS", "C Fox strikes out."), (1, 2, 2, "6-3", "B Kim grounds out."))
    assert [(e.outs_before, e.outs_after) for e in out] == [(1, 1), (2, 3), (1, 2)]
    assert [e.runs_scored for e in out] == [0, 3, 0]  # a score that falls counts for nothing


def test_runner_plays_and_rows_that_are_no_events(spark):
    out = fold(
        spark, {"play_seqno": -1, "narrative": "A Lee steals home"}, (0, 0, 1, "BB", "A Lee walks."), (0, 0, None, None, "A Lee advanced to third on a passed ball."),
        (0, 0, None, "/", "Mound visit."), (0, 0, None, None, "A Lee caught stealing home."), (1, 0, None, None, None),
    )
    assert [(e.event_type, e.is_plate_appearance, e.outs_after) for e in out] == [("walk", True, 0), ("passed_ball", False, 0), ("caught_stealing", False, 1)]
    assert out[1].runners_after == {3: "Ann Lee"} and out[2].runners_after == {} and out[1].batter is None


def test_fielders_follow_the_substitutions(spark):
    out = fold(
        spark, (0, 0, 1, "6-3", "A Lee grounds out."), (1, 0, None, "/", "Lou Left to ss for Sue Short."), (1, 0, 2, "6-3", "B Kim grounds out."),
        (2, 0, 3, "F7", "C Fox flies out."),
    )
    assert [e.play_text.partition(" Fielded by ")[2] for e in out] == ["shortstop Sue Short.", "shortstop Lou Left.", ""]


def test_halves_start_empty_and_extra_innings_with_a_runner(spark):
    other = {"inning": 8, "is_top": False, "batting_team": "home", "fielding_team": "away", "outs": 0, "team_score": 0, "batter_id": 10, "pitcher_id": 3, "action": "BB", "narrative": "S Short walks."}
    out = fold(spark, (0, 0, 1, "1B", "A Lee singled."), other, inning=8)
    assert [e.runners_before for e in out] == [{2: S.PLACED_RUNNER}, {2: S.PLACED_RUNNER}]
    assert out[0].runners_after == {1: "Ann Lee"} and [e.half for e in out] == ["top", "bottom"]


def test_unknown_players_and_audit(spark):
    out = fold(spark, (0, None, 77, "1B", "Somebody singled."), (0, 2, 1, "", "A Lee"))
    assert [(e.batter, e.event_type) for e in out] == [(None, "single"), ("Ann Lee", "unknown")]
    events = spark.createDataFrame([("g", True, 2, 0), ("g", False, 0, 1)], "canonical_id string, is_plate_appearance boolean, runs_scored int, state_errors int")
    audit = D.feed_audit(events, spark.createDataFrame([("g", 2025, 3), ("h", 2025, 0)], "canonical_id string, season int, expected_runs long")).orderBy("canonical_id").collect()
    assert [(a.events, a.plate_appearances, a.observed_runs, a.run_difference, a.state_invariant_error_count) for a in audit] == [(2, 1, 2, -1, 1), (0, 0, 0, 0, 0)]


def test_a_replaced_player_leaves_nothing_empty(spark):
    schema = "canonical_id string, team string, position string, player string"
    starters = spark.createDataFrame([("g", "t", "P", "A"), ("g", "t", "C", "B")], schema)
    moves = spark.createDataFrame([("g", "t", "P", "B", 3), ("g", "t", "1B", "A", 5)], schema + ", seq int")
    plays = spark.createDataFrame([("g", "t", p, 9) for p in ("P", "C", "1B")], "canonical_id string, team string, position string, seq int")
    assert {r.position: r.player for r in E.active_lineup(starters, moves, plays).collect()} == {"P": "B", "C": None, "1B": "A"}


def test_games_are_dealt_out_once_and_people_may_repeat(spark):
    plays = spark.createDataFrame(
        [(g, 2025, n, 1, True, "away", "home", 0, 0, b, 9, "BB", "A Lee walks.") for g in ("g", "h", None) for n, b in enumerate((1, 2, 7))], PLAYS
    )
    people = [("g", None, "Nobody", None, "away"), ("g", 1, "Ann Lee", None, "away"), ("g", 1, "Ann Lea", None, "home"), ("g", 9, "Pia Ace", None, "home"), (None, 1, "X", None, "away")]
    read = D.read_feed(plays, spark.createDataFrame(people, "canonical_id string, person_id long, player string, stat_name string, team string"), 3)
    assert "Exchange" not in read.groupBy("canonical_id", "half_index").count()._jdf.queryExecution().executedPlan().toString()
    got = {(r.canonical_id, r.play_seqno): (r.batter, r.pitcher) for r in read.collect()}
    assert got == {(g, n): (("Ann Lee", None, None)[n], "Pia Ace") if g == "g" else (None, None) for g in ("g", "h", None) for n in range(3)}
