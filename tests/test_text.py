import pytest
from pyspark.sql import functions as F

from basepaths.functions import identity as N
from basepaths.functions import text as X


def column(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


def test_play_types(spark):
    texts = [
        "A grounds into a double play", "A reaches on dropped 3rd strike (passed ball)", "A homers to left", "A is intentionally walked", "A walks",
        "A sacrifices to pitcher", "A hits a sacrifice fly", "A grounds out", "A stares",
    ]
    assert column(spark, X.play_type(F.col("t")), *texts) == [
        "double_play", "dropped_third_reached", "home_run", "intentional_walk", "walk", "sacrifice_bunt", "sacrifice_fly", "out", "unknown",
    ]


def test_action_codes(spark):
    codes = ["HR", "FC 6 DP", "E5", "K ", "6-4-3 DP", "/", "6-3", ""]
    assert column(spark, X.official_play_type(F.col("t"), F.lit("")), *codes) == [
        "home_run", "fielders_choice", "reached_on_error", "out", "double_play", "unknown", "out", "unknown",
    ]


def test_innings(spark):
    assert column(spark, X.innings_to_decimal(F.col("t")), "6.2", "7", "0.1")[0] == pytest.approx(6 + 2 / 3)
    with pytest.raises(Exception, match="invalid innings"):
        column(spark, X.innings_to_decimal(F.col("t")), "6.3")


def pitch_list(spark, text, event):
    rows = spark.createDataFrame([(text, event)], "p string, e string")
    return rows.select(F.explode(X.pitches(F.col("p"), F.col("e"))).alias("x")).select("x.*").collect()


def test_compact_pitches(spark):
    rows = pitch_list(spark, "BB", "single")
    assert [r["count"] for r in rows] == ["0-0", "1-0", "2-0"]
    assert rows[-1].action == "X" and rows[-1].swing
    assert pitch_list(spark, "KKBFS", "strikeout")[-1]["count"] == "1-2"
    assert not pitch_list(spark, "", "hit_by_pitch")[-1].swing
    assert pitch_list(spark, "", "walk") == []


def test_phrase_pitches(spark):
    rows = pitch_list(spark, "Ball 1, Strike 1 looking, Foul, Foul, Strike 3 swinging.", "strikeout")
    assert [r["count"] for r in rows] == ["0-0", "1-0", "1-1", "1-2", "1-2"]
    assert [r.swing for r in rows] == [False, False, True, True, True]
    assert [r.called for r in rows] == [False, True, False, False, False]


def test_spray(spark):
    texts = [
        "A singles on a line drive to left fielder B", "A doubles up the middle", "A grounds out, shortstop B to first baseman C", "A flies out to left center",
        "A bunts, pitcher B throws to first base", "A strikes out",
    ]
    assert column(spark, X.spray_location(F.col("t")), *texts) == ["Left Field", "Center Field", "Shortstop", "Left Field", "Pitcher", None]
    short = ["A singles to lf.", "A grounds out, ss to 1b.", "A flies out to cf", "A lines out to 3b", "A doubles, relay throw to 2b, rf to c", "A bunts, p to 1b",
             "A reaches on error by 2b", "A singles through the middle", "A pops out to c"]
    assert column(spark, X.spray_location(F.col("t")), *short) == [
        "Left Field", "Shortstop", "Center Field", "Third Base", "Right Field", "Pitcher", "Second Base", "Center Field", "Catcher"
    ]


def test_fielder(spark):
    rows = spark.createDataFrame([("A grounds out to shortstop Dee Hall, first baseman Ann Lee", ["Ann Lee", "Dee Hall"])], "t string, n array<string>")
    out = rows.select(
        X.first_position(F.col("t")).alias("p"), X.nearest_name(X.after_first_position(F.col("t")), F.col("n")).alias("f"), X.position_mentions(F.col("t")).alias("m")
    ).first()
    assert tuple(out) == ("shortstop", "Dee Hall", 2)


def test_person_keys(spark):
    names = ["José Ñúñez-O'Neil", "Åsa Öberg", "ﬁn", None]
    assert column(spark, N.person_key(F.col("t")), *names) == ["josenunezoneil", "asaoberg", "fin", ""]
    assert column(spark, N.canonical_key(F.col("t")), "Ali Aguliar", "Ann Lee") == ["aliaguilar", "annlee"]


def test_team_keys(spark):
    assert column(spark, N.team_key(F.col("t"), league_prefix="xyz"), "XYZ Talons", "XYZ Others") == ["talons", "others"]
    assert column(spark, N.strip_class_year(F.col("t")), "Ann Lee (RS-Fr)", "Ann Lee Jr") == ["Ann Lee", "Ann Lee Jr"]
    assert column(spark, N.initial_surname_key(F.col("t")), "Sam Hall", "") == ["shall", None]
