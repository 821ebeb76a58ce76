"""Tables bucketed by game, meetings counted without a shuffle of whole rows, and steps that are computed once."""

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from basepaths.functions import text as X
from basepaths.functions.lines import capped, game_sums
from basepaths.operators import exposure as E
from basepaths.operators import value as V
from basepaths.plans import inputs as I
from basepaths.sources import fixtures

START = datetime.datetime(2024, 1, 1)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def write_events(spark, path, n=700):
    rows = [(i, START + datetime.timedelta(minutes=i)) for i in range(n)] + [(5, None), (5, None), (70, START)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_stage_tables_know_where_a_game_is(spark, tmp_path):
    sf = write_events(spark, tmp_path)
    for table in (I.pbp, I.valued, I.plate_appearances):
        rows = table(spark, sf)
        window = Window.partitionBy("canonical_id", "inning").orderBy("event_order")
        assert "hashpartitioning" not in executed(rows.select("canonical_id", F.row_number().over(window)))
    assert I.pbp(spark, sf).count() == I.valued(spark, sf).count() == 703
    assert sorted(map(str, I.pbp(spark, sf).collect())) == sorted(map(str, fixtures.pbp(spark, sf).collect()))


def test_floors_are_those_of_the_sql(spark):
    rows = spark.sql("select explode(array(-65, -64, -63, -1, 0, 1, 63, 64, 65, 4294967295, 2147483647 * 60L, null)) as event_id")
    for by in ("64.0", "5.0", "6.0", "45.0"):
        exact, quick = f"floor(event_id / {by})", fixtures._in_doubles(f"floor(event_id / {by})")
        assert quick.endswith("D)") and rows.where(f"not (cast({exact} as long) <=> {quick})").isEmpty()


def test_the_searched_text_is_made_once_for_all_names(spark):
    names = ["", "Ann", "bo Ray"]
    cases = [("to pitcher Bo ray, Ann", names[1:]), ("to pitcher", names[1:]), ("to pitcher", names), ("walks", names), ("walks", names[1:]), (None, names), ("", []), ("to catcher Ann.", None)]
    rows = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t string, n array<string>")
    found = X.nearest_name(X.after_first_position(F.col("t")), F.col("n"))
    assert [r.f for r in rows.select("i", found.alias("f")).orderBy("i").collect()] == ["bo Ray", None, "", "", None, "", None, None]
    assert rows.select(found.alias("f"))._jdf.queryExecution().analyzed().toString().lower().count("regexp_extract(") == 1


def test_candidates_are_read_twice_not_four_times(spark, tmp_path):
    sf = write_events(spark, tmp_path)
    found = V.advancement_opportunities(V.advancement_candidates(I.valued(spark, sf), I.re24(spark, sf)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and found.count() > 0


def test_series_meetings_equal_those_of_one_window(spark):
    # a game that is listed twice, in two series and with two starts, missing keys, equal places in the order
    schedule = [("a", 1, "s", 0), ("b", 2, "s", 0), ("b", 2, "t", 5), ("c", 3, "s", None), ("d", 4, None, 2), ("e", 5, None, 3), ("f", 6, "s", 0)]
    schedule = [(g, i, s, None if h is None else START + datetime.timedelta(hours=h)) for g, i, s, h in schedule]
    series = spark.createDataFrame(schedule, "canonical_id string, game_id int, series_id string, game_ts timestamp").withColumn("series_game_number", F.lit(1))
    batters, pitchers = ("x", "x", "y", None), ("p", "q", None)
    rows = [
        (g, 2025, k // 2, batters[k % 4], pitchers[k % 3], "single" if k % 5 else "out", 0.5, True, 1)
        for g in ("a", "b", "c", "d", "e", "f", "z", None) for k in range(24)
    ]
    valued = spark.createDataFrame(
        rows, "canonical_id string, season int, event_order int, batter_key string, pitcher_key string, event_type string, run_value double, is_plate_appearance boolean, inning int"
    ).withColumns({c: F.lit(0) for c in ("runners_before", "runners_after", "runner_actions", "action_keys", "after_keys")})
    weights = spark.createDataFrame([("single", 1.0), ("out", -0.5)], "event_type string, linear_weight double")
    constants = spark.sql("select map('single', 1.0D) as raw_weights, 1.0D as woba_scale")
    found = E.derive_exposures(valued, series, weights, constants)
    start, place = F.col("game_start"), ["series_id", "game_start", "canonical_id", "batter_key", "pitcher_key", "event_order"]
    whole = Window.partitionBy("series_id", "batter_key", "pitcher_key").orderBy(start, "canonical_id", "event_order")
    again = found.withColumn("asked", F.row_number().over(whole))
    one, two = (again.groupBy(*place).agg(F.sort_array(F.collect_list(c)).alias("n")) for c in ("series_matchup_number", "asked"))
    assert found.count() == 7 * 24 and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    assert found.where("prior_series_game_matchups != series_matchup_number - same_game_matchup_number").isEmpty()


def test_payload_sums_equal_those_of_spread_rows(spark, tmp_path):
    pas = I.plate_appearances(spark, write_events(spark, tmp_path))
    entities = {"league": "everyone", "pitcher": "pitcher_key", "batter": "batter_key"}
    number = F.col("same_game_matchup_number")
    cuts = [("same_game", capped("same_game_matchup_number", 4)), ("prior_series", E.prior_band(1)), ("phase", F.when(number == 1, "first").otherwise("later"))]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in entities.items()])
    rows = E.with_periods(pas.withColumn("everyone", F.lit("league"))).select("*", F.inline(kinds))
    rows = rows.select("*", F.inline(F.array(*[F.struct(F.lit(c).alias("cut"), label.alias("label")) for c, label in cuts])))
    keys = ["kind", "key", "period", "cut", "label", "canonical_id"]
    asked = game_sums(rows, *keys[:-1])

    def told(df):
        return sorted(str([r[c] if not isinstance(r[c], float) else round(r[c], 6) + 0.0 for c in (*keys, *sorted(set(df.columns) - set(keys)))]) for r in df.collect())

    found = E.payload_sums(pas, entities)
    assert told(found) == told(asked) and sorted(found.dtypes) == sorted(asked.dtypes)
    assert executed(E.period_payload(pas, entities)).count("plate_appearances") == 0
