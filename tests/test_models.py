import numpy as np
import pytest
from pyspark.sql import functions as F

from basepaths.functions.lines import game_sums, slash_line, stat_fields
from basepaths.functions.ranking import ordered_number
from basepaths.operators import contests as C
from basepaths.operators import pitching as P
from basepaths.operators import positional as O
from basepaths.operators import regression as R
from basepaths.operators import value as V
from basepaths.plans import inputs as I


def test_ordered_number_with_a_dominant_tie(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 97).alias("v"), "id"
    )
    got = {(r.k, r.id): r.n for r in ordered_number(rows, ["k"], [F.col("v").desc(), F.col("id").asc()], "n", 7).collect()}
    want, counts = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, -r.v, r.id)):
        counts[r.k] = counts.get(r.k, 0) + 1
        want[(r.k, r.id)] = counts[r.k]
    assert got == want


def test_slash_line(spark):
    pas = spark.createDataFrame([("g1", "home_run", 1.0), ("g2", "out", -0.5)], "canonical_id string, event_type string, run_value double")
    pas = pas.withColumns(stat_fields()).withColumn("wOBA_num_value", F.when(F.col("event_type") == "home_run", 2.0).otherwise(0.0)).withColumn("k", F.lit(1))
    row = slash_line(game_sums(pas, "k"), "k").first()
    assert (row.AVG, row.SLG, row.OPS, row.RV_per_PA) == (0.5, 2.0, 2.5, 0.25)
    # influences of the two games are +1 and -1: variance 2/1 * 2 / 4
    assert row.wOBA_95_high - row.wOBA == pytest.approx(1.96)


def test_fip_is_centered(spark):
    pitching = spark.createDataFrame([(2026, "a", 10.0, 4), (2026, "b", 5.0, 5)], "season int, player_key string, IP double, ER int")
    kinds = ["home_run", "walk", "strikeout", "out", "hit_by_pitch"]
    pas = spark.createDataFrame([(2026, "ab"[i % 2], k, True) for i, k in enumerate(kinds)], "season int, pitcher_key string, event_type string, is_plate_appearance boolean")
    rows = P.add_fip(pitching, pas).collect()
    assert sum(r.FIP * r.IP for r in rows) / 15 == pytest.approx(9 / 15 * 7)


def test_catchers_balance(spark):
    catching = spark.createDataFrame([(2026, "a", "A", 5, 1), (2026, "b", "B", 1, 3)], "season int, player_key string, player string, sb int, cs int")
    valued = spark.createDataFrame([("stolen_base", 0.2), ("caught_stealing", -0.5)], "event_type string, run_value double")
    rows = V.catcher_throwing(catching, valued).collect()
    assert sum(r.catcher_steal_attempts for r in rows) == 10
    assert sum(r.catcher_throwing_runs for r in rows) == pytest.approx(0)


@pytest.fixture(scope="module")
def pas(spark, sf_dir):
    return I.plate_appearances(spark, sf_dir)


@pytest.fixture(scope="module")
def fitted(pas):
    return R.fit_fixed_effects(pas).collect()


@pytest.mark.parametrize("outcome", list(R.OUTCOMES))
@pytest.mark.parametrize("spec", list(R.SPECS))
def test_regression_equals_dummies(spark, pas, fitted, outcome, spec):
    """The absorbed model equals ordinary least squares with every dummy written out."""
    m, k = next((m, names.index(outcome)) for m, names in enumerate(R.POPULATIONS) if outcome in names)
    rows = R.model_rows(pas).where(F.col("m") == m).toPandas()
    every, names = list(R.exposure_terms(True)), list(R.exposure_terms(R.SPECS[spec]))
    values = np.stack(rows["v"].to_numpy())
    y, terms = values[:, k], values[:, [R.MOST + every.index(n) for n in names]]
    dummies = [np.ones((len(y), 1)), terms]
    for column in ("b", "p"):
        levels = sorted(rows[column].unique())[1:]
        dummies.append((rows[column].to_numpy()[:, None] == np.array(levels)[None, :]).astype(float))
    x = np.hstack(dummies)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    bread, residual = np.linalg.pinv(x.T @ x), y - x @ beta
    games = rows["canonical_id"].to_numpy()
    scores = [x[games == g].T @ residual[games == g] for g in np.unique(games)]
    covariance = bread @ sum(np.outer(s, s) for s in scores) @ bread * len(scores) / (len(scores) - 1)
    errors = np.sqrt(np.maximum(0.0, np.diag(covariance)))
    got = {r.term: r for r in fitted if (r.outcome, r.model_spec) == (outcome, spec)}
    for i, name in enumerate(names, 1):
        assert got[name].estimate == pytest.approx(beta[i], abs=1e-6)
        assert got[name].standard_error == pytest.approx(errors[i], abs=1e-6)
    first = got[names[0]]
    assert first.design_columns == x.shape[1] and first.design_rank == np.linalg.matrix_rank(x)


@pytest.mark.parametrize("block", [3, 1000])
def test_absorbed_effects_leave_what_dummies_leave(spark, block):
    """Two populations; two parts that never met, and players met once; several block rows and one."""
    people = [(i % 2, f"g{i % 7}", f"b{(i * 5) % 6}", f"p{(i * 3) % 4}", [float((i * 11) % 13), float(i % 3 == 0)]) for i in range(160)]
    people += [(0, "g1", f"c{i % 3}", f"q{i % 2}", [float(i), 1.0]) for i in range(9)] + [(0, "g2", "b0", "once", [5.0, 0.0])]
    rows = spark.createDataFrame(people, "m int, canonical_id string, b string, p string, v array<double>")
    effects, facts = R.absorb(rows, 2, block)
    got = R.within(rows, effects).collect()
    for m in (0, 1):
        mine = [r[1:] for r in people if r[0] == m]
        x = np.hstack([np.array([[r[k] == v for v in sorted({q[k] for q in mine})] for r in mine], float) for k in (1, 2)])
        y = np.array([r[3] for r in mine])
        left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        want = sorted((r[0], *[round(w, 6) + 0.0 for w in v]) for r, v in zip(mine, left.tolist()))
        assert sorted((r.canonical_id, *[round(w, 6) + 0.0 for w in r.w]) for r in got if r.m == m) == want
        assert facts[m]["rank"] == np.linalg.matrix_rank(x)


def test_doubleheader_pairs(spark):
    rows = [("h1", "A", "B", "home", 3, 2), ("a1", "B", "A", "away", 2, 3), ("h2", "A", "B", "home", 5, 0), ("a2", "B", "A", "away", 0, 5)]
    schema = "id string, source_team_id string, opponent_team_id string, home_away string, score_team int, score_opponent int"
    base = spark.createDataFrame(rows, schema).withColumns({"season": F.lit(2025), "start_ts": F.lit("2025-06-01")})
    out = {r.id: r.canonical_id for r in C.split_same_time(base).collect()}
    assert out["h1"] == out["a1"] != out["h2"] == out["a2"]
    same = {r.id: r.canonical_id for r in C.split_same_time(base.withColumns({"score_team": F.lit(1), "score_opponent": F.lit(1)})).collect()}
    assert len(set(same.values())) == 1


def test_contest_key_ignores_team_order(spark):
    row = spark.range(1).select(
        C.contest_key(F.lit(2025), F.array(F.lit("x"), F.lit("y")), F.lit("t"), F.lit("")).alias("a"),
        C.contest_key(F.lit(2025), F.array(F.lit("y"), F.lit("x")), F.lit("t"), F.lit("")).alias("b"),
    ).first()
    assert row.a == row.b and len(row.a.split("-")[-1]) == 16


def test_series_gap(spark):
    rows = [(f"c{d}", 2025, ["A", "B"], "V", f"2025-06-{d:02d} 20:00:00") for d in (1, 3, 12)]
    games = spark.createDataFrame(rows, "canonical_id string, season int, teams array<string>, venue string, ts string").select(
        "*", F.to_timestamp("ts").alias("game_ts"), F.lit("RS").alias("game_type"), F.lit(None).cast("int").alias("official_series_id"),
        F.lit(None).cast("int").alias("official_series_game"), F.lit(None).cast("string").alias("series_type"),
    )
    out = {r.canonical_id: (r.series_id, r.series_game_number) for r in C.assign_series(games).collect()}
    assert out["c1"][0] == out["c3"][0] != out["c12"][0]
    assert [out[c][1] for c in ("c1", "c3", "c12")] == [1, 2, 1]


def test_unmatched_official_game_fails(spark):
    contests = spark.sql("select 'c' canonical_id, array('A','B') teams, timestamp'2025-06-01 10:00:00' start_ts, array(1,2) scores")
    official = spark.sql("select 7 game_id, array('A','B') teams, timestamp'2025-06-09 10:00:00' game_ts, array(1,2) scores")
    with pytest.raises(Exception, match="not unique"):
        C.require_matches(C.match_official(contests, official)).collect()


def test_clean_game_confirms_positions(spark):
    labels = ["C", "1B", "2B", "3B", "SS", "LF", "CF", "RF", "DP"]
    box = spark.createDataFrame([("g", 2025, "t", f"P{i}", f"p{i}", p) for i, p in enumerate(labels)], "canonical_id string, season int, team string, player string, player_key string, position string")
    events = spark.createDataFrame([("g", "t", 0, 3, "")], "canonical_id string, fielding_team string, outs_before int, outs_after int, pitch_text string")
    clean = O.team_game_audit(box, events).first()
    assert clean.confirmed_for_innings and clean.defensive_outs == 3
    moved = O.team_game_audit(box, events.withColumn("pitch_text", F.lit("Lineup changed: X"))).first()
    assert not moved.confirmed_for_innings


def test_ordinal_spearman(spark):
    pairs = spark.createDataFrame([("v", p, float(i), float(-i)) for i, p in enumerate(["C", "1B", "2B", "3B"])], "variant string, position string, first double, second double")
    assert O.ordinal_spearman(pairs, "variant").first().spearman == pytest.approx(-1)
    ties = pairs.withColumns({"first": F.lit(0.0), "second": F.lit(0.0)})
    assert O.ordinal_spearman(ties, "variant").first().spearman == pytest.approx(1)


def test_families_are_left_out_together(spark):
    from basepaths.operators import positional

    cells = [(2025, "A", "C", "x", 2, 1.0), (2025, "A2", "C", "y", 3, 0.0), (2025, "B", "C", "x", 4, 2.0), (2025, "B", None, "z", 1, -1.0), (2026, "A2", "SS", "y", 5, 1.0)]
    schema = "season int, team string, position string, player_key string, pa long, runs double"
    df = spark.createDataFrame(cells, schema).withColumn("family", positional.team_family(F.col("team"), {"A2": "A"}))
    sums = {(r.variant, r.season, r.position): r for r in positional.position_sums(df).collect()}
    assert (sums["leave_team_out:A", 2025, "C"].pa, sums["leave_team_out:A", 2025, "C"].mean) == (4, 1.0 / 5)
    assert sums["leave_team_out:A", 2026, "SS"].pa == 0 and sums["leave_team_out:A", 2026, "SS"].mean is None
    assert sums["all", 2025, "C"].mean == 2.0 / 10 and sums["season_2025", 2025, "C"].pa == 9
    players = {(r.variant, r.position): r.players for r in positional.position_players(df).collect()}
    assert players["all", "C"] == 2 and players["leave_team_out:A", "C"] == 1 and players["leave_team_out:B", "C"] == 2 and players["leave_team_out:A", "SS"] == 0
