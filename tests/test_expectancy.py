import pytest
from pyspark.sql import functions as F

from basepaths.operators import expectancy as X

HALF = "canonical_id string, inning int, half string, event_order int, runs_scored int"
STATE = "canonical_id string, outs_before int, bases_before int, runs_remaining_before long"


def test_runs_remaining(spark):
    rows = spark.createDataFrame([("g", 1, "top", i + 1, r) for i, r in enumerate((0, 2, 0))], HALF)
    out = X.annotate_runs_remaining(rows).orderBy("event_order").collect()
    assert [r.runs_remaining_before for r in out] == [2, 2, 0]
    assert [r.runs_remaining_after for r in out] == [2, 0, 0]


def test_all_cells(spark):
    rows = spark.createDataFrame([("g", 0, 0, 1), ("g", 0, 0, 3), ("g", 1, 5, 2)], STATE)
    cells = {(r.outs, r.bases): r for r in X.estimate_re24(rows).collect()}
    assert len(cells) == 24
    assert cells[(0, 0)].raw_re == 2 and cells[(0, 0)].sample_size == 2 and cells[(0, 0)].state == "0 outs, empty"
    assert cells[(1, 5)].state == "1 outs, 13"
    assert cells[(2, 7)].raw_re is None and cells[(2, 7)].smoothed_re == 2.0  # no such outs level: global mean


def test_illegal_state_fails(spark):
    rows = spark.createDataFrame([("g", 3, 0, 1)], STATE)
    with pytest.raises(Exception, match="outs_before"):
        X.estimate_re24(rows).collect()


def test_third_out_is_worth_the_expectancy(spark):
    table = X.state_grid(spark).withColumn("smoothed_re", F.lit(1.0))
    event = spark.createDataFrame(
        [(2, 0, 3, 0, 0, "out")], "outs_before int, bases_before int, outs_after int, bases_after int, runs_scored int, event_type string"
    )
    valued = X.add_run_values(event, table)
    assert valued.first().run_value == -1
    assert X.event_linear_weights(valued).first().linear_weight == -1


def test_bootstrap(spark):
    rows = spark.createDataFrame([(f"g{i}", o, b, (i * 7 + b) % 3) for i in range(9) for o in range(3) for b in range(8)], STATE)
    out = X.bootstrap_re24(rows, replicates=20).collect()
    again = X.bootstrap_re24(rows, replicates=20).collect()
    assert len(out) == 24 and all(r.re_low <= r.re_high for r in out)
    assert sorted(out) == sorted(again)
    point = {(r.outs, r.bases): r.smoothed_re for r in X.estimate_re24(rows).collect()}
    assert all(r.re_low - 1e-9 <= point[(r.outs, r.bases)] <= r.re_high + 1e-9 for r in out)


def test_resampling_counts_are_poisson(spark):
    steps = X.poisson_steps()
    assert steps[0] == round(65536 * 0.36787944117) and steps == sorted(set(steps)) and steps[-1] < 65536
    rows = spark.range(625).select(X.resampling_counts(F.concat(F.lit("g"), F.col("id").cast("string")), F.lit(3), 1).alias("t"))
    times = [v for r in rows.collect() for v in r.t]
    assert len(times) == 10_000
    mean = sum(times) / len(times)
    assert abs(mean - 1) < 0.04 and abs(sum((t - mean) ** 2 for t in times) / len(times) - 1) < 0.06


def test_bootstrap_equals_weighting_by_hand(spark):
    rows = [(f"g{i}", o, b, (i * 7 + b * o) % 5) for i in range(9) for o in range(3) for b in range(0, 8, 2)]
    df = spark.createDataFrame(rows, STATE)
    times = {r.g: r.t for r in spark.createDataFrame([(f"g{i}",) for i in range(9)], "g string").select(
        "g", F.concat(*[X.resampling_counts(F.col("g"), F.lit(b), 7) for b in range(3)]).alias("t")).collect()}
    estimates = []
    for r in range(40):
        copies = [row for row in rows for _ in range(times[row[0]][r])]
        total = sum(c[3] for c in copies) / len(copies)
        means = {o: [c[3] for c in copies if c[1] == o] for o in range(3)}
        cell = [c[3] for c in copies if c[1:3] == (1, 4)]
        prior = sum(means[1]) / len(means[1]) if means[1] else total
        estimates.append((sum(cell) + 20 * prior) / (len(cell) + 20))
    estimates.sort()
    want = [estimates[int(39 * q)] * (1 - 39 * q % 1) + estimates[min(39, int(39 * q) + 1)] * (39 * q % 1) for q in (0.025, 0.975)]
    got = {(r.outs, r.bases): r for r in X.bootstrap_re24(df, replicates=40, seed=7).collect()}
    assert len(got) == 24 and [got[(1, 4)].re_low, got[(1, 4)].re_high] == pytest.approx(want)
