import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basepaths.llm import residue_mining as R

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


@pytest.mark.parametrize("top, width", [(1, 1), (256, 64), (40_000, 7), (3, 4000), (2**24, 128)])
def test_products_are_exact(top, width):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-top, top + 1, (5, width)), rng.integers(-top, top + 1, (9, width))
    a[0], b[0], b[1] = top, top, -top
    r = R.Residues(top, width)
    assert (r.scores(r.split(a), r.split(b)) == a @ b.T).all()


def brute(rows):
    best = {}
    for vec_id, x, label, _ in rows:
        if vec_id is None or x is None or label is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        y = (label, [int(np.floor(256 * v)) for v in x])
        best[vec_id] = min(best.get(vec_id, y), y)
    items = [(i, (y[0] + 1) % 10 if i % 7 == 0 else y[0], y[1]) for i, y in best.items()]
    out = []
    for a, la, xa in items:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(xa, xb)), b, lb) for b, lb, xb in items if b != a)
        for s, b, _ in [t for t in scored if t[2] == la][:5]:
            near = [t for t in scored if t[2] != la and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(a, b, n + 1, c, -s, -t) for n, (t, c, _) in enumerate(near)]
    return sorted(out)


def rows(copies=40):
    rng = random.Random(2)
    crowd = [rng.gauss(0, 0.3) for _ in range(6)]
    out = [(i, [rng.gauss(0, 0.3) for _ in range(6)], rng.choice([0, 0, 0, 1, 2, 9]), "x") for i in range(400)]
    out += [(1000 + i, crowd, i % 2, "x") for i in range(copies)]
    out += [(i, None, 1, None) for i in (2000, 2001)] + [(2050, crowd, None, "x"), (None, crowd, 1, "x")]
    out += [(2100, [0.1, None], 1, "x"), (2150, [float("nan")] * 6, 1, "x"), (2200, [float("inf")] + crowd[1:], 1, "x")]
    out += [(2250, [], 0, "x"), (2300, crowd[:3], 0, "x"), (1000, crowd, 0, "x"), (-50, crowd, -3, "x")]
    return out


def test_against_all_pairs_with_ties_nulls_and_several_cells(spark):
    made = rows()
    df = spark.createDataFrame(made, SCHEMA).repartition(5)
    got = R.hard_negatives(
        R.integer_rows(df).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))),
        F.col("vec_id") % 50 == 0, anchor_group=4, row_group=60,
    )
    assert sorted(map(tuple, got.collect())) == brute(made)
    assert sorted(map(tuple, R.mine_embeddings(df).collect())) == brute(made)


def test_no_rows_and_no_partners(spark):
    assert R.mine_embeddings(spark.createDataFrame([], SCHEMA)).collect() == []
    assert R.mine_embeddings(spark.createDataFrame([(0, [1.0], 1, "x"), (1, [1.0], 2, "x")], SCHEMA)).collect() == []


def test_components_that_leave_64_bits_take_no_part(spark):
    made = [(50, [0.5], 1, ""), (1, [1.0], 1, ""), (2, [0.75], 2, ""), (3, [1e300], 1, ""), (4, [1e12], 1, "")]
    got = R.mine_embeddings(spark.createDataFrame(made, SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(50, 1, 1, 2, 128 * 256, 128 * 192)]
