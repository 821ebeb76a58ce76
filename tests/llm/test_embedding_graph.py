import numpy as np

from basepaths.llm import embedding_graph as G

SCHEMA = "vec_id long, embedding array<float>, label int, c string"


def corpus():
    rng = np.random.default_rng(2)
    rows = [rng.standard_normal(16) for _ in range(250)]
    for k in range(12):
        rows += [rows[k] + 0.12 * rng.standard_normal(16) for _ in range(6 if k else 60)]
    rows += [rows[0]] * 40 + [rows[7] * 3.0]
    rows = [r.astype(np.float32).tolist() for r in rows]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    return [(i, v) for i, v in enumerate(rows)]


def brute(rows):
    real = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    linked = {i: set() for i, _ in rows}
    for i, a in real:
        for j, b in real:
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                linked[i].add(j)
    head = {}
    for i, _ in rows:
        seen, front = {i}, [i]
        while front:
            front = [n for f in front for n in linked[f] if n not in seen and not seen.add(n)]
        head[i] = min(seen)
    return {i: (len(linked[i]), head[i], head[i] == i) for i, _ in rows}


def test_against_all_pairs(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    want = brute(rows)
    for shard_rows, tile in ((60, 1024), (1000, 70)):
        result = G.near_vectors(frame, shard_rows=shard_rows, tile=tile)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in result.collect()}
        assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in got)
        assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in want.values())
        assert np.mean([got[i][1] == want[i][1] for i in got]) > 0.97
    assert 0.9 <= G.audit_recall(frame, result) <= 1


def test_one_shard_is_exact(spark):
    rows = corpus()[:120]
    got = G.near_vectors(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)


def test_repeated_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0, ""), (1, [1.0, 0.0], 0, ""), (None, [1.0, 0.01], 0, ""), (5, [0.0, 1.0], 0, "")], SCHEMA)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in G.near_vectors(frame).collect())
    assert got == [("1", 2, 1, True), ("1", 2, 1, True), ("5", 0, 5, True), ("None", 2, 1, False)]
    assert G.near_vectors(frame.limit(0)).collect() == []


def test_pruning_keeps_what_no_kept_one_covers():
    x = G.normal(np.array([[1, 0], [1, 0.1], [1, 0.2], [1, -0.3], [0, 1.0]]))
    assert G.pruned(x, 0, np.array([0, 1, 2, 3, 4]), degree=4) == [1, 3, 4]
