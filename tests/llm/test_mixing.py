import random
import re

from basepaths.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, size string, target int"


def targets(sizes):
    """Water filling by hand: sources in code point order, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: float(M.WEIGHTS[k % 3]) for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in full}
        full |= over


def corpus():
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        source = rng.choice(["a"] * 60 + ["b", "B", "ä", "c", "tiny", None] * 4)
        rows.append((i, source, " \t".join("w" for _ in range(rng.choice([1, 3, 20, 150]) if source != "tiny" else 1))))
    return rows + [(9000, "a", None), (9001, "b", ""), (9001, "b", "x y"), (9001, "b", "x y"), (None, "c", "no id"), (9003, "zero", None), (9004, "c", "w " * 4000)]


def test_targets_sizes_and_conserved_mass(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    results = []
    for bucket in (64, 4096):
        got = M.mix_documents(frame, bucket_rows=bucket).collect()
        assert len(got) == len(rows)
        for source in sizes:
            own = [r for r in got if r.source == source]
            assert all(abs(r.target - want[source]) < 1e-6 * (1 + want[source]) and r.source_size == sizes[source] for r in own)
            open_ = [r.size for r in own]
            assert abs(sum(r.taken for r in own) - want[source]) <= max(open_, default=0)
        assert all(r.taken % r.size == 0 and 0 <= r.taken <= 3 * r.size if r.size else r.taken == 0 for r in got)
        results.append(sorted(map(str, got)))
    again = M.mix_documents(frame.repartition(7), bucket_rows=4096).collect()
    assert sorted(map(str, again)) == results[1]
    assert M.mix_documents(frame.limit(0)).collect() == []
    nothing = M.mix_documents(frame.where("doc_id in (9000, 9003)")).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_moves_are_fair():
    rng = random.Random(1)
    total = 0.0
    for _ in range(20000):
        p, q = M.move(0.3, 10, 0.6, 4, rng.random())
        assert (p in (0.0, 1.0) or q in (0.0, 1.0)) and abs(p * 10 + q * 4 - 5.4) < 1e-9
        total += p
    assert abs(total / 20000 - 0.3) < 0.01
