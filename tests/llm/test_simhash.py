import itertools
import random

import pytest
import xxhash

from basepaths.llm import simhash_index as S


def brute(rows):
    def fp(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        if not grams:
            return 0
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    fps = [fp(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            old, new = part[j], part[i]
            part = [new if p == old else p for p in part]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    vocab = ["Wört%d" % i for i in range(300)] + ["Is", "the"]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 60, 400]))]
        rows.append((i, " ".join(words)))
        if len(words) == 400:
            for c in range(3):
                near = list(words)
                near[rng.randrange(400)] = "changed"
                rows.append((1000 + 10 * i + c, "\n".join(near)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, rows[5][1]), (2003, rows[5][1]), (None, "a b c"), (2005, "a b"), (2006, "x " * 5000)]
    return rows


@pytest.mark.parametrize("tile", [2, 512])
def test_against_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(S, "TILE", tile)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    links = S.near_links
    monkeypatch.setattr(S, "near_links", lambda fps, bits: links(fps, bits, tile))
    got = sorted((tuple(r) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == []


def test_index_finds_every_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 6, 3)).astype(np.uint64)
    values = np.unique(np.bitwise_xor.reduce(flips, axis=2) ^ base[:, None])
    values = values[np.argsort(S.gray_rank(values))]
    found = {(a, b) for q, v in S.GrayIndex(values).near(values, 4) for a, b in zip(q.tolist(), v.tolist())}
    assert found == {(a, b) for a in range(len(values)) for b in range(len(values)) if (int(values[a]) ^ int(values[b])).bit_count() <= 4}
