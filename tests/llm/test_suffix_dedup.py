import hashlib
import random

import numpy as np
import pytest

from basepaths.llm import induced as I
from basepaths.llm import suffix_dedup as D


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("ab é\0xyz") for _ in range(n))
    shared = [draw(n) for n in (39, 40, 41, 90, 200, 60)]
    rows = []
    for i in range(70):
        parts = [draw(rng.randrange(60)) for _ in range(3)]
        for k in range(2):
            if rng.random() < 0.6:
                parts.insert(k * 2, rng.choice(shared))
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "ab" * 100), (103, "ab" * 21), (104, rows[0][1]), (104, rows[0][1]), (None, draw(300)), (106, "z" * 500)]
    rows.append((107, rows[-2][1][:150] + "q" + rows[-2][1][151:]))
    return rows


@pytest.mark.parametrize("hot,shard", [(256, 1 << 20), (2, 300)])
def test_against_all_windows(spark, hot, shard):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, b"x", 1) for d, t in rows], "doc_id long, text string, tid binary, key int")
    got = sorted((tuple(r) for r in D.suffix_dedup(docs, length=40, reach=16, fine=5, hot=hot, shard_bytes=shard).collect()), key=str)
    assert got == brute(rows, 40)


def test_empty_table(spark):
    assert D.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("memory,few", [(10, 1024), (1_000_000, 1024), (1_000_000, 0)])
def test_suffix_order(memory, few, monkeypatch):
    monkeypatch.setattr(I, "MEMORY_ROWS", memory)
    monkeypatch.setattr(I, "FEW_SYMBOLS", few)
    rng = np.random.default_rng(4)
    for turn in range(200):
        n, symbols = int(rng.integers(1, 90)), int(rng.choice([1, 2, 3, 40]))
        text = rng.integers(0, symbols, n)
        if turn % 3 == 0:
            text = np.tile(text[: max(1, n // 5)], 5)
        limit = int(rng.choice([4, 500]))
        suffixes = [list(text[i:]) for i in range(len(text))]
        want = sorted(range(len(text)), key=lambda i: suffixes[i])
        common = [0]
        for a, b in zip(want, want[1:]):
            pairs = list(zip(suffixes[a], suffixes[b]))
            common.append(min(limit, next((k for k, (x, y) in enumerate(pairs) if x != y), len(pairs))))
        order, lcp = I.suffix_order(text, symbols, limit)
        assert order.tolist() == want and lcp.tolist() == common


def test_shards_sort_the_common_bytes_of_a_key_as_one_symbol(monkeypatch):
    sizes = []
    order = D.suffix_order
    monkeypatch.setattr(D, "suffix_order", lambda text, symbols, limit: sizes.append(len(text)) or order(text, symbols, limit))
    rng = random.Random(8)
    draw = lambda n: bytes(rng.choice(b"ab\0") for _ in range(n))
    length, fine = 60, 6
    # two keys that collide have different cores in one shard
    cores = [draw(length - fine + 1) for _ in range(3)]
    parts = []
    for k in range(300):
        core = rng.randrange(fine)
        windows = rng.randrange(core + 1) + 1
        parts.append((1000 * k, 1000 * k + windows - 1, core, draw(core) + rng.choice(cores) + draw(fine - 2 - core + windows)))
    assert all(len(p) == hi - lo + length for lo, hi, _, p in parts)
    got = D.repeated_starts(parts, length, fine)
    place = [(lo + i, (core - i, p[i : i + length])) for lo, hi, core, p in parts for i in range(hi - lo + 1)]
    count = {}
    for _, window in place:
        count[window] = count.get(window, 0) + 1
    assert sorted(x for starts in got for x in starts.tolist()) == sorted(at for at, window in place if count[window] > 1)
    assert sum(sizes) <= len(parts) * (2 * fine + 1)
