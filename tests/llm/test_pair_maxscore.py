import math
import random
import re

import numpy as np

from basepaths.llm import pair_maxscore as M

DOCS = "doc_id long, text string, item_id string, score double"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def brute(docs, items, limit=50):
    read = [(doc, terms(t)) for doc, t in docs]
    read = [(doc, w) for doc, w in read if w]
    n, total = len(read), sum(len(w) for _, w in read)
    df = {}
    for _, w in read:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, w in read:
            m = 100 - 50 + 50 * len(w) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in wanted if t in w
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:limit])]
    return out


def corpus():
    rng = random.Random(8)
    vocab = [f"Wört{i}" for i in range(120)] + ["The", "of", "É", "x1"]
    common = ["the", "OF", "and"]
    text = lambda n: rng.choice([" ", "\n", "-", "\0"]).join(rng.choice(common if rng.random() < 0.4 else vocab) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 3, 20, 20, 60, 300]))) for i in range(500)]
    docs += [(600 + i, docs[17][1]) for i in range(70)] + [(17, docs[18][1]), (None, docs[19][1]), (None, None), (900, None), (901, "-- !!")]
    items = [(i, text(rng.choice([1, 2, 5, 30]))) for i in range(30)]
    items += [(3, "more terms of wört5"), (None, "wört7 the"), (98, ""), (99, None), (97, "nowhere"), (96, docs[17][1]), (95, "a")]
    return docs, items


def asked(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id int, text string, doc_id int")
    return sorted(map(tuple, M.ranked(d, b, **more).collect()), key=repr)


def test_against_all_documents_with_shards_passes_and_ties(spark):
    docs, items = corpus()
    want = sorted(brute(docs, items), key=repr)
    assert asked(spark, docs, items) == want
    assert asked(spark, docs, items, query_text=300, shard=400) == want
    assert asked(spark, docs, items, limit=3, shard=700) == sorted(brute(docs, items, 3), key=repr)


def test_empty_tables(spark):
    assert asked(spark, [], [(1, "a")]) == [] and asked(spark, [(1, "a")], []) == [] and asked(spark, [(1, "")], [(1, "a")]) == []


def test_pair_bounds_skip_more_than_single_maxima():
    items = M.Items([(0, b"alpha beta gamma delta")])
    items.weigh(np.full(4, 10))
    rng = np.random.default_rng(0)
    docs = np.arange(4000)
    term = docs % 4
    impacts = rng.integers(50, 100, 4000)
    shard = M.Shard(docs, term, impacts, 4000, items)
    assert all(shard.both[p][1] == 0 for p in items.pairs)
    assert sum(shard.bound(u) for u in items.units[0]) < shard.most.sum()
    found, scores = shard.search(items.units[0], 0, 10)
    assert sorted(scores.tolist())[-10:] == sorted(impacts.tolist())[-10:] and not shard.total.any()


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    text = " ".join("w%d" % rng.randrange(5000) for _ in range(400_000)) + "z" * 9000
    raw = text.encode()
    monkeypatch.setattr(M, "PART", 5000)
    assert b"".join(M._parts(raw)) == raw
    whole = M.term_hashes([raw, b"w1 W1"])
    monkeypatch.setattr(M, "PART", 1 << 30)
    assert all((a == b).all() for a, b in zip(whole, M.term_hashes([raw, b"w1 W1"])))
    monkeypatch.undo()
    docs = [(1, text), (2, "w1 w2"), (3, "w2")]
    assert asked(spark, docs, [(1, "w1 w2 " + "z" * 9000)]) == sorted(brute(docs, [(1, "w1 w2 " + "z" * 9000)]), key=repr)
