import math
import random

import numpy as np

from basepaths.llm import decontaminate as D
from basepaths.llm.words import word_hashes

SCHEMA = "doc_id long, text string, item_id string, score int"


def items_and_docs():
    rng = random.Random(4)
    vocab = ["wört%d" % i for i in range(150)] + ["the", "of", "and"] * 30
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(draw(rng.randrange(8, 40))) + ". " + " ".join(draw(6)) + ".") for k in range(60)]
    docs = []
    for i in range(120):
        words = draw(rng.randrange(400))
        if i % 3 == 0:
            leak = items[rng.randrange(60)][1].upper().replace(".", " !").split()
            if i % 2:
                leak[rng.randrange(len(leak))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak
        docs.append((i, " ".join(words)))
    return items, docs


def bm25(index, items, passage):
    """Normalised scores of all items for the distinct words of a passage, from the formula."""
    texts = [word_hashes([t])[0].tolist() for _, t in items]
    mean = sum(map(len, texts)) / len(texts)
    out = {}
    for k, words in enumerate(texts):
        def weight(t):
            df = sum(t in w for w in texts)
            tf = words.count(t)
            return math.log1p((len(texts) - df + 0.5) / (df + 0.5)) * tf * (D.K1 + 1) / (tf + D.K1 * (1 - D.B + D.B * len(words) / mean))
        out[k] = sum(weight(t) for t in set(words) & set(passage)) / sum(weight(t) for t in set(words))
    return out


def test_wand_finds_all_above_the_threshold():
    items, docs = items_and_docs()
    index = D.build_index(items)
    for _, text in docs[:12]:
        words = word_hashes([text])[0][:80]
        want = bm25(index, items, words.tolist())
        terms = np.unique(index.terms(words)[1]).tolist()
        for threshold in (0.2, 0.6):
            got = dict(index.wand(terms, threshold))
            assert got.keys() == {k for k, v in want.items() if v >= threshold}
            assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def brute(items, docs):
    """Every window, every item, no bounds."""
    index = D.build_index(items)
    out = set()
    for doc, text in docs:
        words = word_hashes([text])[0]
        for at in range(-index.window, max(1, len(words)), index.window):
            passage = words[max(0, at) : at + 2 * index.window]
            scores = bm25(index, items, passage.tolist()) if len(passage) else {}
            for k, v in scores.items():
                q, a = index.overlap(index.items[k], passage)
                if v >= 0.6 and q >= 0.8 and a >= 0.5:
                    out.add((doc, items[k][0]))
    return out


def test_against_every_window_and_item(spark):
    items, docs = items_and_docs()
    docs = docs[:40] + [(200, None), (201, ""), (0, docs[0][1]), (None, items[5][1])]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    bench = spark.createDataFrame([*items, (900, None), (901, ""), (902, " . ")], "item_id long, text string")
    pairs = [(r.doc_id, r.item_id) for r in D.leaks(frame, bench).collect()]
    assert set(pairs) == brute(items, docs) and (None, 5) in pairs and len(pairs) > 12
    by_blocks = {(r.doc_id, r.item_id) for r in D.leaks(frame, bench, index_text=700, at_once=2).collect()}
    assert {p[0] for p in by_blocks} == {p[0] for p in pairs}
    left = D.without_leaks(frame, bench)
    assert left.columns == frame.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in {p[0] for p in pairs})
    assert D.leaks(frame, bench.limit(0)).collect() == [] and D.leaks(frame.limit(0), bench).collect() == []
