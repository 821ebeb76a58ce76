import random

import numpy as np

from basepaths.llm import byte_cnn as C
from basepaths.llm import toxicity as T

SCHEMA = "doc_id long, text string, score string, held_out int"


def corpus():
    """Toxic texts hold one of a few words, junk is shouted; words and length say nothing else."""
    rng = random.Random(8)
    vocab = ["wort%d" % i for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(vocab) for _ in range(rng.choice([5, 30, 200]))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grobian", "schuft", "lump"])
        text = " ".join(w.upper() + "!!" if junk else w for w in words)
        docs.append((i, text))
        if rng.random() < 0.6:
            labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def run(spark, module, column, **options):
    docs, labels = corpus()
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs] + [(5000, None, "", 0), (5001, "", "", 0), (None, docs[0][1], "", 0), (0, docs[0][1], "", 0)], SCHEMA)
    known = spark.createDataFrame(labels + [(None, 1, 1), (9999, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    operator = module.toxicity if module is T else module.quality
    got = operator(frame, known, **options).collect()
    assert len(got) == len(docs) + 4 and all(0 <= r.score <= 1 for r in got)
    assert operator(frame.limit(0), known, **options).collect() == []
    assert len(operator(frame.limit(3), known.limit(0), **options).collect()) == 3
    truth = {r[0]: r[column] for r in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60
    return held


def test_toxicity_on_held_out_rows(spark):
    held = run(spark, T, 2)
    assert np.mean([p == t for p, t in held]) > 0.97


def test_quality_on_held_out_rows(spark):
    held = run(spark, C, 1)
    assert np.mean([p == t for p, t in held]) > 0.97


def test_risk_stays_non_negative():
    """With separable positives the estimator does not drive all unlabelled rows to certainty."""
    rng = np.random.default_rng(0)
    draw = lambda toxic: np.unique(np.append(rng.integers(100, 140, 12), 7 if toxic else 8))
    positive, unlabelled = [draw(True) for _ in range(200)], [draw(rng.random() < 0.1) for _ in range(2000)]
    w = T.train(positive, unlabelled, 0.1)
    chance = lambda r: 1 / (1 + np.exp(-(w[r].sum() + w[-1])))
    assert np.mean([chance(r) for r in positive]) > 0.85 and np.mean([chance(r) for r in unlabelled if 8 in r]) < 0.1


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 255, n, dtype=np.uint8).tobytes() for n in (40, 700, 260)]
    x, counts = C.chunks(texts)
    label = np.array([1.0, 0.0, 1.0], np.float32)
    w = {k: v.astype(np.float64) for k, v in C.start_weights().items()}
    w["filter_bias"] += 0.1
    g = C.gradients(w, x, counts, label)

    def loss():
        h = C.chunk_features(w, x)
        z = C.combine(w, h, counts)
        return float(np.mean(np.logaddexp(0, z) - label * z))

    for name, value in w.items():
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(6)]:
            old = value[at]
            value[at] = old + 1e-5
            up = loss()
            value[at] = old - 1e-5
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        text = bytes(1 + i % 250 for i in range(n))
        x, counts = C.chunks([text])
        out = bytearray(len(x) * C.STEP + C.CHUNK)
        for k, row in enumerate(x):
            out[k * C.STEP : k * C.STEP + C.CHUNK] = row.tobytes()
        assert bytes(out[:n]) == text and counts.tolist() == [len(x)] and not any(out[n:])
