"""Quality classifier: a convolutional network over bytes, in numpy.

The whole document is cut into overlapping chunks of bytes. Learned byte vectors go through
learned filters and a maximum over each chunk; a small layer turns the maxima into
features of the chunk, and the mean and the maximum of those over all chunks give one probability.
Training crops are read from a bounded sample of labelled texts; every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basepaths.llm.arrow_text import byte_rows, pieces

CHUNK, STEP = 256, 224
WIDTH, STRIDE = 8, 4
VECTOR, FILTERS, HIDDEN = 8, 32, 16
PLACES = (CHUNK - WIDTH) // STRIDE + 1
SAMPLE = 4000
CROPS = 24
EPOCHS = 6
SHAPES = {
    "bytes": (256, VECTOR), "filters": (WIDTH * VECTOR, FILTERS), "filter_bias": (FILTERS,), "hidden": (FILTERS, HIDDEN),
    "hidden_bias": (HIDDEN,), "out": (2 * HIDDEN,), "out_bias": (1,),
}


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, bytes) of all texts and the number of chunks of each; the last chunk is padded with zeros."""
    counts = np.array([max(1, -(-max(len(t) - (CHUNK - STEP), 0) // STEP)) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((first[-1], CHUNK), np.uint8)
    for t, at, n in zip(texts, first, counts):
        padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
        padded[: len(t)] = np.frombuffer(t, np.uint8)
        out[at : at + n] = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]
    return out, counts


def start_weights(seed: int = 9) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    scale = {"bytes": 0.5, "filters": (WIDTH * VECTOR) ** -0.5, "hidden": FILTERS**-0.5, "out": 0.3}
    return {k: (rng.standard_normal(s) * scale.get(k, 0.0)).astype(np.float32) for k, s in SHAPES.items()}


def convolve(w: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (chunks, places, width x vector) and filter outputs before the maximum."""
    v = w["bytes"][x]
    win = np.lib.stride_tricks.sliding_window_view(v.reshape(len(x), CHUNK * VECTOR), WIDTH * VECTOR, axis=1)[:, :: STRIDE * VECTOR]
    return win, np.ascontiguousarray(win).reshape(-1, WIDTH * VECTOR) @ w["filters"]


def chunk_features(w: dict, x: np.ndarray) -> np.ndarray:
    _, y = convolve(w, x)
    top = np.maximum(y.reshape(len(x), PLACES, FILTERS).max(axis=1) + w["filter_bias"], 0)
    return np.maximum(top @ w["hidden"] + w["hidden_bias"], 0)


def combine(w: dict, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    cuts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    both = np.hstack([np.add.reduceat(h, cuts, axis=0) / counts[:, None], np.maximum.reduceat(h, cuts, axis=0)])
    return both @ w["out"] + w["out_bias"][0]


def probabilities(w: dict, texts: list[bytes], block: int = 2048) -> np.ndarray:
    x, counts = chunks(texts)
    h = np.vstack([chunk_features(w, x[i : i + block]) for i in range(0, len(x), block)])
    return 1 / (1 + np.exp(-np.clip(combine(w, h, counts).astype(np.float64), -30, 30)))


def gradients(w: dict, x: np.ndarray, counts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of the documents whose chunks are ``x``."""
    n = len(x)
    win, y = convolve(w, x)
    y = y.reshape(n, PLACES, FILTERS)
    best = y.argmax(axis=1)
    raw = np.take_along_axis(y, best[:, None], axis=1)[:, 0] + w["filter_bias"]
    top = np.maximum(raw, 0)
    pre = top @ w["hidden"] + w["hidden_bias"]
    h = np.maximum(pre, 0)
    cuts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    doc = np.repeat(np.arange(len(counts)), counts)
    most = np.maximum.reduceat(h, cuts, axis=0)
    both = np.hstack([np.add.reduceat(h, cuts, axis=0) / counts[:, None], most]).astype(np.float32)
    z = both @ w["out"] + w["out_bias"][0]
    dz = ((1 / (1 + np.exp(-z)) - label) / len(label)).astype(np.float32)
    g = {"out": both.T @ dz, "out_bias": np.array([dz.sum()])}
    d_both = dz[:, None] * w["out"]
    at_most = (h == most[doc]).astype(np.float32)
    at_most /= np.maximum(np.add.reduceat(at_most, cuts, axis=0), 1)[doc]
    dh = d_both[doc, :HIDDEN] / counts[doc, None] + d_both[doc, HIDDEN:] * at_most
    dh = (dh * (pre > 0)).astype(np.float32)
    g["hidden"], g["hidden_bias"] = top.T @ dh, dh.sum(axis=0)
    dt = (dh @ w["hidden"].T) * (raw > 0)
    g["filter_bias"] = dt.sum(axis=0)
    chosen = win[np.arange(n)[:, None], best]
    g["filters"] = np.einsum("nfk,nf->kf", chosen, dt)
    back = np.einsum("nf,kf->nfk", dt, w["filters"]).reshape(-1, VECTOR)
    place = (best * STRIDE)[:, :, None] + np.arange(WIDTH)
    byte = x[np.arange(n)[:, None, None], place].ravel()
    g["bytes"] = np.stack([np.bincount(byte, weights=back[:, e], minlength=256) for e in range(VECTOR)], axis=1)
    return g


def train(x: np.ndarray, counts: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 9, batch: int = 32, rate: float = 4e-3) -> dict:
    """Adam over shuffled batches of documents."""
    w, rng = start_weights(seed), np.random.default_rng(seed + 1)
    mean = {k: np.zeros(s) for k, s in SHAPES.items()}
    square = {k: np.zeros(s) for k, s in SHAPES.items()}
    first = np.concatenate([[0], np.cumsum(counts)])
    steps = max(1, epochs * -(-len(counts) // batch))
    turn = 0
    for _ in range(epochs):
        order = rng.permutation(len(counts))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            g = gradients(w, x[rows], counts[docs], label[docs])
            turn += 1
            now = rate * (1 - 0.9 * turn / steps)
            for k in w:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.999 * square[k] + 0.001 * np.square(g[k])
                step = mean[k] / (1 - 0.9**turn) / (np.sqrt(square[k] / (1 - 0.999**turn)) + 1e-8)
                w[k] = (w[k] - now * step).astype(np.float32)
    return w


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights from ``sample`` labelled texts at most (the first by a hash of the id), trained in one task.

    So few ids are broadcast. A training text gives up to ``CROPS`` of its chunks, spread evenly over the whole text.
    """
    known = labels.where(learnable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def crops(batches):
        for piece in pieces(batches):
            rows, counts = chunks(byte_rows(piece.column("text")))
            first = np.concatenate([[0], np.cumsum(counts)])
            taken = [rows[np.unique(np.linspace(a, b - 1, min(CROPS, b - a)).round().astype(int))].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("quality"), pa.array(taken, pa.binary())], names=["doc_id", "quality", "crops"])

    schema = docs.select("doc_id").schema.add("quality", labels.schema["quality"].dataType).add("crops", "binary")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(crops, schema)

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id")
        x = np.frombuffer(b"".join(frame["crops"]), np.uint8).reshape(-1, CHUNK)
        w = train(x, np.array([len(c) // CHUNK for c in frame["crops"]]), frame["quality"].to_numpy(np.float32), epochs)
        return pd.DataFrame({"name": list(w), "value": [v.ravel().astype(float).tolist() for v in w.values()]})

    learnt = rows.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "name string, value array<double>").collect()
    w = start_weights()
    if not learnt:
        w["out"][:] = 0
    for r in learnt:
        w[r["name"]] = np.array(r["value"], np.float32).reshape(SHAPES[r["name"]])
    return w


def score(docs: DataFrame, weights: dict[str, np.ndarray], *keep: str) -> DataFrame:
    """``keep`` and ``score`` of every whole text; null and empty texts are one chunk of zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = docs.select(*keep).schema.add("score", "double")

    def run(batches):
        for piece in pieces(batches, limit=2 << 20):
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(k) for k in keep), pa.array(probabilities(shared.value, byte_rows(piece.column("text"))))], names=[*keep, "score"]
            )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, folds: int = 5, held: int = 0, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Labels are learnt only where crc32(doc_id as text) mod ``folds`` is not ``held``. Null ids
    are scored and not held out; repeated rows are scored alike; without any usable label
    every score is 0.5.
    """
    place = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    learnable = F.coalesce(place != held, F.lit(True))
    weights = fit(docs, labels, learnable, **options)
    return score(docs, weights, "doc_id").select(
        "doc_id", (~learnable).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
