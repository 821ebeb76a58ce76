"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; unlabelled texts stand for the whole corpus. With class
prior p the risk of a classifier is  p R+(f, toxic) + max(0, R-(f, corpus) - p R-(f, toxic)):
the second part estimates the risk on clean texts and may not go below zero (else the
gradient of that part is turned round), which keeps a flexible model from learning the
positives by heart. Several linear classifiers over hashed words are trained in numpy, one task
each with its own share of the corpus, and their logits averaged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from basepaths.llm.arrow_text import pieces
from basepaths.llm.words import word_hashes

BITS = 20
MEMBERS = 4
POSITIVES = 4000
UNLABELLED = 16000
ROUNDS = 150
SHRINK = 3e-5
#: A word is a feature if its share among the positives exceeds that in the corpus by so many standard errors.
SIGNAL = 6.0
#: Least share of the positives that hold a feature; rarer words come from texts that were copied.
SUPPORT = 0.02
#: Bytes of a word that stand for its beginning.
STEM = 4


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``words``: the distinct hashed words of the whole text."""
    schema = docs.select(*keep).schema.add("words", ArrayType(IntegerType()))

    def run(batches):
        for piece in pieces(batches):
            rows = distinct_words(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(k) for k in keep), pa.array([r.astype(np.int32) for r in rows], pa.list_(pa.int32()))], names=[*keep, "words"]
            )

    return docs.select(*keep, "text").mapInArrow(run, schema)


def distinct_words(texts) -> list[np.ndarray]:
    """Hash slots of the distinct words and word beginnings of each text."""
    words, first = word_hashes(texts)
    stems, _ = word_hashes(texts, STEM)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    slots = [(row << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64) for h in (words, stems ^ np.uint64(1 << 63))]
    key = np.unique(np.concatenate(slots))
    return np.split(key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(1, len(texts))))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = ROUNDS, shrink: float = SHRINK) -> np.ndarray:
    """Weights of one classifier (the last is the bias) by the non-negative estimator.

    Logistic loss, full-batch steps with per-weight scaling and soft shrinking of weights. Words
    that are not clearly commoner among the positives are no features, so that what says
    nothing does not add up over a long text.
    """
    rows = positive + unlabelled
    lengths = np.array([len(r) for r in rows])
    used, column = np.unique(np.concatenate(rows) if lengths.sum() else np.zeros(0, np.int64), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), lengths)
    n, m = len(positive), len(unlabelled)
    toxic = np.bincount(column[row < n], minlength=len(used)) / n
    corpus = np.bincount(column[row >= n], minlength=len(used)) / m
    pooled = np.clip((toxic * n + corpus * m) / (n + m), 1e-9, 1 - 1e-9)
    often = (toxic - corpus) / np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m)) >= SIGNAL
    often &= toxic >= SUPPORT
    row, column = row[often[column]], column[often[column]]
    weights, bias = np.zeros(len(used)), np.log(prior / (1 - prior))
    seen, seen_bias = np.full(len(used), 1e-8), 1e-8
    for turn in range(rounds):
        z = np.bincount(row, weights=weights[column], minlength=n + m) + bias
        chance = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p, u = chance[:n], chance[n:]
        clean = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
        slope = np.concatenate([-prior * (1 - p) / n, np.zeros(m)])
        negative = np.concatenate([-prior * p / n, u / m])
        slope = slope + negative if clean >= 0 else -negative
        gradient = np.bincount(column, weights=slope[row], minlength=len(used))
        seen += gradient**2
        seen_bias += slope.sum() ** 2
        step = 1.0 / np.sqrt(seen)
        weights = weights - step * gradient
        weights = np.sign(weights) * np.maximum(0, np.abs(weights) - step * shrink)
        bias -= 0.3 * slope.sum() / np.sqrt(seen_bias)
    out = np.zeros((1 << BITS) + 1)
    out[used] = weights
    out[-1] = bias
    return out


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, members: int = MEMBERS, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> np.ndarray:
    """Mean weights of the members.

    ``learnable`` marks the rows of ``labels`` that may be learnt from. About ``positives``
    confirmed toxic texts at most go to every member (so few ids are broadcast), and to each
    its part of about ``unlabelled`` corpus texts (chosen by a hash of the id, so reruns agree); the class prior is the toxic share
    of all learnable labels. Only the weights, of a fixed size, come to the driver.
    """
    known = labels.where(learnable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    total = docs.count()
    out = np.zeros((1 << BITS) + 1)
    if not counts["p"] or counts["p"] == counts["n"] or not total:
        out[-1] = 10.0 if counts["n"] and counts["p"] == counts["n"] else -10.0
        return out
    place = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    toxic = known.where("toxic = 1").orderBy(place(1), "doc_id").limit(positives).select("doc_id")
    p_rows = docs.select("doc_id", "text").join(F.broadcast(toxic), "doc_id", "left_semi").select(F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"), F.lit(1).alias("toxic"), "text", "doc_id")
    share = min(1.0, unlabelled / members / total)
    windows = F.filter(F.sequence(F.lit(0), F.lit(members - 1)), lambda m: (place(2) + 1 - m / F.lit(float(members))) % F.lit(1.0) < share)
    u_rows = docs.where(learnable).select(F.explode(windows).alias("member"), F.lit(0).alias("toxic"), "text", "doc_id")
    rows = features(p_rows.union(u_rows), "member", "toxic", "doc_id")
    prior = counts["p"] / counts["n"]

    def member(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["toxic", "doc_id"])
        parts = [[np.asarray(w) for w in frame["words"][frame["toxic"] == k]] for k in (1, 0)]
        parts[0] = list({w.tobytes(): w for w in parts[0]}.values())
        if not parts[0] or not parts[1]:
            return pd.DataFrame({"weights": pd.Series([], dtype=object)})
        return pd.DataFrame({"weights": [train(*parts, prior).tolist()]})

    found = [np.array(r["weights"]) for r in rows.groupBy("member").applyInPandas(member, "weights array<double>").toLocalIterator()]
    return np.mean(found, axis=0) if found else out


def score(docs: DataFrame, weights: np.ndarray, *keep: str, name: str = "score") -> DataFrame:
    """``keep`` and the score ``name`` of every whole text; null and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = docs.select(*keep).schema.add(name, "double")

    def run(batches):
        for piece in pieces(batches):
            w = shared.value
            rows = distinct_words(piece.column("text").to_pylist())
            z = np.array([w[r].sum() + w[-1] for r in rows])
            yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*keep, name])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def learnable(folds: int = 3, held: int = 1) -> Column:
    """Rows whose labels may be learnt."""
    return F.coalesce(remainder(F.col("doc_id"), folds) != held, F.lit(True))


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more; columns stay as they are."""
    weights = fit(docs, labels, learnable())
    return score(docs, weights, *docs.columns, name="_toxic").where(F.col("_toxic") < cut).drop("_toxic")


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Labels are learnt only where crc32(doc_id as text) mod ``folds`` is not ``held``. Null ids
    are scored and not held out; repeated rows are scored alike; labels without texts or ids
    are left out; without both classes every score is near 0 (or near 1 if all are toxic).
    """
    ours = learnable(folds, held)
    return score(docs, fit(docs, labels, ours), "doc_id").select(
        "doc_id", (~ours).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )
