"""Benchmark decontamination with a BM25 index and block-max WAND.

The benchmark items are indexed (in blocks of bounded size); each passage of each document is a
query. An item's score is divided by the score of its own words, so one threshold holds for
all. Passages are overlapping windows of twice the longest item, so that an item lies whole
in one of them. For many passages at once the sums of block maxima are taken; passages that can
reach the threshold in no block are done. The others run WAND: posting lists in item
order, a pivot from the lists' maxima, block maxima before any scoring. All items at or above
the threshold are then held against the passage: five-word shingles mark the words they cover,
and enough of the question and of the answer must be covered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from basepaths.llm.arrow_text import pieces
from basepaths.llm.words import word_hashes

SHINGLE = 5
#: Items of a block that share one maximum per list.
BLOCK = 4
#: Characters of benchmark text in one index, and indexes in one pass over the documents.
INDEX_TEXT = 256 << 10
PASS = 8
K1, B = 1.2, 0.75
#: Texts end in an answer: what follows the last break between sentences or lines.
SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def question_and_answer(text: str) -> tuple[str, str]:
    parts = [p for p in SENTENCE.split(text) if p.strip()]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of every run of ``size`` words (of all words, if fewer)."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + words[k : len(words) - size + 1 + k]
    return out


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    question_words: int


class Bm25Index:
    """Inverted lists of normalised impacts, with maxima by list and by block of items."""

    def __init__(self, items: list[Item]):
        self.items = items
        pairs = [np.unique(it.words, return_counts=True) for it in items]
        self.vocabulary = np.unique(np.concatenate([p[0] for p in pairs]))
        terms = [np.searchsorted(self.vocabulary, p[0]) for p in pairs]
        found = np.bincount(np.concatenate(terms), minlength=len(self.vocabulary))
        idf = np.log1p((len(items) - found + 0.5) / (found + 0.5))
        mean = np.mean([len(it.words) for it in items])
        blocks = -(-len(items) // BLOCK)
        self.block_max = np.zeros((len(self.vocabulary), blocks), np.float32)
        lists: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for k, (it, (_, tf), term) in enumerate(zip(items, pairs, terms)):
            impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(it.words) / mean))
            impact = impact / impact.sum()
            for t, v in zip(term.tolist(), impact.tolist()):
                lists[t].append((k, v))
            self.block_max[term, k // BLOCK] = np.maximum(self.block_max[term, k // BLOCK], impact)
        self.postings = [([k for k, _ in p], [v for _, v in p]) for p in lists]
        self.list_max = self.block_max.max(axis=1).tolist()
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.window = max(len(it.words) for it in items)

    def terms(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that the index knows, and their terms."""
        at = np.flatnonzero(self.seen[(words >> np.uint64(44)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        right = self.vocabulary[term] == words[at]
        return at[right], term[right]

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for the distinct ``terms`` is at least ``threshold``."""
        lists = [(self.postings[t], self.list_max[t], t) for t in terms]
        at = [0] * len(lists)
        order = sorted(range(len(lists)), key=lambda i: lists[i][0][0][0])
        found = []
        while order:
            bound, pivot = 0.0, None
            for n, i in enumerate(order):
                bound += lists[i][1]
                if bound >= threshold:
                    pivot = n
                    break
            if pivot is None:
                return found
            item = lists[order[pivot]][0][0][at[order[pivot]]]
            while pivot + 1 < len(order) and lists[order[pivot + 1]][0][0][at[order[pivot + 1]]] == item:
                pivot += 1
            block = item // BLOCK
            if sum(float(self.block_max[lists[i][2], block]) for i in order[: pivot + 1]) < threshold * (1 - 1e-5):
                # no item of this block up to the next list's place can reach the threshold
                goal = (block + 1) * BLOCK
                if pivot + 1 < len(order):
                    goal = min(goal, lists[order[pivot + 1]][0][0][at[order[pivot + 1]]])
                goal = max(goal, item + 1)
            else:
                score = sum(
                    lists[i][0][1][k] for i in order[: pivot + 1] if (k := _seek(lists[i][0][0], at[i], item)) is not None
                )
                if score >= threshold - 1e-12:
                    found.append((item, score))
                goal = item + 1
            for i in order[: pivot + 1]:
                ids, k = lists[i][0][0], at[i]
                while k < len(ids) and ids[k] < goal:
                    k += 1
                at[i] = k
            order = sorted((i for i in order if at[i] < len(lists[i][0][0])), key=lambda i: lists[i][0][0][at[i]])
        return found

    def overlap(self, item: Item, passage: np.ndarray) -> tuple[float, float]:
        """Share of the question's and of the answer's words that common shingles cover."""
        size = min(SHINGLE, len(item.words))
        hit = np.isin(shingles(item.words), shingles(passage, size))
        cover = np.zeros(len(item.words) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(hit), 1)
        np.add.at(cover, np.flatnonzero(hit) + size, -1)
        covered = np.cumsum(cover)[:-1] > 0
        q, a = covered[: item.question_words], covered[item.question_words :]
        return float(q.mean()) if len(q) else 1.0, float(a.mean()) if len(a) else 1.0

    def matches(self, words: np.ndarray, first: np.ndarray, threshold: float, question: float, answer: float):
        """(row, item, score, question overlap, answer overlap), the best passage of each pair."""
        at, term = self.terms(words)
        if not len(at):
            return []
        row = np.searchsorted(first, at, side="right") - 1
        place = (at - first[row]) // self.window
        # a word lies in the window that starts at its place and in the one before
        most = int(place.max()) + 2
        window = np.concatenate([row * most + place + 1, row * most + place])
        key = np.unique(window * len(self.vocabulary) + np.concatenate([term, term]))
        window, term = key // len(self.vocabulary), key % len(self.vocabulary)
        cuts = np.flatnonzero(np.diff(window, prepend=-1))
        reach = np.empty(len(cuts), bool)
        ends = np.append(cuts[1:], len(window))
        for lo in range(0, len(cuts), 4096):
            hi = min(lo + 4096, len(cuts))
            base = cuts[lo]
            sums = np.add.reduceat(self.block_max[term[base : ends[hi - 1]]], cuts[lo:hi] - base, axis=0)
            reach[lo:hi] = sums.max(axis=1) >= threshold - 1e-4
        best: dict[tuple[int, int], tuple] = {}
        for c in np.flatnonzero(reach).tolist():
            r, p = divmod(int(window[cuts[c]]), most)
            start = first[r] + max(0, p - 1) * self.window
            passage = words[start : min(first[r + 1], first[r] + (p + 1) * self.window)]
            for k, score in self.wand(term[cuts[c] : ends[c]].tolist(), threshold):
                q, a = self.overlap(self.items[k], passage)
                if q >= question and a >= answer and score > best.get((r, k), (0.0,))[0]:
                    best[r, k] = (score, q, a)
        return [(r, k, *v) for (r, k), v in best.items()]


def _seek(ids: list[int], k: int, item: int) -> int | None:
    while k < len(ids) and ids[k] < item:
        k += 1
    return k if k < len(ids) and ids[k] == item else None


def build_index(rows) -> Bm25Index | None:
    """Index of (item_id, text) rows; items without words are left out."""
    items = []
    for item_id, text in rows:
        question, answer = question_and_answer(text or "")
        (words, first) = word_hashes([question, answer])
        if len(words):
            items.append(Item(item_id, words, int(first[1])))
    return Bm25Index(items) if items else None


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.8, answer: float = 0.5, index_text: int = INDEX_TEXT, at_once: int = PASS
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every verified pair.

    All passages of all documents are asked. The benchmark is indexed in blocks of about
    ``index_text`` characters; ``at_once`` of them are broadcast together (their size is bounded by
    these two numbers) and asked in one pass over the documents. Null and empty texts on either
    side match nothing; repeated rows give repeated pairs; other columns are not looked at.
    """
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = docs.select("doc_id").schema.add("item_id", benchmark.schema["item_id"].dataType)
    for name in ("score", "question_overlap", "answer_overlap"):
        schema = schema.add(name, "double")
    result = docs.sparkSession.createDataFrame([], schema)
    for shared in broadcast_indexes(benchmark, index_text, at_once):

        def run(batches, shared=shared):
            for piece in pieces(batches):
                words = word_hashes(piece.column("text").to_pylist())
                for index in shared.value:
                    found = index.matches(*words, threshold, question, answer)
                    rows = pa.array([f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("doc_id").take(rows), pa.array([index.items[f[1]].item_id for f in found], item_type),
                            *(pa.array([f[n] for f in found], pa.float64()) for n in (2, 3, 4)),
                        ],
                        names=schema.names,
                    )

        result = result.unionAll(docs.select("doc_id", "text").mapInArrow(run, schema))
    return result


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, question: float = 0.8, answer: float = 0.5, index_text: int = INDEX_TEXT, at_once: int = PASS
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns stay as they are."""
    for shared in broadcast_indexes(benchmark, index_text, at_once):

        def run(batches, shared=shared):
            for piece in pieces(batches):
                words = word_hashes(piece.column("text").to_pylist())
                keep = np.ones(piece.num_rows, bool)
                for index in shared.value:
                    keep[[f[0] for f in index.matches(*words, threshold, question, answer)]] = False
                yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def broadcast_indexes(benchmark: DataFrame, index_text: int, at_once: int):
    """Broadcast lists of indexes that together hold all of ``benchmark``, one list after the other."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // index_text)
    for start in range(0, blocks, at_once):
        found = []
        for block in range(start, min(start + at_once, blocks)):
            part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
            found.append(build_index(part.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()))
        yield benchmark.sparkSession.sparkContext.broadcast([index for index in found if index is not None])
