"""Ranked lexical search by MaxScore with bounds on pairs of terms.

The texts are read once: for each document its number of terms and its occurrences of query terms
are written to the shared folder, and document counts come from there. The table is then read in
shards; a shard is an index whose posting lists carry whole impacts. Terms of an item are paired, most
telling with next most telling. For every pair the shard stores the list of documents that hold both,
with the largest joint impact. What a pair adds to a score is at most the largest of that and
of its two single maxima, which is below their sum unless the best documents of both are the same. The
bounds of an item's pairs decide which pairs open candidates, and which candidates can still
reach the score of the last place; all others are skipped. Scores are exact integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from basepaths.llm.arrow_text import byte_rows, pieces
from basepaths.llm.words import IN_WORD, hashed
from basepaths.session import cut_lineage

#: Bytes of query text per pass over the documents; bounds what is broadcast (a larger single item is a pass of its own).
QUERY_TEXT = 1 << 20
#: Postings of a shard, some 50 MB with its index.
SHARD = 1 << 21
#: Longer texts are read in parts.
PART = 4 << 20
#: Groups in which the lists of the tasks are merged before the last merge.
MERGE = 64

_LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\0", bytes(range(97, 123)) + b" ")


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and the text each belongs to."""
    values, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    group: list[bytes] = []
    rows: list[int] = []

    def flush():
        data = np.frombuffer(b"\0".join(group) + b"\0", np.uint8)
        found, first = hashed(data, len(group))
        values.append(found)
        owners.append(np.repeat(np.asarray(rows, np.int64), np.diff(first)))

    held = 0
    for row, text in enumerate(texts):
        for part in _parts(text.translate(_LOWER)):
            group.append(part)
            rows.append(row)
            held += len(part)
            if held >= PART:
                flush()
                group, rows, held = [], [], 0
    if group:
        flush()
    return np.concatenate(values), np.concatenate(owners)


def _parts(text: bytes) -> list[bytes]:
    """A long text cut between terms."""
    out, start = [], 0
    while len(text) - start > PART:
        data = np.frombuffer(text, np.uint8, offset=start)
        outside = np.flatnonzero(~IN_WORD[data[:PART]])
        if len(outside):
            end = start + int(outside[-1]) + 1
        else:
            rest = np.flatnonzero(~IN_WORD[data])
            end = start + int(rest[0]) + 1 if len(rest) else len(text)
        out.append(text[start:end])
        start = end
    out.append(text[start:])
    return out


class Items:
    """Query items of one pass: their ids and, per item, the places of its terms in ``vocabulary``."""

    def __init__(self, rows):
        by_id: dict = {}
        for item_id, text in rows:
            by_id.setdefault(item_id, []).append(bytes(text or b""))
        self.ids = list(by_id)
        found = [np.unique(term_hashes(texts)[0]) for texts in by_id.values()]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
        self.terms = [np.searchsorted(self.vocabulary, f) for f in found]

    def weigh(self, weights: np.ndarray) -> None:
        """Sets the weights, and pairs the terms of every item by falling weight; terms of weight 0 add nothing."""
        self.weights = weights
        self.units: list[list[tuple[int, ...]]] = []
        for terms in self.terms:
            telling = terms[weights[terms] > 0]
            order = telling[np.lexsort((telling, -weights[telling]))].tolist()
            self.units.append([tuple(order[n : n + 2]) for n in range(0, len(order), 2)])
        self.pairs = sorted({u for units in self.units for u in units if len(u) == 2})


def occurrences(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms of the text), terms and times (places in ``vocabulary`` and how often) of every document."""
    schema = docs.select("doc_id").schema.add("n", "long")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        words = shared.value
        for piece in pieces(batches):
            values, row = term_hashes(byte_rows(piece.column("text")))
            n = np.bincount(row, minlength=piece.num_rows)
            at = np.searchsorted(words, values)
            hit = np.zeros(len(at), bool)
            inside = at < len(words)
            hit[inside] = words[at[inside]] == values[inside]
            key, times = np.unique(row[hit] * max(1, len(words)) + at[hit], return_counts=True)
            owner, term = np.divmod(key, max(1, len(words)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=piece.num_rows))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                ],
                names=["doc_id", "n", "terms", "times"],
            )

    kind = schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, times array<int>")


class Shard:
    """Posting lists of some documents with impacts, and the lists of documents that hold both terms of a pair."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, size: int, items: Items):
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts, self.size = docs[order], impacts[order], size
        self.edges = np.searchsorted(terms[order], np.arange(len(items.vocabulary) + 1))
        self.most = np.zeros(len(items.vocabulary), np.int64)
        full = np.flatnonzero(np.diff(self.edges))
        if len(full):
            self.most[full] = np.maximum.reduceat(self.impacts, self.edges[full])
        self.total = np.zeros(size, np.int64)
        self.both: dict[tuple[int, ...], tuple[np.ndarray, int]] = {}
        for pair in items.pairs:
            self.both[pair] = self._intersect(*pair)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.edges[term], self.edges[term + 1])
        return self.docs[span], self.impacts[span]

    def _intersect(self, a: int, b: int) -> tuple[np.ndarray, int]:
        """Documents that hold both terms, and their largest joint impact."""
        (few, impact), (many, other) = sorted((self.postings(a), self.postings(b)), key=lambda p: len(p[0]))
        if not len(few):
            return few, 0
        at = np.minimum(np.searchsorted(many, few), len(many) - 1)
        met = many[at] == few
        return few[met], int((impact[met] + other[at[met]]).max(initial=0))

    def bound(self, unit: tuple[int, ...]) -> int:
        """The most that the terms of ``unit`` add to any score."""
        single = max(int(self.most[t]) for t in unit)
        return single if len(unit) == 1 else max(single, self.both[unit][1])

    def search(self, units: list[tuple[int, ...]], least: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (with scores) that may be among the ``limit`` best, all that reach ``least`` or tie with the last."""
        bounds = np.array([self.bound(u) for u in units], np.int64)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rest = np.concatenate([np.cumsum(bounds[order][::-1])[::-1], [0]])
        total, touched = self.total, []
        found = np.zeros(0, np.int64)
        opening = True
        for n, unit in enumerate(order):
            if opening and rest[n] < least:
                opening = False
            if not opening:
                found = found[total[found] + rest[n] >= least]
                if not len(found):
                    break
            for term in units[unit]:
                docs, impacts = self.postings(term)
                if opening or len(docs) < 8 * len(found):
                    total[docs] += impacts
                    touched.append(docs)
                else:
                    at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    met = docs[at] == found
                    total[found[met]] += impacts[at[met]]
            if opening:
                found = np.flatnonzero(total)
            if len(found) > limit:
                least = max(least, int(np.partition(total[found], len(found) - limit)[len(found) - limit]))
        scores = total[found].copy()
        for docs in touched:
            total[docs] = 0
        total[found] = 0
        good = scores >= max(1, least)
        return found[good], scores[good]


class Best:
    """The best documents so far of every item."""

    def __init__(self, items: int, limit: int):
        self.limit = limit
        self.held = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in range(items)]

    def least(self, item: int) -> int:
        scores = self.held[item][2]
        return int(scores[-1]) if len(scores) == self.limit else 0

    def add(self, item: int, ids: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> None:
        ids, nulls, scores = (np.concatenate(pair) for pair in zip(self.held[item], (ids, nulls, scores)))
        order = np.lexsort((ids, nulls, -scores))[: self.limit]
        self.held[item] = ids[order], nulls[order], scores[order]


def impact_of(times: np.ndarray, n: np.ndarray, weights: np.ndarray, count: int, total: int) -> np.ndarray:
    """What a term adds to the score of a document of ``n`` terms that holds it ``times`` times; 64-bit integers."""
    m = 100 - 50 + 50 * n * count // total
    return weights * (1_000_000_000 * times // (1000 * times + 20 * m))


def searched(postings: DataFrame, items: Items, count: int, total: int, limit: int, shard: int) -> DataFrame:
    """The ``limit`` best documents of every item from each task."""
    item_type = to_arrow_type(items.kind)
    shared = postings.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        asked = shared.value
        best = Best(len(asked.ids), limit)
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= shard:
                _ask(held, asked, best)
                held, size = [], 0
        _ask(held, asked, best)
        for n, (ids, nulls, scores) in enumerate(best.held):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([asked.ids[n]] * len(ids), item_type), pa.array(ids, pa.int64(), mask=nulls), pa.array(scores, pa.int64())],
                    names=["item_id", "doc_id", "score"],
                )

    def _ask(held, asked, best):
        if not held:
            return
        column = lambda name: np.concatenate([b.column(name).flatten().to_numpy() for b in held])
        sizes = np.concatenate([np.diff(b.column("terms").offsets.to_numpy()) for b in held])
        n = np.concatenate([b.column("n").to_numpy() for b in held])
        ids = np.concatenate([b.column("doc_id").cast(pa.int64()).fill_null(2**63 - 1).to_numpy() for b in held])
        nulls = np.concatenate([b.column("doc_id").is_null().to_numpy(zero_copy_only=False) for b in held])
        docs, terms = np.repeat(np.arange(len(n)), sizes), column("terms").astype(np.int64)
        impacts = impact_of(column("times").astype(np.int64), n[docs], asked.weights[terms], count, total)
        some = impacts > 0
        index = Shard(docs[some], terms[some], impacts[some], len(n), asked)
        for item, units in enumerate(asked.units):
            found, scores = index.search(units, best.least(item), limit)
            if len(found):
                best.add(item, ids[found], nulls[found], scores)

    kind = items.kind.simpleString()
    return postings.where("n > 0").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def ranked(
    docs: DataFrame, benchmark: DataFrame, limit: int = 50, query_text: int = QUERY_TEXT, shard: int = SHARD
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``limit`` best documents of every item of ``benchmark``.

    A term is a run of letters, digits and non-ASCII bytes with A-Z lowered. N documents hold terms, L in
    all, n in one; df hold the term. Weight w = floor(1000 ln((2N + 2) / (2 df + 1))); m = 50 + 50 n N div L;
    the score sums w * (10^9 tf div (1000 tf + 20 m)) over an item's distinct terms. Only scores above 0 count; ties go
    by ascending doc_id, null last. Null and empty texts hold no terms. Each row of ``docs`` is a document,
    also where ids repeat; rows of ``benchmark`` that share an item_id are one item. Empty tables give no rows;
    other columns are not looked at. Items are asked in passes of ``query_text`` bytes.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    result = spark.createDataFrame([], f"item_id {kind.simpleString()}, doc_id long, score long")
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = -(-size // query_text)
    for number in range(passes):
        part = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        items = Items(part.select("item_id", F.encode("text", "UTF-8")).toLocalIterator())
        if not len(items.vocabulary):
            continue
        items.kind = kind
        postings = cut_lineage(occurrences(docs, items.vocabulary))
        count, total = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        if not count:
            continue
        held_by = np.zeros(len(items.vocabulary), np.int64)
        for row in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("c")).toLocalIterator():
            held_by[row["t"]] = row["c"]
        items.weigh(np.array([math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) for df in held_by.tolist()], np.int64))
        result = result.unionAll(searched(postings, items, count, total, limit, shard))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    group = F.pmod(F.xxhash64("doc_id"), F.lit(MERGE))
    some = result.withColumn("_g", group).withColumn("_r", F.row_number().over(Window.partitionBy("item_id", "_g").orderBy(*order)))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return some.where(F.col("_r") <= limit).select("item_id", "doc_id", "score", place.alias("rank")).where(F.col("rank") <= limit).select(
        "item_id", "rank", "doc_id", "score"
    )


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

SQL = f"""
with q as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
d as (select row_number() over () as row, doc_id, {_TERMS} as words from documents),
c as (select count(*) as cn, cast(sum(len(words)) as bigint) as cl from d where len(words) > 0),
t as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, len(words) as n, unnest(words) as term from d) a group by all),
f as (select term, cast(floor(1000 * ln((2 * any_value(cn) + 2) / (2 * count(*) + 1))) as bigint) as w from t, c where term in (select term from q) group by term),
s as (select item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * cn) // cl)))) as bigint) as score
  from t join f using (term) join q using (term), c group by item_id, row, doc_id)
select item_id, cast(rank as int) as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0) a where rank <= 50"""
