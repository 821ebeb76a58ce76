"""Hard negatives by exact integer scores from products of residues.

Scores are inner products of integer vectors. Each vector is reduced modulo a few small primes;
the residue matrices are multiplied in float32, where sums stay below 2^24 and are exact; the
signed score is put together again by Chinese remaindering (Garner's mixed radix). How many primes
are needed follows from the largest component of the table.

The anchors (a stated set of queries) meet all rows in a grid of cells: an anchor goes to every
row group and a row to every anchor group, groups being hashes of the id, so no label or copied
vector makes a cell large. A cell holds its anchors and streams its rows, and returns a few rows
per anchor, which are merged by window. The grid is walked twice: for the positives, then for
the negatives that fall in the positives' score windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basepaths.session import cut_lineage

#: Anchors of a cell at most on average; with its residues some 10 MB at 64 dimensions.
ANCHOR_GROUP = 4096
#: Rows of a cell on average.
ROW_GROUP = 16384
#: Scores computed at once.
TILE = 1 << 20
#: Sums below this are exact in float32.
EXACT = 1 << 24
#: Scores stay below this, so that they and their multiples by 100 are exact in 64 bits.
MOST_SCORE = 1 << 55


class Residues:
    """Exact products of integer matrices by residue arithmetic.

    ``top`` bounds the absolute components and ``width`` the dimensions.
    """

    def __init__(self, top: int, width: int):
        self.bound = max(1, top) ** 2 * max(1, width)
        half = min(510, max(1, math.isqrt((EXACT - 1) // max(1, min(width, 64)))))
        self.chunk = max(1, (EXACT - 1) // half**2)
        self.primes: list[int] = []
        product, candidate = 1, 2 * half + 1
        while product <= 2 * self.bound:
            while any(candidate % d == 0 for d in range(2, math.isqrt(candidate) + 1)):
                candidate -= 1
            self.primes.append(candidate)
            product *= candidate
            candidate -= 1

    def split(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Balanced residues of int64 rows, one float32 matrix per prime."""
        out = []
        for p in self.primes:
            rest = vectors % p
            out.append(np.where(rest > p // 2, rest - p, rest).astype(np.float32))
        return out

    def _modular(self, a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
        total = None
        for at in range(0, max(1, a.shape[1]), self.chunk):
            part = (a[:, at : at + self.chunk] @ b[:, at : at + self.chunk].T).astype(np.int64) % p
            total = part if total is None else (total + part) % p
        return total

    def scores(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """int64 inner products of all rows of ``a`` with all rows of ``b``."""
        digits, moduli = [], []
        for x, y, p in zip(a, b, self.primes):
            rest = self._modular(x, y, p)
            weight = 1
            for digit, q in zip(digits, moduli):
                rest = (rest - digit * (weight % p)) % p
                weight *= q
            digits.append(rest * pow(weight, -1, p) % p if digits else rest)
            moduli.append(p)
        # Each digit is centred, so the number is the signed one of least size and no step passes 64 bits.
        value = np.zeros_like(digits[0])
        carry = np.zeros_like(digits[0])
        weight = 1
        for digit, p in zip(digits, moduli):
            digit = digit + carry
            high = digit > p // 2
            value += np.where(high, digit - p, digit) * (weight if weight < 1 << 63 else 0)
            carry = high.astype(np.int64)
            weight *= p
        return value


def integer_rows(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, x (array of long): the rows that take part.

    Left out are rows with a null id, label or vector, and those with a component that is null, not
    finite, or so large that a score could leave 64 bits. Of rows that share an id the smallest
    by label and vector is taken.
    """
    floored = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float(2**53 // scale))))
    fits = F.forall("x", lambda v: F.abs(v) <= F.floor(F.sqrt(F.lit(float(MOST_SCORE)) / F.greatest(F.lit(1), F.size("x")))))
    taken = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(finite).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), floored.alias("x")
    ).where(fits)
    return taken.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """int64 matrix of a list column; shorter vectors are filled with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return np.asarray(flat, np.int64).reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Cell:
    """The anchors of one cell with what they look for."""

    def __init__(self, batches: list[pa.RecordBatch], residues: Residues, width: int, limit: int, windows: bool):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda n: table.column(n).to_numpy()
        self.ids, self.labels, self.limit, self.windows = column("vec_id"), column("label"), limit, windows
        self.parts = residues.split(np.concatenate([matrix(b.column("x"), width) for b in batches]))
        self.residues = residues
        if windows:
            self.positives = table.column("positives").to_pylist()
        self.best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def keep(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        held = self.best.get(key)
        if held is not None:
            scores, ids = np.concatenate([held[0], scores]), np.concatenate([held[1], ids])
        order = np.lexsort((ids, -scores))[: self.limit]
        self.best[key] = scores[order], ids[order]

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        parts = self.residues.split(x)
        if self.windows:
            step = max(1, TILE // max(1, len(ids)))
            for at in range(0, len(self.ids), step):
                scores = self.residues.scores([p[at : at + step] for p in self.parts], parts)
                for row in range(len(scores)):
                    self.windowed(at + row, scores[row], ids, labels)
            return
        for label in np.intersect1d(self.labels, labels):
            mine, theirs = np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)
            step = max(1, TILE // len(theirs))
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                scores = self.residues.scores([p[some] for p in self.parts], [p[theirs] for p in parts])
                for row, anchor in enumerate(some):
                    self.first(int(anchor), scores[row], ids[theirs])

    def first(self, anchor: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """The highest scores of other rows of the label."""
        others = ids != self.ids[anchor]
        scores, ids = scores[others], ids[others]
        if len(scores) > self.limit:
            least = np.partition(scores, len(scores) - self.limit)[len(scores) - self.limit]
            held = self.best.get((anchor, 0))
            if held is not None and len(held[0]) == self.limit:
                least = max(least, held[0][-1])
            near = scores >= least
            scores, ids = scores[near], ids[near]
        if len(scores):
            self.keep((anchor, 0), scores, ids)

    def windowed(self, anchor: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """For each positive, the highest scores of other labels within its window."""
        wanted = self.positives[anchor]
        low = min(-(-w["low"] // 100) for w in wanted)
        high = max(w["high"] // 100 for w in wanted)
        near = np.flatnonzero((scores >= low) & (scores <= high) & (labels != self.labels[anchor]))
        if not len(near):
            return
        near = near[np.lexsort((ids[near], -scores[near]))]
        falling = -scores[near]
        for n, w in enumerate(wanted):
            start = np.searchsorted(falling, -(w["high"] // 100), "left")
            end = np.searchsorted(falling, -(-(-w["low"] // 100)), "right")
            some = near[start : min(end, start + self.limit)]
            if len(some):
                self.keep((anchor, n), scores[some], ids[some])

    def found(self) -> Iterator[tuple[int, int | None, int | None, int, int]]:
        for (anchor, n), (scores, ids) in self.best.items():
            w = self.positives[anchor][n] if self.windows else {"id": None, "score": None}
            for score, row in zip(scores.tolist(), ids.tolist()):
                yield int(self.ids[anchor]), w["id"], w["score"], row, score


_FOUND = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
_FOUND_ARROW = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "vec_id", "score")])
_WINDOWS = "array<struct<id:bigint,score:bigint,low:bigint,high:bigint>>"


def best_in_cells(anchors: DataFrame, rows: DataFrame, residues: Residues, width: int, grid: tuple[int, int], limit: int, windows: bool) -> DataFrame:
    """Every anchor against every row; ``limit`` rows per anchor (and window) from each cell."""
    across, down = grid

    def dealt(df: DataFrame, side: int, own: Column, copies: int) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        positives = F.col("positives") if side == 0 and windows else F.lit(None).cast(_WINDOWS)
        groups = (own.alias("a"), other.alias("r")) if side == 0 else (other.alias("a"), own.alias("r"))
        return df.select(*groups, F.lit(side).alias("side"), "vec_id", "label", "x", positives.alias("positives"))

    group = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    cells = dealt(anchors, 0, group(5, across), down).unionAll(dealt(rows, 1, group(6, down), across))
    ordered = cells.withColumn("cell", F.col("a") * down + F.col("r")).repartitionById(across * down, F.col("cell")).sortWithinPartitions("cell", "side")

    def run(batches):
        current, asking, cell = None, [], None

        def results():
            if cell is not None:
                rows = list(cell.found())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], schema=_FOUND_ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("cell").to_numpy() * 2 + batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                key, side = divmod(int(keys[start]), 2)
                if key != current:
                    yield from results()
                    current, asking, cell = key, [], None
                part = batch.slice(start, end - start)
                if side == 0:
                    asking.append(part)
                    continue
                if asking:
                    cell, asking = Cell(asking, residues, width, limit, windows), []
                if cell is not None:
                    cell.meet(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("x"), width))
        yield from results()

    return ordered.mapInArrow(run, _FOUND)


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchor_group: int = ANCHOR_GROUP,
    row_group: int = ROW_GROUP,
) -> DataFrame:
    """Negatives of each anchor whose score is ``low`` to ``high`` percent of a positive's.

    ``rows``: vec_id, label, x as ``integer_rows`` gives them; ``anchor`` marks the queries. An
    anchor's positives are its best ``positives`` other rows of the label; per positive the best
    ``negatives`` rows of other labels within the window are returned, ranked from 1. Higher scores come
    first, ties by smaller vec_id. An empty table, an anchor without other rows of its label and a
    positive without a row in its window give no rows. Vectors of different length are
    filled with zeros.
    """
    rows = cut_lineage(rows)
    facts = rows.agg(
        F.count("*").alias("n"), F.count(F.when(anchor, 1)).alias("a"), F.max(F.size("x")).alias("width"),
        F.max(F.greatest(F.coalesce(F.array_max("x"), F.lit(0)), -F.coalesce(F.array_min("x"), F.lit(0)))).alias("top"),
    ).first()
    width = facts["width"] or 0
    residues = Residues(int(facts["top"] or 0), width)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = max(1, -(-facts["a"] // anchor_group))
    grid = across, max(1, -(-facts["n"] // row_group), -(-tasks // across))
    asking = rows.where(anchor)

    by_score = [F.col("score").desc(), F.col("vec_id")]
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(*by_score))
    best = best_in_cells(asking, rows, residues, width, grid, positives, False)
    window = F.struct(
        F.col("vec_id").alias("id"), "score", (F.col("score") * low).alias("low"), (F.col("score") * high).alias("high")
    )
    wanted = cut_lineage(best.withColumn("place", place).where(F.col("place") <= positives).groupBy("anchor_id").agg(
        F.array_sort(F.collect_list(window)).cast(_WINDOWS).alias("positives")
    ))
    with_windows = asking.join(wanted, asking.vec_id == wanted.anchor_id).drop("anchor_id")
    found = best_in_cells(with_windows, rows, residues, width, grid, negatives, True)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(*by_score))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, embedding, label); other columns are not looked at.

    Anchors are the rows whose vec_id is divisible by 50; where it is divisible by 7, the label is first
    moved to (label + 1) % 10. Rows that ``integer_rows`` leaves out take no part.
    """
    rows = integer_rows(embeddings).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


SQL = """
with x as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda v: floor(256 * cast(v as double))) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda v: v is null or isnan(v) or isinf(v))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_inner_product(a.e, b.e) as bigint) as score
  from x a join x b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (select p.a, p.b, s.b as c, p.score as ps, s.score as ns,
    row_number() over (partition by p.a, p.b order by s.score desc, s.b) as r
  from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a as anchor_id, b as positive_id, cast(r as int) as rank, c as negative_id, ps as positive_score, ns as negative_score
from n where r <= 3"""
