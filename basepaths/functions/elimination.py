"""Exact solution of large symmetric systems by block elimination.

The matrix is held in square blocks spread over the tasks; only blocks of the lower half that
hold something are there. A step factors one diagonal block, solves the blocks below it and takes
their products off the blocks further down; right sides are one more row of blocks. The number of
steps is the number of block rows, whatever the numbers in the matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basepaths.session import cut_lineage

#: Unknowns of a block row on average; a block is 8 MB.
BLOCK = 1024
BLOCKS = "m int, i int, j int, rows int, columns int, a binary"


def unpack(row) -> np.ndarray:
    return np.frombuffer(row.a, np.float64).reshape(row.rows, row.columns)


def packed(m: int, i: int, j: int, block: np.ndarray) -> tuple:
    return int(m), int(i), int(j), block.shape[0], block.shape[1], np.ascontiguousarray(block, np.float64).tobytes()


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])


def _square(a: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(a, np.float64).reshape(rows, rows)


def cholesky(a: np.ndarray, scale: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower factor of a positive semidefinite matrix and which pivots are there.

    A pivot below ``tolerance`` times its first value (``scale``) depends on those before it: its row and column
    are left out, so its unknown is 0.
    """
    a, size = a.copy(), len(a)
    there = np.zeros(size, bool)
    for k in range(size):
        if a[k, k] > tolerance * max(scale[k], 1e-300):
            there[k] = True
            a[k, k] = np.sqrt(a[k, k])
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k])
        else:
            a[k:, k] = 0.0
            a[k, k] = 1.0
    return np.tril(a), there


def forward(lower: np.ndarray, there: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the transposed factor; left-out unknowns get 0."""
    out = np.linalg.solve(lower, rows.T).T if rows.size else rows.copy()
    out[:, ~there] = 0.0
    return out


def summed(blocks: DataFrame) -> DataFrame:
    """Blocks of one place added up, two at a time within a task."""

    def add(batches):
        for part in batches:
            held: dict[tuple, np.ndarray] = {}
            for row in part.itertuples():
                key = (row.m, row.i, row.j)
                held[key] = held[key] + unpack(row) if key in held else unpack(row)
            yield frame([packed(*key, block) for key, block in held.items()])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        return frame([packed(rows.m[0], rows.i[0], rows.j[0], sum(unpack(r) for r in rows.itertuples()))])

    return blocks.mapInPandas(add, BLOCKS).groupBy("m", "i", "j").applyInPandas(total, BLOCKS)


def eliminate(blocks: DataFrame, rows: int, tolerance: float = 1e-11) -> tuple[DataFrame, dict[int, int]]:
    """Solutions and ranks of the systems ``m``.

    ``blocks`` holds the lower halves in block rows 0 to ``rows`` - 1 and, in block row ``rows``, the
    transposed right sides. Returned are the transposed solutions as blocks (i = ``rows``, j), and the
    pivots per system.
    """
    spark = blocks.sparkSession
    left = cut_lineage(blocks)
    factors: list[DataFrame] = []
    ranks: dict[int, int] = {}
    # the first diagonal tells what a vanished pivot is
    scales = left.where("i = j").withColumn("i", F.lit(-1))

    for k in range(rows):

        def diagonal(one: pd.DataFrame) -> pd.DataFrame:
            """The factor of the diagonal block (i = k) and which of its pivots are there (i = -1)."""
            first = next(unpack(r) for r in one.itertuples() if r.i < 0)
            lower, there = cholesky(next(unpack(r) for r in one.itertuples() if r.i == k), np.diag(first), tolerance)
            return frame([packed(one.m[0], k, k, lower), packed(one.m[0], -1, k, there.astype(float)[None])])

        def solve(batches):
            for part in batches:
                yield frame([packed(r.m, r.i, r.j, forward(_square(r.la, r.lr), np.frombuffer(r.ta) > 0, unpack(r))) for r in part.itertuples()])

        here = left.where(f"i = {k} and j = {k}").unionByName(scales.where(F.col("j") == k))
        factor = cut_lineage(here.groupBy("m").applyInPandas(diagonal, BLOCKS))
        both = factor.where("i >= 0").select("m", F.col("rows").alias("lr"), F.col("a").alias("la")).join(
            factor.where("i = -1").select("m", F.col("a").alias("ta")), "m")
        below = cut_lineage(left.where((F.col("j") == k) & (F.col("i") > k)).join(both, "m").mapInPandas(solve, BLOCKS))
        factors.append(factor.unionByName(below))
        for row in factor.where("i = -1").collect():
            ranks[row["m"]] = ranks.get(row["m"], 0) + int(unpack(row).sum())
        if k + 1 < rows:
            pairs = below.select("m", F.col("i").alias("j"), F.col("rows").alias("jr"), F.col("columns").alias("jc"), F.col("a").alias("ja"))
            met = below.select("m", "i", "rows", "columns", "a").join(pairs.where(F.col("j") < rows), "m").where("i >= j")

            def products(batches):
                for part in batches:
                    yield frame([
                        packed(r.m, r.i, r.j, -unpack(r) @ np.frombuffer(r.ja, np.float64).reshape(r.jr, r.jc).T) for r in part.itertuples()
                    ])

            rest = left.where(F.col("j") > k)
            left = cut_lineage(summed(rest.unionByName(met.mapInPandas(products, BLOCKS))))

    solution: DataFrame | None = None
    for k in reversed(range(rows)):
        known = spark.createDataFrame([], BLOCKS) if solution is None else solution
        # the blocks of this block row that lie further down, beside the part of the solution they meet
        beside = known.select("m", F.col("j").alias("i"), F.col("a").alias("xa"), F.col("rows").alias("xr"), F.col("columns").alias("xc"))
        met = factors[k].where((F.col("i") > k) & (F.col("i") < rows)).join(beside, ["m", "i"])

        def products(batches):
            for part in batches:
                yield frame([packed(r.m, rows, k, -np.frombuffer(r.xa, np.float64).reshape(r.xr, r.xc) @ unpack(r)) for r in part.itertuples()])

        def back(one: pd.DataFrame) -> pd.DataFrame:
            at = {r.i: unpack(r) for r in one.itertuples() if r.i < rows}
            right = sum(unpack(r) for r in one.itertuples() if r.i == rows)
            there = at[-1][0] > 0
            solved = np.linalg.solve(at[k].T, np.where(there, right, 0.0).T).T
            return frame([packed(one.m[0], rows, k, np.where(there, solved, 0.0))])

        mine = factors[k].where(F.col("i").isin(-1, k, rows)).unionByName(met.mapInPandas(products, BLOCKS))
        solved = cut_lineage(mine.groupBy("m").applyInPandas(back, BLOCKS))
        solution = solved if solution is None else solution.unionByName(solved)
    return solution, ranks
