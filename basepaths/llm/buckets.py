"""Buckets of rows to compare, with hot buckets dealt out over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, bucket: str, member: str, tile: int) -> DataFrame:
    """``rows`` with ``tile_a``, ``tile_b`` and ``side``: the group to compare them in and their tile.

    A bucket of m rows is cut into ceil(m / tile) tiles by a hash of ``member``; each unordered
    pair of tiles forms a group, so any two rows of a bucket meet in exactly one group with
    different tiles, or in the group of their common tile. Groups hold about 2 x ``tile`` rows
    whatever the size of the bucket. Buckets of one row are left out.
    """
    counts = rows.groupBy(F.col(bucket).alias("_k")).agg(F.count("*").alias("_m")).where("_m > 1")
    joined = rows.join(counts, F.col(bucket) == F.col("_k")).drop("_k")
    tiles = F.ceil(F.col("_m") / F.lit(tile)).cast("int")
    placed = joined.withColumn("_n", tiles).withColumn("side", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_n")).cast("int"))
    met = placed.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return met.select(
        *rows.columns, "side", F.least("side", "_y").cast("int").alias("tile_a"), F.greatest("side", "_y").cast("int").alias("tile_b")
    )


def gathered(rows: DataFrame, bucket: str, *order: str) -> DataFrame:
    """Rows of a group side by side within one task, ``order`` within the group."""
    keys = [bucket, "tile_a", "tile_b"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


class Forest:
    """Union-find over the rows of one group."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """True if ``x`` and ``y`` were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True
