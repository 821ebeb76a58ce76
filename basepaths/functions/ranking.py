"""Exact numbering and ranking that never gathers a whole pool in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basepaths.session import cut_lineage

def ordered_number(df: DataFrame, keys: list[str], order: list[Column], output: str, tasks: int | None = None) -> DataFrame:
    """``row_number`` per ``keys`` by ``order``, exact for pools of any size.

    Rows are range partitioned by (keys, order) and written once, so a large pool or a large
    tie is spread over many tasks; the row counts of the ranges (a few per task) give each
    range its offset. ``order`` must end in a unique column.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(tasks, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_c")).select(
        *keys, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o")
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return ranged.join(offsets, [*keys, "_range"]).withColumn(output, F.col("_o") + inside).drop("_range", "_o")
