"""File fingerprints of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Manifest entries whose file is missing or differs."""
    now = current.select("path", F.col("sha256").alias("_now"))
    return manifest.join(now, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_now"))).withColumn(
        "problem", F.when(F.col("_now").isNull(), "missing").otherwise("changed")
    ).drop("_now")
