"""Shrinkage of small samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shrink(n: Column, k: float) -> Column:
    """Weight n / (n + k), zero without observations."""
    return F.when(n > 0, n / (n + F.lit(float(k)))).otherwise(F.lit(0.0))
