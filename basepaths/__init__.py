"""Play-by-play analytics on Spark: DataFrame-in, DataFrame-out operators."""
