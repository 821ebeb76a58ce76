"""Run expectancy by base-out state, run values, linear weights and game bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basepaths.session import cut_lineage

PRIOR = 20.0


def annotate_runs_remaining(events: DataFrame) -> DataFrame:
    """Runs from each event to the end of its half-inning, with and without the event."""
    rest = (
        Window.partitionBy("canonical_id", "inning", "half")
        .orderBy("event_order")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    runs = F.coalesce(F.col("runs_scored"), F.lit(0)).cast("bigint")
    before = F.sum(runs).over(rest)
    return events.withColumn("runs_remaining_before", before).withColumn(
        "runs_remaining_after", F.col("runs_remaining_before") - runs
    )


def state_label(outs: Column, bases: Column) -> Column:
    occupied = F.concat(
        *[F.when(bases.bitwiseAND(bit) > 0, str(base)).otherwise("") for base, bit in ((1, 1), (2, 2), (3, 4))]
    )
    return F.concat(
        outs.cast("string"), F.lit(" outs, "), F.when(bases == 0, F.lit("empty")).otherwise(occupied)
    )


def state_grid(spark: SparkSession) -> DataFrame:
    """The 24 base-out states."""
    return spark.range(1, numPartitions=1).select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("outs")).select(
        "outs", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bases")
    )


def state_sums(annotated: DataFrame, *keys: str) -> DataFrame:
    """Count and sum of runs remaining per state; a state outside the 24 raises."""
    outs, bases = F.col("outs_before"), F.col("bases_before")
    legal = outs.between(0, 2) & bases.between(0, 7)
    checked = annotated.select(
        *keys,
        F.when(legal, outs).otherwise(F.raise_error(F.lit("outs_before must be 0..2 and bases_before 0..7")).cast("int")).alias("outs"),
        bases.alias("bases"),
        "runs_remaining_before",
    )
    return checked.groupBy(*keys, "outs", "bases").agg(
        F.count("*").alias("n"), F.sum("runs_remaining_before").cast("double").alias("total")
    )


def smooth_states(sums: DataFrame, prior: float = PRIOR, keys: tuple[str, ...] = ()) -> DataFrame:
    """All 24 cells with raw mean, outs-level prior and smoothed expectancy.

    ``sums`` has at most 24 rows per key, so grouping its rows by key stays small.
    """
    if prior < 0:
        raise ValueError("the prior counts as so many events and must be 0 or more")
    spark = sums.sparkSession
    per_outs = sums.groupBy(*keys, "outs").agg(F.sum("n").alias("on"), F.sum("total").alias("ot"))
    overall = sums.groupBy(*keys).agg(F.sum("n").alias("gn"), F.sum("total").alias("gt"))
    if keys:
        grid = overall.select(
            *keys, (F.col("gt") / F.col("gn")).alias("gm"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("outs")
        ).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bases"))
    else:
        mean = overall.select((F.col("gt") / F.col("gn")).alias("gm")).scalar()
        grid = state_grid(spark).withColumn("gm", mean)
    filled = grid.join(sums, [*keys, "outs", "bases"], "left").join(per_outs, [*keys, "outs"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    prior_mean = F.coalesce(F.col("ot") / F.col("on"), F.col("gm"))
    weight = n + F.lit(float(prior))
    smoothed = F.when(weight > 0, (F.coalesce(F.col("total"), F.lit(0.0)) + float(prior) * prior_mean) / F.nullif(weight, F.lit(0.0))).otherwise(prior_mean)
    return filled.select(
        *keys,
        "outs", "bases",
        state_label(F.col("outs"), F.col("bases")).alias("state"),
        n.cast("bigint").alias("sample_size"),
        (F.col("total") / F.col("n")).alias("raw_re"),
        prior_mean.alias("outs_prior_re"),
        F.lit(float(prior)).alias("prior_pseudocount"),
        smoothed.alias("smoothed_re"),
    )


def estimate_re24(annotated: DataFrame, prior: float = PRIOR) -> DataFrame:
    return smooth_states(state_sums(annotated), prior)


def re_map(re24: DataFrame) -> Column:
    """The 24 cells as one map column ``outs * 8 + bases -> value`` (a scalar subquery)."""
    entries = F.collect_list(F.struct(F.col("outs") * 8 + F.col("bases"), F.col("smoothed_re")))
    return re24.agg(F.map_from_entries(entries).alias("re")).scalar()


def re_value(table: Column, outs: Column, bases: Column) -> Column:
    """Expectancy of a state, zero from the third out on."""
    return F.when(outs >= 3, F.lit(0.0)).otherwise(F.element_at(table, outs * 8 + bases))


def add_run_values(events: DataFrame, re24: DataFrame) -> DataFrame:
    """run_value = runs + RE(after) - RE(before); the 24 cells travel as one literal map."""
    table = F.col("_re")
    before = re_value(table, F.col("outs_before"), F.col("bases_before"))
    after = re_value(table, F.col("outs_after"), F.col("bases_after"))
    runs = F.coalesce(F.col("runs_scored"), F.lit(0)).cast("double")
    return (
        events.withColumn("_re", re_map(re24))
        .withColumns({"re_before": before, "re_after": after})
        .withColumn("run_value", runs + F.col("re_after") - F.col("re_before"))
        .drop("_re")
    )


def event_linear_weights(valued: DataFrame, *keys: str) -> DataFrame:
    return (
        valued.where(F.col("event_type").isNotNull())
        .groupBy(*keys, "event_type")
        .agg(F.count("*").alias("sample_size"), F.avg("run_value").alias("linear_weight"))
    )


def poisson_steps(digits: int = 16) -> list[int]:
    """From which ``digits``-bit number on a Poisson variable of mean 1 is at least 1, 2, 3, ..."""
    top, total, term, steps = 1 << digits, 0.0, math.exp(-1.0), []
    while round(top * (total + term)) < top:
        total += term
        steps.append(round(top * total))
        term /= len(steps)
    return steps


#: Replicates that share one hash of a game: 64 hexadecimal digits, four for each.
BLOCK = 16


def resampling_counts(game: Column, block: Column, seed: int) -> Column:
    """How often each of the ``BLOCK`` replicates of ``block`` takes the game: Poisson numbers of mean 1 from the digits of sha256."""
    steps = F.array(*[F.lit(v) for v in poisson_steps()])
    digits = F.sha2(F.concat(F.lit(f"{seed}|"), game, F.lit("|"), block.cast("string")), 256)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.conv(digits.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    return F.transform(numbers, lambda v: F.size(F.filter(steps, lambda t: t <= v)))


def bootstrap_re24(
    annotated: DataFrame, prior: float = PRIOR, replicates: int = 500, seed: int = 20260704
) -> DataFrame:
    """Percentile intervals from resampling whole games.

    Every game is reduced to its state sums and gets an array of counts, how often each
    replicate takes it (Poisson bootstrap: the size of a replicate varies around the number of games).
    Sums for the replicates of an array are taken side by side and before the shuffle, so a task shuffles
    24 x replicates numbers whatever the number of games. A replicate that takes no game is left out.
    """
    cells = F.array_sort(F.collect_list(F.struct("outs", "bases", "n", "total")))
    games = state_sums(annotated, "canonical_id").groupBy("canonical_id").agg(cells.alias("cells"))
    blocks = games.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))))
    counted = blocks.withColumn("times", resampling_counts(F.col("canonical_id"), F.col("block"), seed))
    drawn = counted.select("block", "times", F.explode("cells").alias("c"))
    weighed = [F.array(*[F.sum(F.col(f"c.{v}") * F.col("times")[i]) for i in range(BLOCK)]).alias(v) for v in ("n", "total")]
    sums = drawn.groupBy("block", F.col("c.outs").alias("outs"), F.col("c.bases").alias("bases")).agg(*weighed)
    # from here on the size is fixed: 24 cells x replicates
    each = cut_lineage(sums).select("block", "outs", "bases", F.posexplode(F.arrays_zip("n", "total")).alias("i", "s"))
    replicate = F.col("block") * BLOCK + F.col("i")
    resampled = each.select(replicate.alias("replicate"), "outs", "bases", "s.n", "s.total").where((F.col("n") > 0) & (F.col("replicate") < replicates))
    smoothed = smooth_states(resampled, prior, keys=("replicate",))
    bounds = F.percentile("smoothed_re", F.array(F.lit(0.025), F.lit(0.975)))
    return smoothed.groupBy("outs", "bases").agg(bounds.alias("q")).select(
        "outs", "bases", F.col("q")[0].alias("re_low"), F.col("q")[1].alias("re_high")
    )


def re24_summary(re24: DataFrame) -> DataFrame:
    seen = F.col("sample_size") > 0
    return re24.agg(
        F.count_if(seen).alias("states_observed"),
        F.min("sample_size").alias("minimum_state_sample"),
        F.max("sample_size").alias("maximum_state_sample"),
    )
