"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source shall be taken ``target / source_size`` times. The whole part is
certain; the fractions are rounded in pairs: word mass moves at random between two fractional
documents, without changing either expectation, until one of them is 0 or 1. The mass of a
pair stays the same, so a source misses its target by less than one document. Pairs are formed
inside buckets of a fixed mean size; each bucket leaves at most one fraction, and the
fractions of the buckets are paired again, level by level, up to one bucket per source. Large
documents go first, so that what is left over at the end is small.
Random numbers are hashes of ids and levels, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basepaths.functions.ranking import ordered_number
from basepaths.session import cut_lineage

BUCKET_ROWS = 4096
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
TINY = 1e-9


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, rows, target) from rows of (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target over ``most`` times its source's size stops there and the excess is shared
    again by weight among the others.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    placed = ordered_number(
        sums.withColumn("_all", F.lit(0)).withColumn("_null", F.col("source").isNull()), ["_all"], [F.col("_null"), F.col("source")], "place"
    )
    turns = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut_lineage(
        placed.withColumn("weight", F.element_at(turns, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most))).drop("_all", "_null", "place")
    )
    level = None
    while True:
        # the level at which weight x level meets the cap decides who stops there
        stopped = F.lit(False) if level is None else F.col("cap") < F.col("weight") * F.lit(level)
        row = sources.select("*", stopped.alias("full")).agg(
            F.sum("source_size").alias("all"), F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).alias("used"),
            F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0.0)).alias("weight"),
        ).first()
        if not row["all"] or not row["weight"]:
            level = level or 0.0
            break
        raised = (row["all"] - row["used"]) / row["weight"]
        if level is not None and raised <= level * (1 + 1e-15):
            break
        level = raised
    return sources.select("source", "source_size", "rows", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def uniform(doc_id, level: int, seed: int) -> float:
    return xxhash.xxh64_intdigest(f"{seed}|{level}|{doc_id}") / 2.0**64


def move(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """Fractions of two documents of ``s`` and ``t`` words after mass moved until one is 0 or 1."""
    gain, loss = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    moved = gain if u * (gain + loss) < loss else -loss
    p, q = p + moved / s, q - moved / t
    snap = lambda x: 0.0 if x < TINY else 1.0 if x > 1 - TINY else x
    return snap(p), snap(q)


def _pivot(level: int, seed: int, last: bool):
    """Settle the rows of each (source, bucket) as they stream by; one open row is held."""

    def emit(rows: pa.RecordBatch, fractions: list[float], settled: bool) -> pa.RecordBatch:
        names = [n for n in rows.schema.names if n not in ("_p", "_settled")]
        return pa.RecordBatch.from_arrays(
            [*(rows.column(n) for n in names), pa.array(fractions, pa.float64()), pa.array([settled] * rows.num_rows, pa.bool_())],
            names=[*names, "_p", "_settled"],
        )

    def close(held):
        row, p, doc, _ = held
        if last:
            return emit(row, [1.0 if uniform(doc, level + 1000, seed) < p else 0.0], True)
        return emit(row, [p], False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = None, None
        for batch in batches:
            names = ("source", "_bucket", "doc_id", "size", "_p")
            columns = [batch.column(n).to_pylist() for n in names]
            value, done, place = list(columns[4]), [True] * batch.num_rows, None
            for i, (source, bucket, doc, size, p) in enumerate(zip(*columns)):
                if (source, bucket) != group:
                    if held:
                        if held[0] is None:
                            done[place] = False
                            held = (batch.slice(place, 1), *held[1:])
                        yield close(held)
                    group, held, place = (source, bucket), None, None
                if p in (0.0, 1.0):
                    continue
                if held is None:
                    held, place = (None, p, doc, size), i
                    continue
                row, q, other, t = held
                p, q = move(p, size, q, t, uniform(doc, level, seed))
                if q in (0.0, 1.0):
                    if row is None:
                        value[place] = q
                    else:
                        yield emit(row, [q], True)
                    held, place = (None, p, doc, size), i
                    if p in (0.0, 1.0):
                        held, place, value[i] = None, None, p
                else:
                    held, value[i] = (row, q, other, t), p
            if held and held[0] is None:
                done[place] = False
                held = (batch.slice(place, 1), *held[1:])
                place = None
            kept = [i for i, d in enumerate(done) if d]
            if kept:
                yield emit(batch.take(pa.array(kept, pa.int64())) if len(kept) < batch.num_rows else batch, [value[i] for i in kept], True)
        if held:
            yield close(held)

    return run


def mix(rows: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES, bucket_rows: int = BUCKET_ROWS, seed: int = 20) -> DataFrame:
    """``rows`` (doc_id, source, size and any others) with source_size, target and taken.

    ``taken`` is size x copies. Rows of size 0 take 0 words; null sources form one source, the
    last; null ids are allowed; repeated rows are mixed as rows of their own. An empty table
    gives an empty result. Columns named source_size, target or taken are replaced.
    """
    rows = rows.drop("source_size", "target", "taken")
    sources = source_targets(rows.select("source", "size"), weights, most)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    parts = sources.withColumn("_f", wanted).withColumn("_whole", F.floor(F.col("_f") + TINY).cast("double")).select(
        F.col("source").alias("_s"), "source_size", "target", "_whole", (F.col("_f") - F.col("_whole")).alias("_part"), "rows"
    )
    part = F.when((F.col("_part") < TINY) | (F.col("size") == 0), 0.0).otherwise(F.col("_part"))
    open_rows = rows.join(parts, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_p", part).withColumn(
        "_buckets", F.ceil(F.col("rows") / F.lit(bucket_rows))
    ).withColumn("_order", F.xxhash64("doc_id", "size", F.lit(seed))).drop("_s", "_part", "rows").withColumn("_settled", F.lit(False))
    most_buckets = sources.agg(F.max(F.ceil(F.col("rows") / F.lit(bucket_rows)))).first()[0] or 1
    level, done = 0, None
    while True:
        last = most_buckets == 1
        bucket = F.pmod(F.xxhash64(F.col("_order"), F.lit(level)), F.col("_buckets"))
        dealt = open_rows.drop("_bucket").withColumn("_bucket", bucket)
        grouped = dealt.repartition("source", "_bucket").sortWithinPartitions("source", "_bucket", F.desc("size"), "_order", "doc_id")
        kinds = {f.name: f for f in grouped.schema}
        names = [n for n in grouped.columns if n not in ("_p", "_settled")] + ["_p", "_settled"]
        schema = type(grouped.schema)([kinds[n] for n in names])
        written = cut_lineage(grouped.mapInArrow(_pivot(level, seed, last), schema))
        settled = written.where("_settled")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        open_rows = written.where("not _settled").withColumn("_buckets", F.ceil(F.col("_buckets") / F.lit(bucket_rows)))
        most_buckets = -(-most_buckets // bucket_rows)
        level += 1
    taken = ((F.col("_whole") + F.col("_p")) * F.col("size")).cast("long")
    return done.withColumn("taken", taken).drop("_whole", "_p", "_buckets", "_order", "_settled", "_bucket")


def mix_documents(docs: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Documents with size (words), source_size, target and taken; ``keep`` names further columns to carry."""
    keep = tuple(k for k in keep if k not in ("doc_id", "source"))
    rows = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"))
    return mix(rows, **options).select("doc_id", *keep, "source", "size", "source_size", "target", "taken")
