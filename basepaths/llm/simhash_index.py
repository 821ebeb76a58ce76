"""SimHash near-dedup over a Gray-ordered hierarchical index.

Fingerprints are taken over shingles of words. Distinct fingerprints are dealt out by
pigeonhole: within ``bits`` differing bits, two fingerprints agree on one of ``bits + 1`` blocks
of the word, so they share a bucket. Each bucket is sorted by Gray rank, so that neighbours
share most bits; leaves of consecutive fingerprints and the nodes above them keep the bits that
all their members share (a mask and a pattern), each node only those its parent does not have.
Two groups are compared from the top; shared bits that differ add up on the way down, and a
pair of groups is left as soon as the sum is over ``bits``. A bucket hands on only the links of
a spanning forest, which have the same components as all its links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basepaths.llm.arrow_text import by_group, byte_rows, pieces
from basepaths.llm.buckets import Forest, gathered, tiled
from basepaths.functions.graph import components
from basepaths.session import cut_lineage

SEED = 42
FANOUT = 8
TILE = 512


def fingerprint(text: bytes, words: int = 4) -> int:
    """64-bit SimHash of the ``words``-word shingles (XXH64, seed 42) of the ASCII-lower-cased text."""
    spaced = b" ".join(text.lower().split())
    if not spaced:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32), len(spaced))
    if len(ends) <= words:
        return xxhash.xxh64_intdigest(spaced, SEED)
    starts = np.append(0, ends[:-1] + 1)[: len(ends) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    ends = ends[words - 1 :].tolist()
    for at in range(0, len(starts), 65536):
        hashes = np.array([digest(spaced[s:e], SEED) for s, e in zip(starts[at : at + 65536], ends[at : at + 65536])], dtype=np.uint64)
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, keep: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """``keep`` and ``name`` (the 64 bits as a signed long) of every row."""
    schema = docs.select(*keep).schema

    def run(batches):
        for piece in pieces(batches):
            found = np.array([fingerprint(t, words) for t in byte_rows(piece.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(k) for k in keep), pa.array(found.view(np.int64))], names=[*keep, name]
            )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema.add(name, "long"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each code word in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy of shared bits over fingerprints in Gray order."""

    def __init__(self, values: np.ndarray):
        self.values = values
        masks, patterns = np.full(len(values), ~np.uint64(0)), values
        self.levels = []
        while True:
            self.levels.append((masks, patterns))
            if len(masks) == 1:
                break
            cuts = np.arange(0, len(masks), FANOUT)
            ones = np.bitwise_and.reduceat(masks & patterns, cuts)
            zeros = np.bitwise_and.reduceat(masks & ~patterns, cuts)
            masks, patterns = ones | zeros, ones
        # a node keeps only the bits its parent does not share already
        for level in range(len(self.levels) - 1):
            own, pattern = self.levels[level]
            above = self.levels[level + 1][0]
            own = own & ~above[np.arange(len(own)) // FANOUT]
            self.levels[level] = (own, pattern & own)

    def near(self, queries: np.ndarray, bits: int, block: int = 1 << 16):
        """Index pairs (query, value) of at most ``bits`` differing bits, in blocks of queries."""
        for start in range(0, len(queries), block):
            q = np.arange(start, min(start + block, len(queries)))
            masks, patterns = self.levels[-1]
            cost = np.bitwise_count((queries[q] ^ patterns[0]) & masks[0]).astype(np.int64)
            node = np.zeros(len(q), np.int64)
            alive = cost <= bits
            q, node, cost = q[alive], node[alive], cost[alive]
            for masks, patterns in self.levels[-2::-1]:
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, cost = np.repeat(q, FANOUT), np.repeat(cost, FANOUT)
                real = child < len(masks)
                q, cost, child = q[real], cost[real], child[real]
                cost = cost + np.bitwise_count((queries[q] ^ patterns[child]) & masks[child])
                alive = cost <= bits
                q, node, cost = q[alive], child[alive], cost[alive]
            yield q, node


def forest_links(values: np.ndarray, side: np.ndarray, cross: bool, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among ``values`` (in Gray order) within ``bits`` bits."""
    forest, links = Forest(len(values)), []
    if cross:
        left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    else:
        left = right = np.arange(len(values))
    index = GrayIndex(values[right])
    for q, v in index.near(values[left], bits, block=256):
        q, v = left[q], right[v]
        if not cross:
            q, v = q[q < v], v[q < v]
        for x, y in zip(q.tolist(), v.tolist()):
            if forest.join(x, y):
                links.append((x, y))
    return links


def near_links(fps: DataFrame, bits: int = 4, tile: int = TILE) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``fp`` that give the components of all links."""
    blocks = bits + 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = F.array(*[
        F.struct(
            (F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) * F.lit(blocks) + F.lit(k)).alias("bucket")
        )
        for k in range(blocks)
    ])
    rows = fps.select("fp", F.explode(keys).alias("key")).select("fp", F.col("key.bucket").alias("bucket"))
    shape = tiled(rows, "bucket", "fp", tile)

    def run(batches):
        a, b = [], []
        for (_, tile_a, tile_b), group in by_group(batches, ["bucket", "tile_a", "tile_b"]):
            values = group.column("fp").to_numpy().view(np.uint64)
            side = group.column("side").to_numpy()
            if tile_a != tile_b and side.min() == side.max():
                continue
            order = np.argsort(gray_rank(values), kind="stable")
            values, side = values[order], side[order]
            for x, y in forest_links(values, side, tile_a != tile_b, bits):
                a.append(values[x])
                b.append(values[y])
            if len(a) > 50_000:
                yield batch_of(a, b)
                a, b = [], []
        yield batch_of(a, b)

    def batch_of(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in (a, b)], names=["a", "b"])

    return gathered(shape, "bucket").mapInArrow(run, "a long, b long")


def components_of(rows: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, component_id) of the fingerprints in ``rows`` (doc_id, fp)."""
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = components(near_links(classes.select("fp"), bits))
    placed = classes.join(groups, classes.fp == groups.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.join(named, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """Fingerprint and component of every document.

    Returns one row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest
    doc_id linked directly or through others). Null and empty texts have fingerprint zero and
    are linked like any other; repeated rows give repeated results; rows without doc_id count
    for no component's name, and a component of such rows only has a null name. Further
    columns of ``docs`` are not looked at. An empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, words))
    labels = components_of(rows, bits)
    return rows.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id.

    Rows that repeat the id and text that stay are dropped too. Rows without doc_id stay unless
    their component has a document with one.
    """
    rows = cut_lineage(fingerprints(docs, words))
    labelled = rows.join(components_of(rows, bits).withColumnRenamed("fp", "_f"), F.col("fp") == F.col("_f"))
    kept = cut_lineage(labelled.where("doc_id = component_id").select("doc_id", "fp"))
    nameless = labelled.where("doc_id is null and component_id is null").select("fp").distinct()
    repeated = not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if not repeated:
        named = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    else:
        with_fp = fingerprints(docs, words, tuple(docs.columns), "_fp")
        named = with_fp.join(kept.distinct().withColumnsRenamed({"doc_id": "_d", "fp": "_f"}), (F.col("doc_id") == F.col("_d")) & (F.col("_fp") == F.col("_f")), "left_semi")
        named = named.dropDuplicates(["doc_id"]).drop("_fp")
    if rows.where("doc_id is null").isEmpty():
        return named.select(*docs.columns)
    others = fingerprints(docs.where("doc_id is null"), words, tuple(docs.columns), "_fp")
    return named.select(*docs.columns).union(others.join(nameless.withColumnRenamed("fp", "_f"), F.col("_fp") == F.col("_f"), "left_semi").select(*docs.columns))
