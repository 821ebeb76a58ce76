"""Removal of every byte covered by a long string that also starts elsewhere.

A string of ``length`` bytes that occurs twice is found by sorting suffixes; only suffixes that
can matter are sorted, and strings that can be equal meet in one shard:

1. Each start of a window of ``length`` bytes has an anchor: the place of the least 8-byte hash
   among the ``reach`` places from the start. The ``length - reach + 1`` bytes from the anchor are
   the key. Equal windows have equal anchors at equal distance, hence equal keys.
2. Starts with a common anchor form a segment: a piece of text of ``length`` bytes or some more.
   Segments whose key occurs once are done. Equal segments are kept once, with their count.
3. Segments whose key others share are cut into finer ones of up to ``fine`` starts at a fixed distance
   from the anchor, with longer keys (``length - fine + 1`` bytes), and step 2 is repeated. This
   leaves little but the ends of repeated passages.
4. The segments of each key that several different segments share go to shards, which are
   sorted by external induced sorting (``induced``). The bytes of the key, which every window of the
   segment holds at the same distance from its anchor, are one symbol there (equal for equal bytes),
   so a window is ``fine`` symbols. Suffixes whose common prefix with a neighbour reaches that start
   repeated windows, as do all starts of a segment that occurs twice.
5. Keys with more than ``hot`` different segments (a passage that very many documents share, at its
   two ends) would not be bounded shards. Their windows are told apart one by one by 128-bit digests,
   counted with partial sums, so no task holds such a group.

Matches never cross documents. Rows are keyed by a digest of the text, as equal texts have
equal results; a text that occurs twice repeats as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basepaths.llm.arrow_text import by_group, byte_rows, pieces
from basepaths.llm.induced import suffix_order
from basepaths.session import cut_lineage

LENGTH = 400
REACH = 256
FINE = 16
HOT = 256
#: Text a task works on at once (one text at least), and what it holds of its results before it hands them on.
PIECE_BYTES = 1 << 20
ROWS_HELD = 10_000
BYTES_HELD = 2 << 20
SHARD_BYTES = 4 << 20
GRAM = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(text_id(F.col("text")).alias("tid"), F.xxhash64("doc_id").alias("o"), "text")


def anchors(data: np.ndarray, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of the segments of one text."""
    starts = len(data) - length + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 3
    padded = np.concatenate([data, np.zeros(GRAM, np.uint8)])
    grams = np.ndarray((starts + reach - 1,), "<u8", padded.data, strides=(1,))
    least = ((grams * _ODD) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: starts], least[reach - span : reach - span + starts])
    anchor = (least[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    return anchor[first], first, np.append(first[1:], starts) - 1


def segments(docs: DataFrame, length: int, reach: int) -> DataFrame:
    """(tid, o, a, lo, hi, key, seg): hash of the id, anchor, first and last start, hash of the key and digest of the piece."""
    schema = "tid binary, o long, a integer, lo integer, hi integer, key long, seg binary"
    core = length - reach + 1

    def run(batches):
        short, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for piece in pieces(batches, limit=PIECE_BYTES):
            tids, ids, columns, keys, segs = [], [], [[], [], []], [], []
            for tid, o, text in zip(piece.column("tid").to_pylist(), piece.column("o").to_pylist(), byte_rows(piece.column("text"))):
                found = anchors(np.frombuffer(text, np.uint8), length, reach)
                a, lo, hi = (x.tolist() for x in found)
                tids += [tid] * len(a)
                ids += [o] * len(a)
                for column, values in zip(columns, (a, lo, hi)):
                    column += values
                keys += [short(text[x : x + core]) for x in a]
                # the distance from start to anchor belongs to the piece, as it decides where windows start
                segs += [long(text[x : y + length], seed=z - x) for z, x, y in zip(a, lo, hi)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tids, pa.binary()), pa.array(ids, pa.int64()), *(pa.array(c, pa.int32()) for c in columns), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(segs, pa.binary())],
                names=["tid", "o", "a", "lo", "hi", "key", "seg"],
            )

    return keyed(docs).mapInArrow(run, schema).withColumn("weight", F.lit(1))


def with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tid, o, text, parts): texts with the segments ``wanted`` from them.

    The join takes the id too, so that of many copies of a text only one is read.
    """
    lists = wanted.groupBy("tid", "o").agg(F.collect_list(F.struct("a", "lo", "hi", "key", "weight")).alias("parts"))
    return lists.join(keyed(docs), ["tid", "o"])


def _columns(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in enumerate(kinds)], names=names)


def finer(docs: DataFrame, wanted: DataFrame, length: int, fine: int) -> DataFrame:
    """The segments ``wanted`` cut where the distance from start to anchor passes a multiple of ``fine``."""
    names = ["tid", "o", "a", "lo", "hi", "key", "seg", "weight"]
    kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32())

    def run(batches):
        short, long = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in pieces(batches, limit=PIECE_BYTES):
            rows = []
            for tid, o, text, parts in zip(*(batch.column(n).to_pylist() for n in ("tid", "o")), byte_rows(batch.column("text")), batch.column("parts").to_pylist()):
                for p in parts:
                    a = p["a"]
                    for k in range((a - p["hi"]) // fine, (a - p["lo"]) // fine + 1):
                        lo, hi = max(p["lo"], a - k * fine - fine + 1), min(p["hi"], a - k * fine)
                        common = a - k * fine
                        key = short(text[common : common + length - fine + 1], seed=k)
                        rows.append((tid, o, a, lo, hi, key - (key >> 63 << 64), long(text[lo : hi + length], seed=a - lo), p["weight"]))
                    if len(rows) >= ROWS_HELD:
                        yield _columns(rows, names, kinds)
                        rows = []
            yield _columns(rows, names, kinds)

    return with_text(docs, wanted).mapInArrow(run, "tid binary, o long, a integer, lo integer, hi integer, key long, seg binary, weight integer")


def pieces_of(docs: DataFrame, wanted: DataFrame, length: int, fine: int) -> DataFrame:
    """``wanted`` (tid, o, a, lo, hi, key, weight) with the bytes ``piece`` of each segment; its key begins at byte ``core``."""
    names = ["tid", "lo", "hi", "core", "key", "piece"]
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def run(batches):
        for batch in pieces(batches, limit=PIECE_BYTES):
            rows, held = [], 0
            for tid, text, parts in zip(batch.column("tid").to_pylist(), byte_rows(batch.column("text")), batch.column("parts").to_pylist()):
                for p in parts:
                    piece = text[p["lo"] : p["hi"] + length]
                    rows.append((tid, p["lo"], p["hi"], p["hi"] - p["lo"] + (p["a"] - p["hi"]) % fine, p["key"], piece))
                    held += len(piece)
                    if held >= BYTES_HELD:
                        yield _columns(rows, names, kinds)
                        rows, held = [], 0
            yield _columns(rows, names, kinds)

    return with_text(docs, wanted).mapInArrow(run, "tid binary, lo integer, hi integer, core integer, key long, piece binary").dropDuplicates(["tid", "lo"])


def collapsed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole, rival) of segments: those that occur twice, and one of each that shares its key with a different one.

    ``weight`` 2 marks a segment that stands for several; rivals come with ``m``, the number of
    different segments of their key.
    """
    found = cut_lineage(found)
    shared = found.groupBy("key").agg(F.sum("weight").alias("n")).where("n > 1").select(F.col("key").alias("k"))
    shared = cut_lineage(found.join(shared, F.col("key") == F.col("k")).drop("k"))
    classes = cut_lineage(
        shared.groupBy("key", "seg").agg(F.sum("weight").alias("n"), F.min(F.struct("tid", "o", "a", "lo", "hi")).alias("one"))
    )
    many = classes.where("n > 1").select(F.col("key").alias("k"), F.col("seg").alias("s"))
    whole = shared.join(many, (F.col("key") == F.col("k")) & (F.col("seg") == F.col("s"))).select("tid", "lo", "hi")
    rivals = classes.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select(F.col("key").alias("k"), "m")
    rival = classes.join(rivals, F.col("key") == F.col("k")).select("key", "m", "one.*", F.least("n", F.lit(2)).cast("int").alias("weight"))
    return whole, rival


def repeated_starts(parts: list[tuple[int, int, int, bytes]], length: int, fine: int) -> list[np.ndarray]:
    """For pieces (lo, hi, core, bytes) of one shard: the starts whose window also starts in another place of it.

    The ``length - fine + 1`` bytes from ``core`` on lie in every window of a piece and count as one symbol.
    """
    held = length - fine + 1
    cores: dict[bytes, int] = {}
    names = [cores.setdefault(p[core : core + held], len(cores)) for _, _, core, p in parts]
    short = [p[:core] + b"\0" + p[core + held :] + b"\0" for _, _, core, p in parts]
    text = np.frombuffer(b"".join(short), np.uint8)
    # separators and cores get symbols of their own
    symbols = text.astype(np.int64) + 1
    first = np.concatenate([[0], np.cumsum([len(p) for p in short])])
    symbols[first[1:] - 1] = 0
    symbols[first[:-1] + [core for _, _, core, _ in parts]] = 257 + np.array(names)
    order, common = suffix_order(symbols, 257 + len(cores), fine)
    again = common >= fine
    again[:-1] |= common[1:] >= fine
    repeated = np.zeros(len(text), bool)
    repeated[order[again]] = True
    return [lo + np.flatnonzero(repeated[at : at + hi - lo + 1]) for (lo, hi, *_), at in zip(parts, first)]


def ranges(starts: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()


def sorted_shards(rows: DataFrame, length: int, fine: int, shard_bytes: int) -> DataFrame:
    """(tid, lo, hi) ranges of repeated starts among the pieces of each key."""

    def solve(held):
        out = {"tid": [], "lo": [], "hi": []}
        if held:
            found = repeated_starts([h[1:] for h in held], length, fine)
            for (tid, *_), starts in zip(held, found):
                lo, hi = ranges(starts)
                out["tid"] += [tid] * len(lo)
                out["lo"] += lo
                out["hi"] += hi
        return pa.RecordBatch.from_arrays([pa.array(out["tid"], pa.binary()), pa.array(out["lo"], pa.int32()), pa.array(out["hi"], pa.int32())], names=list(out))

    def run(batches):
        held, size = [], 0
        for _, group in by_group(batches, ["key"]):
            held += zip(*(group.column(n).to_pylist() for n in ("tid", "lo", "hi", "core", "piece")))
            size += sum(len(h[4]) for h in held[-group.num_rows :])
            if size >= shard_bytes:
                yield solve(held)
                held, size = [], 0
        yield solve(held)

    return rows.repartition("key").sortWithinPartitions("key").select("key", "tid", "lo", "hi", "core", "piece").mapInArrow(run, "tid binary, lo integer, hi integer")


def windows(rows: DataFrame, length: int) -> DataFrame:
    """(w, tid, at): the digest of every window of the pieces."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                out = ([], [], [])
                for tid, lo, hi, piece in zip(*(batch.slice(k, 1024).column(n).to_pylist() for n in ("tid", "lo", "hi", "piece"))):
                    n = hi - lo + 1
                    for column, values in zip(out, ([digest(piece[i : i + length]) for i in range(n)], [tid] * n, range(lo, hi + 1))):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.binary(), pa.int32()))], names=["w", "tid", "at"])

    return rows.select("tid", "lo", "hi", "piece").mapInArrow(run, "w binary, tid binary, at integer")


def repeated_ranges(
    docs: DataFrame, length: int = LENGTH, reach: int = REACH, fine: int = FINE, hot: int = HOT, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(tid, lo, hi) ranges of starts of windows that also start elsewhere, per distinct text."""
    whole, rival = collapsed(segments(docs, length, reach))
    fine_whole, rival = collapsed(finer(docs, rival, length, fine))
    crowd = rival.where(F.col("m") > hot).select(F.col("key").alias("c")).distinct()
    texts = cut_lineage(pieces_of(docs, rival, length, fine))
    marked = texts.join(crowd, F.col("key") == F.col("c"), "left")
    few = sorted_shards(marked.where("c is null"), length, fine, shard_bytes)
    digests = windows(marked.where("c is not null"), length)
    again = digests.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select(F.col("w").alias("v"))
    single = digests.join(again, F.col("w") == F.col("v")).select("tid", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return whole.unionByName(fine_whole).unionByName(few).unionByName(single)


def cleaned(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` holds the bytes that stay.

    Null texts are empty; repeated rows repeat each other's whole text. Ids may be null or
    repeated; other columns are not looked at. An empty table gives an empty result.
    """
    found = repeated_ranges(docs, length, **options)
    per_text = found.groupBy(F.col("tid").alias("t")).agg(F.collect_set(F.struct("lo", "hi")).alias("starts"))
    keyed = docs.select("doc_id", text_id(F.col("text")).alias("tid"), "text")
    joined = keyed.join(per_text, F.col("tid") == F.col("t"), "left").select("doc_id", "text", "starts")
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def run(batches):
        for batch in pieces(batches, limit=PIECE_BYTES):
            out = ([], [], [], [])
            for text, starts in zip(byte_rows(batch.column("text")), batch.column("starts").to_pylist()):
                spans: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"] + length) for s in starts or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                kept, at = [], 0
                for lo, hi in spans:
                    kept.append(text[at:lo])
                    at = hi
                kept.append(text[at:])
                left = b"".join(kept)
                for column, value in zip(out, (len(text), len(text) - len(left), len(spans), left)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=schema.names
            )

    return joined.mapInArrow(run, schema)


def suffix_dedup(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    return cleaned(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
