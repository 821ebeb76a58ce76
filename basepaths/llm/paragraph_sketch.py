"""Fingerprints of documents as invertible Bloom lookup sketches of their paragraphs.

A text is a set of 64-bit paragraph digests (see ``Paragraphs``). A sketch adds each digest and its
checksum to one cell in each of three tables. The sketch of one version less that of another holds
only what differs, and peeling recovers it: a cell that holds one digest gives it away, the digest
is taken out of its other two cells, and so on. Where peeling gets stuck, both versions are sketched
again four times as large with other places, until it succeeds; so the recovered difference, and
the likeness computed from it, are exact up to collisions of 64 bits.

The fingerprint is the smallest sketch, of fixed size whatever the text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType

from basepaths.llm.arrow_text import byte_rows, pieces
from basepaths.llm.words import mixed

#: Cells per table of a fingerprint; three tables.
CELLS = 8
#: A paragraph is cut after one in so many of its words, on average.
PIECE_WORDS = 16
#: No piece is longer than this.
LONGEST = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEWLINE, _SPACE = 10, 32


def _salted(values: np.ndarray, salt: int) -> np.ndarray:
    return mixed(values + np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % 2**64))


class Paragraphs:
    """Digests of many texts: ``values`` with the ``row`` of each, sorted by row; ``sizes`` per row.

    A paragraph ends at a newline; a long one is also cut after spaces that the four bytes before
    them select, so that an edit touches few digests however long the paragraph. Empty paragraphs count
    for nothing; the n-th repeat of a paragraph in a text has a digest of its own.
    """

    def __init__(self, texts: list[bytes]):
        self.rows = len(texts)
        values, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        group: list[bytes] = []
        owners: list[int] = []
        held = 0
        for row, text in enumerate(texts):
            for part in [text] if len(text) <= LONGEST else _split(text):
                group.append(part)
                owners.append(row)
                held += len(part)
                if held >= LONGEST:
                    self._digest(group, owners, values, rows)
                    group, owners, held = [], [], 0
        self._digest(group, owners, values, rows)
        value, row = np.concatenate(values), np.concatenate(rows)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        same = np.zeros(len(value), bool)
        same[1:] = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
        first = np.flatnonzero(~same)
        nth = np.arange(len(value)) - np.repeat(first, np.diff([*first, len(value)]))
        self.values, self.row = mixed(value + nth.astype(np.uint64) * _BASE), row
        self.sizes = np.bincount(row, minlength=self.rows)

    @staticmethod
    def _digest(texts: list[bytes], owners: list[int], values: list, rows: list) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return
        lengths = np.array([len(t) for t in texts])
        begin = np.cumsum(lengths) - lengths
        ends = np.union1d(_cuts(data, begin) + 1, (begin + lengths)[lengths > 0])
        starts = np.concatenate([[0], ends[:-1]])
        place = np.arange(len(data)) - np.repeat(starts, ends - starts)
        powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
        parts = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
        parts[data == _NEWLINE] = 0
        total = np.add.reduceat(parts, starts)
        full = total != 0
        values.append(mixed(total[full]))
        rows.append(np.asarray(owners)[np.searchsorted(begin, starts[full], "right") - 1])


def _cuts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places of the newlines, and of the spaces where a paragraph is cut. ``begin``: where texts start."""
    spaces = np.flatnonzero(data == _SPACE)
    offset = spaces - begin[np.searchsorted(begin, spaces, "right") - 1]
    seen = np.zeros(len(spaces), np.uint64)
    for k in range(1, 5):
        seen = seen * np.uint64(257) + np.where(offset >= k, data[np.maximum(spaces - k, 0)], 0).astype(np.uint64)
    return np.union1d(np.flatnonzero(data == _NEWLINE), spaces[mixed(seen) % np.uint64(PIECE_WORDS) == 0])


def _split(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end where a paragraph is cut."""
    places = [np.zeros(0, np.int64)]
    for at in range(0, len(text), LONGEST):
        back = min(at, 4)
        window = np.frombuffer(text[at - back : at + LONGEST], np.uint8)
        found = _cuts(window, np.array([0 if back == 0 else -4]))
        places.append(found[found >= back] + at - back + 1)
    ends = np.concatenate([*places, [len(text)]])
    start = last = 0
    for end in ends.tolist():
        if end - start > LONGEST and last > start:
            yield text[start:last]
            start = last
        while end - start > LONGEST:
            yield text[start : start + LONGEST]
            start += LONGEST
        last = end
    yield text[start:]


class Sketches:
    """Sketches of many texts at once: counts, digest sums and checksum sums per cell, wrapping around."""

    def __init__(self, rows: int, cells: int, salt: int):
        self.rows, self.cells, self.salt = rows, cells, salt
        size = rows * 3 * cells
        self.counts, self.keys, self.checks = np.zeros(size, np.int32), np.zeros(size, np.uint64), np.zeros(size, np.uint32)

    def places(self, values: np.ndarray) -> list[np.ndarray]:
        """The cell of each value in each table."""
        return [
            (_salted(values, 3 * self.salt + t + 1) % np.uint64(self.cells)).astype(np.int64) + t * self.cells for t in range(3)
        ]

    def add(self, row: np.ndarray, values: np.ndarray, times) -> list[np.ndarray]:
        times = np.broadcast_to(np.asarray(times, np.int64), values.shape)
        keys = values * times.astype(np.uint64)
        checks = (_check(values).astype(np.uint64) * times.astype(np.uint64)).astype(np.uint32)
        touched = [row * (3 * self.cells) + place for place in self.places(values)]
        for at in touched:
            np.add.at(self.counts, at, times.astype(np.int32))
            np.add.at(self.keys, at, keys)
            np.add.at(self.checks, at, checks)
        return touched

    def less(self, other: Sketches, mine: np.ndarray, theirs: np.ndarray) -> Sketches:
        """Sketches of what differs between rows ``mine`` of this and rows ``theirs`` of the other."""
        out = Sketches(len(mine), self.cells, self.salt)
        take = lambda a, rows: a.reshape(-1, 3 * self.cells)[rows].ravel()
        out.counts = take(self.counts, mine) - take(other.counts, theirs)
        out.keys = take(self.keys, mine) - take(other.keys, theirs)
        out.checks = take(self.checks, mine) - take(other.checks, theirs)
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(decoded per row, row, value, sign) of the digests; takes them out of the cells."""
        width = 3 * self.cells
        rows, values, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        at = np.flatnonzero(np.abs(self.counts) == 1)
        while len(at):
            sign = self.counts[at]
            key = np.where(sign == 1, self.keys[at], np.uint64(0) - self.keys[at])
            check = np.where(sign == 1, self.checks[at], np.uint32(0) - self.checks[at])
            here = np.choose((at % width) // self.cells, self.places(key))
            pure = (check == _check(key)) & (here == at % width)
            row, key, sign = at[pure] // width, key[pure], sign[pure]
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            row, key, sign = row[new], key[new], sign[new]
            if not len(key):
                break
            rows.append(row)
            values.append(key)
            signs.append(sign)
            touched = np.unique(np.concatenate(self.add(row, key, -sign)))
            at = touched[np.abs(self.counts[touched]) == 1]
        empty = (self.counts == 0) & (self.keys == 0) & (self.checks == 0)
        return empty.reshape(-1, width).all(axis=1), np.concatenate(rows), np.concatenate(values), np.concatenate(signs)

    def texts(self) -> list[str]:
        """The sketches written out: 3 x cells counts, sums of digests and sums of checks, in base64."""
        width = 3 * self.cells
        columns = [a.reshape(-1, width) for a in (self.counts.astype("<i4"), self.keys.astype("<u8"), self.checks.astype("<u4"))]
        return [base64.b64encode(b"".join(c[r].tobytes() for c in columns)).decode() for r in range(self.rows)]

    @classmethod
    def read(cls, texts: list[str], salt: int = 0) -> Sketches:
        """Sketches from their written form."""
        raw = np.frombuffer(b"".join(base64.b64decode(t) for t in texts), np.uint8).reshape(len(texts), -1)
        width = raw.shape[1] // 16
        out = cls(len(texts), width // 3, salt)
        part = lambda a, b, kind: np.ascontiguousarray(raw[:, a * width : b * width]).view(kind).ravel()
        out.counts, out.keys, out.checks = part(0, 4, "<i4").astype(np.int32), part(4, 12, "<u8").copy(), part(12, 16, "<u4").copy()
        return out


def _check(values: np.ndarray) -> np.ndarray:
    return (_salted(values, 0) >> np.uint64(32)).astype(np.uint32)


def sketched(paragraphs: Paragraphs, cells: int, salt: int) -> Sketches:
    out = Sketches(paragraphs.rows, cells, salt)
    out.add(paragraphs.row, paragraphs.values, 1)
    return out


def _some(paragraphs: Paragraphs, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``rows``, value) of the digests of those rows."""
    first = np.concatenate([[0], np.cumsum(paragraphs.sizes)])
    sizes = paragraphs.sizes[rows]
    at = np.repeat(first[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return np.repeat(np.arange(len(rows)), sizes), paragraphs.values[at]


def differences(
    old: Paragraphs, new: Paragraphs, pairs: tuple[np.ndarray, np.ndarray], fingerprints: tuple[Sketches, Sketches]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign, tries per pair) of all that differs: sign 1 is in the old row only, -1 in the new one only.

    First the fingerprints are subtracted; pairs that don't peel are sketched again, larger. A pair
    whose sizes alone tell that a sketch is too small skips it.
    """
    mine, theirs = pairs
    pending = np.arange(len(mine))
    least = np.abs(old.sizes[mine] - new.sizes[theirs])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    tries = np.zeros(len(mine), np.int64)
    cells, salt = CELLS, 0
    while len(pending):
        now = pending[least[pending] <= 3 * cells]
        if len(now):
            if salt == 0:
                left = fingerprints[0].less(fingerprints[1], mine[now], theirs[now])
            else:
                left = Sketches(len(now), cells, salt)
                left.add(*_some(old, mine[now]), 1)
                left.add(*_some(new, theirs[now]), -1)
            done, row, value, sign = left.peel()
            tries[now] += 1
            good = done[row]
            found.append((now[row[good]], value[good], sign[good]))
            pending = np.setdiff1d(pending, now[done])
        cells, salt = cells * 4, salt + 1
    columns = [np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in range(3)]
    return columns[0], columns[1], columns[2], tries


def likeness(old: Paragraphs, new: Paragraphs, pairs: tuple[np.ndarray, np.ndarray], fingerprints: tuple[Sketches, Sketches]) -> np.ndarray:
    """Shared digests over all digests of each pair; two texts without digests are alike."""
    pair, _, _, _ = differences(old, new, pairs, fingerprints)
    total = old.sizes[pairs[0]] + new.sizes[pairs[1]]
    apart = np.bincount(pair, minlength=len(pairs[0]))
    shared = (total - apart) // 2
    return np.where(total == 0, 1.0, shared / np.maximum(shared + apart, 1))


# --- versions side by side ---------------------------------------------------------------


def version_differences(versions: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """What differs between two texts of a row, recovered from their sketches.

    Returns ``key``, fingerprint and new_fingerprint, only_old and only_new (sorted digests as signed
    longs), likeness and tries (sketch sizes it took). Null texts are empty; rows and their
    order don't matter; an empty table gives no rows.
    """
    schema = versions.select(key).schema
    for name, column_kind in (("fingerprint", "string"), ("new_fingerprint", "string"), ("only_old", ArrayType(LongType())), ("only_new", ArrayType(LongType()))):
        schema = schema.add(name, column_kind)
    schema = schema.add("likeness", "double").add("tries", "integer")

    def run(batches):
        for piece in pieces(batches, old):
            a, b = Paragraphs(byte_rows(piece.column(old))), Paragraphs(byte_rows(piece.column(new)))
            prints = sketched(a, CELLS, 0), sketched(b, CELLS, 0)
            every = np.arange(piece.num_rows)
            pair, value, sign, tries = differences(a, b, (every, every), prints)
            order = np.lexsort((value.view(np.int64), pair))
            pair, value, sign = pair[order], value[order].view(np.int64), sign[order]

            def lists(side):
                mine = sign == side
                offsets = np.concatenate([[0], np.cumsum(np.bincount(pair[mine], minlength=piece.num_rows))])
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value[mine], pa.int64()))

            apart, total = np.bincount(pair, minlength=piece.num_rows), a.sizes + b.sizes
            shared = (total - apart) // 2
            near = np.where(total == 0, 1.0, shared / np.maximum(shared + apart, 1))
            yield pa.RecordBatch.from_arrays(
                [piece.column(key), pa.array(prints[0].texts()), pa.array(prints[1].texts()), lists(1), lists(-1), pa.array(near), pa.array(tries, pa.int32())],
                names=schema.names,
            )

    return versions.select(key, old, new).mapInArrow(run, schema)


# --- a ring of edited documents ----------------------------------------------------------

EDITED = (
    "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long"
)


def _range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    literal = lambda values: F.array(*[F.lit(v) for v in values])
    part = F.size(F.filter(literal([p[0] for p in parts]), lambda b: b <= value))
    inside = F.size(F.filter(F.element_at(F.array(*[literal(p) for p in parts]), part), lambda b: b <= value))
    return F.when(part == 0, 0).otherwise((part - 1) * step + inside)


def in_ranges(docs: DataFrame) -> DataFrame:
    """_range, _place, doc_id and text, by ascending doc_id within the tasks.

    A task holds one range of ids (_place 0) and then the document that follows its last one (_place 1);
    after the last range comes the first document. Documents without an id come at the end of a range
    (_place 2). The driver sees two ids per range.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / tasks for i in range(1, tasks)] or [0.5]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 20 * tasks)).first()[0] or []
    bounds = sorted(set(bounds))
    placed = docs.select(
        F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(len(bounds) + 1))).otherwise(_range_of(F.col("doc_id"), bounds)).cast("int").alias("_range"),
        F.when(F.col("doc_id").isNull(), 2).otherwise(0).alias("_place"), "doc_id", "text",
    )
    first = placed.where("_place = 0").groupBy("_range").agg(F.min("doc_id").alias("doc_id")).orderBy("_range").collect()
    if first:
        before = {row["doc_id"]: first[n - 1]["_range"] for n, row in enumerate(first)}
        pairs = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])
        guests = docs.where(F.col("doc_id").isin(list(before))).select(
            F.try_element_at(pairs, F.col("doc_id")).cast("int").alias("_range"), F.lit(1).alias("_place"), "doc_id", "text"
        )
        placed = placed.unionAll(guests)
    return placed.repartitionById(len(bounds) + 1, F.col("_range")).sortWithinPartitions("_range", "_place", "doc_id", "text")


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


def edited_documents(docs: DataFrame) -> DataFrame:
    """Every document beside an edited version and beside the next document, by fingerprint.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next
    document by ascending doc_id (after the last comes the first). near_edited and near_next are the shares of
    paragraph digests in common. Null texts are empty. Documents that share an id follow each
    other by text. A document without an id has no next one: its text is only cut, and near_next
    is null. An empty table gives no rows. The text is shuffled once; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held: list[tuple] = []
        for piece in pieces(batches, limit=1 << 20):
            held += zip(*(piece.column(n).to_pylist() for n in ("_range", "_place", "doc_id")), byte_rows(piece.column("text")))
            yield from compared(held)
            held = held[-1:]
        yield from compared([*held, (None, 1, None, b"")])

    def compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """All rows but the last, each beside the one after it."""
        asked = [n for n, row in enumerate(rows[:-1]) if row[1] != 1]
        if not asked:
            return
        raw = [row[3] for row in rows]
        sizes, edited, shas = [], [], []
        for n in asked:
            text = _text(raw[n])
            gone = len(text) // 4
            follows = _text(raw[n + 1])[:gone] if gone and rows[n][1] == 0 else ""
            sizes.append(len(text))
            edited.append((text[: len(text) - gone] + follows).encode("utf-8", "surrogateescape"))
            shas.append(hashlib.sha256(edited[-1]).hexdigest())
        texts, changed = Paragraphs(raw), Paragraphs(edited)
        prints, changed_prints = sketched(texts, CELLS, 0), sketched(changed, CELLS, 0)
        at = np.array(asked)
        near_edited = likeness(texts, changed, (at, np.arange(len(at))), (prints, changed_prints))
        near_next = likeness(texts, texts, (at, at + 1), (prints, prints))
        alone = np.array([rows[n][1] == 2 for n in asked])
        written = prints.texts()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[n][2] for n in asked], id_type), pa.array(sizes, pa.int64()), pa.array(shas), pa.array([written[n] for n in asked]),
                pa.array(changed_prints.texts()), pa.array(near_edited), pa.array(near_next, mask=alone), pa.array(texts.sizes[at], pa.int64()),
            ],
            names=names,
        )

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    names = [part.split()[0] for part in EDITED.split(", ")]
    return in_ranges(docs).mapInArrow(run, EDITED.format(id=kind))
