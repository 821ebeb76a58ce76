"""External induced sorting of suffixes, with common-prefix lengths.

The suffixes of a string are S (smaller than the next one) or L; S after L are the seeds. Sorted
seeds induce the order of all L suffixes from left to right, and those the order of all S suffixes
from right to left: whoever leaves the queue sends its predecessor in, keyed by (first symbol,
place of arrival). The seeds themselves are sorted by inducing over their substrings, naming
these, and recursion on the string of names. All queues are merge queues of sorted runs; beyond
``MEMORY_ROWS`` entries the runs live in unnamed files, which vanish with the task.

Queue entries carry the common prefix of a suffix and the one before it in its bucket: one more
than the least value between the places where their successors left the queue. These minima
come from a growing tree of aligned ranges. Only at the seams (between neighbouring seeds and
between the L and S part of a bucket) texts are compared; values stop at ``limit``.
"""

from __future__ import annotations

import tempfile

import numpy as np

MEMORY_ROWS = 1 << 20
_CLASS, _SYMBOL = np.uint64(39), np.uint64(40)
MOST_SYMBOLS = 1 << 24
FEW_SYMBOLS = 1024


class RunQueue:
    """Priority queue of (key, position, common prefix) with distinct keys, in bulk."""

    def __init__(self, memory_rows: int | None = None):
        self.runs: list[list] = []  # [keys, positions, prefixes, cursor]
        self.memory = MEMORY_ROWS if memory_rows is None else memory_rows
        self.rows = 0

    def __len__(self) -> int:
        return self.rows

    def push(self, columns: tuple[np.ndarray, ...]) -> None:
        if not len(columns[0]):
            return
        self.rows += len(columns[0])
        order = np.argsort(columns[0], kind="stable")
        self.runs.append([*(c[order] for c in columns), 0])
        if len(self.runs) > 24:
            self._merge()

    def _merge(self) -> None:
        """Small runs become one; a large result goes to a file."""
        self.runs.sort(key=lambda r: len(r[0]) - r[-1])
        few, self.runs = self.runs[:18], self.runs[18:]
        columns = [np.concatenate([r[k][r[-1] :] for r in few]) for k in range(3)]
        order = np.argsort(columns[0], kind="stable")
        columns = [c[order] for c in columns]
        held = sum(len(r[0]) - r[-1] for r in self.runs if not isinstance(r[0], np.memmap))
        if held + len(order) > self.memory:
            columns = [_on_disk(c) for c in columns]
        self.runs.append([*columns, 0])

    def peek(self, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Smallest entries in order: ``limit`` at least where so many are left."""
        bound = None
        for keys, _, _, cursor in self.runs:
            if cursor + limit < len(keys) and (bound is None or keys[cursor + limit - 1] < bound):
                bound = keys[cursor + limit - 1]
        ends = [
            c + (len(k) - c if bound is None else int(np.searchsorted(k[c : c + limit], bound, side="right"))) for k, _, _, c in self.runs
        ]
        parts = [(r, r[-1], e) for r, e in zip(self.runs, ends) if e > r[-1]]
        columns = [np.concatenate([r[k][c:e] for r, c, e in parts]) for k in range(3)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns)

    def take(self, last: np.uint64, count: int) -> None:
        """Drop all entries up to key ``last``; they are ``count``."""
        self.rows -= count
        left = []
        for run in self.runs:
            keys, cursor = run[0], run[-1]
            if keys[cursor] <= last:
                run[-1] = cursor + int(np.searchsorted(keys[cursor : cursor + count], last, side="right"))
            if run[-1] < len(keys):
                left.append(run)
        self.runs = left


def _on_disk(column: np.ndarray) -> np.ndarray:
    file = tempfile.TemporaryFile()
    column.tofile(file)
    file.flush()
    return np.memmap(file, column.dtype, "r", shape=column.shape)


class Minima:
    """Least value of any range of a growing sequence."""

    def __init__(self, size: int):
        self.levels = [np.empty(size, np.int32)]
        while len(self.levels[-1]) > 1:
            self.levels.append(np.empty(len(self.levels[-1]) // 2, np.int32))
        self.count = 0

    def extend(self, values: np.ndarray) -> None:
        start, self.count = self.count, self.count + len(values)
        self.levels[0][start : self.count] = values
        low, high = start, self.count
        for below, level in zip(self.levels, self.levels[1:]):
            low, high = low // 2, high // 2
            if high <= low:
                break
            np.minimum(below[2 * low : 2 * high : 2], below[2 * low + 1 : 2 * high : 2], out=level[low:high])

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of places low..high, both included."""
        result = np.full(len(low), np.iinfo(np.int32).max, np.int32)
        which = np.arange(len(low))
        low, high = low.copy(), high.copy()
        for level in self.levels:
            which, low, high = which[keep := low <= high], low[keep], high[keep]
            if not len(which):
                break
            odd = np.flatnonzero(low & 1)
            result[which[odd]] = np.minimum(result[which[odd]], level[low[odd]])
            even = np.flatnonzero((high & 1) == 0)
            result[which[even]] = np.minimum(result[which[even]], level[high[even]])
            low, high = (low + 1) >> 1, (high - 1) >> 1
        return result


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Equal leading symbols of the suffixes at ``a`` and ``b``, up to ``limit``; four at a time while symbols are small."""
    n = len(text)
    result = np.zeros(len(a), np.int32)
    if n > 4 and text.dtype == np.uint16:
        four = np.ndarray((n - 3,), "<u8", text.data, strides=(2,))
        which = np.arange(len(a))
        for k in range(0, limit, 4):
            x, y = a[which] + k, b[which] + k
            inside = (x < n - 3) & (y < n - 3)
            which = which[inside]
            which = which[four[x[inside]] == four[y[inside]]]
            if not len(which):
                break
            result[which] = k + 4
    which = np.arange(len(a))
    while True:
        x, y = a[which] + result[which], b[which] + result[which]
        inside = (x < n) & (y < n) & (result[which] < limit)
        which = which[inside]
        which = which[text[x[inside]] == text[y[inside]]]
        if not len(which):
            return np.minimum(result, limit)
        result[which] += 1


def small_types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next; the last is not."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    place = np.where(step != 0, np.arange(n - 1), n)
    place = np.minimum.accumulate(place[::-1])[::-1] if n > 1 else place
    out = np.zeros(n, bool)
    known = place < n
    out[:-1][known] = step[place[known]] > 0
    return out


def _drain(text, types, start: np.ndarray, up: bool, wanted: bool, limit: int | None, symbols: int):
    """Empty the queue that begins with ``start``: (positions, lcp) in the order they leave.

    ``up``: smallest symbols first. Each entry that leaves sends in its predecessor if that is
    of the type ``wanted``. Without ``limit`` no common prefixes are carried.
    """
    if not limit and symbols > FEW_SYMBOLS and len(text) <= 4 * MEMORY_ROWS:
        return _drain_lists(text, types, start, up, wanted, symbols), None
    queue = RunQueue()
    queue.push(start)
    order, values = [], []
    left, size = 0, 4096
    minima = Minima(len(text) + 1) if limit else None
    last_seen = np.full(symbols, -1, np.int64) if limit else None
    previous = -1
    while len(queue):
        keys, places, lcp = queue.peek(size)
        before = places - 1
        sends = np.flatnonzero((before >= 0) & (types[before] == wanted))
        at = before[sends]
        symbol = text[at].astype(np.int64)
        if not up:
            symbol = symbols - 1 - symbol
        sent = (symbol.astype(np.uint64) << _SYMBOL) + (left + sends).astype(np.uint64)
        # an entry may leave only before all that those ahead of it send in
        count = len(keys)
        if len(sends):
            floor = np.minimum.accumulate(sent)
            ahead = np.searchsorted(sends, np.arange(1, count), side="left") - 1
            late = np.flatnonzero((ahead >= 0) & (keys[1:] > floor[ahead]))
            if len(late):
                count = int(late[0]) + 1
        queue.take(keys[count - 1], count)
        size = min(1 << 17, size * 2) if count == len(keys) else max(256, min(size, 4 * count))
        places, here = places[:count], np.searchsorted(sends, count)
        sends, at, symbol, sent = sends[:here], at[:here], symbol[:here], sent[:here]
        carried = np.zeros(here, np.int32)
        if limit:
            lcp = lcp[:count].copy()
            ahead_at = np.concatenate([[previous], places[:-1]])
            same = text[places] == text[ahead_at]
            same[0] &= previous >= 0
            lcp[~same] = 0
            if up:  # the one-symbol suffix was sent in by the end of the string, which has no place
                lcp[(ahead_at == len(text) - 1) & same] = 1
            seam = np.flatnonzero(same & (types[places] != types[ahead_at]))
            if len(seam):
                lcp[seam] = common_prefix(text, places[seam], ahead_at[seam], limit)
            previous = places[-1]
            minima.extend(lcp)
            values.append(lcp)
            if here:
                by = np.argsort(symbol, kind="stable")
                place, kind = left + sends[by], symbol[by]
                back = np.concatenate([[-1], place[:-1]])
                opens = np.concatenate([[True], kind[1:] != kind[:-1]])
                back[opens] = last_seen[kind[opens]]
                closes = np.append(np.flatnonzero(opens)[1:] - 1, here - 1)
                known = back >= 0
                value = np.zeros(here, np.int32)
                value[known] = np.minimum(minima.least(back[known] + 1, place[known]) + 1, limit)
                last_seen[kind[closes]] = place[closes]
                carried[by] = value
        order.append(places)
        left += count
        queue.push((sent, at, carried))
    at = np.concatenate(order) if order else np.zeros(0, np.int64)
    return at, (np.concatenate(values) if limit else None)


def _drain_lists(text, types, start, up: bool, wanted: bool, symbols: int) -> np.ndarray:
    """``_drain`` for strings of names, which fit in memory: a first-in-first-out list for each symbol.

    Few entries of such strings can leave at once, so bulk steps would not pay.
    """
    keys, places, _ = start
    order = np.argsort(keys, kind="stable")
    fixed = (keys[order] >> _CLASS & np.uint64(1)).tolist()
    arrived, waiting = [[] for _ in range(symbols)], [[] for _ in range(symbols)]
    symbol = text.astype(np.int64) if up else symbols - 1 - text.astype(np.int64)
    symbol, sends = symbol.tolist(), (types == wanted).tolist()
    for place, later in zip(places[order].tolist(), fixed):
        (waiting if later else arrived)[symbol[place]].append(place)
    out = []
    for kind in range(symbols):
        for row in (arrived[kind], waiting[kind]):
            for place in row:  # grows while it is read
                if place and sends[place - 1]:
                    arrived[symbol[place - 1]].append(place - 1)
            out += row
        arrived[kind] = waiting[kind] = None
    return np.array(out, np.int64)


def _entries(symbol: np.ndarray, at: np.ndarray, lcp: np.ndarray | None) -> tuple[np.ndarray, ...]:
    keys = (symbol.astype(np.uint64) << _SYMBOL) | (np.uint64(1) << _CLASS) | np.arange(len(at), dtype=np.uint64)
    return keys, at, np.zeros(len(at), np.int32) if lcp is None else lcp.astype(np.int32)


def induce(text: np.ndarray, types: np.ndarray, seeds: np.ndarray, symbols: int, limit: int | None = None):
    """Order of all suffixes (and common prefixes with the one before) from the order of the seeds."""
    n = len(text)
    seed_lcp = None
    if limit:
        seed_lcp = np.zeros(len(seeds), np.int32)
        if len(seeds) > 1:
            seed_lcp[1:] = common_prefix(text, seeds[1:], seeds[:-1], limit)
    # the end of the string sends in the last suffix before all others
    end = (np.array([int(text[n - 1]) << 40], np.uint64), np.array([n - 1]), np.zeros(1, np.int32))
    start = tuple(np.concatenate(pair) for pair in zip(end, _entries(text[seeds], seeds, seed_lcp)))
    at, lcp = _drain(text, types, start, True, False, limit, symbols)
    large = ~types[at]
    descending = at[large][::-1]
    back = None
    if limit:
        # common prefix of each L suffix with the one after it, as the queue now runs backwards
        own = np.minimum(lcp, limit)
        places = np.flatnonzero(large)
        ahead = np.zeros(len(places), np.int32)
        if len(places) > 1:
            run = np.diff(places) == 1
            ahead[:-1][run] = own[places[1:][run]]
        back = ahead[::-1]
    start = _entries(symbols - 1 - text[descending].astype(np.int64), descending, back)
    at, lcp = _drain(text, types, start, False, True, limit, symbols)
    order = at[::-1]
    if not limit:
        return order, None
    out = np.zeros(n, np.int32)
    out[1:] = lcp[::-1][:-1]
    return order, out


def suffix_order(text: np.ndarray, symbols: int, limit: int | None = None):
    """(suffix array, common prefix with the suffix before, up to ``limit``) of symbols 0..symbols-1."""
    n = len(text)
    if n <= 1:
        return np.arange(n), np.zeros(n, np.int32)
    if symbols > MOST_SYMBOLS or n >= 1 << 38:
        raise ValueError(f"too many symbols for one shard: {symbols}")
    text = np.ascontiguousarray(text, np.uint16 if symbols <= 1 << 16 else np.int64)
    types = small_types(text)
    seeds = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    if len(seeds) > 1:
        rough, _ = induce(text, types, seeds, symbols)
        is_seed = np.zeros(n, bool)
        is_seed[seeds] = True
        rough = rough[is_seed[rough]]
        names = _names(text, seeds, rough)
        reduced = np.empty(n, np.int64)
        reduced[rough] = names
        reduced = reduced[seeds]
        count = int(names[-1]) + 1
        seeds = seeds[suffix_order(reduced, count)[0]] if count < len(seeds) else rough
    return induce(text, types, seeds, symbols, limit)


def _names(text: np.ndarray, seeds: np.ndarray, rough: np.ndarray) -> np.ndarray:
    """Rank of each seed's substring (up to the next seed, included), along ``rough``."""
    n = len(text)
    size = np.empty(n, np.int64)
    size[seeds] = np.append(np.diff(seeds) + 1, n + 1 - seeds[-1])
    a, b = rough[1:], rough[:-1]
    equal = size[a] == size[b]
    which = np.flatnonzero(equal)
    k = 0
    while len(which):
        x, y = a[which] + k, b[which] + k
        done = k >= size[a[which]]
        over = (x >= n) | (y >= n)
        same = np.zeros(len(which), bool)
        same[~over] = text[x[~over]] == text[y[~over]]
        equal[which[~done & ~same]] = False
        which = which[~done & same]
        k += 1
    return np.concatenate([[0], np.cumsum(~equal)])
