"""Words of many texts at once, as numpy arrays of hashes."""

from __future__ import annotations

import numpy as np

#: Letters, digits and all bytes of multi-byte characters belong to words.
IN_WORD = np.zeros(256, bool)
IN_WORD[128:] = True
for _first, _last in (b"09", b"AZ", b"az"):
    IN_WORD[_first : _last + 1] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONGEST = 64


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE, np.uint64))


_POWERS = _powers(_LONGEST)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str | None], prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the offset of each text's first word.

    With ``prefix``, of the first so many bytes of each word.
    """
    joined = "\0".join(t.lower() if t else "" for t in texts).encode("utf-8", "surrogatepass") + b"\0"
    data = np.frombuffer(joined, np.uint8)
    return hashed(data, len(texts), prefix)


def hashed(data: np.ndarray, texts: int, prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for the bytes of lower-cased texts, each followed by a zero byte."""
    inside = IN_WORD[data]
    step = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    rows = np.cumsum(data == 0)
    first = np.searchsorted(rows[starts], np.arange(texts + 1), side="left") if len(starts) else np.zeros(texts + 1, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = ends - starts
    letters = np.flatnonzero(inside)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    powers = _POWERS if place.max() < _LONGEST else _powers(int(place.max()) + 1)
    parts = (data[letters].astype(np.uint64) + np.uint64(1)) * powers[place]
    if prefix:
        parts[place >= prefix] = 0
    return mixed(np.add.reduceat(parts, begin)), first
