"""Hashes of all words and all word windows of a text, by array operations.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. Its hash is a polynomial
in its bytes modulo 2^64, read off prefix sums and scrambled; a window's hash is a polynomial in
the scrambled word hashes. Such polynomials collide for some long words whatever the base, so
what must be right is decided by keyed hashes of another kind as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

_BYTE_BASE = 0xD1342543DE82EF95
_WORD_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t\n\v\f\r]")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for k < size; the base is odd."""
    known = _powers.get(base)
    if known is None or len(known[0]) < size:
        size = max(size, _PIECE + 1)
        steps = []
        for factor in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, factor, dtype=np.uint64)
            step[0] = 1
            steps.append(np.cumprod(step))
        known = _powers[base] = (steps[0], steps[1])
    return known


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(is_word.view(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _pieces(text: bytes) -> Iterator[tuple[int, int]]:
    """Bounds of parts of a text of about 1 MB, cut after words."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, min(at + _PIECE, len(text)))
        stop = space.start() if space else len(text)
        yield at, stop
        at = stop


def _piece_hashes(data: np.ndarray, heads: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    starts, ends = _runs((data != 32) & ((data < 9) | (data > 13)))
    power, inverse = _power_tables(_BYTE_BASE, len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=prefix[1:])
    first, back = prefix[starts], inverse[starts]
    stops = [ends, *(np.minimum(starts + n, ends) for n in heads)]
    hashes = [scramble((prefix[stop] - first) * back) for stop in stops]
    return hashes[0], starts, ends, *hashes[1:]


def word_hashes(text: bytes, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hash, start and end (in bytes) of every word, and hashes of its first ``heads`` bytes.

    Long texts are worked off in pieces.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= _PIECE:
        return _piece_hashes(data, heads)
    found = []
    for at, stop in _pieces(text):
        hashes, starts, ends, *more = _piece_hashes(data[at:stop], heads)
        found.append((hashes, starts + at, ends + at, *more))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def keyed_word_hashes(text: bytes, key: int) -> np.ndarray:
    """XXH3 of every word under a key; no polynomial, and independent of ``word_hashes``."""
    hash_of = xxhash.xxh3_64_intdigest
    parts = [
        np.fromiter((hash_of(word, key) for word in text[at:stop].split()), dtype=np.uint64)
        for at, stop in _pieces(text)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class Windows:
    """Hashes of windows of any length over one array of word hashes."""

    def __init__(self, words: np.ndarray):
        self.count = len(words)
        power, self.inverse = _power_tables(_WORD_BASE, len(words) + 1)
        self.prefix = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * power[: len(words)], out=self.prefix[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Windows that begin at ``starts``; the caller keeps them inside the array."""
        total = (self.prefix[starts + length] - self.prefix[starts]) * self.inverse[starts]
        return scramble(total + np.uint64(length))


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over values[i : i + width] for every full window, in log(width) steps."""
    out, span = values, 1
    while span < width:
        step = min(span, width - span)
        out = pick(out[:-step], out[step:]) if step else out
        span += step
    return out
