"""Sets of word shingles as sorted 63-bit hashes, worked out on the texts' UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_values = np.random.default_rng(20240607).integers(1, 2**63, 260, dtype=np.uint64)
#: A value for each byte, with A-Z as a-z; the base of the rolling hash is odd, so that it has an inverse.
LETTERS, BASE = _values[:256].copy(), int(_values[256]) | 1
LETTERS[65:91] = LETTERS[97:123]
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text worked on at once.
CHUNK = 1_000_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


_cached: list[np.ndarray] = []


def _both_powers(n: int) -> list[np.ndarray]:
    if not _cached or len(_cached[0]) < n:
        size = max(n, CHUNK + CHUNK // 4)
        _cached[:] = [_powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)]
    return _cached


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another in ``data``, and each text's first word; ends: where texts begin and end."""
    n = len(data)
    word = ~BLANK[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = ends[(ends > 0) & (ends < n)]
    begins[edges] = word[edges]
    stops = word.copy()
    stops[:-1] &= ~word[1:] if n else word[1:]
    stops[edges - 1] = word[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = _both_powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTERS[data] * power[:n], out=sums[1:])
    return mix((sums[stop] - sums[start]) * inverse[start]), np.searchsorted(start, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``words`` words, sorted; fewer words: the whole sequence; none: nothing."""
    hashes, firsts = word_hashes(data, ends)
    rolled = hashes.copy()
    for j in range(1, words):
        rolled = rolled[: max(0, len(hashes) - j)]
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j:])
    rolled >>= np.uint64(1)
    for a, b in zip(firsts.tolist(), firsts[1:].tolist()):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1]).view(np.int64)
        elif b > a:
            whole = hashes[a : a + 1]
            for h in hashes[a + 1 : b]:
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h)
            yield (mix(whole + np.uint64(b - a)) >> np.uint64(1)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to) of a string column of at most about CHUNK bytes, with their bytes and ends; null: empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield at, to, everything[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to
