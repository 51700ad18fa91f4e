"""Bucket identifiers of the byte strings of texts, made of each other at later offsets, and the stretches that share a sampled suffix."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of a match, and of the strings of the initial buckets, a power of two.
MATCH, GRAM = 100, 32
#: A sampled suffix begins in the first SPREAD places of each match.
SPREAD = MATCH - GRAM + 1
#: Places worked on at once; a place of a piece and its margins fits PLACE bits.
PIECE, PLACE = 1 << 18, 20
_draw = np.random.default_rng(20250311)
_BYTES = _draw.integers(1, 2**63, 256, dtype=np.uint64)
_TURN, _SPREAD = (np.uint64(int(v) | 1) for v in _draw.integers(2**62, 2**63, 2, dtype=np.uint64))


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The identifiers of pairs of buckets; not symmetric."""
    z = x * _TURN
    z += y
    z ^= z >> np.uint64(29)
    z *= _SPREAD
    z ^= z >> np.uint64(32)
    return z


def initial_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the GRAM bytes from each place on: that of the first half with that of the second, half of it away."""
    buckets, width = _BYTES[data], 1
    while width < GRAM:
        buckets = joined(buckets[:-width], buckets[width:])
        width *= 2
    return buckets


def refined(buckets: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bucket of ``lengths`` bytes (MATCH to MATCH + SPREAD) from each of ``places`` on, of the initial buckets at offsets that cover them.

    Each step refines by the bucket at a later offset; past the end it is the last one again.
    """
    last = lengths - GRAM
    out = joined(buckets[places], lengths.astype(np.uint64))
    for offset in range(GRAM, MATCH + SPREAD - GRAM + 1, GRAM):
        out = joined(out, buckets[places + np.minimum(offset, last)])
    return joined(out, buckets[places + last])


def matches(buckets: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the MATCH bytes from each of ``places`` on, as numbers of 64 and 32 bits."""
    out = buckets[places]
    other = joined(out, out)
    for offset in (*range(GRAM, MATCH - GRAM + 1, GRAM), MATCH - GRAM):
        later = buckets[places + offset]
        out, other = joined(out, later), joined(later, other)
    return out, (other >> np.uint64(32)).astype(np.uint32)


@dataclass
class Stretches:
    """Runs of places (first to last) whose matches hold the same sampled suffix: its initial bucket, and that of all the run's bytes."""

    first: np.ndarray
    last: np.ndarray
    bucket: np.ndarray
    whole: np.ndarray


def _least(keys: np.ndarray) -> np.ndarray:
    """The least of the SPREAD keys from each place on."""
    width, least = 1, keys
    while 2 * width <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (SPREAD - width)], least[SPREAD - width :])


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to): runs of places in which matches begin."""
    return ((at, min(at + PIECE, len(data))) for at in range(0, len(data), PIECE) if len(data) - at >= MATCH)


def stretches(data: np.ndarray, ends: np.ndarray) -> Stretches:
    """All stretches of texts that lie one after another in ``data``; ends: where texts begin and end.

    The suffix is the one of the least initial bucket of the match, of equal ones the first. So equal matches hold the same suffix at the same place, and
    of all places only the suffixes' buckets, about 2 in SPREAD + 1, need be compared.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for at, to in pieces(data):
        begin, stop = max(at - 1, 0), min(to + SPREAD + MATCH, len(data))
        buckets = initial_buckets(data[begin:stop])
        keys = buckets >> np.uint64(PLACE) << np.uint64(PLACE)
        keys |= np.arange(len(keys), dtype=np.uint64)
        suffix = (_least(keys) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        places = np.arange(begin, begin + len(suffix))
        inside = ends[np.searchsorted(ends, places, "right")] - places >= MATCH
        suffix[~inside] = -1
        change = np.flatnonzero(suffix[1:] != suffix[:-1]) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change, [len(suffix)]]) - 1
        own = (suffix[first] >= 0) & (first + begin >= at) & (first + begin < to)
        first, last = first[own], last[own]
        found.append((first + begin, last + begin, buckets[suffix[first]], refined(buckets, first, last - first + MATCH)))
    if not found:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Stretches(*(np.concatenate(x) for x in zip(*found)))


def match_buckets(data: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, buckets of 64 and of 32 bits) of the matches of the runs first to last, which are in order."""
    sizes = last - first + 1
    places = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out, other = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint32)
    for at, to in pieces(data):
        a, b = np.searchsorted(places, [at, to])
        if a < b:
            out[a:b], other[a:b] = matches(initial_buckets(data[at : min(to + MATCH, len(data))]), places[a:b] - at)
    return places, out, other
