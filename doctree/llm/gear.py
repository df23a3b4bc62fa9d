"""Content-defined chunks: boundaries by a gear rolling hash, normalised towards a middle size."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np

from .shared import _BYTE, range_hashes

_GEAR = np.random.default_rng(77).integers(0, 1 << 16, 256, dtype=np.uint16)


@dataclass(frozen=True)
class Sizes:
    """Chunk sizes in bytes. A boundary is rarer before `normal` (strict bits) than after it (loose bits).

    `least` must be 16 or more: the hash covers 16 bytes, so no boundary depends on what stands before a text.
    """

    least: int = 16
    normal: int = 32
    most: int = 96
    strict: int = 5
    loose: int = 3


def rolled(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of gear values of the last 16 bytes, each shifted by its distance."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h[:-step] << np.uint16(step)
        h = h.copy()
        h[step:] += shifted
    return h


def chunk(data: np.ndarray, at: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of texts laid end to end, and for each text the index of its first chunk (n + 1 long)."""
    n = len(at) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    h = rolled(data)
    top = lambda bits: np.uint16((0xFFFF << (16 - bits)) & 0xFFFF)
    loose = np.flatnonzero((h & top(sizes.loose)) == 0) + 1
    strict = np.flatnonzero((h & top(sizes.strict)) == 0) + 1
    far = np.array([1 << 60])
    loose, strict = np.concatenate([loose, far]), np.concatenate([strict, far])
    # Where the chunk that starts at each possible place ends.
    places = np.union1d(loose[:-1], at[:-1])
    early = strict[np.searchsorted(strict, places + sizes.least)]
    late = np.minimum(loose[np.searchsorted(loose, places + sizes.normal)], places + sizes.most)
    after = np.where(early < places + sizes.normal, early, late)
    where = np.searchsorted(places, after)
    where[places[np.minimum(where, len(places) - 1)] != after] = -1
    first, after, where = np.searchsorted(places, at[:-1]).tolist(), after.tolist(), where.tolist()
    known: tuple[list[int], list[int], list[int]] | None = None
    ends, index = [], [0] * (n + 1)
    for d, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        i, place = first[d], low
        while place < high:
            if i >= 0:
                place = after[i]
                i = where[i]
            else:  # the last chunk was cut at its largest size, where the hash had no boundary
                if known is None:
                    known = strict.tolist(), loose.tolist(), places.tolist()
                early = known[0][bisect_left(known[0], place + sizes.least)]
                late = known[1][bisect_left(known[1], place + sizes.normal)]
                place = early if early < place + sizes.normal else min(late, place + sizes.most)
                i = bisect_left(known[2], place)
                i = i if i < len(known[2]) and known[2][i] == place else -1
            if place < high:
                ends.append(place)
        if high > low:
            ends.append(high)
        index[d + 1] = len(ends)
    return np.array(ends, np.int64), np.array(index, np.int64)


def digests(data: np.ndarray, at: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit digests) of all chunks and the index of each text's first."""
    ends, index = chunk(data, at, sizes)
    starts = np.zeros(len(ends), np.int64)
    starts[1:] = ends[:-1]
    filled = index[:-1] < index[1:]
    starts[index[:-1][filled]] = at[:-1][filled]
    return starts, ends, range_hashes(_BYTE[data], starts, ends), index
