"""Word shingles as sorted arrays of 64-bit hashes, in numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random value of each byte, and powers by the byte's place in its word.
_BYTE = np.random.default_rng(20240).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)
#: Bytes of text that are hashed together.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _power_table(length: int) -> np.ndarray:
    global _powers
    if len(_powers) < length:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * length, _MIX1)]))
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each word (white space is ASCII) of a byte string."""
    raw = np.frombuffer(data, np.uint8)
    solid = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(offsets, sizes)
    terms = _BYTE[raw[solid]] * _power_table(int(sizes.max()))[place]
    return mix(np.add.reduceat(terms, offsets) + sizes.astype(np.uint64)), starts


def _combined(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _MULTIPLIER + h[k : k + len(out)]
    return mix(out)


def _chunk_sets(parts: list[bytes], width: int) -> Iterator[np.ndarray]:
    h, starts = word_hashes(b" ".join(parts))
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))
    every = _combined(h, width) if len(h) >= width else None
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        elif b > a:
            yield _combined(h[a:b], int(b - a))
        else:
            yield np.empty(0, np.uint64)


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A-Z are lower-cased and words end at ASCII white space. A text of fewer
    words is one shingle; without words (or null) the set is empty.
    """
    parts, held = [], 0
    for text in texts:
        parts.append((text or "").encode().lower())
        held += len(parts[-1])
        if held >= CHUNK:
            yield from _chunk_sets(parts, width)
            parts, held = [], 0
    if parts:
        yield from _chunk_sets(parts, width)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """:func:`shingle_sets` of one text."""
    return next(shingle_sets([text], width))


def overlap_needed(a, b, percent: int = 80):
    """Least intersection of sets of sizes a and b whose Jaccard index is ``percent`` / 100."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = 80) -> int:
    """So many of a set's first elements hold one that any set at least so similar has among its own first ones."""
    return n - (-(-percent * n // 100)) + 1 if n else 0
