"""Anchored windows of byte strings.

A window is a string of ``WIDTH`` bytes. Its anchor is the place, among the
``GRAM``-byte strings inside it, of the smallest hash (the first such place).
Equal windows have equal anchors at equal offsets, so all windows that could be
equal meet under the hash of their anchor. Neighbouring windows mostly share
their anchor; a run of windows with one anchor is a *stretch*.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 200
GRAM = 32
#: Anchor places inside a window.
PLACES = WIDTH - GRAM + 1
#: Window starts that are worked on at a time; fits in 16 bits with what lies behind.
BLOCK = (1 << 14) - 512
_U = np.uint64
_A = 0x9E3779B97F4A7C15
_A_INV = pow(_A, -1, 1 << 64)
_SYMBOL = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64) | _U(1)


def _powers(a: int, n: int) -> np.ndarray:
    out = np.full(n, a, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _POW_INV = _powers(_A, 1 << 14), _powers(_A_INV, 1 << 14)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    h = _SYMBOL[data]
    n, step = 1, 0
    while n < GRAM:
        h = h[:-n] * _U((0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[step]) + (h[n:] ^ (h[n:] >> _U(31)))
        n, step = n * 2, step + 1
    return mix(h)


def running(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any part of a block."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SYMBOL[data] * _POW[: len(data)], dtype=np.uint64)])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _POW_INV[start] + (end - start).astype(np.uint64))


def stretches(data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(first window's start, windows, anchor's place, anchor's hash, hash of the stretch), block by block.

    The hash of a stretch is that of all its bytes and of the anchor's offset.
    Every window of ``data`` is in exactly one stretch.
    """
    n, lo = len(data) - WIDTH + 1, 0
    while lo < n:
        hi = min(n, lo + BLOCK)
        part = data[lo : hi + WIDTH - 1]
        h = gram_hashes(part)
        least = (h & ~_U(0xFFFF)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= PLACES:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < PLACES:
            least = np.minimum(least[: span - PLACES], least[PLACES - span :])
        at = (least & _U(0xFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)]
        if hi < n:  # the last stretch may go on: the next block begins with it
            first, last = first[:-1], last[:-1]
        place = at[first]
        whole = span_hash(running(part), first, last + WIDTH - 1)
        whole = mix(whole + (place - first).astype(np.uint64))
        yield first + lo, last - first, place + lo, h[place], whole
        lo += int(last[-1])
