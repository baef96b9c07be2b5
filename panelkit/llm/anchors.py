"""Content-defined segments of byte arrays.

Every window of ``WINDOW`` bytes has an anchor: the position of its smallest ``GRAM``-byte gram by hash (the
leftmost on ties).  Equal windows have their anchor at the same offset, so they share its hash.  Neighbouring
windows mostly share their anchor; a segment is the text under a maximal run of windows with one anchor.
Whatever compares windows can therefore be dealt by anchor hash, one segment at a time.
"""

from __future__ import annotations

from functools import cache

import numpy as np

WINDOW, GRAM = 50, 24
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers have inverses modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SLICE = 1 << 15  # its arrays stay in a core's cache
_AT = np.uint64((1 << 22) - 1)  # low bits that hold the position


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """64-bit hash of every gram of ``size`` bytes of a byte array (at most a slice long)."""
    up, down = _powers(_SLICE + WINDOW)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    h = total[size:] - total[:-size]
    h *= down[:len(h)]
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    return h ^ (h >> np.uint64(31))


def _slice_segments(data: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    h = gram_hashes(data)
    place = np.arange(len(h), dtype=np.uint64)
    low = (h & ~_AT) | place
    width, have = WINDOW - GRAM + 1, 1
    while have < width:  # smallest of 2, 4, 8, 16 ... then of ``width`` neighbours
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    anchor = (low & _AT).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    start = np.concatenate([[0], cut])
    stop = np.concatenate([cut, [len(anchor)]])  # of window starts
    return start + first, stop - start, h[anchor[start]]


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of documents laid end to end (``ends``: their ends): first byte, number of windows, anchor
    hash, document number.  A segment is ``windows + WINDOW - 1`` bytes; none crosses a document's end."""
    found = []
    for i in range(0, max(len(data) - WINDOW + 1, 0), _SLICE):
        part = data[i:i + _SLICE + WINDOW - 1]
        if len(part) >= WINDOW:
            found.append(_slice_segments(part, i))
    if not found:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    start, n, h = (np.concatenate(x) for x in zip(*found, strict=True))
    # Windows that cross a document's end go: a run is cut at the last start inside its document, and goes on
    # with the next document's first window.
    stop, pieces = start + n, []
    doc = np.searchsorted(ends, start, side="right")
    while len(start):
        pieces.append((start, np.minimum(stop, ends[doc] - WINDOW + 1) - start, h, doc))
        over = np.flatnonzero(stop > ends[doc])  # runs that reach into the next document
        start, stop, h, doc = ends[doc[over]], stop[over], h[over], doc[over] + 1
    start, n, h, doc = (np.concatenate([p[k] for p in pieces]) for k in range(4))
    keep = n > 0
    order = np.argsort(start[keep], kind="stable")
    return tuple(x[keep][order] for x in (start, n, h, doc))
