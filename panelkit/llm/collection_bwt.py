"""Burrows-Wheeler transform and common prefixes of a string collection, built column by column.

Round j inserts one suffix per string, the one of length j, into the sorted order of all shorter ones: its
place is the LF image of the place of its own tail, so nothing is compared.  The transform (the byte before
every suffix) is kept in an external file, read once and written once a round, in order.  The order is cut into
leaves with a count of every symbol; an LF image is a sum of counts and a count within one leaf, so a round
touches only the new suffixes, besides copying the transform.  Common prefixes are read off the final order,
neighbour against neighbour, eight bytes at a time.

``END`` stands before a whole string and sorts after all bytes (UTF-8 never uses 255); ends of different
strings are different symbols, so no common prefix runs past an end.
"""

from __future__ import annotations

import os
import tempfile
from functools import cache

import numpy as np

END = 255
_LONG, _BLOCK = 512, 256  # a leaf has _BLOCK places when made; all are made anew when one has more than _LONG
_GROUP = 8  # leaves


class _File:
    """The order's column in an external file; every round reads a generation and writes the next over it, which
    is never shorter."""

    def __init__(self, folder: str, name: str):
        self.path = os.path.join(folder, name)
        open(self.path, "wb").close()

    def read(self) -> np.ndarray:
        return np.fromfile(self.path, np.uint8)

    def write(self, values: np.ndarray) -> None:
        with open(self.path, "r+b") as f:
            values.tofile(f)


@cache
def _first_bits(width: int) -> np.ndarray:
    """Row k: words with their first k of ``width`` bits set."""
    return np.packbits(np.tri(width + 1, width, -1, np.uint8), axis=1, bitorder="little").view("<u8")


class _Leaves:
    """Counts of the symbols (0 to ``symbols`` - 1) in every leaf of the order."""

    def __init__(self, column: np.ndarray, symbols: int):
        self.symbols = symbols
        self._make(column)

    def _make(self, column: np.ndarray) -> None:
        n = -(-len(column) // _BLOCK)
        self.size = np.full(n, _BLOCK)
        self.size[-1] = len(column) - _BLOCK * (n - 1)
        self.counts = np.zeros((-(-n // _GROUP) * _GROUP, self.symbols), np.int32)
        step = max(1, (1 << 20) // _BLOCK)  # leaves at a time
        for i in range(0, n, step):
            part = column[i * _BLOCK:(i + step) * _BLOCK]
            k = -(-len(part) // _BLOCK)
            at = part + np.repeat(np.arange(k) * self.symbols, self.size[i:i + k])
            self.counts[i:i + k] = np.bincount(at, minlength=k * self.symbols).reshape(k, -1)
        self.groups = self.counts.reshape(-1, _GROUP, self.symbols).sum(axis=1)
        self._ends()

    def _ends(self) -> None:
        self.start = np.cumsum(self.size) - self.size
        self.before = np.cumsum(self.groups, axis=0)  # counts before each group of leaves
        total = self.before[-1]
        self.first = np.cumsum(total) - total  # place of the first suffix that starts with each symbol
        self.before -= self.groups

    def image(self, column: np.ndarray, at: np.ndarray, step: int = 1 << 14) -> np.ndarray:
        """LF images of ascending places."""
        width = -(-int(self.size.max()) // 64) * 64
        rows = np.lib.stride_tricks.sliding_window_view(np.append(column, np.zeros(width, np.uint8)), width)
        before = _first_bits(width)
        out, counts = np.empty(len(at), np.int64), self.counts.reshape(-1)
        for i in range(0, len(at), step):
            p = at[i:i + step]
            leaf = np.searchsorted(self.start, p, side="right") - 1
            symbol, begin = column[p], self.start[leaf]
            same = np.packbits(rows[begin] == symbol[:, None], axis=1, bitorder="little").view("<u8")
            same &= before[p - begin]
            inside = np.zeros(len(p), np.int64)
            for word in range(width // 64):
                inside += np.bitwise_count(same[:, word])
            group = leaf // _GROUP
            cell, back = leaf * self.symbols + symbol, leaf - group * _GROUP
            for k in range(1, _GROUP):  # leaves of the group that stand before
                inside += counts[cell - k * self.symbols] * (back >= k)
            out[i:i + step] = self.first[symbol] + self.before[group, symbol] + inside
        return out

    def insert(self, column: np.ndarray, places: np.ndarray) -> None:
        """``column`` now has new symbols at the ascending ``places``."""
        leaf = np.searchsorted(self.start, places - np.arange(len(places)), side="right") - 1
        self.size += np.bincount(leaf, minlength=len(self.size))
        if self.size.max() > _LONG:
            self._make(column)
            return
        symbol = column[places]
        np.add.at(self.counts.reshape(-1), leaf * self.symbols + symbol, np.int32(1))
        np.add.at(self.groups.reshape(-1), leaf // _GROUP * self.symbols + symbol, 1)
        self._ends()


def _common_prefixes(flat: np.ndarray, start: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
    """Of each suffix (its first byte in ``flat``, its length) with the one before it; 0 unless both have ``least`` bytes."""
    padded = np.append(flat, np.zeros(16, np.uint8))
    words = np.ndarray(len(flat) + 8, np.dtype("<u8"), padded, strides=(1,))  # the eight bytes from every byte on
    out = np.zeros(len(start), np.uint8)
    limit = np.minimum(length[1:], length[:-1])
    going, k = np.flatnonzero(limit >= max(least, 1)) + 1, 0
    while len(going):
        x = words[start[going - 1] + k] ^ words[start[going] + k]
        equal = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3  # 8 where x is 0
        k += 8
        most = limit[going - 1]
        out[going] = np.minimum(k - 8 + equal.astype(np.int32), most)
        going = going[(x == 0) & (most > k)]
    return out


def build(strings: list[bytes], folder: str, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ranks, lengths, prefixes)``: ``ranks[j, i]`` is the place of string i's suffix of length j in the
    final order (-1: no such suffix), ``prefixes[r]`` the common prefix of the suffixes at r - 1 and r
    (0 unless both have ``least`` bytes)."""
    m = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, m)
    longest = int(lengths.max()) if m else 0
    flat = np.frombuffer(b"".join(strings), np.uint8)
    used = np.flatnonzero(np.bincount(flat, minlength=END + 1)[:END])
    end = len(used)  # symbols are numbered in order, the end after all bytes
    number = np.zeros(END + 1, np.uint8)
    number[used] = np.arange(end)
    columns = np.full((longest + 2, m), end, np.uint8)  # columns[j]: the symbol j from the end
    string = np.repeat(np.arange(m), lengths)
    ends = np.cumsum(lengths)
    columns[np.repeat(ends, lengths) - 1 - np.arange(len(flat)), string] = number[flat]

    file = _File(folder, "bwt")
    file.write(columns[0])
    leaves = _Leaves(columns[0], end + 1)
    at, live = np.arange(m), np.arange(m)  # places of the last suffixes, ascending, and their strings
    for j in range(longest):
        bwt = file.read()
        symbol = bwt[at]
        going = np.argsort(symbol, kind="stable")[:np.count_nonzero(symbol != end)]  # the images then ascend, too
        live, at = live[going], leaves.image(bwt, at)[going]
        old = np.ones(len(bwt) + len(at), bool)
        old[at] = False
        following = np.empty(len(old), np.uint8)
        following[old] = bwt
        following[at] = columns[j + 1, live]
        file.write(following)
        leaves.insert(following, at)

    bwt = file.read()
    by_symbol = np.argsort(bwt, kind="stable").astype(np.int32)
    image = np.empty(len(bwt), np.int32)
    image[by_symbol] = np.arange(len(bwt), dtype=np.int32)
    ranks = np.full((longest + 1, m), -1, np.int32)
    start, length = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.uint8)
    live = np.arange(m)
    ranks[0] = len(bwt) - m + live
    start[ranks[0]], length[ranks[0]] = ends, 0
    for j in range(longest):  # walk every string through the final order
        live = live[columns[j, live] != end]
        here = image[ranks[j, live]]
        ranks[j + 1, live] = here
        start[here], length[here] = ends[live] - j - 1, j + 1
    return ranks, lengths, _common_prefixes(flat, start, length, least)


def first_owner(strings: list[bytes], owners: np.ndarray, depth: int) -> list[np.ndarray]:
    """For every string, for each of its windows of ``depth`` bytes in order: the smallest owner of a string
    that holds an equal window."""
    if not strings:
        return []
    with tempfile.TemporaryDirectory() as folder:  # scratch of this task only, gone with it
        ranks, lengths, prefixes = build(strings, folder, depth)
    group = np.cumsum(prefixes < depth) - 1
    tall = ranks[depth:]  # suffixes that start a window
    length, string = np.nonzero(tall >= 0)
    of = group[tall[length, string]]
    least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of, owners[string])
    size = np.maximum(lengths - depth + 1, 0)
    ends = np.cumsum(size)
    flat = np.empty(int(size.sum()), np.int64)
    flat[ends[string] - 1 - length] = least[of]
    return [flat[a:b] for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)]
