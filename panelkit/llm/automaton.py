"""Regexes to one deterministic byte automaton: Thompson construction, subset construction over byte
classes, minimisation by partition refinement, transitions in one flat array.

Supported syntax: literals, classes, ``. | ? * + {m,n}``, groups and ``(?i:...)`` — what Python's own regex
parser reports for it; anything else (anchors, look-around, back references) is refused.
"""

from __future__ import annotations

import re
from collections import deque
from re import _constants as C
from re import _parser as sre  # the standard library's parser: only the syntax tree is used


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.arcs: list[tuple[int, int] | None] = []  # (mask of 256 bits, target)

    def state(self) -> int:
        self.eps.append([])
        self.arcs.append(None)
        return len(self.eps) - 1

    def byte_arc(self, mask: int) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.arcs[a] = (mask, b)
        return a, b


def _class_mask(items, fold: bool) -> int:
    mask, negate = 0, False
    for op, av in items:
        if op is C.NEGATE:
            negate = True
        elif op is C.LITERAL:
            mask |= _fold(1 << av, fold)
        elif op is C.RANGE:
            mask |= _fold(((1 << (av[1] + 1)) - 1) & ~((1 << av[0]) - 1), fold)
        else:
            raise ValueError(f"class item {op} is not supported")
    return ((1 << 256) - 1) & ~mask if negate else mask


def _fold(mask: int, fold: bool) -> int:
    if fold:
        for c in range(65, 91):
            if mask >> c & 1 or mask >> (c + 32) & 1:
                mask |= 1 << c | 1 << (c + 32)
    return mask


def _build(nfa: _Nfa, tree, fold: bool, backwards: bool) -> tuple[int, int]:
    first = last = nfa.state()
    for op, av in reversed(list(tree)) if backwards else tree:
        if op is C.LITERAL:
            a, b = nfa.byte_arc(_fold(1 << av, fold))
        elif op is C.NOT_LITERAL:
            a, b = nfa.byte_arc(((1 << 256) - 1) & ~_fold(1 << av, fold))
        elif op is C.ANY:
            a, b = nfa.byte_arc(((1 << 256) - 1) & ~(1 << 10))
        elif op is C.IN:
            a, b = nfa.byte_arc(_class_mask(av, fold))
        elif op is C.SUBPATTERN:
            a, b = _build(nfa, av[3], fold or bool(av[1] & re.I), backwards)
        elif op is C.BRANCH:
            a, b = nfa.state(), nfa.state()
            for part in av[1]:
                x, y = _build(nfa, part, fold, backwards)
                nfa.eps[a].append(x)
                nfa.eps[y].append(b)
        elif op is C.MAX_REPEAT:
            low, high, part = av
            a = b = nfa.state()
            for _ in range(low):
                x, y = _build(nfa, part, fold, backwards)
                nfa.eps[b].append(x)
                b = y
            if high is C.MAXREPEAT:
                x, y = _build(nfa, part, fold, backwards)
                end = nfa.state()
                nfa.eps[b] += [x, end]
                nfa.eps[y] += [x, end]
                b = end
            else:
                end = nfa.state()
                nfa.eps[b].append(end)
                for _ in range(high - low):
                    x, y = _build(nfa, part, fold, backwards)
                    nfa.eps[b].append(x)
                    nfa.eps[y].append(end)
                    b = y
                b = end
        else:
            raise ValueError(f"{op} is not supported")
        nfa.eps[last].append(a)
        last = b
    return first, last


class Dfa:
    """``table[state + byte class]`` is the next state (states count in rows of the table); ``accepts``
    maps accepting states to the bit mask of their patterns.  Accepting states have the highest numbers:
    every state from ``floor`` on accepts.  ``dead`` is the state without a way out (-1: none)."""

    def __init__(self, patterns: list[bytes], anywhere: bool, backwards: bool = False):
        nfa = _Nfa()
        root, ends = nfa.state(), {}
        for k, p in enumerate(patterns):
            a, b = _build(nfa, sre.parse(p), False, backwards)
            nfa.eps[root].append(a)
            ends[b] = 1 << k
        masks = {arc[0] for arc in nfa.arcs if arc}
        kinds: dict[tuple, int] = {}
        self.classes = bytes(kinds.setdefault(tuple(m >> c & 1 for m in masks), len(kinds)) for c in range(256))
        sample = [self.classes.index(k) for k in range(len(kinds))]  # one byte of each class

        def closed(states) -> frozenset:
            seen, todo = set(states), list(states)
            while todo:
                for t in nfa.eps[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(seen)

        # Subset construction.
        start = closed([root])
        number, rows, todo = {start: 0}, [], deque([start])
        while todo:
            at = todo.popleft()
            arcs = [nfa.arcs[s] for s in at if nfa.arcs[s]]
            row = []
            for c in sample:
                to = closed([t for m, t in arcs if m >> c & 1] + [root] * anywhere)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        out = [0] * len(rows)
        for states, n in number.items():
            for s in states:
                out[n] |= ends.get(s, 0)

        # Minimisation: split blocks until all members of a block lead to the same blocks.
        block = {m: i for i, m in enumerate(sorted(set(out)))}
        of = [block[m] for m in out]
        while True:
            split: dict[tuple, int] = {}
            new = [split.setdefault((of[s], *(of[t] for t in rows[s])), len(split)) for s in range(len(rows))]
            same, of = len(split) == len(set(of)), new
            if same:
                break
        member: dict[int, int] = {}
        for s, b in enumerate(of):
            member.setdefault(b, s)
        order = sorted(member, key=lambda b: (out[member[b]] != 0, b != of[0], b))
        width, place = len(kinds), {b: i * len(kinds) for i, b in enumerate(order)}
        self.table = [place[of[t]] for b in order for t in rows[member[b]]]
        self.start = place[of[0]]
        self.accepts = {place[b]: out[member[b]] for b in order if out[member[b]]}
        self.floor = min(self.accepts, default=len(self.table))
        self.dead = next((place[b] for b in order if not out[member[b]] and all(of[t] == b for t in rows[member[b]])), -1)
        self.n_states, self.n_subset_states, self.width = len(order), len(rows), width

    def longest(self, data: bytes, at: int, stop: int, step: int = 1) -> int:
        """Anchored at ``at``: the farthest end of a match (going by ``step``, not past ``stop``), or -1."""
        table, classes, floor, dead = self.table, self.classes, self.floor, self.dead
        s, found, i = self.start, -1, at
        while i != stop:
            s = table[s + classes[data[i if step == 1 else i - 1]]]
            i += step
            if s >= floor:
                found = i
            elif s == dead:
                break
        return found
